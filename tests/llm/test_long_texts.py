"""Texts of any length are read by one rule, and documents that very many pairs ask for are shared out."""

import numpy as np
import pytest

from mediasift.llm import langid, minhash, quality
from mediasift.llm.textbytes import parts


@pytest.mark.parametrize("size", [5000, 5599, 5600, 5601, 12345])
def test_passages_do_not_depend_on_blocks(monkeypatch, size):
    data = np.frombuffer(np.random.default_rng(size).integers(32, 127, size).astype(np.uint8).tobytes(), np.uint8)
    offsets = np.array([0, size])
    whole, first = quality.passages(data, offsets)
    for block in (800, 1700, 2400, 4000):
        monkeypatch.setattr(quality, "BLOCK", block)
        x, f = quality.passages(data, offsets)
        assert np.array_equal(x, whole) and np.array_equal(f, first)


def test_training_takes_evenly_spread_passages_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(quality, "PASSAGES_PER_ROW", 5)
    rows = [(k, ("good words, in order. " if k % 2 else "@@## $$ %% 00 ") * (3 + k * 20)) for k in range(40)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] * 3, "doc_id long, quality int")  # labels that repeat count once
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in quality.score(docs, model).collect()}
    assert all(got[k] == k % 2 for k in range(30, 40))


def test_no_ngram_is_lost_between_parts():
    rng = np.random.default_rng(4)
    logits = rng.normal(size=((1 << langid.BUCKET_BITS) + 2, 3)).astype(np.float32)
    for letters in (b"abcdefgh", b"abcdefgh ", "abcäöß ".encode()):
        text = b"".join(bytes([letters[i]]) for i in rng.integers(0, len(letters), 20000)) if len(letters) < 10 and letters.isascii() else ("äöüß" * 3000 + " straße").encode()
        data = np.frombuffer(text, np.uint8)
        total, count = langid._sums(data, np.array([0, len(data)]), logits)
        found = [langid._sums_of_part(data, a, b, logits) for a, b in parts(data, 700)]
        assert len(found) > 10 and sum(c for _, c in found) == count[0]
        assert np.allclose(sum(s for s, _ in found), total[0], rtol=1e-3, atol=0.5)


def test_hot_pivots_and_hot_partners(spark, monkeypatch):
    """A cluster of distinct near copies hangs on one pivot; its set is met in many copies."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    rows = [(1, " ".join(base))]
    for k in range(2, 150):
        words = list(base)
        words[int(rng.integers(0, 300))] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(k, " ".join(f"v{i}" for i in rng.integers(0, 5000, 300))) for k in range(150, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert {want[k] for k in range(1, 150)} == {1} and all(want[k] == k for k in range(150, 200))
    monkeypatch.setattr(minhash, "PAIRS_OF_A_COPY", 7)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_verified_with_copies_on_both_sides(spark, monkeypatch):
    sets = [(k, np.arange(k % 7, 100 + k % 7, dtype=np.uint64).tobytes()) for k in range(40)]
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    s, p = spark.createDataFrame(sets, "id long, h binary"), spark.createDataFrame(pairs, "a long, b long")
    want = {(a, b) for a, b in pairs if 100 * (100 - abs(a % 7 - b % 7)) >= 95 * (100 + abs(a % 7 - b % 7))}
    for most in (1000, 3):
        monkeypatch.setattr(minhash, "PAIRS_OF_A_COPY", most)
        assert {tuple(r) for r in minhash._verified(p, s, 95, "bigint").collect()} == want
