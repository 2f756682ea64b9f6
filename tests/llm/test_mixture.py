import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mediasift.llm import mixture as M


def cuts(schedule, sizes, seed=0):
    """Places of all tokens of all queues, asked for in stretches of odd length."""
    rng, out = random.Random(seed), {}
    for k, n in enumerate(sizes):
        at = 0
        while at < n:
            end = min(n, at + rng.choice([1, 7, 300, 5000]))
            ahead = at
            for a, b, place in schedule.places(k, at, end):
                assert a == ahead < b
                for x in range(a, b):
                    out[place + x - a] = k
                ahead = b
            assert ahead == end
            at = end
    return out


@pytest.mark.parametrize("seed", range(25))
def test_queues_fill_the_stream_without_gaps(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 50, 700, 4000]) * rng.randint(1, 3) for _ in range(rng.randint(1, 6))]
    weights = sizes if seed % 3 == 0 and all(sizes) else [rng.randint(5, 60) for _ in sizes]
    window = rng.choice([64, 1000])
    if weights is sizes and window * min(sizes) < 2 * sum(sizes):
        weights = [1] * len(sizes)
    got = cuts(M.Schedule(sizes, weights, window), sizes, seed)
    assert sorted(got) == list(range(sum(sizes))) and Counter(got.values()) == Counter({k: n for k, n in enumerate(sizes) if n})


def test_windows_hold_the_shares_and_carry_what_is_left():
    sizes, weights, window = [5000, 3000, 2003], [5, 3, 2], 97
    got = cuts(M.Schedule(sizes, weights, window), sizes)
    whole = 0
    for w in range(sum(sizes) // window):
        counts = Counter(got[x] for x in range(w * window, (w + 1) * window))
        whole += 1
        total = Counter(got[x] for x in range((w + 1) * window))
        for k in range(3):
            assert abs(counts[k] - window * weights[k] / 10) < 2
            assert abs(total[k] - whole * window * weights[k] / 10) <= 1  # nothing is lost from window to window
        if w == 95:
            break


def test_a_dry_queue_leaves_its_share_to_the_others():
    sizes, window = [100, 4000, 4000], 100
    got = cuts(M.Schedule(sizes, [50, 25, 25], window), sizes)
    first = Counter(got[x] for x in range(window))
    later = Counter(got[x] for x in range(10 * window, 11 * window))
    assert first == {0: 50, 1: 25, 2: 25} and later == {1: 50, 2: 50}


def check(rows, docs):
    """Every id in one piece, sequences without gaps and full but for the last."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    whole = {k: [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts] for k, texts in docs.items()}
    fills, spans = {}, {}
    for r in rows:
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        spans.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in whole[r["doc_id"]])
    for places in fills.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= M.CAPACITY
    for (_, n), pieces in spans.items():
        want[n] += 1
        assert sum(length for _, length in pieces) % n == 0
    total = sum(len(x) for texts in whole.values() for x in texts)
    assert sum(r["length"] for r in rows) == total and len(fills) == -(-total // M.CAPACITY)
    return fills


@pytest.mark.parametrize("few", [True, False])
def test_documents_are_packed_whole(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(M, "BROADCAST_STRETCHES", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7)
    docs = docs.withColumn("source", F.when(F.col("source") != "src1", F.col("source")))
    rows = M.packed(docs.withColumns({"of": F.lit(1), "part": F.lit("x"), "queue": F.lit(None)})).collect()
    check(rows, {r["doc_id"]: [r["text"]] for r in docs.collect()})


def test_windows_of_documents_hold_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    of = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = M.packed(docs, {"src0": 0.25, "src5": 0.125}).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"] // M.WINDOW_SEQUENCES, Counter())[of[r["doc_id"]]] += r["length"]
    size = M.WINDOW_SEQUENCES * M.CAPACITY
    assert windows[0]["src0"] == size / 4 and windows[0]["src5"] == size / 8 and sum(windows[0].values()) == size
    with pytest.raises(ValueError, match="shares"):
        M.packed(docs, {"src0": 0.7, "src5": 0.5})


def test_natural_shares_last_to_the_end(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    of = {r["doc_id"]: r["source"] for r in docs.collect()}
    total, windows = Counter(), {}
    for r in M.packed(docs).collect():
        total[of[r["doc_id"]]] += r["length"]
        windows.setdefault(r["sequence_id"] // M.WINDOW_SEQUENCES, Counter())[of[r["doc_id"]]] += r["length"]
    for w in list(windows.values())[: len(windows)]:
        n = sum(w.values())
        assert all(abs(w[s] - n * t / sum(total.values())) < 2 for s, t in total.items())


def test_many_small_sources_share_a_queue(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"))
    rows = M.packed(docs.repartition(6)).collect()
    check(rows, {r["doc_id"]: [r["text"]] for r in docs.collect()})


def test_odd_documents(odd):
    rows = M.packed(odd).collect()
    docs = {}
    for r in odd.collect():
        docs.setdefault(r["doc_id"], []).append(r["text"])
    check(rows, docs)
    assert {(r["doc_id"], r["length"]) for r in rows if r["doc_tokens"] == 1} == {(3, 1), (4, 1), (None, 1)}
    assert M.packed(odd.where("false")).count() == 0
