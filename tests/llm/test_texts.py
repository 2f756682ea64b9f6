import hashlib
import re
import time
import zlib

import brute_lines
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediasift.llm import decontaminate, fingerprint, fmindex, linededup, minhash, packing, pii, trigrams
from mediasift.sources.tables import table

SF = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index_finds_all(text, phrase):
    index = fmindex.FMIndex(np.array(text))
    lo, hi = index.search(np.array([phrase]))
    want = [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_contamination_by_windows(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "Intro " + passage.upper() + " end"), (2, " ".join(f"w{k}" for k in range(12))), (3, "x-short-y"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, "short")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.verdicts(decontaminate.find(docs, items)).collect()}
    assert (got[1]["n_hit"], got[1]["items"], got[1]["contaminated"]) == (30, ["7"], True)
    assert got[2]["n_hit"] == 0 and got[3]["items"] == ["8"] and got[4]["n_words"] == 0


def test_items_in_blocks(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    rows = lambda: sorted(map(str, decontaminate.find(docs, items).collect()))
    one = rows()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS_BYTES", 2000)
    assert rows() == one


def test_spans_can_be_removed():
    text = "A b c, D e F."
    assert decontaminate.without_spans(text, [(1, 4)]) == "A  e F."


def test_chunks_are_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("th", F.lit(0).cast("long"))
    runs = linededup.runs_of(linededup.repeated_lines(docs))
    got = {(r["id"], r["c"]["first"], r["c"]["size"]) for r in runs.select("id", F.explode(linededup.chunks_of(F.col("lines"))).alias("c")).collect()}
    assert got == brute_lines.chunks(rows)
    assert sum(n for _, _, n in got) / len(got) > 2  # chunks of several lines


def test_moved_passage_goes(spark):
    passage = " ".join(f"Sentence number {k} has its own words {k * 7} and {k * 13}." for k in range(12))
    rows = [(1, f"Start here.\n{passage} Then on."), (2, f"Quite another beginning. And more of it. {passage} An end\x01."), (3, "Nothing of that. Nothing at all.")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert "Sentence number 6" not in got[2] and got[2].startswith("Quite another") and got[2].endswith("An end\x01.")


def shingles(text):
    w = minhash_words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def minhash_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_groups_are_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(160):
        w = list(base) if i % 4 else [f"r{i}_{k}" for k in range(80)]
        for k in rng.integers(0, len(w), int(rng.integers(0, 5))):
            w[k] = f"e{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_signatures_estimate():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.85):
        hits = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, 400).astype(np.uint64)
            k = int(400 * share)
            extra = rng.integers(0, 1 << 63, 400 - k).astype(np.uint64)
            a, b = np.concatenate([both[:k], both[k : k + (400 - k) // 2]]), np.concatenate([both[:k], extra[: (400 - k) // 2]])
            sig = minhash.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            hits.append((sig[0] == sig[1]).mean() - k / (len(a) + len(b) - k))
        assert abs(np.mean(hits)) < 0.02


def test_syncmers_need_no_context():
    core = np.random.default_rng(4).integers(97, 122, 400).astype(np.uint8)
    got = []
    for left in (0, 37):
        data = np.concatenate([np.full(left, 65, np.uint8), core, np.full(11, 66, np.uint8)])
        h, place, _ = fingerprint.syncmers(data, np.array([0, len(data)]))
        inside = (place >= left) & (place + fingerprint.K <= left + len(core))
        got.append(list(zip(h[inside].tolist(), (place[inside] - left).tolist())))
    assert got[0] == got[1] and len(got[0]) > 20


def test_edits(spark):
    texts = {5: "abc " * 50, 3: "Grüße an alle, " * 20, 2: "", 1: "xy"}
    got = {r["doc_id"]: r for r in fingerprint.edits(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    import hashlib

    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % 4]]
        g = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - g] + after[:g]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t) and 0 <= got[i]["near_edited"] <= 1
    assert got[2]["near_edited"] == 1.0


@pytest.mark.parametrize("text", ["plain words here", "two  blanks", " lead and trail ", "line\nbreak \n x", "ümläut é ª² ½", "漢字 mixed “quoted” text…", "tab\tbed", "a<|endoftext|>b", "3.14 isn't 1,000", "nbsp\xa0here soft\xadhyphen", "€5 naïve œuvre"])
def test_packed_ids_are_the_tokenizers(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    ids = np.frombuffer(packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))(text), "<u4").tolist()
    assert ids == Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=120))
def test_bins_hold_all(lengths):
    x = np.array(lengths, int)
    first = packing.best_fit(x, 1024)
    bins = packing.improve(packing.best_fit(x, 1024), x, 1024)
    assert sorted(i for b in bins for i in b) == list(range(len(x)))
    assert all(x[b].sum() <= 1024 for b in bins) and len(bins) <= len(first)


def test_local_search_empties_bins():
    x = np.array([600, 500, 400, 300, 200, 48])
    assert len(packing.improve([[0], [1], [2], [3], [4], [5]], x, 1024)) < 6


def test_trigram_queries():
    assert trigrams.trigram_query("abc[0-9]+def") == [frozenset({"abc", "def"})]
    assert trigrams.trigram_query("[0-9a-f]{24,}") == []
    assert trigrams.trigram_query("(?:foo|ba[rz]s)x?") == sorted([frozenset({"foo"}), frozenset({"bar", "ars"}), frozenset({"baz", "azs"})], key=sorted)


def plain_fingerprint(text):
    """Closed syncmers, one k-mer after the other: {hash: first place}."""
    data, k, n = text.encode(), fingerprint.K, fingerprint.S
    mask, mix = (1 << 64) - 1, lambda x: int(fingerprint._mix(np.array([x], np.uint64))[0])
    inner = [mix(int.from_bytes(data[i : i + n], "big")) for i in range(len(data) - n + 1)]
    out = {}
    for i in range(len(data) - k + 1):
        own = inner[i : i + k - n + 1]
        if min(own) in (own[0], own[-1]):
            h = own[0]
            for j in sorted({*range(n, k - n + 1, n), k - n}):
                h = mix((h * 0x100000001B3 + inner[i + j]) & mask)
            out.setdefault(h, i)
    if not out:
        return {int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big"): 0}, mask
    low = sorted(out)
    low = low[: max(fingerprint.ANCHORS, sum(h < fingerprint.SHARE for h in low))]
    return {h: out[h] for h in low}, mask if len(low) == len(out) else low[-1]


def plain_likeness(a, b):
    bound = min(a[1], b[1])
    x, y = ({h: p for h, p in s[0].items() if h <= bound} for s in (a, b))
    shifts = sorted(y[h] - x[h] for h in x if h in y)
    near = [d for d in shifts if abs(d - shifts[len(shifts) // 2]) <= fingerprint.SLACK] if shifts else []
    return len(near) / len({*x, *y})


def test_fingerprints_are_the_plain_ones(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").where("length(text) < 4000").limit(40).select("doc_id", "text").collect()]
    rows += [(10_000, "x" * 30), (10_001, ""), (10_002, None), (10_003, "short"), (10_004, "".join(chr(97 + k * k % 23) for k in range(140_000)))]
    docs = sorted(rows, reverse=True)
    texts = [t or "" for _, t in docs]
    got = {r["doc_id"]: r for r in fingerprint.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, _) in enumerate(docs):
        text, after = texts[k], texts[(k + 1) % len(docs)]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, changed, other = (plain_fingerprint(x) for x in (text, edited, after))
        show = lambda s: ",".join(f"{h:016x}@{s[0][h]}" for h in sorted(s[0]))
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (show(own), show(changed))
        assert (got[i]["near_edited"], got[i]["near_next"]) == pytest.approx((plain_likeness(own, changed), plain_likeness(own, other)))


def test_texts_of_any_two_lengths_share_anchors():
    base = " ".join(f"word{k} of {k * k}" for k in range(40))
    a, b = fingerprint.sketches(pa.array([base[:150], base[:110]]))
    assert fingerprint.likeness(a, b) > 0.5


def test_nameless_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 2000)
    rows = [(None, f"text {k} " * 30) for k in range(60)] + [(k, f"named {k} " * 20) for k in range(60)] + [(-(1 << 63), "low")]
    got = fingerprint.edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 121
    after = {r["doc_id"]: r for r in got}
    edited = "named 9 " * 20
    edited = edited[: len(edited) - len(edited) // 3] + ("named 8 " * 20)[: len(edited) // 3]
    assert after[9]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_base_spans():
    t = "Mail a.b@c.d.e or x@y; 1.2.3.4 999.1.1.1, 4111 1111 1111 1111, +1 (017) 555-7713. a@@b.c q@r.s"
    got = {(k, t[a:b]) for k, a, b in pii.base_spans(t)}
    assert got == {("email", "a.b@c.d.e"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (017) 555-7713"), ("email", "q@r.s")}


@settings(max_examples=200, deadline=None)
@given(st.text("a@.-_ ", max_size=24))
def test_emails_as_the_expression(text):
    assert list(pii._emails(text)) == [m.span() for m in pii.EMAIL.finditer(text)]


@settings(max_examples=200, deadline=None)
@given(st.text("019. a", max_size=40))
def test_ips_as_the_expression(text):
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in plain.finditer(text)]


def test_long_digits_take_linear_time():
    began = time.process_time()
    assert pii.base_spans("7" * 2_000_000 + " 1.2.3.4 " + "1." * 300_000)[0] == ("ip", 2_000_001, 2_000_008)
    assert time.process_time() - began < 20


def test_base_spans_of_the_table_are_the_plain_expressions(spark):
    """All four kinds, by the expressions as they are stated, over whole texts."""
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    rows = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    want = {r["doc_id"]: [f"{k}:{m.start()}:{m.end()}" for k, (x, fits) in plain.items() for m in re.finditer(x, r["text"] or "") if fits(m[0])] for r in rows}
    got = pii.find(spark.createDataFrame(rows)).collect()
    assert {r["doc_id"]: r["base"] for r in got} == want and sum(map(len, want.values())) > 50


def test_added_kinds_are_found_and_others_left(spark):
    """Planted spans of the added kinds and look-alikes; precision and recall of 0.9 at least."""
    rng = np.random.default_rng(3)
    n = lambda k: "".join(map(str, rng.integers(1, 10, k)))
    real = [lambda: ("tel", f"Please call (0{n(2)}) {n(3)}-{n(4)}", f"(0"), lambda: ("ssn", f"her ssn is {n(3)}-{n(2)}-{n(4)}", None), lambda: ("person", f"My name is Anna {rng.choice(['Keller', 'Novak', 'Smith'])}", None), lambda: ("birth", f"born {n(1)}.{n(1)}.19{n(2)} in town", None)]
    fake = [lambda: f"see figure {n(3)}-{n(2)}-{n(4)} of section {n(1)}", lambda: f"order {n(3)} {n(3)} {n(3)} of invoice {n(5)}", lambda: f"build 20{n(2)}-0{n(1)}-1{n(1)} of version {n(1)}", lambda: "The Quick Brown fox of page 3"]
    rows, planted = [], {}
    for k in range(400):
        if k % 2:
            planted[k], text, _ = real[k // 2 % len(real)]()
        else:
            text = fake[k // 2 % len(fake)]()
        rows.append((k, f"Some words before. {text} and some after."))
    got = {r["doc_id"]: [s.split(":")[0] for s in r["added"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(planted[k] in got[k] for k in planted)
    wrong = sum(len(got[k]) for k in got if k not in planted)
    assert hit / len(planted) >= 0.9 and hit / max(1, hit + wrong) >= 0.9, (hit, wrong, len(planted))


def test_unreliable_labelers_are_found():
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = tuple(int(v) for v in (1 if rng.random() < (0.9 if y else 0.1) else -1, 1 if rng.random() < (0.85 if y else 0.2) else -1, 1 if rng.random() < 0.5 else -1, 1 if rng.random() < (0.8 if y else 0.25) else -1))  # two informative labelers would not be enough to tell
        counts[votes] = counts.get(votes, 0) + 1
    likely, chance, share = pii.reliabilities(counts)
    assert chance[0, 1, 2] > 0.8 and abs(chance[2, 1, 2] - chance[2, 0, 2]) < 0.1 and 0.3 < share < 0.5
    assert likely[(1, 1, 1, 1)] > 0.8 > 0.2 > likely[(-1, -1, -1, -1)]


def test_added_personal_data(spark):
    rows = [(k, f"Contact Mrs. Anna Schmidt, phone (030) 555-{1000 + k}, SSN 123-45-67{10 + k}") for k in range(20)] + [(k, f"see table 3 in chapter 12, version 10.{k}") for k in range(20, 60)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r["doc_id"]: r["added"] for r in got}
    assert all(any(s.startswith("tel:") for s in added[k]) for k in range(20)) and not any(added[k] for k in range(20, 60))
    assert pii.masked("call 1.2.3.4 now", ["ip:5:12"]) == "call <ip> now"


def test_every_document_can_be_rebuilt(spark):
    """All pieces of the table: ids by the whole tokenizer, cuts, checksums, and places without gaps."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows, pieces = docs.collect(), {}
    for r in packing.packed(docs).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    places: dict = {}
    for r in rows:
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[r["doc_id"]], key=lambda p: p["piece"])
        assert [p["piece"] for p in own] == list(range(len(own))) and (len(own) > 1) == (len(ids) > 1024)
        assert [p["length"] for p in own[1:]] == [1024] * (len(own) - 1)
        at = 0
        for p in own:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
            places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert at == len(ids)
    for seq in places.values():
        ends = np.cumsum([0] + [n for _, n in sorted(seq)])
        assert [o for o, _ in sorted(seq)] == ends[:-1].tolist() and ends[-1] <= 1024
    least = -(-sum(n for seq in places.values() for _, n in seq) // 1024)
    assert len(places) <= 1.01 * least


def test_search_ends_where_no_exchange_helps():
    rng = np.random.default_rng(6)
    lengths = rng.integers(300, 420, 120)
    bins = packing.improve(packing.best_fit(lengths, 1024), lengths, 1024)
    fill = [int(lengths[b].sum()) for b in bins]
    gain = lambda a, b, d: max(fill[a], fill[b]) < max(fill[a] - d, fill[b] + d) <= 1024
    for a, x in enumerate(bins):
        for b, y in enumerate(bins):
            if a == b or 1024 in (fill[a], fill[b]):
                continue
            outs = [(i,) for i in x] + [(i, j) for n, i in enumerate(x) for j in x[:n]]
            for out in outs:
                mass = int(lengths[list(out)].sum())
                assert not (len(out) == 1 and gain(a, b, mass))
                assert not any(lengths[j] > mass and fill[a] - mass + lengths[j] <= 1024 and fill[a] + lengths[j] - mass > fill[b] for j in y)
    assert sorted(i for b in bins for i in b) == list(range(120))
