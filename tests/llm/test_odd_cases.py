"""Every operator over the odd cases and over an empty table."""

import pytest
from pyspark.sql import functions as F

from mediasift.llm import decontaminate, fingerprint, langid, licenses, linededup, minhash, packing, pii, quality, secrets


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, "the of and"), (None, "stream table"), (2, None), (3, "")], "item_id long, text string")


def labelled(docs):
    return docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()


OPERATORS = {
    "langid": lambda d, items: langid.predict(d, langid.train(d)),
    "linededup": lambda d, items: linededup.dedup(d),
    "decontaminate": lambda d, items: decontaminate.verdicts(decontaminate.find(d, items)),
    "minhash": lambda d, items: minhash.near_duplicates(d),
    "secrets": lambda d, items: secrets.find(d),
    "fingerprint": lambda d, items: fingerprint.fingerprints(d),
    "edits": lambda d, items: fingerprint.edits(d),
    "pii": lambda d, items: pii.find(d),
    "quality": lambda d, items: quality.score(d, quality.train(d, labelled(d))),
    "licenses": lambda d, items: licenses.scan(d.withColumn("path", F.concat(F.lit("/r/"), F.col("doc_id").cast("string")))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay(name, odd, items):
    got = OPERATORS[name](odd, items).collect()
    assert len(got) == 12


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, odd, items):
    assert OPERATORS[name](odd.where("false"), items).count() == 0


def test_packing(odd):
    got = packing.packed(odd).collect()
    ones = [r for r in got if r["length"] == 1]
    assert {r["doc_id"] for r in ones} >= {3, 4} and len({(r["doc_id"], r["piece"]) for r in got if r["doc_id"] == 6}) > 20
    assert packing.packed(odd.where("false")).count() == 0


def test_undetermined(odd, items):
    got = {(r["doc_id"], r["lang_pred"]) for r in OPERATORS["langid"](odd, items).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "und")} <= got and (9, "und") not in got


def test_no_shingles_no_links(odd, items):
    got = {r["doc_id"]: r for r in OPERATORS["minhash"](odd, items).collect()}
    assert [got[k]["n_shingles"] for k in (3, 4, 5)] == [0, 0, 0] and all(got[k]["kept"] for k in (3, 4, 5))
    assert got[2]["component_id"] == 1 and not got[2]["kept"]


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_line_dedup_values(odd, items):
    got = by_id(OPERATORS["linededup"](odd, items).collect())
    assert [list(r["removed_lines"]) for r in got[1]] == [[]] and [list(r["removed_lines"]) for r in got[2]] == [[0], [0]]  # equal to an earlier text
    assert [r["text"] for r in got[2]] == ["", ""] and [r["text"] for r in got[3]] == [None] and [r["text"] for r in got[4]] == [""]
    assert [r["text"] for r in got[5]] == [" \n\t "] and {r["text"] is None for r in got[None]} == {True, False}
    assert all(list(r["removed_lines"]) == [] for k in (3, 4, 5, 6, 7, 8, 9, None) for r in got[k])


def test_line_dedup_of_other_ids_and_columns(odd):
    text = F.concat(F.lit("x"), F.col("doc_id").cast("string"))
    named = odd.withColumn("doc_id", text).withColumn("removed_lines", F.lit("own"))
    got = linededup.dedup(named, removed="gone")
    assert got.columns == [*named.columns, "gone"] and {r["removed_lines"] for r in got.collect()} == {"own"}
    assert linededup.dedup(named).columns == [c for c in named.columns if c != "removed_lines"] + ["removed_lines"]


def test_line_dedup_sorts_where_broadcasts_end(spark, monkeypatch):
    from mediasift.operators import joins
    from mediasift.sources.tables import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    broadcast = sorted(map(repr, linededup.dedup(docs).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    assert sorted(map(repr, linededup.dedup(docs).collect())) == broadcast


def test_decontamination_values(odd, items):
    got = by_id(OPERATORS["decontaminate"](odd, items).collect())
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for k in (3, 4, 5) for r in got[k]] == [(0, 0, False)] * 3
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in got[7]] == [(1, 0, False)]
    assert got[2][0]["spans"] == got[2][1]["spans"] == got[1][0]["spans"]


def test_secret_and_personal_values(odd, items):
    for name in ("secrets", "pii"):
        got = by_id(OPERATORS[name](odd, items).collect())
        spans = "spans" if name == "secrets" else "base"
        assert not any(r[spans] for k in (3, 4, 5, 7, 9) for r in got[k]) and got[1][0][spans] == got[2][0][spans]


def test_fingerprint_values(odd, items):
    got = by_id(OPERATORS["fingerprint"](odd, items).collect())
    assert got[3][0]["fingerprint"] == got[4][0]["fingerprint"] != got[5][0]["fingerprint"]
    assert len({r["fingerprint"] for k in (1, 2) for r in got[k]}) == 1
    assert len(got[6][0]["fingerprint"].split(",")) > fingerprint.ANCHORS  # a long text has more anchors


def test_quality_values(odd, items):
    got = by_id(OPERATORS["quality"](odd, items).collect())
    assert all(0 <= r["score"] <= 1 for rows in got.values() for r in rows)
    assert len({r["score"] for k in (1, 2) for r in got[k]}) == 1 and got[3][0]["score"] == got[4][0]["score"]


def test_licence_values(odd, items):
    got = OPERATORS["licenses"](odd, items).collect()
    assert {r["license"] for r in got} == {None} and sum(r["path"] is None for r in got) == 2


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages(spark, odd, number):
    """Every stage on every odd case, on an empty table, and beside columns of the names that it uses itself."""
    import corpus_pipeline

    docs = odd.withColumn("n_chars", F.length("text").cast("long")).withColumn("removed_lines", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("score", F.lit(0.5))
    name, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, docs, "/root/testdata/sf0.001")
    rows, none = got.collect(), stage(spark, docs.where("false"), "/root/testdata/sf0.001").collect()
    assert none == []
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
        return
    assert got.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    whole = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
    if name == "line_dedup":
        assert [x for x in whole if x != (False, 2)] == ids and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    elif name == "near_duplicates":
        assert [x for x in whole if x != (False, 2)] == ids
    elif name == "decontaminate":
        assert ids == whole
    else:
        assert set(ids) <= set(whole)
