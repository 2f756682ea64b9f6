import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediasift.llm import licenses, pii, queries, secrets
from mediasift.sources.tables import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_secrets(spark):
    aws, gh = "AKIA" + "A1" * 8, "ghp_" + "aB3" * 12
    rows = [(1, f'x Secret: "{"k" * 6}" {aws} {gh}'), (2, "secret=token: abcdef"), (3, "deadbeef" * 3), (4, "api-key=short12 apikey = 'é'")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, *_ in got[1]] == ["assign", "access", "github"]
    assert got[2] == [] and got[3] == [("hex", 0, 24)] and got[4] == []


def test_licence_inheritance(spark):
    files = [("/r/LICENSE", "Released under the MIT License"), ("/r/a/b/x.py", "code"), ("/r/a/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("/r/y.py", "# Licensed under the Apache License, Version 2.0\ncode"), ("/q/z.py", "none"), ("/r/c/w.py", None)]
    got = {r["path"]: (r["own"], r["license"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["/r/a/b/x.py"] == (None, "GPL-3.0") and got["/r/c/w.py"] == (None, "MIT")
    assert got["/r/y.py"] == ("Apache-2.0", "Apache-2.0") and got["/q/z.py"] == (None, None)


@pytest.fixture(scope="session")
def stages(spark, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(root / name))
        after = spark.read.parquet(str(root / name))
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


MIT_FILE = """MIT License

Copyright (c) 2021 Some Body

""" + licenses.TEMPLATES[14][1][12:].replace(". ", ".\n\n")


def test_whole_licence_files_are_known(spark):
    gpl = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n" + "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. " * 40
    files = [("/m/LICENSE", MIT_FILE), ("/m/a/b/c.txt", "no licence here"), ("/g/COPYING", gpl), ("/g/x/y.txt", None), ("/m/a/NOTICE", "Licensed under the Apache License, Version 2.0."), ("/z.txt", "words")]
    got = {r["path"]: (r["own"], r["license"]) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["/m/LICENSE"] == ("MIT", "MIT") and got["/g/COPYING"][0] == "GPL-3.0"
    assert got["/m/a/b/c.txt"] == (None, "Apache-2.0") and got["/g/x/y.txt"] == (None, "GPL-3.0") and got["/z.txt"] == (None, None)


def test_units_without_a_cue_are_near_no_template(spark):
    """Every unit of every text against all templates: what comes near one has a cue."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    units = docs.select("doc_id", F.posexplode(F.split("text", licenses.UNIT_END)).alias("n", "text"))
    units = units.select(F.struct("doc_id", "n").alias("unit"), "text")
    near = licenses.cosines(units).where(F.col("cosine") >= licenses.LEAST).select("unit").distinct().join(units, "unit")
    assert near.where(F.col("text").rlike(licenses.CUE)).count() > 20 and near.where(~F.col("text").rlike(licenses.CUE)).count() == 0


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert before.columns == after.columns and before.count() >= after.count() > 0


def test_rejected_go(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = after.join(labels, "doc_id").groupBy("quality").count()
    got, had = ({r["quality"]: r["count"] for r in x.collect()} for x in (kept, before.join(labels, "doc_id").groupBy("quality").count()))
    assert got[1] > 0.95 * had[1] and got.get(0, 0) < 0.3 * had[0]


def test_one_of_each_group_stays(stages):
    _, after = stages["near_duplicates"]
    again = corpus_pipeline.minhash.near_duplicates(after, percent=corpus_pipeline.PERCENT)
    assert again.where("not kept").count() == 0


def test_contaminated_go_and_others_stay_as_they_are(spark, stages):
    before, after = stages["decontaminate"]
    found = corpus_pipeline.decontaminate.verdicts(corpus_pipeline.decontaminate.find(before, spark.read.parquet(f"{SF}/benchmark.parquet")))
    clean = before.join(found.where("not contaminated").select("doc_id"), "doc_id").select(*before.columns)
    assert sorted(map(str, clean.collect())) == sorted(map(str, after.collect()))


def test_all_that_is_left_is_packed(stages):
    before, after = stages["packing"]
    assert after.select("doc_id").distinct().count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_parts_of_thousands_of_zeros_are_an_address():
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.1.2.3 and 1.{zeros}9.2.3") == [("ip", 0, 5006), ("ip", 5011, 5011 + 5007)]
    assert pii.base_spans(f"{zeros}256.1.2.3") == [] and pii.base_spans("0.0.0.0") == [("ip", 0, 7)]
