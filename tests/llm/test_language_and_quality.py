import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm import langid, quality
from mediasift.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = table(spark, SF, "documents")
    got = langid.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_scores_are_calibrated(spark):
    """Scores of held-out texts are right as often as they say, and noise of another kind is rejected more often than text."""
    docs = table(spark, SF, "documents")
    got = langid.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").toPandas()
    right = got["lang"] == got["lang_pred"]
    assert abs(got["score"].mean() - right.mean()) < 0.05
    model = langid.train(docs)
    rng = np.random.default_rng(0)
    noise = [(k, " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(30))) for k in range(60)]
    odd = langid.predict(spark.createDataFrame(noise, "doc_id long, text string"), model).toPandas()
    assert odd["score"].mean() < got["score"].mean()


def test_other_columns_do_not_matter(spark):
    docs = table(spark, SF, "documents").limit(200)
    model = langid.train(docs)
    a = langid.predict(docs, model).orderBy("doc_id").collect()
    b = langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model).orderBy("doc_id").collect()
    assert a == b


def test_sums_are_those_of_embeddings():
    rng = np.random.default_rng(0)
    emb, out = rng.normal(size=(1 << langid.BUCKET_BITS, 4)), rng.normal(size=(4, 3))
    emb[0] = 0
    data = np.frombuffer("Ein Satz, und noch einer".encode(), np.uint8)
    h = np.concatenate(langid._buckets(data, np.array([0, len(data)])))
    total, count = langid._sums(data, np.array([0, len(data)]), emb @ out)
    assert np.allclose(total[0] / count[0], emb[h[h > 0]].mean(axis=0) @ out)


def test_held_out_quality(spark):
    labels = table(spark, SF, "labels")
    got = quality.query(spark, SF).join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.97


def test_gradients():
    rng = np.random.default_rng(1)
    w = {k: rng.normal(size=s) * 0.3 for k, s in (("enc", (quality.WIDTH, quality.HIDDEN)), ("enc0", (quality.HIDDEN,)), ("v", (quality.HIDDEN, quality.GATE)), ("u", (quality.HIDDEN, quality.GATE)), ("a", (quality.GATE,)), ("out", (quality.HIDDEN,)))}
    w["out0"] = np.float64(0.1)
    x, first, y, weight = rng.normal(size=(9, quality.WIDTH)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss(w):
        p = quality._forward(w, x, first)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    grads = quality._gradients(w, x, first, y, weight)
    for k in w:
        step = np.zeros_like(w[k])
        at = tuple(0 for _ in step.shape)
        step[at] = 1e-5
        want = (loss({**w, k: w[k] + step}) - loss({**w, k: w[k] - step})) / 2e-5
        assert grads[k][at] == pytest.approx(want, abs=1e-6), k


def test_attention_sums_to_one():
    data = np.frombuffer(("word " * 900).encode(), np.uint8)
    x, first = quality.passages(data, np.array([0, len(data)]))
    assert len(x) == first[-1] == -(-len(data) // quality.PASSAGE_BYTES)


def test_one_label_only(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) == 1.0


def test_neighbours_do_not_count():
    """A text's features are the same alone and in any block."""
    texts = ["One text here.", "x", "", "Another one, a bit longer. " * 60, "ab", "One text here."]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    together, first = quality.passages(data, offsets)
    for k, t in enumerate(texts):
        alone, _ = quality.passages(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        assert np.array_equal(alone, together[first[k] : first[k + 1]])
