from mediasift.operators import semantic as M
from mediasift.plans import catalogue
from mediasift.sources.tables import table

SF = "/root/testdata/sf0.1"


def test_all_embeddings_are_clustered(spark):
    ids = {r["vec_id"] for r in table(spark, SF, "embeddings").select("vec_id").collect()}
    assert {r["id"] for r in catalogue.queries()["l4_auto_classify"](spark, SF).select("id").collect()} == ids and len(ids) > 500


def test_kmeans_takes_its_default_tries(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "kmeans", lambda *args, **more: seen.append((len(args), more)))
    catalogue.queries()["e21_kmeans"](spark, "/root/testdata/sf0.001")
    assert seen == [(2, {})]


def cost_of(vectors, centres):
    import numpy as np

    x = np.array([r["emb"] for r in vectors.select("emb").collect()])
    return ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_starts_at_once_cost_no_more_than_separate_fits(spark):
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from mediasift.operators import kmeans as K

    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 6)) * 3
    rows = [(k, (middle[k % 12] + rng.normal(size=6)).tolist()) for k in range(1500)]
    vectors = spark.createDataFrame(rows, "id long, emb array<double>").repartition(4)
    mine = cost_of(vectors, K.best_centres(vectors, 12))
    features = vectors.select(array_to_vector("emb").alias("features")).cache()
    theirs = min(KMeans(k=12, seed=42 + t, maxIter=300).fit(features).summary.trainingCost for t in range(10))
    assert mine <= theirs * 1.005
    got = {r["id"]: r["cluster"] for r in M.kmeans(vectors, 12).collect()}
    assert len(got) == 1500 and len(set(got.values())) == 12


def test_groups_of_starts_and_odd_vectors(spark, monkeypatch):
    from mediasift.operators import kmeans as K

    same = spark.createDataFrame([(k, [1.0, float(k % 3)]) for k in range(60)] + [(99, None)], "id long, emb array<double>")
    for size in (1, K.CENTRE_BYTES):
        monkeypatch.setattr(K, "CENTRE_BYTES", size)
        got = {r["id"]: r["cluster"] for r in M.kmeans(same, 5, tries=3).collect()}
        assert len(got) == 60 and len({(k % 3, c) for k, c in got.items()}) == 3  # no more clusters than distinct vectors
    assert M.kmeans(same.where("id = 99"), 5).count() == 0 and M.kmeans(same.where("id = 1"), 5).collect()[0]["cluster"] == 0


def test_sums_of_centres_are_those_of_single_additions():
    import numpy as np

    from mediasift.operators import kmeans as K

    rng = np.random.default_rng(2)
    for k in (1, 9, 70_000):
        x, near = rng.normal(size=(500, 6)), rng.integers(0, k, 500)
        want, got = np.ones((k, 6)), np.ones((k, 6))
        np.add.at(want, near, x)
        K._add(got, near, x)
        assert np.allclose(got, want, rtol=0, atol=1e-12)
    x, starts = rng.normal(size=(300, 6)), [rng.normal(size=(k, 6)) for k in (3, 20)]
    for rows, near, least in K._nearest(x, starts):
        for t, c in enumerate(starts):
            d = ((x[rows][:, None] - c[None]) ** 2).sum(2)
            assert (near[:, t] == d.argmin(1)).all() and np.allclose(least[:, t], d.min(1))
