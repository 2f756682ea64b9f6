"""Connected components of an edge table: union-find inside parts, then minimum labels with pointer jumping between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.operators.joins import key_sizes, with_one
from mediasift.sources.shared import stored, stored_and_seen

#: Links of a part on average; a part is joined up in one task.
PART_LINKS = 300_000


def _joined_up(batches):
    """Every node of the links with the smallest node that they lead to."""
    root: dict = {}

    def find(x):
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for k in range(0, len(nodes), 1 << 16):
        some = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([find(x) for x in some], kind)], names=["x", "y"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; a component is named by its smallest node.

    Links are dealt to parts of bounded size, and each part's are joined up by union-find, which leaves one link from each
    node to the smallest of its part. If there is more than one part, rounds follow: each node takes the smallest label
    among its own and its neighbours', passes it on to the node that its label names, and then takes the label of that label,
    so that components join as wholes and long chains shorten by doubling. A node
    with very many neighbours and a label that very many nodes share are hot keys of these joins, and are joined as such
    (:func:`with_one`); messages are reduced before the shuffle. Rounds are written to the shared folder.

    Edges with a null end are left out; repeated edges and loops change nothing; an empty table gives an empty one.
    """
    kind = edges.schema[a].dataType.simpleString()
    both = stored(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null"), "links")
    parts = -(-both.count() // PART_LINKS) or 1
    dealt = both.repartition(parts) if parts > 1 else both.coalesce(1)
    stars = stored(dealt.mapInArrow(_joined_up, f"x {kind}, y {kind}"), "stars")
    if parts == 1:
        return stars.select(F.col("x").alias("node"), F.col("y").alias("component"))
    stars = stars.distinct()
    links = stored(stars.where("x <> y").unionByName(stars.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"))), "links")
    degrees = links.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    labels = stars.select(F.col("x").alias("y")).distinct().join(degrees.hint("merge"), "y", "left").select("y", F.coalesce("n", F.lit(0)).alias("n"), F.col("y").alias("label"))
    labels, degree_sizes = stored_and_seen(labels, "labels", *key_sizes())
    while True:
        heard = with_one(links, labels, ["y"], sizes=degree_sizes).groupBy("x").agg(F.min("label").alias("heard"))
        told = labels.join(heard.hint("merge"), labels["y"] == heard["x"], "left").select("y", "n", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("low"))
        told = stored(told, "labels")
        passed_on = told.groupBy(F.col("old").alias("root")).agg(F.min("low").alias("passed"))
        mine = told.join(passed_on.hint("merge"), told["y"] == passed_on["root"], "left").select("y", "n", "old", F.least("low", F.coalesce("passed", "low")).alias("low"))
        mine = stored(mine, "labels")
        named = mine.groupBy("low").agg(F.count(F.lit(1)).alias("n"))
        lower = named.join(mine.select(F.col("y").alias("low"), F.col("low").alias("lower")).hint("merge"), "low")  # every label is a node
        lower, label_sizes = stored_and_seen(lower, "lower-labels", *key_sizes())
        jumped = with_one(mine.withColumnRenamed("n", "degree"), lower, ["low"], sizes=label_sizes).select("y", F.col("degree").alias("n"), F.least("low", "lower").alias("label"), "old")
        jumped = stored(jumped, "labels")
        labels = jumped.select("y", "n", "label")
        if jumped.where("label <> old").isEmpty():
            return labels.select(F.col("y").alias("node"), F.col("label").alias("component"))
