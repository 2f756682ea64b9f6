from mediasift.operators import pairs as P
from mediasift.plans import pipelines


def test_copies_stay_with_their_representative(spark):
    """Groups of 3 and of 1000 equal items, and copies of two similar items."""
    row = lambda i, p: (i, [p], [p], None, 10.0, f"/{i}", f"{i}", i, 1.0, 1, 1)
    rows = [row(i, 0) for i in range(3)] + [row(i, 0x5A5A5A5A5A5A5A5A) for i in range(10, 1010)]
    rows += [row(2000, 0x3333333333333333), row(2001, 0x3333333333333332), row(2002, 0x3333333333333333), row(2003, 0x3333333333333332)]
    items = spark.createDataFrame(rows, "id long, phash array<long>, dhash array<long>, audio array<long>, duration double, path string, name string, size long, mtime double, width int, height int")
    groups = {}
    for r in pipelines.groups_of(items, 0.7, 0.85)["members"].select("group_id", "id").collect():
        groups.setdefault(r["group_id"], []).append(r["id"])
    assert {g: sorted(x) for g, x in groups.items()} == {0: [0, 1, 2], 10: list(range(10, 1010)), 2000: [2000, 2001, 2002, 2003]}
    assert P.copy_links(items).count() == 2 + 999 + 2
