"""The tiers of a cascade, each by a document."""

from compare import compare

from sparkloom.sources.shared import new_path
from sparkloom.plans import texts


def test_tiers(spark, tmp_path):
    item = "One two, three four five six seven.\nEight nine ten eleven"
    docs = [(1, "a\nOne two, three four five six seven.\nb"), (2, "one TWO three four five six seven\nb"), (3, "so one two three\nfour five six seven eight, nine ten eleven it goes"), (4, "one two three four five six seven eight nine"), (5, None), (6, ""), (7, "xone two three four five six seven eight nine ten eleven"), (8, "of short"), (None, f"x {item} y")]
    path = new_path(spark, "cascade")
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, item), (3, "Short!"), (4, "?"), (5, None)], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    got = {r.doc_id: (r.tier, r.item_id) for r in texts.cascade_tiers(spark, path).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (3, 1), 4: (4, None), 5: (4, None), 6: (4, None), 7: (4, None), 8: (3, 3), None: (3, 1)}


def test_against_sql(spark):
    """At a size at which documents contain items in longer lines."""
    folder = "/root/testdata/sf0.01"
    assert compare(texts.cascade_tiers(spark, folder), texts.query.sql["cascade_tiers"], folder) > 0
