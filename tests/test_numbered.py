"""Numbering of wide tables, under several numbers of shuffle partitions."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertebra.operators import adjacency, entities
from vertebra.sources.bulk import GraphView


@pytest.mark.parametrize("parts", [4, 8, 200])
def test_wide_rows_keep_their_numbers(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        n = 1_000_000 if parts == 8 else 200_000
        rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.repeat(F.lit("x"), 128).alias("wide"))
        want = rows.select("k", F.row_number().over(W.partitionBy("g").orderBy("k")).alias("want"))
        for _ in range(2):
            got = entities.numbered(rows, "g", ["k"])
            r = got.join(want, "k").agg(F.count(F.lit(1)), F.count(F.when(F.col("id") == F.col("want"), 1)), F.min(F.length("wide"))).first()
            assert tuple(r) == (n, n, 128)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_blocks_hold_every_member(spark):
    g = GraphView(spark, "/root/testdata/sf0.1")
    both = adjacency.both_ways(g.edges(5).union(g.edges(6)))
    made = adjacency.blocks(both)
    assert adjacency.members(made).count() == both.count()


def test_start_and_ties(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (1, "a"), (None, "z"), (None, "y")], "g int, k string")
    start = spark.createDataFrame([(1, 10)], "g int, start long")
    got = sorted(((r.g or 0, r.k, r.id) for r in entities.numbered(rows, "g", ["k"], start).collect()))
    assert got == [(0, "y", 1), (0, "z", 2), (1, "a", 11), (1, "a", 12), (1, "b", 13), (2, "a", 1)]
