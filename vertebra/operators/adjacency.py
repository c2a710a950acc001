"""Adjacency: both directions of every edge, segments of new members, and compaction into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertebra.operators.entities import numbered

#: Members that fit one block: an 8 KB page less its headers, by the member's size.
BLOCK = 155
MEMBER = ["dir", "edge_label", "edge_id", "other_label", "other_id"]


def both_ways(edges: DataFrame) -> DataFrame:
    """Two rows per edge, one for each end as owner: dir 0 leaves the owner, 1 enters it. A self-loop has both."""
    out = F.struct(F.col("start_label").alias("owner_label"), F.col("start_id").alias("owner_id"), F.lit(0).alias("dir"), F.col("end_label").alias("other_label"), F.col("end_id").alias("other_id"))
    into = F.struct(F.col("end_label").alias("owner_label"), F.col("end_id").alias("owner_id"), F.lit(1).alias("dir"), F.col("start_label").alias("other_label"), F.col("start_id").alias("other_id"))
    both = edges.select("graph_id", F.col("label_id").alias("edge_label"), F.col("id").alias("edge_id"), F.explode(F.array(out, into)).alias("m"))
    return both.select("graph_id", "m.owner_label", "m.owner_id", "m.dir", "edge_label", "edge_id", "m.other_label", "m.other_id")


def degrees(adjacency: DataFrame) -> DataFrame:
    """Edges that leave and enter each owner."""
    count = lambda d: F.count(F.when(F.col("dir") == d, 1))
    return adjacency.groupBy("owner_label", "owner_id").agg(count(0).alias("out_degree"), count(1).alias("in_degree"))


def blocks(adjacency: DataFrame, size: int = BLOCK) -> DataFrame:
    """Members of each owner, newest edge first, in blocks of at most `size`.

    Places are numbered before anything is gathered, so an owner with very many edges is many blocks and no task holds
    all its members.
    """
    a = adjacency.withColumn("__owner", F.struct("owner_label", "owner_id")).withColumn("__newest", -F.col("edge_id"))
    placed = numbered(a, "__owner", ["owner_label", "owner_id", "__newest", "edge_label", "dir"], out="__place")
    placed = placed.withColumn("block", F.floor((F.col("__place") - 1) / size).cast("int"))
    member = F.struct(F.col("__place").alias("place"), *MEMBER)
    made = placed.groupBy("owner_label", "owner_id", "block").agg(F.sort_array(F.collect_list(member)).alias("members"))
    return made.withColumn("members", F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in MEMBER])))


def members(stored: DataFrame) -> DataFrame:
    """Rows of adjacency that blocks hold."""
    return stored.select("owner_label", "owner_id", F.explode("members").alias("m")).select("owner_label", "owner_id", "m.*")


def compacted(stored: DataFrame, segment: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks after a segment of new members is merged in; only owners in the segment are laid out again."""
    owners = segment.select("owner_label", "owner_id").distinct()
    touched = members(stored.join(owners, ["owner_label", "owner_id"], "left_semi"))
    columns = ["owner_label", "owner_id", *MEMBER]
    new = blocks(segment.select(*columns).unionByName(touched.select(*columns)), size)
    return stored.join(owners, ["owner_label", "owner_id"], "left_anti").unionByName(new.select(*stored.columns))


def rotated(segments: DataFrame, label_id: int) -> DataFrame:
    """Segments (label_id, segment_id, active, compacted) after a label's active one is closed and a new one opened."""
    own = F.col("label_id") == label_id
    closed = segments.withColumn("active", F.col("active") & ~own)
    new = segments.where(own).agg((F.coalesce(F.max("segment_id"), F.lit(0)) + 1).cast("int").alias("segment_id"))
    return closed.unionByName(new.select(F.lit(label_id).alias("label_id"), "segment_id", F.lit(True).alias("active"), F.lit(False).alias("compacted")))


def oldest_open(segments: DataFrame, label_id: int) -> DataFrame:
    """The segment that compaction takes next: the oldest that is neither active nor compacted."""
    rows = segments.where((F.col("label_id") == label_id) & ~F.col("active") & ~F.col("compacted"))
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("label_id").orderBy("segment_id"))).where("__n = 1").drop("__n")
