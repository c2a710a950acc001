"""Traversal as joins: expansion, meeting in the middle, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(frontier: DataFrame, adjacency: DataFrame, direction: int | None = 0, edge_labels: list[int] | None = None, other_labels: list[int] | None = None) -> DataFrame:
    """Each row of frontier (label_id, id, more columns) with every live edge of its vertex.

    direction 0 follows edges, 1 goes against them, None takes both. Label conditions are tested on the adjacency row
    itself, before the join and without fetching the other vertex. Adds dir, edge_label, edge_id, other_label, other_id.
    """
    a = adjacency
    if direction is not None:
        a = a.where(F.col("dir") == direction)
    if edge_labels is not None:
        a = a.where(F.col("edge_label").isin(edge_labels))
    if other_labels is not None:
        a = a.where(F.col("other_label").isin(other_labels))
    a = a.select(F.col("owner_label").alias("label_id"), F.col("owner_id").alias("id"), "dir", "edge_label", "edge_id", "other_label", "other_id")
    return frontier.join(a, ["label_id", "id"])


def step(frontier: DataFrame, adjacency: DataFrame, **conditions) -> DataFrame:
    """expand(), with the other vertex as the new label_id and id."""
    out = expand(frontier, adjacency, **conditions)
    return out.select(*[c for c in frontier.columns if c not in ("label_id", "id")], F.col("other_label").alias("label_id"), F.col("other_id").alias("id"))


def scan(edges: DataFrame, label_id: int) -> DataFrame:
    """All (start, end) pairs of an edge label."""
    return edges.where(F.col("label_id") == label_id).select("id", "start_label", "start_id", "end_label", "end_id")


def meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths of two edges: full scans of two edge labels joined on the shared vertex. Spark picks the join."""
    a = left.select(F.col("id").alias("first_id"), F.col("start_label").alias("from_label"), F.col("start_id").alias("from_id"), F.col("end_label").alias("mid_label"), F.col("end_id").alias("mid_id"))
    b = right.select(F.col("id").alias("second_id"), F.col("start_label").alias("mid_label"), F.col("start_id").alias("mid_id"), F.col("end_label").alias("to_label"), F.col("end_id").alias("to_id"))
    return a.join(b, ["mid_label", "mid_id"])


def with_properties(rows: DataFrame, table: DataFrame, label: str, key: str) -> DataFrame:
    """Properties fetched last, for the rows that are left."""
    return rows.join(table.select(F.col("label_id").alias(label), F.col("id").alias(key), "properties"), [label, key])


def reachable(start: DataFrame, adjacency: DataFrame, most_steps: int, checkpoint=None, **conditions) -> DataFrame:
    """(label_id, id, steps): vertices within most_steps edges of the start, with the fewest steps.

    Each round expands only what the last one found. checkpoint, if given, cuts the lineage after each round.
    """
    cut = checkpoint or (lambda df: df)
    seen = cut(start.select("label_id", "id").distinct().withColumn("steps", F.lit(0)))
    frontier = seen
    for n in range(1, most_steps + 1):
        found = step(frontier.select("label_id", "id"), adjacency, **conditions).distinct()
        frontier = cut(found.join(seen, ["label_id", "id"], "left_anti").withColumn("steps", F.lit(n)))
        seen = cut(seen.unionByName(frontier))
    return seen
