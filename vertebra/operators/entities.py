"""Vertices and edges: numbering, insert, update, delete, detach and relabelling, for whole tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vertebra.tables import saved

VERTEX = "graph_id int, label_id int, id long, dictionary_id short, properties string, annotations array<string>"
EDGE = "graph_id int, label_id int, id long, dictionary_id short, start_label int, start_id long, end_label int, end_id long, properties string, annotations array<string>"
KEY = ["graph_id", "label_id", "id"]


def numbered(rows: DataFrame, group: str, order: list[str], start: DataFrame | None = None, out: str = "id") -> DataFrame:
    """Adds out: 1, 2, ... within each group in the given order, plus the group's start (columns group, start).

    Rows are range-partitioned by the order; a partition's rows follow those of the partitions before it, so no group
    passes through one task. Rows with their partition and their place in it are written once, and the counts are taken
    from what was written, so both mean the same partitions. What is added up in between is one count per partition and
    group. Rows that tie in the order are numbered in any order among themselves. A row without a count is an error.
    """
    dealt = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    dealt = saved(dealt.withColumn("__own", F.row_number().over(W.partitionBy("__part", group).orderBy(*order))))
    counts = dealt.groupBy(F.col("__part").alias("__p"), F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("__g").orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    df = dealt.join(counts, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    if start is not None:
        df = df.join(start.select(group, F.col("start").alias("__start")), group, "left")
    else:
        df = df.withColumn("__start", F.lit(0))
    place = F.coalesce(F.col("__before"), F.raise_error(F.lit("a numbered row has no count")).cast("long")) + F.col("__own")
    return df.withColumn(out, (F.coalesce("__start", F.lit(0)) + place).cast("long")).drop("__part", "__own", "__p", "__g", "__before", "__start")


def appended(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with more rows; columns that they lack are null."""
    return table.unionByName(new, allowMissingColumns=True)


def unknown_annotations(new: DataFrame, labels: DataFrame) -> DataFrame:
    """New entities with an annotation that their label's map lacks; column bad has the first such name."""
    maps = labels.select("label_id", F.coalesce("annotation_map", F.array().cast("array<string>")).alias("__map"))
    bad = F.array_except("annotations", "__map")
    return new.join(maps, "label_id").where(F.size(bad) > 0).withColumn("bad", F.element_at(bad, 1)).drop("__map")


def dangling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with an end that is no vertex."""
    there = vertices.select("label_id", "id").distinct()
    ends = lambda end: there.select(F.col("label_id").alias(f"{end}_label"), F.col("id").alias(f"{end}_id"), F.lit(True).alias(f"__{end}"))
    df = edges.join(ends("start"), ["start_label", "start_id"], "left").join(ends("end"), ["end_label", "end_id"], "left")
    return df.where("__start is null or __end is null").select(*edges.columns)


def updated(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Whole property objects replaced by those of changes (key columns, properties); annotations stay."""
    new = changes.select(*KEY, F.col("properties").alias("__new"), F.lit(True).alias("__hit"))
    df = table.join(new, KEY, "left")
    return df.withColumn("properties", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("properties"))).select(*table.columns)


def deleted(table: DataFrame, victims: DataFrame) -> DataFrame:
    """The rows whose keys are not among the victims'."""
    return table.join(victims.select(*KEY).distinct(), KEY, "left_anti")


def incident(edges: DataFrame, victims: DataFrame) -> DataFrame:
    """Edges with an end among the vertices, each once, self-loops too."""
    v = victims.select("graph_id", F.col("label_id").alias("__l"), F.col("id").alias("__i")).distinct()
    at = lambda end: edges.join(v.withColumnRenamed("__l", f"{end}_label").withColumnRenamed("__i", f"{end}_id"), ["graph_id", f"{end}_label", f"{end}_id"], "left_semi")
    return at("start").select(*edges.columns).unionByName(at("end").select(*edges.columns)).dropDuplicates(KEY)


def without_vertices(vertices: DataFrame, edges: DataFrame, victims: DataFrame, detach: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) after a delete. Without detach, vertices that still have edges are an error."""
    touched = incident(edges, victims)
    if detach:
        return deleted(vertices, victims), deleted(edges, touched)
    held = touched.select("graph_id", F.explode(F.array(F.struct(F.col("start_label").alias("label_id"), F.col("start_id").alias("id")), F.struct(F.col("end_label").alias("label_id"), F.col("end_id").alias("id")))).alias("v"))
    first = held.select("graph_id", "v.*").join(victims.select(*KEY), KEY, "left_semi").agg(F.min("id")).first()[0]
    if first is not None:
        raise ValueError(f"Cannot delete vertex {first} because it still has active edges. Use DETACH DELETE.")
    return deleted(vertices, victims), edges


def moved(vertices: DataFrame, targets: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Maps (graph_id, label_id, id) of vertices that change label to (new_label, new_id).

    targets has the key and new_label. New ids follow the target label's highest one, start (new_label, start).
    """
    there = targets.join(vertices.select(*KEY), KEY, "left_semi")
    return numbered(there.select(*KEY, "new_label"), "new_label", ["label_id", "id"], start, "new_id")


def relabelled(vertices: DataFrame, moves: DataFrame) -> DataFrame:
    """Vertices under their new labels and ids, with properties and annotations."""
    df = vertices.join(moves.withColumnRenamed("new_id", "__id").withColumnRenamed("new_label", "__label"), KEY, "left")
    return df.withColumns({"id": F.coalesce("__id", "id"), "label_id": F.coalesce("__label", "label_id")}).select(*vertices.columns)


def migrated(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with ends that follow moved vertices; a self-loop changes at both. Ids, labels and properties stay."""
    df = edges
    for end in ("start", "end"):
        m = moves.select("graph_id", F.col("label_id").alias(f"{end}_label"), F.col("id").alias(f"{end}_id"), F.col("new_label").alias("__label"), F.col("new_id").alias("__id"))
        df = df.join(m, ["graph_id", f"{end}_label", f"{end}_id"], "left")
        df = df.withColumns({f"{end}_label": F.coalesce("__label", f"{end}_label"), f"{end}_id": F.coalesce("__id", f"{end}_id")}).drop("__label", "__id")
    return df.select(*edges.columns)


def edges_relabelled(edges: DataFrame, where: Column, new_label: int, annotation_map: list[str] | None = None) -> DataFrame:
    """Chosen edges under a new label, ids kept; annotations that the new label's map lacks go if a map is given."""
    kept = F.col("annotations") if annotation_map is None else F.array_intersect("annotations", F.array(*[F.lit(a) for a in annotation_map]).cast("array<string>"))
    return edges.withColumns({"annotations": F.when(where, kept).otherwise(F.col("annotations")), "label_id": F.when(where, F.lit(new_label)).otherwise(F.col("label_id"))})
