"""Annotation labels: per-label lists of names, cascades down the hierarchy, and bitsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertebra.operators.labels import ROOT, descends

_NONE = "array<string>"


def added(labels: DataFrame, path: str, name: str) -> DataFrame:
    """Labels after an annotation is added to a label and all below it that lack it. The empty path is the root."""
    tokens = [ROOT, *[t for t in path.split(".") if t]]
    have = F.coalesce("annotation_map", F.array().cast(_NONE))
    new = F.when(descends(F.col("tokens"), tokens) & ~F.array_contains(have, name), F.array_append(have, F.lit(name))).otherwise(F.col("annotation_map"))
    return labels.withColumn("annotation_map", new)


def removed(labels: DataFrame, path: str, name: str) -> DataFrame:
    """Labels after an annotation is dropped from a label and those below it.

    A label strictly below keeps it if another of its tokens is a label of its own, right under the root, that has the
    annotation. Stored annotations of entities don't change; they show again if the name comes back.
    """
    tokens = [ROOT, *[t for t in path.split(".") if t]]
    owners = labels.where((F.size("tokens") == 2) & F.array_contains("annotation_map", name) & ~(F.element_at("tokens", 2) == tokens[-1]))
    owners = owners.select(F.element_at("tokens", 2).alias("token")).distinct()
    below = labels.where(descends(F.col("tokens"), tokens) & (F.size("tokens") > len(tokens)))
    kept = below.select("label_id", F.explode("tokens").alias("token")).join(owners, "token", "left_semi").select("label_id").distinct().withColumn("kept", F.lit(True))
    hit = descends(F.col("tokens"), tokens) & F.col("kept").isNull()
    new = F.when(hit, F.array_remove("annotation_map", name)).otherwise(F.col("annotation_map"))
    return labels.join(kept, "label_id", "left").withColumn("annotation_map", new).select(*labels.columns)


def annotated(entities: DataFrame, where: Column, name: str) -> DataFrame:
    """Entities after an annotation is set on those chosen."""
    have = F.coalesce("annotations", F.array().cast(_NONE))
    return entities.withColumn("annotations", F.when(where, F.array_union(have, F.array(F.lit(name)))).otherwise(F.col("annotations")))


def unannotated(entities: DataFrame, where: Column, name: str) -> DataFrame:
    """Entities after an annotation is cleared on those chosen."""
    return entities.withColumn("annotations", F.when(where, F.array_remove("annotations", name)).otherwise(F.col("annotations")))


def bits(annotation_map: Column, annotations: Column) -> Column:
    """Hex of the bitset: bit i of byte i div 8, lowest first, is set if the map's name i is among the annotations."""
    byte = lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, i: acc + F.when(F.array_contains(annotations, F.get(annotation_map, b * 8 + i)), F.expr("1")).otherwise(F.lit(0)) * F.pow(F.lit(2), i).cast("int"))
    n = F.ceil(F.size(annotation_map) / 8).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.lpad(F.hex(F.coalesce(byte(b), F.lit(0))), 2, "0")), "")).otherwise(F.lit(""))


def names(annotation_map: Column, bitset: Column) -> Column:
    """The map's names whose bits are set in an integer bitset."""
    return F.filter(annotation_map, lambda m, i: F.getbit(bitset, i) == 1)
