"""External text of vertices, edges, dictionaries and adjacency members, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def visible(annotation_map: Column, annotations: Column) -> Column:
    """Annotations of an entity that its label's map has now, in the map's order."""
    return F.filter(F.coalesce(annotation_map, F.array().cast("array<string>")), lambda m: F.coalesce(F.array_contains(annotations, m), F.lit(False)))


def vertex_label(tokens: Column, shown: Column) -> Column:
    """Tokens without the root, then annotations, all joined by colons."""
    return F.array_join(F.concat(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), shown), ":")


def edge_label(tokens: Column, shown: Column) -> Column:
    """The path with dots, without the root unless it is alone, then annotations joined by colons."""
    path = F.when(F.size(tokens) > 1, F.array_join(F.slice(tokens, 2, F.size(tokens) - 1), ".")).otherwise(F.lit("_"))
    return F.array_join(F.concat(F.array(path), shown), ":")


def vertex_text(id_: Column, label: Column, properties: Column) -> Column:
    return F.concat(F.lit('{"id": '), id_.cast("string"), F.lit(', "label": "'), label, F.lit('", "properties": '), F.coalesce(properties, F.lit("{}")), F.lit("}"))


def edge_text(id_: Column, start_label: Column, start_id: Column, end_label: Column, end_id: Column, label: Column, properties: Column) -> Column:
    end = lambda lab, i: F.concat(F.lit("("), lab.cast("string"), F.lit(","), i.cast("string"), F.lit(")"))
    parts = [F.lit('{"id": '), id_.cast("string"), F.lit(', "start_vertex": '), end(start_label, start_id), F.lit(', "edge_vertex": '), end(end_label, end_id)]
    return F.concat(*parts, F.lit(', "label": "'), label, F.lit('", "properties": '), F.coalesce(properties, F.lit("{}")), F.lit("}"))


def vertex_build(id_: Column, graph_id: Column, label_id: Column, dictionary_id: Column) -> Column:
    return F.struct(id_.cast("long").alias("id"), graph_id.cast("int").alias("graph_id"), label_id.cast("int").alias("label_id"), dictionary_id.cast("short").alias("dictionary_id"))


def edge_build(id_: Column, graph_id: Column, label_id: Column, dictionary_id: Column, start: Column, end: Column) -> Column:
    """An edge struct with the ends of two vertex structs."""
    return F.struct(
        id_.cast("long").alias("id"), graph_id.cast("int").alias("graph_id"), label_id.cast("int").alias("label_id"), dictionary_id.cast("short").alias("dictionary_id"),
        start["label_id"].alias("start_label"), start["id"].alias("start_id"), end["label_id"].alias("end_label"), end["id"].alias("end_id"),
    )


def dictionary_text(dict_id: Column, keys: Column) -> Column:
    """dict{id}["a", "b"]."""
    quoted = F.transform(keys, lambda k: F.concat(F.lit('"'), F.regexp_replace(k, r'(["\\])', r"\\$1"), F.lit('"')))
    return F.concat(F.lit("dict{"), dict_id.cast("string"), F.lit("}["), F.array_join(quoted, ", "), F.lit("]"))


def dictionary_values(props: Column, keys: Column) -> Column:
    """Values of an object (a map of key to canonical text) in the dictionary's order, null where it has none."""
    return F.transform(keys, lambda k: F.element_at(props, k))


def members_text(members: Column) -> Column:
    """Adjacency members as JSON text."""
    return F.to_json(members)
