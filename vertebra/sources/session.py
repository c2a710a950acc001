"""The statement interface: graphs, labels and entities by name, each statement one committed version."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertebra.functions import gtype, render
from vertebra.operators import adjacency, annotations, entities
from vertebra.sources.catalog import Catalog
from vertebra.sources.store import Store

ADJACENCY = "graph_id int, owner_label int, owner_id long, dir int, edge_label int, edge_id long, other_label int, other_id long"
BLOCKS = "owner_label int, owner_id long, block int, members array<struct<dir:int,edge_label:int,edge_id:long,other_label:int,other_id:long>>"
SCHEMAS = {"vertices": entities.VERTEX, "edges": entities.EDGE, "segments": ADJACENCY, "blocks": BLOCKS}


class GraphSession:
    """Statements over a store. Single-row forms are thin wrappers of the bulk ones.

    Tables are kept per (table, graph, label): a statement writes only the labels that it touches. annotation_migration:
    what relabelling does with annotations that the new label lacks: drop, strict (an error) or auto (its map gets them).
    """

    def __init__(self, spark: SparkSession, root: str, namespace: str = "default", annotation_migration: str = "drop"):
        self.spark, self.store, self.namespace, self.annotation_migration = spark, Store(spark, root), namespace, annotation_migration
        self._depth = 0
        self.refresh()

    def refresh(self, version: int | None = None) -> None:
        self.version, state = self.store.load(version)
        self.catalog = Catalog(self.spark, state.get("catalog"), self.namespace)
        self.paths: dict[str, list[str]] = state.get("paths", {})
        self.segments: dict[str, list[dict]] = state.get("segments", {})

    @contextmanager
    def transaction(self):
        """Statements inside are one version; an error leaves the version before."""
        self._depth += 1
        try:
            yield self
        except BaseException:
            self._depth -= 1
            if not self._depth:
                self.refresh()
            raise
        self._depth -= 1
        if not self._depth:
            self.store.commit(self.version + 1, {"catalog": self.catalog.state(), "paths": self.paths, "segments": self.segments})
            self.version += 1

    def ddl(self, statement: str, *args, **kwargs):
        """Any statement of the catalog (create_graph, create_vlabel, merge, drop_label, add_annotation, ...)."""
        with self.transaction():
            out = getattr(self.catalog, statement)(*args, **kwargs)
            if statement == "drop_graph":
                self.paths = {k: v for k, v in self.paths.items() if k.split("/")[1] != str(out)}
                self.segments = {k: v for k, v in self.segments.items() if k.split("/")[0] != str(out)}
            return out

    # Tables

    def table(self, name: str, graph_id: int, label_ids: list[int] | None = None) -> DataFrame:
        """Rows of a graph, of given labels only if asked: other labels' files aren't even listed."""
        paths = [p for k, ps in sorted(self.paths.items()) for p in ps if k.split("/")[:2] == [name, str(graph_id)] and (label_ids is None or int(k.split("/")[2]) in label_ids)]
        return self.store.read(paths, SCHEMAS[name])

    def _put(self, name: str, graph_id: int, label_id: int, df: DataFrame, append: bool = False) -> None:
        key = f"{name}/{graph_id}/{label_id}"
        new = self.store.write(df.selectExpr(*[c.strip().split(" ")[0] for c in _split(SCHEMAS[name])]), name)
        self.paths[key] = [*self.paths.get(key, []), new] if append else [new]

    def _labels_in(self, df: DataFrame, column: str) -> list[int]:
        return sorted(r[0] for r in df.select(column).distinct().collect())

    # Insert

    def insert_vertices(self, graph_id: int, label_id: int, rows: DataFrame) -> int:
        """Appends rows (properties, and if given id and annotations); rows without an id are numbered. How many."""
        label = self.catalog.label(graph_id, "v", label_id)
        rows = self._valued(rows)
        if "annotations" in rows.columns:
            if label["annotation_map"] is None and rows.where("size(annotations) > 0").limit(1).count():
                raise ValueError("This structural label does not support annotations")
            bad = entities.unknown_annotations(rows.withColumn("label_id", F.lit(label_id)), self.catalog.frame(graph_id, "v").where(F.col("label_id") == label_id).select("label_id", "annotation_map")).first()
            if bad:
                raise ValueError(f"Annotation label '{bad.bad}' is not valid for this structural label")
        return self._append("vertices", "v", graph_id, label_id, rows)

    def insert_edges(self, graph_id: int, label_id: int, rows: DataFrame, validate: bool = True) -> int:
        """Appends rows (start_label, start_id, end_label, end_id, properties, and if given id) and their adjacency."""
        self.catalog.label(graph_id, "e", label_id)
        rows = self._valued(rows)
        if validate and entities.dangling(rows, self.table("vertices", graph_id)).limit(1).count():
            raise ValueError("Vertex ID not found in phys_map")
        with self.transaction():
            n = self._append("edges", "e", graph_id, label_id, rows)
            new = self.store.read(self.paths[f"edges/{graph_id}/{label_id}"][-1:], entities.EDGE)
            both = adjacency.both_ways(new)
            for owner in self._labels_in(both, "owner_label"):
                self._segment(graph_id, owner)["paths"].append(self.store.write(both.where(F.col("owner_label") == owner), "segments"))
            return n

    def _valued(self, rows: DataFrame) -> DataFrame:
        if "properties" not in rows.columns:
            return rows.withColumn("properties", F.lit("{}"))
        v = gtype.parsed(F.coalesce("properties", F.lit("{}")))
        rows = rows.withColumn("__v", v)
        bad = rows.where("__v.error is not null or substr(__v.canon, 1, 1) <> '{'").first()
        if bad:
            raise ValueError(bad["__v"]["error"] or "invalid format for properties, expects object")
        return rows.withColumn("properties", F.col("__v.canon")).drop("__v")

    def _append(self, name: str, kind: str, graph_id: int, label_id: int, rows: DataFrame) -> int:
        counter = f"id/{graph_id}/{kind}/{label_id}"
        with self.transaction():
            rows = rows.withColumns({"graph_id": F.lit(graph_id), "label_id": F.lit(label_id)})
            if "id" not in rows.columns:
                start = self.spark.createDataFrame([(label_id, self.catalog.counters.get(counter, 0))], "label_id int, start long")
                order = [c for c in rows.columns if c not in ("graph_id", "label_id", "annotations")]
                rows = entities.numbered(rows, "label_id", order, start)
            for c, t in (("dictionary_id", "short"), ("annotations", "array<string>")):
                if c not in rows.columns:
                    rows = rows.withColumn(c, F.lit(None).cast(t))
            self._put(name, graph_id, label_id, rows, append=True)
            last = self.store.read(self.paths[f"{name}/{graph_id}/{label_id}"][-1:], SCHEMAS[name]).agg(F.max("id"), F.count(F.lit(1))).first()
            self.catalog.counters[counter] = max(self.catalog.counters.get(counter, 0), last[0] or 0)
            return last[1]

    def insert_vertex(self, graph_id: int, label_id: int, properties: str = "{}", annots: list[str] | None = None) -> int:
        self.insert_vertices(graph_id, label_id, self.spark.createDataFrame([(properties, annots)], "properties string, annotations array<string>"))
        return self.catalog.counters[f"id/{graph_id}/v/{label_id}"]

    def insert_edge(self, graph_id: int, label_id: int, start: tuple[int, int], end: tuple[int, int], properties: str = "{}") -> int:
        """start and end are (label, id)."""
        self.insert_edges(graph_id, label_id, self.spark.createDataFrame([(*start, *end, properties)], "start_label int, start_id long, end_label int, end_id long, properties string"))
        return self.catalog.counters[f"id/{graph_id}/e/{label_id}"]

    # Update and delete

    def _one(self, name: str, graph_id: int, label_id: int, id_: int, kind: str) -> DataFrame:
        row = self.table(name, graph_id, [label_id]).where(F.col("id") == id_)
        if not row.limit(1).count():
            raise ValueError("Vertex ID not found in phys_map" if kind == "v" else "Edge ID not found in phys_map")
        return row

    def update(self, kind: str, graph_id: int, label_id: int, id_: int, properties: str) -> None:
        """Replaces the properties of one vertex (kind v) or edge (kind e)."""
        name = "vertices" if kind == "v" else "edges"
        self._one(name, graph_id, label_id, id_, kind)
        change = self._valued(self.spark.createDataFrame([(graph_id, label_id, id_, properties)], "graph_id int, label_id int, id long, properties string"))
        with self.transaction():
            self._put(name, graph_id, label_id, entities.updated(self.table(name, graph_id, [label_id]), change))

    def annotate(self, kind: str, graph_id: int, label_id: int, id_: int, annotation: str, remove: bool = False) -> None:
        """Sets or clears an annotation of one vertex or edge."""
        name = "vertices" if kind == "v" else "edges"
        if annotation not in (self.catalog.label(graph_id, kind, label_id)["annotation_map"] or []):
            raise ValueError(f"Annotation label '{annotation}' is not valid for this structural label")
        self._one(name, graph_id, label_id, id_, kind)
        change = annotations.unannotated if remove else annotations.annotated
        with self.transaction():
            self._put(name, graph_id, label_id, change(self.table(name, graph_id, [label_id]), F.col("id") == id_, annotation))

    def delete_edge(self, graph_id: int, label_id: int, id_: int) -> None:
        row = self._one("edges", graph_id, label_id, id_, "e")
        with self.transaction():
            self._put("edges", graph_id, label_id, entities.deleted(self.table("edges", graph_id, [label_id]), row))

    def delete_vertex(self, graph_id: int, label_id: int, id_: int, detach: bool = False) -> None:
        row = self._one("vertices", graph_id, label_id, id_, "v")
        edges = self.table("edges", graph_id)
        touched = self._labels_in(entities.incident(edges, row), "label_id")
        left, kept = entities.without_vertices(self.table("vertices", graph_id, [label_id]), edges, row, detach)
        with self.transaction():
            for e in touched:
                self._put("edges", graph_id, e, kept.where(F.col("label_id") == e))
            self._put("vertices", graph_id, label_id, left)

    # Relabel

    def set_vertex_label(self, graph_id: int, label_id: int, id_: int, new: str) -> tuple[int, int] | None:
        """Appends a token to the vertex's path. (label, id) after the move; None if it has the token."""
        label = self.catalog.label(graph_id, "v", label_id)
        if "." in new:
            raise ValueError("labels cannot contain dots.")
        if new in label["tokens"]:
            return None
        with self.transaction():
            base = self.catalog.find_or_create(graph_id, "v", ["_", new], None)
            self.catalog._register(graph_id, new, "s")
            maps = [*(label["annotation_map"] or []), *(self.catalog.label(graph_id, "v", base)["annotation_map"] or [])]
            target = self.catalog.find_or_create(graph_id, "v", [*label["tokens"], new], list(dict.fromkeys(maps)) or None)
            return self._move(graph_id, label_id, id_, target)

    def remove_vertex_label(self, graph_id: int, label_id: int, id_: int, token: str) -> tuple[int, int] | None:
        """Takes the first such token out of the vertex's path; None if there is none."""
        label = self.catalog.label(graph_id, "v", label_id)
        if "." in token:
            raise ValueError("labels cannot contain dots.")
        if token not in label["tokens"][1:]:
            return None
        at = label["tokens"].index(token)
        with self.transaction():
            target = self.catalog.find_or_create(graph_id, "v", label["tokens"][:at] + label["tokens"][at + 1 :], None)
            return self._move(graph_id, label_id, id_, target)

    def _move(self, graph_id: int, label_id: int, id_: int, target: int) -> tuple[int, int]:
        self._one("vertices", graph_id, label_id, id_, "v")
        counter = f"id/{graph_id}/v/{target}"
        start = self.spark.createDataFrame([(target, self.catalog.counters.get(counter, 0))], "new_label int, start long")
        asked = self.spark.createDataFrame([(graph_id, label_id, id_, target)], "graph_id int, label_id int, id long, new_label int")
        old, edges = self.table("vertices", graph_id, [label_id]), self.table("edges", graph_id)
        row = entities.moved(old, asked, start).first()
        moves = self.spark.createDataFrame([(graph_id, label_id, id_, target, row.new_id)], "graph_id int, label_id int, id long, new_label int, new_id long")
        new = entities.relabelled(old, moves).where((F.col("label_id") == target) & (F.col("id") == row.new_id)) if target != label_id else entities.relabelled(old, moves)
        have = set((new.first().annotations or []) if target != label_id else [])
        into = self.catalog.label(graph_id, "v", target)
        lost = have - set(into["annotation_map"] or [])
        if lost and self.annotation_migration == "strict":
            raise ValueError(f"Annotation label '{min(lost)}' is not valid for this structural label")
        if lost and self.annotation_migration == "auto":
            into["annotation_map"] = [*(into["annotation_map"] or []), *sorted(lost)]
        elif lost:
            keep = F.array(*[F.lit(a) for a in into["annotation_map"] or []]).cast("array<string>")
            new = new.withColumn("annotations", F.array_intersect("annotations", keep))
        touched = self._labels_in(entities.incident(edges, asked), "label_id")
        after = entities.migrated(edges, moves)
        for e in touched:
            self._put("edges", graph_id, e, after.where(F.col("label_id") == e))
        left = entities.deleted(old, asked)
        if target == label_id:
            self._put("vertices", graph_id, label_id, new)
        else:
            self._put("vertices", graph_id, target, new, append=True)
            self._put("vertices", graph_id, label_id, left)
        self.catalog.counters[counter] = row.new_id
        for owner in {label_id, target}:
            both = adjacency.both_ways(self.table("edges", graph_id)).where(F.col("owner_label") == owner)
            own = self._segment(graph_id, owner)
            for s in self.segments[f"{graph_id}/{owner}"]:
                s["paths"] = []
            own["paths"] = [self.store.write(both, "segments")]
            self.paths.pop(f"blocks/{graph_id}/{owner}", None)
        return target, row.new_id

    def set_edge_label(self, graph_id: int, label_id: int, id_: int, new: str) -> tuple[int, int] | None:
        label = self.catalog.label(graph_id, "e", label_id)
        if new in label["tokens"]:
            return None
        with self.transaction():
            base = self.catalog.find_or_create(graph_id, "e", ["_", new], None)
            maps = [*(label["annotation_map"] or []), *(self.catalog.label(graph_id, "e", base)["annotation_map"] or [])]
            return self._move_edge(graph_id, label_id, id_, self.catalog.find_or_create(graph_id, "e", [*label["tokens"], new], list(dict.fromkeys(maps)) or None))

    def remove_edge_label(self, graph_id: int, label_id: int, id_: int, token: str) -> tuple[int, int] | None:
        label = self.catalog.label(graph_id, "e", label_id)
        if token not in label["tokens"][1:]:
            return None
        rest = [t for t in label["tokens"] if t != token]
        if len(rest) < 2:
            raise ValueError("Cannot remove the base structural label of an edge")
        with self.transaction():
            return self._move_edge(graph_id, label_id, id_, self.catalog.find_or_create(graph_id, "e", rest, label["annotation_map"]))

    def _move_edge(self, graph_id: int, label_id: int, id_: int, target: int) -> tuple[int, int]:
        """The edge under its new label; its id stays if it is free there, else it gets the next."""
        row = self._one("edges", graph_id, label_id, id_, "e")
        counter = f"id/{graph_id}/e/{target}"
        taken = self.table("edges", graph_id, [target]).where(F.col("id") == id_).limit(1).count()
        new_id = self.catalog.counters.get(counter, 0) + 1 if taken else id_
        moved = entities.edges_relabelled(row, F.lit(True), target, self.catalog.label(graph_id, "e", target)["annotation_map"] or []).withColumn("id", F.lit(new_id).cast("long"))
        self._put("edges", graph_id, target, moved, append=True)
        self._put("edges", graph_id, label_id, entities.deleted(self.table("edges", graph_id, [label_id]), row))
        self.catalog.counters[counter] = max(self.catalog.counters.get(counter, 0), new_id)
        both = adjacency.both_ways(self.table("edges", graph_id, [target]).where(F.col("id") == new_id))
        for owner in self._labels_in(both, "owner_label"):
            self._segment(graph_id, owner)["paths"].append(self.store.write(both.where(F.col("owner_label") == owner), "segments"))
        return target, new_id

    # Adjacency

    def _segment(self, graph_id: int, label_id: int) -> dict:
        """The label's active segment; the first one is opened when it is needed."""
        own = self.segments.setdefault(f"{graph_id}/{label_id}", [])
        if not own:
            own.append({"segment_id": 1, "active": True, "compacted": False, "paths": []})
        return next(s for s in own if s["active"])

    def segment_table(self, graph_id: int, label_id: int) -> DataFrame:
        rows = [(label_id, s["segment_id"], s["active"], s["compacted"]) for s in self.segments.get(f"{graph_id}/{label_id}", [])]
        return self.spark.createDataFrame(rows, "label_id int, segment_id int, active boolean, compacted boolean")

    def _take(self, graph_id: int, label_id: int, table: DataFrame) -> None:
        old = {s["segment_id"]: s["paths"] for s in self.segments.get(f"{graph_id}/{label_id}", [])}
        rows = sorted(table.collect(), key=lambda r: r.segment_id)
        self.segments[f"{graph_id}/{label_id}"] = [{"segment_id": r.segment_id, "active": r.active, "compacted": r.compacted, "paths": old.get(r.segment_id, [])} for r in rows]

    def rotate(self, graph_id: int, label_id: int) -> None:
        """Closes the label's active segment and opens a new one."""
        with self.transaction():
            self._segment(graph_id, label_id)
            self._take(graph_id, label_id, adjacency.rotated(self.segment_table(graph_id, label_id), label_id))

    def compact_oldest(self, graph_id: int, label_id: int) -> None:
        """Merges the oldest closed segment into the label's blocks; the active one is closed first if none is."""
        with self.transaction():
            self._segment(graph_id, label_id)
            pick = adjacency.oldest_open(self.segment_table(graph_id, label_id), label_id).first()
            if pick is None:
                self.rotate(graph_id, label_id)
                pick = adjacency.oldest_open(self.segment_table(graph_id, label_id), label_id).first()
            segment = next(s for s in self.segments[f"{graph_id}/{label_id}"] if s["segment_id"] == pick.segment_id)
            rows = self._live(self.store.read(segment["paths"], ADJACENCY), graph_id)
            self._put("blocks", graph_id, label_id, adjacency.compacted(self.table("blocks", graph_id, [label_id]), rows))
            segment["compacted"], segment["paths"] = True, []

    def _live(self, rows: DataFrame, graph_id: int) -> DataFrame:
        live = self.table("edges", graph_id).select(F.col("label_id").alias("edge_label"), F.col("id").alias("edge_id"))
        return rows.join(live, ["edge_label", "edge_id"], "left_semi")

    def adjacency(self, graph_id: int, label_id: int) -> DataFrame:
        """Live members of the label's vertices, from open segments and from blocks."""
        paths = [p for s in self.segments.get(f"{graph_id}/{label_id}", []) for p in s["paths"]]
        columns = ["owner_label", "owner_id", *adjacency.MEMBER]
        rows = self.store.read(paths, ADJACENCY).select(*columns)
        return self._live(rows.unionByName(adjacency.members(self.table("blocks", graph_id, [label_id])).select(*columns)), graph_id)

    # Text

    def vertex_texts(self, graph_id: int, label_ids: list[int] | None = None) -> DataFrame:
        """(label_id, id, vertex): the external text of each vertex."""
        names = F.broadcast(self.catalog.frame(graph_id, "v").select("label_id", "tokens", "annotation_map"))
        df = self.table("vertices", graph_id, label_ids).join(names, "label_id")
        label = render.vertex_label(F.col("tokens"), render.visible(F.col("annotation_map"), F.col("annotations")))
        return df.select("label_id", "id", render.vertex_text(F.col("id"), label, F.col("properties")).alias("vertex"))

    def edge_texts(self, graph_id: int, label_ids: list[int] | None = None) -> DataFrame:
        """(label_id, id, edge): the external text of each edge."""
        names = F.broadcast(self.catalog.frame(graph_id, "e").select("label_id", "tokens", "annotation_map"))
        df = self.table("edges", graph_id, label_ids).join(names, "label_id")
        label = render.edge_label(F.col("tokens"), render.visible(F.col("annotation_map"), F.col("annotations")))
        text = render.edge_text(*[F.col(c) for c in ("id", "start_label", "start_id", "end_label", "end_id")], label, F.col("properties"))
        return df.select("label_id", "id", text.alias("edge"))

    # Dictionaries

    def dictionary_log(self, graph_id: int, label_id: int, keys: list[str]) -> int:
        """Keeps a list of property names for a vertex label; its id there."""
        with self.transaction():
            n = self.catalog.next(f"dictionary/{graph_id}/{label_id}")
            self.catalog.dictionaries.append({"graph_id": graph_id, "label_id": label_id, "dict_id": n, "keys": list(keys)})
            return n

    def vertex_set_dictionary(self, graph_id: int, label_id: int, id_: int, dict_id: int) -> None:
        """Sets a vertex's dictionary; an unknown one changes nothing, a second one is an error."""
        row = self._one("vertices", graph_id, label_id, id_, "v").first()
        if row.dictionary_id:
            raise ValueError("dictionary is already set")
        if not any((d["graph_id"], d["label_id"], d["dict_id"]) == (graph_id, label_id, dict_id) for d in self.catalog.dictionaries):
            return
        with self.transaction():
            table = self.table("vertices", graph_id, [label_id])
            new = F.when(F.col("id") == id_, F.lit(dict_id).cast("short")).otherwise(F.col("dictionary_id"))
            self._put("vertices", graph_id, label_id, table.withColumn("dictionary_id", new))

    def dump(self) -> str:
        """The catalog as JSON, for a look at it."""
        return json.dumps(self.catalog.state(), indent=1)


def _split(ddl: str) -> list[str]:
    """Columns of a schema string, commas inside types aside."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
