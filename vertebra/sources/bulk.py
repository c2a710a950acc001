"""The shared tables as a graph: a view, nothing is written."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label ids and paths of the view.
VERTEX_LABELS = {1: "_", 2: "_.place", 3: "_.place.region", 4: "_.place.nation", 5: "_.party", 6: "_.party.customer", 7: "_.party.supplier", 8: "_.thing.part", 9: "_.thing.order"}
EDGE_LABELS = {1: "_", 2: "_.in", 3: "_.in.nation", 4: "_.in.region", 5: "_.placed", 6: "_.contains", 7: "_.supplied"}


@dataclass
class GraphView:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def labels(self, kind: str) -> DataFrame:
        """Labels of the view; half of the parties' annotations are for the schema operators to work on."""
        maps = {5: ["ACTIVE", "VIP"], 6: ["ACTIVE", "VIP", "DEBTOR"], 7: ["ACTIVE"], 9: ["OPEN", "FILLED"]} if kind == "v" else {5: ["URGENT"], 6: ["RETURNED"]}
        rows = [(1, kind, i, p.split("."), maps.get(i), True) for i, p in (VERTEX_LABELS if kind == "v" else EDGE_LABELS).items()]
        return self.spark.createDataFrame(rows, "graph_id int, kind string, label_id int, tokens array<string>, annotation_map array<string>, is_primary boolean")

    def vertices(self, *label_ids: int) -> DataFrame:
        """Vertices of some labels (all: none given). Ids are keys + 1. Properties are canonical object text."""
        text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
        made = {
            3: ("region", "r_regionkey", [("name", text("r_name"))], None),
            4: ("nation", "n_nationkey", [("name", text("n_name"))], None),
            6: ("customer", "c_custkey", [("name", text("c_name")), ("segment", text("c_mktsegment"))], F.when(F.col("c_acctbal") < 0, F.array(F.lit("DEBTOR"))).when(F.col("c_acctbal") > 9000, F.array(F.lit("ACTIVE"), F.lit("VIP"))).otherwise(F.array(F.lit("ACTIVE")))),
            7: ("supplier", "s_suppkey", [("name", text("s_name"))], F.array(F.lit("ACTIVE"))),
            8: ("part", "p_partkey", [("name", text("p_name")), ("size", F.col("p_size").cast("string")), ("brand", text("p_brand"))], None),
            9: ("orders", "o_orderkey", [("status", text("o_orderstatus")), ("priority", text("o_orderpriority"))], F.when(F.col("o_orderstatus") == "O", F.array(F.lit("OPEN"))).otherwise(F.array(F.lit("FILLED")))),
        }
        return _union(
            self.table(t).select(F.lit(1).alias("graph_id"), F.lit(n).alias("label_id"), (F.col(k) + 1).cast("long").alias("id"), F.lit(None).cast("short").alias("dictionary_id"), _object(p).alias("properties"), (F.lit(None) if a is None else a).cast("array<string>").alias("annotations"))
            for n, (t, k, p, a) in made.items() if not label_ids or n in label_ids
        )

    def edges(self, *label_ids: int) -> DataFrame:
        """Edges of some labels: 3 customers and suppliers in nations, 4 nations in regions, 5 orders placed, 6 their parts, 7 their suppliers.

        Ids: 3 even numbers for customers and odd ones for suppliers; 6 and 7 order key * 8 + line number, which
        repeat where the table's lines do.
        """
        c, s, n, o, li = (self.table(t) for t in ("customer", "supplier", "nation", "orders", "lineitem"))
        line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
        made = {
            3: [(c, F.col("c_custkey") * 2 + 2, 6, "c_custkey", 4, "c_nationkey", None), (s, F.col("s_suppkey") * 2 + 1, 7, "s_suppkey", 4, "s_nationkey", None)],
            4: [(n, F.col("n_nationkey") + 1, 4, "n_nationkey", 3, "n_regionkey", None)],
            5: [(o, F.col("o_orderkey") + 1, 6, "o_custkey", 9, "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("URGENT"))))],
            6: [(li, line, 9, "l_orderkey", 8, "l_partkey", F.when(F.col("l_returnflag") == "R", F.array(F.lit("RETURNED"))))],
            7: [(li, line, 9, "l_orderkey", 7, "l_suppkey", None)],
        }
        return _union(
            t.select(F.lit(1).alias("graph_id"), F.lit(label).alias("label_id"), i.cast("long").alias("id"), F.lit(None).cast("short").alias("dictionary_id"), F.lit(a).alias("start_label"), (F.col(ak) + 1).cast("long").alias("start_id"), F.lit(b).alias("end_label"), (F.col(bk) + 1).cast("long").alias("end_id"), F.lit("{}").alias("properties"), (F.lit(None) if ann is None else ann).cast("array<string>").alias("annotations"))
            for label, parts in made.items() if not label_ids or label in label_ids for t, i, a, ak, b, bk, ann in parts
        )


def _object(fields: list[tuple[str, Column]]) -> Column:
    parts = []
    for i, (k, v) in enumerate(sorted(fields, key=lambda f: (len(f[0]), f[0]))):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{k}": '), v]
    return F.concat(*parts, F.lit("}"))


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
