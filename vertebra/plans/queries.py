"""One query per graph operator over the tables' graph view, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertebra.functions import gtype, render
from vertebra.operators import adjacency, annotations, entities, labels, traverse
from vertebra.sources.bulk import EDGE_LABELS, VERTEX_LABELS, GraphView
from vertebra.sources.store import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a function of the graph view under its name, with its SQL."""

    def add(f: Callable[[GraphView], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(GraphView(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return add


def _sql_labels(paths: dict[int, str], maps: dict[int, list[str]]) -> str:
    rows = ", ".join(f"({i}, string_split('{p}', '.'), {maps.get(i, 'NULL::VARCHAR[]')}, true)" for i, p in paths.items())
    return f"WITH labels(label_id, tokens, annotation_map, is_primary) AS (VALUES {rows}) "


VL = _sql_labels(VERTEX_LABELS, {5: ["ACTIVE", "VIP"], 6: ["ACTIVE", "VIP", "DEBTOR"], 7: ["ACTIVE"], 9: ["OPEN", "FILLED"]})
EL = _sql_labels(EDGE_LABELS, {5: ["URGENT"], 6: ["RETURNED"]})
#: SQL of the view's tables.
CUSTOMERS = """(SELECT 6 AS label_id, c_custkey + 1 AS id, '{"name": "' || c_name || '", "segment": "' || c_mktsegment || '"}' AS properties,
  CASE WHEN c_acctbal < 0 THEN ['DEBTOR'] WHEN c_acctbal > 9000 THEN ['ACTIVE', 'VIP'] ELSE ['ACTIVE'] END AS annotations FROM customer)"""
PLACED = "(SELECT o_orderkey + 1 AS id, o_custkey + 1 AS start_id, o_orderkey + 1 AS end_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' ELSE '' END AS ann FROM orders)"
CONTAINS = "(SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey + 1 AS start_id, l_partkey + 1 AS end_id FROM lineitem)"


def _flat(df: DataFrame) -> DataFrame:
    """Labels with lists as text."""
    return df.select("label_id", F.array_join("tokens", ".").alias("path"), F.coalesce(F.array_join("annotation_map", ","), F.lit("-")).alias("names"), "is_primary")


FLAT = "SELECT label_id, array_to_string(tokens, '.') AS path, coalesce(array_to_string(annotation_map, ','), '-') AS names, is_primary FROM "


# Scans and text


@query(f"SELECT id, properties, array_to_string(annotations, ',') AS names FROM {CUSTOMERS}")
def scan_vertices_by_label(g: GraphView) -> DataFrame:
    return g.vertices(6).select("id", "properties", F.array_join("annotations", ",").alias("names"))


@query(f"SELECT id, properties FROM {CUSTOMERS} WHERE id = 78")
def point_lookup_vertex(g: GraphView) -> DataFrame:
    return g.vertices(6).where((F.col("label_id") == 6) & (F.col("id") == 78)).select("id", "properties")


@query("SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey + 1 AS start_id, l_suppkey + 1 AS end_id FROM lineitem")
def scan_edges_by_label(g: GraphView) -> DataFrame:
    return traverse.scan(g.edges(7), 7).select("id", "start_id", "end_id")


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS slot, c_custkey + 1 AS id FROM customer")
def map_slots(g: GraphView) -> DataFrame:
    return entities.numbered(g.vertices(6).select("label_id", "id"), "label_id", ["id"], out="slot").select("slot", "id")


@query(f"""SELECT id, '{{"id": ' || id || ', "label": "party:customer:' || array_to_string(annotations, ':') || '", "properties": ' || properties || '}}' AS vertex FROM {CUSTOMERS}""")
def vertex_build_render(g: GraphView) -> DataFrame:
    names = F.broadcast(g.labels("v").select("label_id", "tokens", "annotation_map"))
    label = render.vertex_label(F.col("tokens"), render.visible(F.col("annotation_map"), F.col("annotations")))
    return g.vertices(6).join(names, "label_id").select("id", render.vertex_text(F.col("id"), label, F.col("properties")).alias("vertex"))


@query(f"""SELECT id, '{{"id": ' || id || ', "start_vertex": (6,' || start_id || '), "edge_vertex": (9,' || end_id || '), "label": "placed' || CASE WHEN ann = '' THEN '' ELSE ':' || ann END || '", "properties": {{}}}}' AS edge FROM {PLACED}""")
def edge_build_render(g: GraphView) -> DataFrame:
    names = F.broadcast(g.labels("e").select("label_id", "tokens", "annotation_map"))
    label = render.edge_label(F.col("tokens"), render.visible(F.col("annotation_map"), F.col("annotations")))
    text = render.edge_text(*[F.col(c) for c in ("id", "start_label", "start_id", "end_label", "end_id")], label, F.col("properties"))
    return g.edges(5).join(names, "label_id").select("id", text.alias("edge"))


@query("SELECT o_orderkey + 1 AS id, 5 AS label_id, 6 AS start_label, o_custkey + 1 AS start_id, 9 AS end_label, o_orderkey + 1 AS end_id FROM orders")
def edge_struct_build(g: GraphView) -> DataFrame:
    o = g.table("orders")
    v = lambda label, key: render.vertex_build(F.col(key) + 1, F.lit(1), F.lit(label), F.lit(0))
    e = render.edge_build(F.col("o_orderkey") + 1, F.lit(1), F.lit(5), F.lit(0), v(6, "o_custkey"), v(9, "o_orderkey"))
    return o.select(e.alias("e")).select("e.id", "e.label_id", "e.start_label", "e.start_id", "e.end_label", "e.end_id")


@query("""SELECT p_partkey + 1 AS id, 'dict{' || (p_partkey % 3) || '}["' || p_brand || '", "' || p_type || '"]' AS dict FROM part""")
def dictionary_render(g: GraphView) -> DataFrame:
    return g.table("part").select((F.col("p_partkey") + 1).alias("id"), render.dictionary_text(F.col("p_partkey") % 3, F.array("p_brand", "p_type")).alias("dict"))


@query("SELECT p_partkey + 1 AS id, p_brand AS first, p_type AS second, true AS third_is_null FROM part")
def dictionary_encode(g: GraphView) -> DataFrame:
    props = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
    values = render.dictionary_values(props, F.array(F.lit("brand"), F.lit("type"), F.lit("gone")))
    return g.table("part").select((F.col("p_partkey") + 1).alias("id"), values.alias("v")).select("id", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"), F.col("v")[2].isNull().alias("third_is_null"))


# Values

#: Literals and their canonical text, or null where the text is no value.
LITERALS = [
    ("42", "42"), ("-9876543210", "-9876543210"), ("3.14159", "3.14159"), ("-0.0000001", "-1e-07"), ("1.23456789e10", "12345678900"), ("true", "true"), ("null", "null"),
    ('"hello world"', '"hello world"'), ('{"name": "Alice", "age": 30}', '{"age": 30, "name": "Alice"}'), ('{"bool": true, "nullval": null, "float": 3.14}', '{"bool": true, "float": 3.14, "nullval": null}'),
    ("[1,2,[3]]", "[1, 2, [3]]"), ("127.0.0.1", "127.0.0.1"), ("192.168.1.1/24", "192.168.1.1/24"), ("-0", "0"), ("1e-10", "1e-10"), ("NaN", "NaN"), ("Infinity", "Infinity"),
    ("42::int", "42"), ("3.14::float", "3.14"), ('"text"::text', '"text"'), ('"12/31/1971"::date', "1971-12-31"), ("1.50::numeric", "1.50"), ("invalid", None), ("{broken: json}", None), ("1::bool", None), ('{"a": 1, "a": 2}', '{"a": 2}'),
]
_LITERAL_SQL = ", ".join(f"('{a}', {'NULL' if b is None else repr(b) if chr(39) not in b else b})" for a, b in LITERALS)


@query(f"SELECT input, canon FROM (VALUES {_LITERAL_SQL}) t(input, canon)")
def gtype_literals(g: GraphView) -> DataFrame:
    return g.spark.createDataFrame([(a,) for a, _ in LITERALS], "input string").select("input", gtype.parsed(F.col("input"))["canon"].alias("canon"))


@query("""SELECT event_id, '{"k": ' || (props::JSON ->> 'k') || ', "type": "' || event_type || '"}' AS canon FROM events""")
def gtype_object_key_order(g: GraphView) -> DataFrame:
    text = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return g.table("events").select("event_id", gtype.parsed(text)["canon"].alias("canon"))


@query("SELECT (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def gtype_property_get(g: GraphView) -> DataFrame:
    return g.table("events").select(gtype.property_of(gtype.plain_variant(F.col("props")), "$.k", "long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


# Labels


@query(VL + "SELECT label_id FROM labels WHERE list_has_all(tokens, ['party', 'customer']) AND is_primary")
def label_match_and(g: GraphView) -> DataFrame:
    return labels.matches_all(g.labels("v"), ["party", "customer"]).select("label_id")


@query(VL + "SELECT label_id FROM labels WHERE list_has_any(tokens, ['place', 'order']) AND is_primary")
def label_match_or(g: GraphView) -> DataFrame:
    return labels.matches_any(g.labels("v"), ["place", "order"]).select("label_id")


@query(EL + "SELECT label_id FROM labels WHERE list_has_all(tokens, ['in']) AND is_primary")
def elabel_match_and(g: GraphView) -> DataFrame:
    return labels.matches_all(g.labels("e"), ["in"]).select("label_id")


@query(EL + "SELECT label_id FROM labels WHERE list_has_any(tokens, ['nation', 'supplied']) AND is_primary")
def elabel_match_or(g: GraphView) -> DataFrame:
    return labels.matches_any(g.labels("e"), ["nation", "supplied"]).select("label_id")


@query(VL + "SELECT p.label_id AS parent, c.label_id AS child, '_.' || array_to_string(p.tokens[2:] || c.tokens[2:], '.') AS path FROM labels p, labels c WHERE p.label_id IN (2, 5) AND c.label_id IN (3, 6)")
def label_merge(g: GraphView) -> DataFrame:
    p = g.labels("v").where("label_id in (2, 5)").select(F.col("label_id").alias("parent"), F.col("tokens").alias("pt"))
    c = g.labels("v").where("label_id in (3, 6)").select(F.col("label_id").alias("child"), F.col("tokens").alias("ct"))
    return p.crossJoin(c).select("parent", "child", F.array_join(labels.merged_tokens(F.col("pt"), F.col("ct")), ".").alias("path"))


_DROP = "SELECT label_id, coalesce(nullif(array_to_string(list_filter(tokens, lambda x: x <> '{0}'), '.'), ''), '_') AS path, coalesce(array_to_string(annotation_map, ','), '-') AS names, NOT coalesce(tokens[-1] = '{0}', false) AS is_primary FROM labels"


@query(VL + _DROP.format("customer"))
def label_drop_leaf(g: GraphView) -> DataFrame:
    return _flat(labels.dropped(g.labels("v"), "customer"))


@query(VL + _DROP.format("place"))
def label_drop_inner(g: GraphView) -> DataFrame:
    return _flat(labels.dropped(g.labels("v"), "place"))


@query(VL + "SELECT label_id FROM labels WHERE list_has_all(tokens, ['_']) AND tokens[-1] <> 'place'")
def label_match_after_drop(g: GraphView) -> DataFrame:
    return labels.matches_all(labels.dropped(g.labels("v"), "place"), ["_"]).select("label_id")


@query(EL + FLAT + "(SELECT label_id, list_transform(tokens, lambda x: CASE WHEN x = 'in' THEN 'within' ELSE x END) AS tokens, annotation_map, is_primary FROM labels)")
def label_rename(g: GraphView) -> DataFrame:
    return _flat(labels.renamed(g.labels("e"), "in", "within"))


@query(VL + "SELECT label_id FROM labels WHERE tokens[1:2] = ['_', 'party']")
def label_descendants(g: GraphView) -> DataFrame:
    return g.labels("v").where(labels.descends(F.col("tokens"), ["_", "party"])).select("label_id")


@query(VL + "SELECT min(label_id) AS label_id FROM labels WHERE array_to_string(tokens, '.') = '_.party.supplier'")
def label_by_path(g: GraphView) -> DataFrame:
    return labels.by_path(g.labels("v"), "party.supplier")


# Annotations


@query(VL + FLAT + "(SELECT label_id, tokens, is_primary, CASE WHEN tokens[2] = 'party' THEN coalesce(annotation_map, []) || ['NEW'] ELSE annotation_map END AS annotation_map FROM labels)")
def annotation_add_cascade(g: GraphView) -> DataFrame:
    return _flat(annotations.added(g.labels("v"), "party", "NEW"))


@query(VL + FLAT + "(SELECT label_id, tokens, is_primary, CASE WHEN tokens[2] = 'party' THEN list_filter(annotation_map, lambda x: x <> 'ACTIVE') ELSE annotation_map END AS annotation_map FROM labels)")
def annotation_drop_owned(g: GraphView) -> DataFrame:
    return _flat(annotations.removed(g.labels("v"), "party", "ACTIVE"))


@query(f"SELECT id, CASE WHEN list_contains(annotations, 'DEBTOR') THEN '04' WHEN list_contains(annotations, 'VIP') THEN '03' ELSE '01' END AS bits FROM {CUSTOMERS}")
def annotation_encode(g: GraphView) -> DataFrame:
    names = F.broadcast(g.labels("v").select("label_id", "annotation_map"))
    return g.vertices(6).join(names, "label_id").select("id", annotations.bits(F.col("annotation_map"), F.col("annotations")).alias("bits"))


@query("SELECT c_custkey + 1 AS id, array_to_string(list_filter(['ACTIVE', 'VIP', 'DEBTOR'], lambda x, i: (c_custkey >> (i - 1)) & 1 = 1), ',') AS names FROM customer")
def annotation_decode(g: GraphView) -> DataFrame:
    names = F.broadcast(g.labels("v").select("label_id", "annotation_map"))
    df = g.vertices(6).join(names, "label_id")
    return df.select("id", F.array_join(annotations.names(F.col("annotation_map"), F.col("id") - 1), ",").alias("names"))


@query(f"SELECT id, array_to_string(CASE WHEN id % 5 = 0 AND NOT list_contains(annotations, 'VIP') THEN annotations || ['VIP'] ELSE annotations END, ',') AS names FROM {CUSTOMERS}")
def vertex_add_annotation(g: GraphView) -> DataFrame:
    return annotations.annotated(g.vertices(6), F.col("id") % 5 == 0, "VIP").select("id", F.array_join("annotations", ",").alias("names"))


@query(f"SELECT id, array_to_string(CASE WHEN id % 2 = 0 THEN list_filter(annotations, lambda x: x <> 'ACTIVE') ELSE annotations END, ',') AS names FROM {CUSTOMERS}")
def vertex_remove_annotation(g: GraphView) -> DataFrame:
    return annotations.unannotated(g.vertices(6), F.col("id") % 2 == 0, "ACTIVE").select("id", F.array_join("annotations", ",").alias("names"))


@query(f"SELECT id, CASE WHEN start_id % 7 = 0 THEN 'URGENT' ELSE ann END AS names FROM {PLACED}")
def edge_add_annotation(g: GraphView) -> DataFrame:
    return annotations.annotated(g.edges(5), F.col("start_id") % 7 == 0, "URGENT").select("id", F.coalesce(F.array_join("annotations", ","), F.lit("")).alias("names"))


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN '' ELSE ann END AS names FROM {PLACED}")
def edge_remove_annotation(g: GraphView) -> DataFrame:
    return annotations.unannotated(g.edges(5), F.col("id") % 2 == 0, "URGENT").select("id", F.coalesce(F.array_join("annotations", ","), F.lit("")).alias("names"))


@query("SELECT o_orderkey + 1 AS id, 'OPEN' AS bad FROM orders WHERE o_orderstatus = 'O'")
def unknown_annotation_check(g: GraphView) -> DataFrame:
    maps = g.labels("v").withColumn("annotation_map", F.array(F.lit("FILLED")))
    return entities.unknown_annotations(g.vertices(9), maps).select("id", "bad")


# Vertices and edges


@query("""SELECT 'old' AS part, count(*) AS n, sum(s_suppkey + 1)::BIGINT AS ids FROM supplier
UNION ALL SELECT 'new', count(*), sum(r + (SELECT max(s_suppkey + 1) FROM supplier))::BIGINT FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS r FROM nation)""")
def insert_vertex_append(g: GraphView) -> DataFrame:
    old = g.vertices(7)
    start = old.groupBy("label_id").agg(F.max("id").alias("start"))
    new = g.table("nation").select(F.lit(1).alias("graph_id"), F.lit(7).alias("label_id"), "n_nationkey", F.concat(F.lit('{"name": "'), "n_name", F.lit('"}')).alias("properties"))
    new = entities.numbered(new, "label_id", ["n_nationkey"], start).drop("n_nationkey")
    both = entities.appended(old, new.withColumn("annotations", F.array(F.lit("new"))))
    part = F.when(F.array_contains("annotations", "new"), "new").otherwise("old")
    return both.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("SELECT 1000 + r AS id, a AS start_id, b AS end_id FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS r, n_nationkey + 1 AS a, n_regionkey + 1 AS b FROM nation) UNION ALL SELECT n_nationkey + 1, n_nationkey + 1, n_regionkey + 1 FROM nation")
def insert_edge_append(g: GraphView) -> DataFrame:
    old = g.edges(4)
    start = g.spark.createDataFrame([(4, 1000)], "label_id int, start long")
    new = entities.numbered(old.drop("id"), "label_id", ["start_id"], start)
    return entities.appended(old, new).select("id", "start_id", "end_id")


@query("SELECT n_nationkey + 1 AS id, n_regionkey + 1 AS end_id FROM nation WHERE n_regionkey >= 3")
def neighbors_left_anti(g: GraphView) -> DataFrame:
    some = g.vertices(3, 4).where("label_id = 4 or id <= 3")
    return entities.dangling(g.edges(4), some).select("id", "end_id")


@query(f"""SELECT id, CASE WHEN id % 10 = 0 THEN '{{"gone": true}}' ELSE properties END AS properties, array_to_string(annotations, ',') AS names FROM {CUSTOMERS}""")
def update_vertex_props(g: GraphView) -> DataFrame:
    v = g.vertices(6)
    change = v.where("id % 10 = 0").select("graph_id", "label_id", "id", F.lit('{"gone": true}').alias("properties"))
    return entities.updated(v, change).select("id", "properties", F.array_join("annotations", ",").alias("names"))


@query(f"""SELECT id, CASE WHEN start_id % 4 = 0 THEN '{{"late": ' || start_id || '}}' ELSE '{{}}' END AS properties FROM {PLACED}""")
def update_edge_props(g: GraphView) -> DataFrame:
    e = g.edges(5)
    change = e.where("start_id % 4 = 0").select("graph_id", "label_id", "id", F.concat(F.lit('{"late": '), "start_id", F.lit("}")).alias("properties"))
    return entities.updated(e, change).select("id", "properties")


@query(f"SELECT id, start_id, end_id FROM {PLACED} WHERE id % 3 <> 0")
def delete_edge(g: GraphView) -> DataFrame:
    e = g.edges(5)
    return entities.deleted(e, e.where("id % 3 = 0")).select("id", "start_id", "end_id")


@query(f"SELECT id FROM {CUSTOMERS} c WHERE id % 2 = 1 OR EXISTS (SELECT 1 FROM {PLACED} o WHERE o.start_id = c.id)")
def delete_vertex_restrict(g: GraphView) -> DataFrame:
    v, e = g.vertices(6), g.edges(5)
    asked = v.where("id % 2 = 0")
    held = entities.incident(e, asked).select("graph_id", F.col("start_label").alias("label_id"), F.col("start_id").alias("id"))
    free = entities.deleted(asked, held)
    left, _ = entities.without_vertices(v, e, free)
    return left.select("id")


@query(f"SELECT 'v' AS kind, count(*) AS n FROM {CUSTOMERS} WHERE id % 4 <> 0 UNION ALL SELECT 'e', count(*) FROM {PLACED} WHERE start_id % 4 <> 0")
def delete_vertex_detach(g: GraphView) -> DataFrame:
    v, e = entities.without_vertices(g.vertices(6), g.edges(5), g.vertices(6).where("id % 4 = 0"), detach=True)
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return count(v, "v").unionByName(count(e, "e"))


_MOVE = f"(SELECT id, 100 + row_number() OVER (ORDER BY id) AS new_id FROM {CUSTOMERS} WHERE id % 3 = 0)"


@query(f"SELECT e.id, CASE WHEN m.id IS NULL THEN 6 ELSE 20 END AS start_label, coalesce(m.new_id, e.start_id) AS start_id, e.end_id FROM {PLACED} e LEFT JOIN {_MOVE} m ON m.id = e.start_id")
def set_vertex_label_migrate(g: GraphView) -> DataFrame:
    v = g.vertices(6)
    start = g.spark.createDataFrame([(20, 100)], "new_label int, start long")
    moves = entities.moved(v, v.where("id % 3 = 0").select(*entities.KEY, F.lit(20).alias("new_label")), start)
    return entities.migrated(g.edges(5), moves).select("id", "start_label", "start_id", "end_id")


@query(f"SELECT CASE WHEN m.id IS NULL THEN 6 ELSE 20 END AS label_id, coalesce(m.new_id, c.id) AS id, c.properties FROM {CUSTOMERS} c LEFT JOIN {_MOVE} m USING (id)")
def remove_vertex_label_migrate(g: GraphView) -> DataFrame:
    v = g.vertices(6)
    start = g.spark.createDataFrame([(20, 100)], "new_label int, start long")
    moves = entities.moved(v, v.where("id % 3 = 0").select(*entities.KEY, F.lit(20).alias("new_label")), start)
    return entities.relabelled(v, moves).select("label_id", "id", "properties")


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN 8 ELSE 5 END AS label_id, ann AS names FROM {PLACED}")
def set_edge_label(g: GraphView) -> DataFrame:
    return entities.edges_relabelled(g.edges(5), F.col("id") % 2 == 0, 8).select("id", "label_id", F.coalesce(F.array_join("annotations", ","), F.lit("")).alias("names"))


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE 5 END AS label_id, CASE WHEN id % 2 = 0 THEN '' ELSE ann END AS names FROM {PLACED}")
def remove_edge_label(g: GraphView) -> DataFrame:
    return entities.edges_relabelled(g.edges(5), F.col("id") % 2 == 0, 1, []).select("id", "label_id", F.coalesce(F.array_join("annotations", ","), F.lit("")).alias("names"))


@query("""SELECT 'insert' AS op, n_nationkey + 1 AS id, '{"name": "' || n_name || '"}' AS properties FROM nation WHERE n_nationkey = 24
UNION ALL SELECT 'delete', n_nationkey + 1, '{"name": "' || n_name || '"}' FROM nation WHERE n_nationkey = 0
UNION ALL SELECT 'update', n_nationkey + 1, '{}' FROM nation WHERE n_nationkey = 5""")
def change_feed(g: GraphView) -> DataFrame:
    v = g.vertices(4)
    after = v.where("id > 1").withColumn("properties", F.when(F.col("id") == 6, "{}").otherwise(F.col("properties")))
    return changes(v.where("id < 25"), after, entities.KEY).select("op", "id", "properties")


# Adjacency


@query(f"SELECT 6 AS owner_label, start_id AS owner_id, 0 AS dir, id AS edge_id, end_id AS other_id FROM {PLACED} UNION ALL SELECT 9, end_id, 1, id, start_id FROM {PLACED}")
def adjacency_both_dirs(g: GraphView) -> DataFrame:
    return adjacency.both_ways(g.edges(5)).select("owner_label", "owner_id", "dir", "edge_id", "other_id")


@query(f"SELECT owner_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT start_id AS owner_id, 1 AS o, 0 AS i FROM {CONTAINS} UNION ALL SELECT end_id, 0, 1 FROM {PLACED}) GROUP BY 1")
def degree_in_out(g: GraphView) -> DataFrame:
    return adjacency.degrees(adjacency.both_ways(g.edges(5, 6))).where("owner_label = 9").select("owner_id", "out_degree", "in_degree")


@query("SELECT n_regionkey + 1 AS owner_id, string_agg(n_nationkey + 1, ',' ORDER BY n_nationkey DESC) AS members FROM nation GROUP BY 1")
def adjacency_compact_members(g: GraphView) -> DataFrame:
    stored = adjacency.blocks(adjacency.both_ways(g.edges(4).where("id <= 10")).where("dir = 1"))
    after = adjacency.compacted(stored, adjacency.both_ways(g.edges(4).where("id > 10")).where("dir = 1"))
    ids = F.transform(F.sort_array(F.transform("members", lambda m: m["edge_id"]), asc=False), lambda x: x.cast("string"))
    return after.select("owner_id", F.array_join(ids, ",").alias("members"))


@query("SELECT l_suppkey + 1 AS owner_id, (r // 155)::INTEGER AS block, count(*) AS n FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey) - 1 AS r FROM lineitem) GROUP BY 1, 2")
def adjacency_blocks_155(g: GraphView) -> DataFrame:
    both = adjacency.both_ways(g.edges(7)).where("dir = 1")
    return adjacency.blocks(both).select("owner_id", "block", F.size("members").cast("long").alias("n"))


@query("SELECT * FROM (VALUES (2, 1, false, true), (2, 2, false, false), (2, 3, true, false)) t(label_id, segment_id, active, compacted)")
def segment_rotation_state(g: GraphView) -> DataFrame:
    s = g.spark.createDataFrame([(2, 1, False, True), (2, 2, True, False)], "label_id int, segment_id int, active boolean, compacted boolean")
    return adjacency.rotated(s, 2)


# Traversal


@query("SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def customers_per_region(g: GraphView) -> DataFrame:
    adj = adjacency.both_ways(g.edges(3, 4))
    there = traverse.step(traverse.step(g.vertices(6).select("label_id", "id"), adj, edge_labels=[3]), adj, edge_labels=[4])
    per = there.groupBy("label_id", "id").agg(F.count(F.lit(1)).alias("n"))
    named = traverse.with_properties(per, g.vertices(3), "label_id", "id")
    return named.select(gtype.property_of(gtype.plain_variant(F.col("properties")), "$.name", "string").alias("r_name"), "n")


@query(f"SELECT id, start_id, end_id FROM {PLACED} WHERE start_id <= 50")
def expand_one_hop(g: GraphView) -> DataFrame:
    start = g.vertices(6).where("id <= 50").select("label_id", "id")
    out = traverse.expand(start, adjacency.both_ways(g.edges(5)))
    return out.select(F.col("edge_id").alias("id"), F.col("id").alias("start_id"), F.col("other_id").alias("end_id"))


@query("SELECT o_custkey + 1 AS customer, l_partkey + 1 AS part, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey < 100 GROUP BY 1, 2")
def expand_two_hop(g: GraphView) -> DataFrame:
    start = g.vertices(6).where("id <= 100").select("label_id", "id", F.col("id").alias("customer"))
    there = traverse.step(traverse.step(start, adjacency.both_ways(g.edges(5))), adjacency.both_ways(g.edges(6)))
    return there.groupBy("customer", F.col("id").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey + 1 AS id, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def expand_other_label_filter(g: GraphView) -> DataFrame:
    start = g.vertices(4).select("label_id", "id")
    out = traverse.expand(start, adjacency.both_ways(g.edges(3)), direction=1, other_labels=[7])
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey + 1 AS from_id, l_suppkey + 1 AS to_id, count(*) AS paths FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def meet_in_the_middle(g: GraphView) -> DataFrame:
    paths = traverse.meet(traverse.scan(g.edges(5), 5), traverse.scan(g.edges(7), 7))
    return paths.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("paths"))


@query("SELECT l_orderkey + 1 AS order_id, l_partkey + 1 AS part_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45 AND l_orderkey < 500")
def lazy_property_filter(g: GraphView) -> DataFrame:
    some = traverse.expand(g.vertices(9).where("id <= 500").select("label_id", "id"), adjacency.both_ways(g.edges(6)))
    rows = traverse.with_properties(some.select(F.col("id").alias("order_id"), "other_label", "other_id"), g.vertices(8), "other_label", "other_id")
    big = gtype.property_of(gtype.plain_variant(F.col("properties")), "$.size", "int") > 45
    return rows.where(big).select("order_id", F.col("other_id").alias("part_id"))


@query("""WITH RECURSIVE e AS (
  SELECT 6000000000 + c_custkey AS a, 4000000000 + c_nationkey AS b FROM customer WHERE c_custkey < 5
  UNION ALL SELECT 4000000000 + n_nationkey, 3000000000 + n_regionkey FROM nation UNION ALL SELECT 7000000000 + s_suppkey, 4000000000 + s_nationkey FROM supplier WHERE s_suppkey < 10),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, steps) AS (SELECT 6000000000::BIGINT, 0 UNION SELECT u.b, steps + 1 FROM r JOIN u ON u.a = r.v WHERE steps < 4)
SELECT (v // 1000000000)::INTEGER AS label_id, v % 1000000000 + 1 AS id, min(steps)::INTEGER AS steps FROM r GROUP BY 1, 2""")
def var_length_reachability(g: GraphView) -> DataFrame:
    e = g.edges(3, 4).where("label_id = 4 or (start_label = 6 and start_id <= 5) or (start_label = 7 and start_id <= 10)")
    return traverse.reachable(g.vertices(6).where("id = 1"), adjacency.both_ways(e), 4, direction=None)


# The four traversals above whose SQL starts from few ids, from all vertices and over all edges


@query(f"SELECT id, start_id, end_id FROM {PLACED}")
def expand_one_hop_all(g: GraphView) -> DataFrame:
    out = traverse.expand(g.vertices(6).select("label_id", "id"), adjacency.both_ways(g.edges(5)))
    return out.select(F.col("edge_id").alias("id"), F.col("id").alias("start_id"), F.col("other_id").alias("end_id"))


@query("SELECT o_custkey + 1 AS customer, l_partkey + 1 AS part, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def expand_two_hop_all(g: GraphView) -> DataFrame:
    start = g.vertices(6).select("label_id", "id", F.col("id").alias("customer"))
    there = traverse.step(traverse.step(start, adjacency.both_ways(g.edges(5))), adjacency.both_ways(g.edges(6)))
    return there.groupBy("customer", F.col("id").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey + 1 AS order_id, l_partkey + 1 AS part_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45")
def lazy_property_filter_all(g: GraphView) -> DataFrame:
    every = traverse.expand(g.vertices(9).select("label_id", "id"), adjacency.both_ways(g.edges(6)))
    rows = traverse.with_properties(every.select(F.col("id").alias("order_id"), "other_label", "other_id"), g.vertices(8), "other_label", "other_id")
    big = gtype.property_of(gtype.plain_variant(F.col("properties")), "$.size", "int") > 45
    return rows.where(big).select("order_id", F.col("other_id").alias("part_id"))


@query("""WITH RECURSIVE e AS (
  SELECT 6000000000 + c_custkey AS a, 4000000000 + c_nationkey AS b FROM customer
  UNION ALL SELECT 4000000000 + n_nationkey, 3000000000 + n_regionkey FROM nation UNION ALL SELECT 7000000000 + s_suppkey, 4000000000 + s_nationkey FROM supplier),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, steps) AS (SELECT 6000000000::BIGINT, 0 UNION SELECT u.b, steps + 1 FROM r JOIN u ON u.a = r.v WHERE steps < 4)
SELECT (v // 1000000000)::INTEGER AS label_id, v % 1000000000 + 1 AS id, min(steps)::INTEGER AS steps FROM r GROUP BY 1, 2""")
def var_length_reachability_all(g: GraphView) -> DataFrame:
    return traverse.reachable(g.vertices(6).where("id = 1"), adjacency.both_ways(g.edges(3, 4)), 4, direction=None)


# Relational work over graph tables


@query(f"SELECT id, properties FROM {CUSTOMERS} WHERE id > 10 ORDER BY id DESC LIMIT 5")
def host_filter_sort_limit(g: GraphView) -> DataFrame:
    return g.vertices(6).where("id > 10").orderBy(F.desc("id")).limit(5).select("id", "properties")


@query("SELECT 3 AS label_id, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 4, count(*) FROM nation UNION ALL SELECT 5, count(*) FROM orders")
def host_count(g: GraphView) -> DataFrame:
    return g.edges(3, 4, 5).groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id FROM {CUSTOMERS} WHERE id = (SELECT max(start_id) FROM {PLACED})")
def host_scalar_subquery(g: GraphView) -> DataFrame:
    top = g.edges(5).agg(F.max("start_id").alias("id"))
    return g.vertices(6).join(F.broadcast(top), "id", "left_semi").select("id")


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def host_union(g: GraphView) -> DataFrame:
    name = gtype.property_of(gtype.plain_variant(F.col("properties")), "$.name", "string").alias("name")
    return g.vertices(3).select(name).union(g.vertices(4).select(name)).distinct()


@query(f"SELECT DISTINCT start_id FROM {PLACED}")
def host_distinct(g: GraphView) -> DataFrame:
    return g.edges(5).select("start_id").distinct()


@query("SELECT n_nationkey + 1 AS nation, r_regionkey + 1 AS region FROM nation, region WHERE n_regionkey = r_regionkey AND r_name < 'B'")
def host_cross_filter(g: GraphView) -> DataFrame:
    name = gtype.property_of(gtype.plain_variant(F.col("properties")), "$.name", "string")
    some = g.vertices(3).where(name < "B").select(F.col("id").alias("region"))
    e = g.edges(4).select(F.col("start_id").alias("nation"), F.col("end_id").alias("region"))
    return e.join(some, "region").select("nation", "region")
