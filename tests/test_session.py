import pytest
from pyspark.sql import functions as F

from vertebra.sources.session import GraphSession


@pytest.fixture
def session(spark, tmp_path):
    return GraphSession(spark, str(tmp_path / "g"))


def labels(s, g, kind="v"):
    return {r["label_id"]: (".".join(r["tokens"]), r["annotation_map"], r["is_primary"]) for r in s.catalog.labels if (r["graph_id"], r["kind"]) == (g, kind)}


def paths(s, g, kind="v"):
    return {i: p for i, (p, _, _) in labels(s, g, kind).items()}


def test_graph_catalog(session):
    s = session
    g = s.ddl("create_graph", "인간 graph")
    long = s.ddl("create_graph", "x" * 66, "other")
    assert s.catalog.graphs[str(long)]["name"] == "x" * 63
    with pytest.raises(ValueError, match="already exists"):
        s.ddl("create_graph", "인간 graph")
    assert s.ddl("alter_graph", "인간 graph", "other") == 2 and s.ddl("alter_graph", "인간 graph", "other", "other") == 0
    s.ddl("rename_graph", "인간 graph", "people", "other")
    with pytest.raises(ValueError, match='graph "people" already exists'):
        s.ddl("rename_graph", "x" * 63, "people", "other")
    assert s.ddl("drop_graph", "people", "other") == g
    with pytest.raises(ValueError, match="does not exist"):
        s.ddl("drop_graph", "people", "other")
    again = GraphSession(s.spark, s.store.root)
    assert again.version == s.version and list(again.catalog.graphs) == [str(long)]


def test_label_algebra(session):
    s = session
    g = s.ddl("create_graph", "g")
    for name in ("person", "software", "employee"):
        s.ddl("create_vlabel", "g", name)
    s.ddl("merge", "v", "g", 2, 4)
    s.ddl("create_vlabel", "g", "engineer")
    s.ddl("merge", "v", "g", 5, 6)
    s.ddl("create_vlabel", "g", "contractor")
    s.ddl("merge", "v", "g", 2, 8)
    assert paths(s, g) == {1: "_", 2: "_.person", 3: "_.software", 4: "_.employee", 5: "_.person.employee", 6: "_.engineer", 7: "_.person.employee.engineer", 8: "_.contractor", 9: "_.person.contractor"}
    ids = s.catalog.label_ids
    assert ids("v", "g", ["employee"]) == [4, 5, 7] and ids("v", "g", ["person", "engineer"]) == [7] and ids("v", "g", ["manager"]) == []
    assert ids("v", "g", ["engineer", "software"], any_of=True) == [3, 6, 7] and ids("v", "g", ["engineer", None, "janitor"], any_of=True) == [6, 7]
    for wanted, text in (([], "must not be empty"), (None, "must not be NULL")):
        with pytest.raises(ValueError, match=text):
            ids("v", "g", wanted)
    assert s.ddl("rename_label", "v", "g", "employee", "staff") == 3
    assert paths(s, g)[7] == "_.person.staff.engineer" and "staff" in s.catalog.registry[str(g)]
    for old, new, text in (("gone", "x", "does not exist"), ("person", "staff", "already exists"), ("a.b", "c", "dots"), ("", "c", "empty")):
        with pytest.raises(ValueError, match=text):
            s.ddl("rename_label", "v", "g", old, new)
    with pytest.raises(ValueError, match="dots"):
        s.ddl("create_vlabel", "g", "a.b")
    e = s.ddl("create_elabel", "g", "knows.well")
    assert paths(s, g, "e")[e] == "_.knows.well"


def test_hierarchical_drop(session):
    s = session
    g = s.ddl("create_graph", "g")
    for name in ("entity", "organization", "department"):
        s.ddl("create_vlabel", "g", name)
    s.ddl("merge", "v", "g", 2, 3)
    s.ddl("merge", "v", "g", 5, 4)
    s.insert_vertex(g, 6, '{"name": "Engineering"}')
    assert s.ddl("drop_label", "v", "g", "department") == 2
    assert labels(s, g)[4] == ("_", None, False) and labels(s, g)[6] == ("_.entity.organization", None, False)
    assert s.ddl("add_annotation", "g", "entity", "Archived") == 3
    s.annotate("v", g, 6, 1, "Archived")
    s.ddl("drop_annotation", "g", "entity", "Archived")
    assert labels(s, g)[6][1] == []
    s.ddl("add_annotation", "g", "entity", "Archived")
    assert s.ddl("drop_label", "v", "g", "organization") == 3 and s.ddl("drop_label", "v", "g", "entity") == 3
    assert s.ddl("drop_label", "v", "g", "nothing") == 0
    assert s.vertex_texts(g).first().vertex == '{"id": 1, "label": "Archived", "properties": {"name": "Engineering"}}'


def test_entities(session):
    s = session
    g = s.ddl("create_graph", "g")
    p = s.ddl("create_vlabel", "g", "person", ["EMPLOYED", "FREE"])
    a, b = s.insert_vertex(g, p, '{"name": "Alice"}', ["EMPLOYED"]), s.insert_vertex(g, p, '{"name": "Bob", "age": 30}', ["FREE"])
    assert (a, b) == (1, 2)
    with pytest.raises(ValueError, match="Annotation label 'X' is not valid"):
        s.insert_vertex(g, p, "{}", ["X"])
    with pytest.raises(ValueError, match="does not support annotations"):
        s.insert_vertex(g, 1, "{}", ["X"])
    with pytest.raises(ValueError, match="expects object"):
        s.insert_vertex(g, p, "[1]")
    texts = {r.id: r.vertex for r in s.vertex_texts(g, [p]).collect()}
    assert texts[2] == '{"id": 2, "label": "person:FREE", "properties": {"age": 30, "name": "Bob"}}'
    k = s.ddl("create_elabel", "g", "knows", None, ["close"])
    e1, e2 = s.insert_edge(g, k, (p, 1), (p, 2)), s.insert_edge(g, k, (p, 1), (p, 2))
    with pytest.raises(ValueError, match="not found"):
        s.insert_edge(g, k, (p, 1), (p, 99))
    assert s.adjacency(g, p).count() == 4
    s.annotate("e", g, k, e1, "close")
    s.update("e", g, k, e1, '{"since": 1971}')
    assert s.edge_texts(g).where(F.col("id") == e1).first().edge == '{"id": 1, "start_vertex": (2,1), "edge_vertex": (2,2), "label": "knows:close", "properties": {"since": 1971}}'
    s.update("v", g, p, 1, '{"name": "Alex"}')
    s.annotate("v", g, p, 1, "EMPLOYED", remove=True)
    assert s.vertex_texts(g).where("id = 1").first().vertex == '{"id": 1, "label": "person", "properties": {"name": "Alex"}}'
    s.delete_edge(g, k, e2)
    assert s.adjacency(g, p).count() == 2
    with pytest.raises(ValueError, match="Cannot delete vertex 1 because it still has active edges"):
        s.delete_vertex(g, p, 1)
    s.delete_vertex(g, p, 1, detach=True)
    assert [r.id for r in s.table("vertices", g).collect()] == [2] and s.table("edges", g).count() == 0 and s.adjacency(g, p).count() == 0


def test_relabel(session):
    s = session
    g = s.ddl("create_graph", "g")
    p = s.ddl("create_vlabel", "g", "person", ["FREE"])
    for i in range(3):
        s.insert_vertex(g, p, f'{{"n": {i}}}', ["FREE"])
    k = s.ddl("create_elabel", "g", "knows")
    s.insert_edge(g, k, (p, 1), (p, 2))
    s.insert_edge(g, k, (p, 2), (p, 2))
    to = s.set_vertex_label(g, p, 2, "boss")
    assert paths(s, g)[to[0]] == "_.person.boss" and to[1] == 1
    ends = sorted((r.start_label, r.start_id, r.end_label, r.end_id) for r in s.table("edges", g).collect())
    assert ends == sorted([(p, 1, *to), (*to, *to)])
    assert s.adjacency(g, to[0]).count() == 3
    assert "person:boss:FREE" in s.vertex_texts(g, [to[0]]).first().vertex
    assert s.set_vertex_label(g, *to, "boss") is None and s.remove_vertex_label(g, *to, "gone") is None
    assert s.remove_vertex_label(g, *to, "boss") == (p, 4)
    root = s.remove_vertex_label(g, p, 4, "person")
    assert root[0] == 1 and '"label": ""' in s.vertex_texts(g, [1]).first().vertex
    e = s.set_edge_label(g, k, 1, "promoted")
    assert paths(s, g, "e")[e[0]] == "_.knows.promoted" and e[1] == 1
    assert s.remove_edge_label(g, *e, "promoted") == (k, 1)
    with pytest.raises(ValueError, match="base structural label"):
        s.remove_edge_label(g, k, 1, "knows")


def test_compaction_and_supernode(session):
    s = session
    g = s.ddl("create_graph", "g")
    p = s.ddl("create_vlabel", "g", "person")
    s.insert_vertices(g, p, s.spark.range(1, 5).select(F.concat(F.lit('{"n": '), F.col("id"), F.lit("}")).alias("properties")))
    edge = lambda n: s.spark.range(n).select(F.lit(p).alias("start_label"), F.lit(1).cast("long").alias("start_id"), F.lit(p).alias("end_label"), (F.col("id") % 3 + 2).alias("end_id"), F.concat(F.lit('{"k": '), F.col("id"), F.lit("}")).alias("properties"))
    s.insert_edges(g, 1, edge(8))
    s.compact_oldest(g, p)
    s.insert_edges(g, 1, edge(200))
    s.rotate(g, p)
    before = s.adjacency(g, p).count()
    s.compact_oldest(g, p)
    assert before == s.adjacency(g, p).count() == 416
    sizes = {r.block: r.n for r in s.table("blocks", g).where("owner_id = 1").select("block", F.size("members").alias("n")).collect()}
    assert sizes == {0: 155, 1: 53}
    states = [(r.segment_id, r.active, r.compacted) for r in s.segment_table(g, p).orderBy("segment_id").collect()]
    assert states == [(1, False, True), (2, False, True), (3, True, False)]
    s.set_vertex_label(g, p, 1, "hub")
    assert s.table("edges", g).where("start_id = 1 and start_label <> 2").count() == 208


def test_rollback_and_versions(session):
    s = session
    g = s.ddl("create_graph", "g")
    s.ddl("create_vlabel", "g", "person")
    at = s.version
    with pytest.raises(RuntimeError):
        with s.transaction():
            s.ddl("add_annotation", "g", "person", "A")
            s.insert_vertex(g, 2, "{}", ["A"])
            raise RuntimeError
    assert s.version == at and s.table("vertices", g).count() == 0
    with pytest.raises(ValueError):
        s.annotate("v", g, 2, 1, "A")
    with s.transaction():
        s.insert_vertex(g, 2)
        s.insert_vertex(g, 2)
    assert s.version == at + 1 and s.table("vertices", g).count() == 2
    s.refresh(at)
    assert s.table("vertices", g).count() == 0


def test_dictionary(session):
    s = session
    g = s.ddl("create_graph", "g")
    s.insert_vertex(g, 1, '{"a": 1}')
    d = s.dictionary_log(g, 1, ["a", "b"])
    s.vertex_set_dictionary(g, 1, 1, 99)
    s.vertex_set_dictionary(g, 1, 1, d)
    assert s.table("vertices", g).first().dictionary_id == d
    with pytest.raises(ValueError, match="already set"):
        s.vertex_set_dictionary(g, 1, 1, d)
