from graphloom.cli import run
from graphloom.operators import setops as U
from graphloom.sources import snapshot

from .test_graph import rows


def test_tools(spark, tmp_path):
    (tmp_path / "n.csv").write_text("nodeId:ID,:LABEL\n10,a\n20,b\n30,a\n")
    (tmp_path / "e.csv").write_text(":START_ID,:END_ID,:TYPE\n10,20,x\n20,30,x\n10,30,y\n10,40,\n")
    g = run(spark, ["csv-to-static", f"{tmp_path}/e.csv", f"{tmp_path}/o", "--nodes", f"{tmp_path}/n.csv", "--reorder-node-id", "--reorder-label-id"])
    path = f"{tmp_path}/o/graph"
    back = snapshot.load(spark, path)
    assert U.equal(g, back) and rows(back.node_labels()) == [(0, "b"), (1, "a")] and rows(back.nodes)[3] == (3, "a")
    assert U.equal(snapshot.load_compact(spark, f"{tmp_path}/o/compact"), g)
    assert run(spark, ["stats", path]) == {"nodes": 4, "edges": 4, "max_degree": 3, "average_degree": 2, "node_labels": [("a", 2), ("b", 1)], "edge_labels": [("x", 2), ("y", 1)]}
    run(spark, ["graph-to-csv", path, f"{tmp_path}/csv"])
    again = run(spark, ["csv-to-static", f"{tmp_path}/csv/edges", f"{tmp_path}/o2", "--nodes", f"{tmp_path}/csv/nodes"])
    assert U.equal(again, g)
    run(spark, ["graph-to-compact", path, f"{tmp_path}/c"])
    run(spark, ["remove-labels", path, f"{tmp_path}/bare"])
    assert not snapshot.load(spark, f"{tmp_path}/bare").has_node_labels()
    run(spark, ["vary-labels", path, f"{tmp_path}/varied"])
    paths = run(spark, ["vary-density", path, f"{tmp_path}/dense", "4", "5"])
    assert [snapshot.load(spark, p).edge_count() for p in paths] == [8, 10]


def test_ldbc_tool(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "person_knows_person_0_0.csv").write_text("Person.id|Person.id\n7|8\n")
    path = run(spark, ["ldbc-to-graph", f"{tmp_path}/in", f"{tmp_path}/out"])
    assert path.endswith("ldbc_2_1") and snapshot.load(spark, path).edge_count() == 1
