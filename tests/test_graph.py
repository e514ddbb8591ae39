"""Scenarios on small graphs: lookups, changes, neighbourhoods, labels, set operations."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import dictionary as D
from graphloom.graph import GraphImpl, PropertyGraph
from graphloom.operators import mutate as M
from graphloom.operators import setops as U


def graph(spark, nodes, edges, directed=True, node_label="string", edge_label="string"):
    n = spark.createDataFrame(nodes, f"id long, label {node_label}")
    e = spark.createDataFrame([(*x, None)[:3] for x in edges], f"src long, dst long, label {edge_label}")
    return PropertyGraph.of(n, e, directed)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def ids(df):
    return [r[0] for r in df.collect()]


def test_label_dictionary_and_missing_nodes(spark):
    g = graph(spark, [(0, "a"), (1, "b"), (2, "a"), (3, None)], [], False)
    assert rows(g.node_labels()) == [(0, "a"), (1, "b")]
    assert rows(g.nodes_with_label_ids().select("id", "label_id")) == [(0, 0), (1, 1), (2, 0), (3, None)]
    assert not g.has_node(4) and g.get_node(4).isEmpty() and g.get_node_label(4) is None
    assert g.get_node_label(1) == "b" and g.get_node_label(3) is None
    assert g.num_of_node_labels() == 2 and not g.has_edge_labels()


@pytest.mark.parametrize("directed", [True, False])
def test_readding_replaces_labels(spark, directed):
    g = graph(spark, [(0, "a"), (1, "b")], [(0, 1, "x")], directed)
    batch = spark.createDataFrame([(0, None, 1), (5, "new", 0), (5, "newer", 1)], "id long, label string, seq int")
    g = M.add_nodes(g, batch)
    assert rows(g.nodes) == [(0, None), (1, "b"), (5, "newer")]
    again = spark.createDataFrame([((0, 1) if directed else (1, 0)) + ("y", 0)], "src long, dst long, label string, seq int")
    assert rows(M.are_new_edges(g, again)) == [(*((0, 1) if directed else (1, 0)), False)]
    g = M.add_edges(g, again)
    assert g.edge_count() == 1 and g.get_edge_label(0, 1) == "y"


def test_remove_node_directed_and_undirected(spark):
    gone = spark.createDataFrame([(0,)], "id long")
    g = M.remove_nodes(graph(spark, [], [(0, 1), (0, 2), (1, 0)]), gone)
    assert (g.node_count(), g.edge_count()) == (2, 0)
    g = M.remove_nodes(graph(spark, [], [(0, 1), (0, 2), (1, 2)], False), gone)
    assert (g.node_count(), g.edge_count()) == (2, 1)


def test_remove_node_with_self_loop_keeps_max_seen_id(spark):
    g = M.remove_nodes(graph(spark, [], [(9, 9), (1, 9)]), spark.createDataFrame([(9,)], "id long"))
    assert ids(g.nodes) == [1] and g.edges.isEmpty() and g.max_seen_id() == 9


def test_directed_edges(spark):
    g = graph(spark, [], [(0, 1, "a"), (1, 2, "b"), (2, 0, "a"), (1, 0), (0, 0)])
    assert g.edge_count() == 5 and not g.has_edge(1, 3) and not g.has_edge(2, 1) and g.has_edge(0, 0)
    assert g.get_edge_label(1, 2) == "b" and g.get_edge_label(1, 0) is None


def test_undirected_edges_answer_both_ways(spark):
    g = graph(spark, [(3, None)], [(0, 1, "a"), (1, 2, "b"), (2, 0, "a"), (0, 0)], False)
    assert g.edge_count() == 4 and g.get_edge_label(2, 1) == "b"
    assert rows(g.get_edge(2, 1)) == [(2, 1, "b")]
    assert ids(g.neighbors(0)) == [0, 1, 2] and g.degree(0) == 3 and g.in_degree(0) == 0
    assert g.as_digraph() is None and rows(g.in_degrees()) == [(i, 0) for i in range(4)]


def test_remove_edges(spark):
    pairs = lambda *p: spark.createDataFrame(p, "src long, dst long")
    g = M.remove_edges(graph(spark, [], [(0, 1), (1, 0), (1, 2)]), pairs((0, 1)))
    assert g.edge_count() == 2 and g.has_edge(1, 0)
    g = M.remove_edges(graph(spark, [], [(0, 1), (2, 1)], False), pairs((1, 0), (1, 2)))
    assert g.edge_count() == 0 and g.node_count() == 3


def test_neighbours_and_degrees(spark):
    g = graph(spark, [], [(0, 1), (0, 2), (2, 1)])
    assert ids(g.neighbors(0)) == [1, 2] and ids(g.in_neighbors(1)) == [0, 2] and ids(g.non_less_neighbors(2)) == []
    assert rows(g.degrees()) == [(0, 2), (1, 0), (2, 1)] and rows(g.in_degrees()) == [(0, 0), (1, 2), (2, 1)]
    assert rows(g.total_degrees()) == [(0, 2), (1, 2), (2, 2)]
    assert g.max_degree().first()[0] == 2 and g.average_degree() == 2
    assert rows(g.neighbor_lists()) == [(0, [1, 2]), (1, []), (2, [1])]


def test_max_seen_id(spark):
    g, seen = PropertyGraph.empty(spark), []
    for i in (1, 0, 2):
        g = M.add_nodes(g, spark.createDataFrame([(i, None)], "id long, label string"))
        seen.append(g.max_seen_id())
    for e in ((3, 4), (6, 5)):
        g = M.add_edges(g, spark.createDataFrame([(*e, None)], "src long, dst long, label string"))
        seen.append(g.max_seen_id())
    assert seen == [1, 1, 2, 4, 6] and PropertyGraph.empty(spark).max_seen_id() is None


def test_label_histograms(spark):
    g = graph(spark, [(0, 0), (1, 0), (2, 1), (3, None)], [(0, 1, 0), (1, 2, 0), (2, 3, 1), (3, 1, None)], node_label="long", edge_label="long")
    assert rows(g.node_label_counts()) == rows(g.edge_label_counts()) == [(0, 2), (1, 1)]
    assert rows(g.node_label_id_counts()) == [(0, 2), (1, 1)]


def test_update_labels_only_where_they_exist(spark):
    g = graph(spark, [(1, "a"), (2, "b")], [(1, 2, "x")], False)
    g = M.update_node_labels(g, spark.createDataFrame([(1, None), (7, "z")], "id long, label string"))
    g = M.update_edge_labels(g, spark.createDataFrame([(2, 1, "y")], "src long, dst long, label string"))
    assert rows(g.nodes) == [(1, None), (2, "b")] and rows(g.edges) == [(1, 2, "y")]
    bare = M.remove_labels(g)
    assert not bare.has_node_labels() and not bare.has_edge_labels()


@pytest.mark.parametrize("directed", [True, False])
def test_union_and_minus(spark, directed):
    a = graph(spark, [(1, 0), (2, 1)], [(1, 2, 10)], directed, "long", "long")
    b = graph(spark, [(3, 2), (4, 3)], [(3, 4, 20)], directed, "long", "long")
    both = a + b
    assert both.node_count() == 4 and both.get_edge_label(3, 4) == 20 and both.has_edge(2, 1) is (not directed)
    assert U.equal(both - b, a) and U.equal(both - a, b)


def test_union_lets_null_labels_win(spark):
    a = graph(spark, [(1, "a"), (2, "b")], [(1, 2, "x")])
    b = graph(spark, [(2, None), (3, "c")], [(1, 2, None)])
    assert rows((a + b).nodes) == [(1, None), (2, None), (3, "c")]
    assert rows((a + b).edges) == [(1, 2, None)] and (a + b).edge_count() == 1


def test_equality_is_symmetric_and_by_value(spark):
    a = graph(spark, [(1, "a")], [(1, 2)])
    more = graph(spark, [(1, "a"), (3, None)], [(1, 2)])
    assert U.equal(a, U.copy(a)) and not U.equal(a, more) and not U.equal(more, a)
    assert not U.equal(a, graph(spark, [(1, "a")], [(1, 2)], False))
    print_of = lambda g: U.fingerprint(g).first()[0]
    assert print_of(a) == print_of(graph(spark, [(2, None), (1, "a")], [(1, 2)])) != print_of(more)


def test_dictionary(spark):
    d = D.from_values(spark, ["zero", "first", "zero", "first"])
    assert rows(d) == [(0, "zero"), (1, "first")] and D.size(d) == 2
    assert D.find_index(d, "first") == 1 and D.find_index(d, "five") is None and D.get_item(d, 2) is None and D.contains(d, "zero")
    new = spark.createDataFrame([("five", 2), ("zero", 0), (None, 0), ("four", 1)], "label string, seq int")
    assert [r[1] for r in D.items(D.add(d, new)).collect()] == ["zero", "first", "four", "five"]
    less, last = D.pop_item(d)
    assert last == "first" and D.size(less) == 1 and D.size(D.clear(d)) == 0 and D.pop_item(D.clear(d))[1] is None


def test_shared_dictionaries_may_hold_unused_labels(spark):
    d = D.from_values(spark, ["q", "a"])
    g = graph(spark, [(0, "a")], []).with_label_maps(d, d)
    assert rows(g.nodes_with_label_ids()) == [(0, 1, "a")] and g.num_of_node_labels() == 2


def test_null_ids_duplicates_and_extra_columns(spark):
    n = spark.createDataFrame([(1, "a", 9), (1, None, 9), (None, "x", 9)], "id long, label string, weight int")
    e = spark.createDataFrame([(1, None, "x"), (2, 2, "y"), (2, 2, "z")], "src long, dst long, label string")
    g = PropertyGraph.of(n, e)
    assert rows(g.nodes) == [(1, "a"), (2, None)] and rows(g.edges) == [(2, 2, "z")]


def test_metadata(spark):
    assert GraphImpl.parse("StaticGraphMmap") is GraphImpl.STATICGRAPHMMAP
    with pytest.raises(ValueError):
        GraphImpl.parse("heap")
    g = PropertyGraph.empty(spark)
    assert g.is_directed() and g.max_possible_id() == 4294967295 and g.average_degree() == 0
    assert g.max_degree().select(F.col("max_degree")).first()[0] == 0
