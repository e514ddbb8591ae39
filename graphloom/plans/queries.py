"""The queries: every operator of the graph engine on a derived graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionary as D
from ..functions.ordering import numbered
from ..graph import PropertyGraph
from ..operators import components as K
from ..operators import generate as C
from ..operators import mutate as M
from ..operators import reorder as R
from ..operators import setops as U
from ..operators import traversal as T
from ..scratch import cut, shared_folder
from ..sources import csv as csv_files
from ..sources import ldbc, snapshot
from ..streaming.incremental import IncrementalComponents
from .derived import clicks, geo, star, supply, table, trade

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_ALL)


def _joined(array: str) -> Column:
    return F.array_join(F.col(array).cast("array<string>"), ",").alias(array)


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/graphloom/files-{uuid.uuid4().hex}"


@query
def node_scan(spark, d):
    return geo(spark, d).nodes


@query
def edge_scan(spark, d):
    return geo(spark, d).edges


@query
def node_lookup(spark, d):
    g = geo(spark, d)
    return reduce(DataFrame.unionByName, [g.get_node(i) for i in (0, 100, 1000007, 10000003, -1)])


@query
def edge_lookup(spark, d):
    g = trade(spark, d)
    first = g.neighbors(1000001).first()
    return g.get_edge(1000001, first["id"] if first else 0)


@query
def edge_exists(spark, d):
    g = trade(spark, d)
    return g.has_edges(spark.range(1000000, 1000020).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(10000000).cast("long"), F.lit(10000009).cast("long"))).alias("dst")))


@query
def node_exists(spark, d):
    return geo(spark, d).has_nodes(spark.range(200))


@query
def undirected_edge_exists(spark, d):
    return supply(spark, d).has_edges(spark.range(20).select(F.explode(F.sequence(F.lit(10000000).cast("long"), F.lit(10000009).cast("long"))).alias("src"), F.col("id").alias("dst")))


@query
def out_degree(spark, d):
    return trade(spark, d).degrees()


@query
def in_degree(spark, d):
    return trade(spark, d).in_degrees()


@query
def total_degree(spark, d):
    return trade(spark, d).total_degrees()


@query
def undirected_degree(spark, d):
    return clicks(spark, d, directed=False).degrees()


@query
def supply_degree(spark, d):
    return supply(spark, d).degrees()


@query
def neighbor_lists(spark, d):
    return geo(spark, d).neighbor_lists().select("id", _joined("neighbors"))


@query
def in_neighbor_lists(spark, d):
    return geo(spark, d).in_neighbor_lists().select("id", _joined("in_neighbors"))


@query
def neighbors_of(spark, d):
    return geo(spark, d).neighbors(103)


@query
def graph_summary(spark, d):
    g = trade(spark, d)
    g = replace(g, edges=cut(g.edges))
    found = (g.node_count(), g.edge_count(), g.max_degree().first()[0], g.average_degree(), g.max_seen_id())
    return spark.createDataFrame([found], "nodes long, edges long, max_degree long, average_degree long, max_seen_id long")


@query
def node_label_counts(spark, d):
    return geo(spark, d).node_label_counts()


@query
def edge_label_counts(spark, d):
    return trade(spark, d).edge_label_counts()


@query
def most_common_labels(spark, d):
    return numbered(geo(spark, d).node_label_counts(), [F.desc("n"), F.col("label")], "at").select("label", "n", (F.col("at") + 1).alias("place"))


@query
def label_dictionary(spark, d):
    return geo(spark, d).node_labels()


@query
def edge_label_dictionary(spark, d):
    return geo(spark, d).edge_labels()


@query
def dictionary_add(spark, d):
    g = geo(spark, d)
    return D.add(g.node_labels(), g.edges.select("label", F.col("src").alias("seq")))


@query
def node_labels_joined(spark, d):
    return geo(spark, d).nodes_with_label_ids()


def _node_batch(spark, d, g) -> DataFrame:
    old = g.nodes.where("id % 5 = 0").select("id", F.when(F.col("id") % 4 != 0, "new").alias("label"), F.lit(1).alias("seq"))
    stale = g.nodes.where("id % 5 = 0").select("id", F.lit("stale").alias("label"), F.lit(0).alias("seq"))
    new = table(spark, d, "nation").select((F.col("n_nationkey") + 700000000).cast("long").alias("id"), F.lit("added").alias("label"), F.lit(2).alias("seq"))
    return old.unionByName(stale).unionByName(new)


@query
def upsert_nodes(spark, d):
    g = geo(spark, d)
    return M.add_nodes(g, _node_batch(spark, d, g)).nodes


@query
def upsert_nodes_added(spark, d):
    g = geo(spark, d)
    return M.are_new_nodes(g, _node_batch(spark, d, g))


def _edge_batch(spark, d, g) -> DataFrame:
    old = g.edges.where("dst % 5 = 0").select("src", "dst", F.when(F.col("dst") % 4 != 0, "new").alias("label"), F.lit(1).alias("seq"))
    new = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("src"), (F.col("r_regionkey") + 800000000).cast("long").alias("dst"), F.lit("added").alias("label"), F.lit(2).alias("seq"))
    return old.unionByName(new)


@query
def upsert_edges(spark, d):
    g = geo(spark, d)
    return M.add_edges(g, _edge_batch(spark, d, g)).edges


@query
def upsert_edges_nodes(spark, d):
    g = geo(spark, d)
    return M.add_edges(g, _edge_batch(spark, d, g)).nodes


@query
def remove_nodes(spark, d):
    g = geo(spark, d)
    return M.remove_nodes(g, g.nodes.where("id % 3 = 0")).edges


@query
def remove_edges(spark, d):
    g = geo(spark, d)
    return M.remove_edges(g, g.edges.where("dst % 4 = 1")).edges


@query
def update_node_labels(spark, d):
    g = geo(spark, d)
    batch = g.nodes.where("id % 6 < 2").select("id", F.when(F.col("id") % 6 == 0, "changed").alias("label"))
    return M.update_node_labels(g, batch.unionByName(spark.createDataFrame([(999999999, "nobody")], "id long, label string"))).nodes


@query
def update_edge_labels(spark, d):
    g = geo(spark, d)
    return M.update_edge_labels(g, g.edges.where("dst % 6 = 0").select("src", "dst", F.lit("changed").alias("label"))).edges


@query
def strip_labels(spark, d):
    return M.remove_labels(geo(spark, d)).nodes


def _second(spark, d) -> PropertyGraph:
    g = geo(spark, d)
    label = lambda c: F.when(F.col(c) % 2 != 0, "second").alias("label")
    nodes = g.nodes.where("id % 3 = 0").select("id", label("id")).unionByName(g.nodes.where("id % 7 = 0").select((F.col("id") + 500000000).alias("id"), "label"))
    return PropertyGraph(nodes, g.edges.where("dst % 3 = 0").select("src", "dst", label("dst")))


@query
def union_graphs_nodes(spark, d):
    return (geo(spark, d) + _second(spark, d)).nodes


@query
def union_graphs_edges(spark, d):
    return (geo(spark, d) + _second(spark, d)).edges


def _nations(spark, d) -> PropertyGraph:
    return PropertyGraph(geo(spark, d).nodes.where("label = 'nation' and id % 2 = 1"), PropertyGraph.empty(spark).edges)


@query
def minus_graphs_nodes(spark, d):
    return (geo(spark, d) - _nations(spark, d)).nodes


@query
def minus_graphs_edges(spark, d):
    return (geo(spark, d) - _nations(spark, d)).edges


@query
def graph_equal(spark, d):
    g = geo(spark, d)
    found = (U.equal(g, replace(g, nodes=g.nodes.orderBy(F.desc("id")))), U.equal(g, M.set_edge_labels(g, F.lit("x"))), U.equal(g, replace(g, edges=g.edges.where("dst % 2 = 0"))))
    return spark.createDataFrame([found], "itself boolean, relabelled boolean, smaller boolean")


@query
def graph_fingerprint(spark, d):
    """Whether fingerprints are equal for the same graph in another order, relabelled, and smaller."""
    g = geo(spark, d)
    of = lambda x: U.fingerprint(x).first()[0]
    own = of(g)
    found = (of(replace(g, nodes=g.nodes.orderBy(F.desc("id")))) == own, of(M.set_edge_labels(g, F.lit("x"))) == own, of(replace(g, edges=g.edges.where("dst % 2 = 0"))) == own)
    return spark.createDataFrame([found], "itself boolean, relabelled boolean, smaller boolean")


@query
def components(spark, d):
    return K.components(geo(spark, d))


@query
def star_components(spark, d):
    return K.components(star(spark, d))


@query
def component_sizes(spark, d):
    return K.component_sizes(K.components(star(spark, d)))


@query
def component_count(spark, d):
    return spark.createDataFrame([(K.component_count(K.components(star(spark, d))),)], "components long")


@query
def same_component(spark, d):
    """For every customer, whether a nation (or an id that is none) is in its component."""
    pairs = table(spark, d, "customer").select((F.col("c_custkey") + 1000000).alias("a"), (F.col("c_custkey") % 30 + 100).alias("b"))
    return K.are_connected(K.components(geo(spark, d)), pairs)


@query
def component_members(spark, d):
    return K.connected_nodes(K.components(geo(spark, d)), 104)


@query
def connected_subgraph_nodes(spark, d):
    return K.ConnectedSubgraphs(star(spark, d)).nodes()


@query
def connected_subgraph_edges(spark, d):
    return K.ConnectedSubgraphs(star(spark, d)).edges()


@query
def incremental_components(spark, d):
    g, state = star(spark, d), IncrementalComponents(spark)
    for k in range(3):
        state.process(g.edges.where(F.col("dst") % 3 == k))
    return state.components()


@query
def bfs_order(spark, d):
    return T.bfs(geo(spark, d))


@query
def bfs_cyclic(spark, d):
    return T.bfs(clicks(spark, d), 2, reachable_only=True).select("id", "level")


@query
def dfs_order(spark, d):
    return T.dfs(geo(spark, d))


@query
def reachable_from(spark, d):
    return T.reachable(geo(spark, d), 2)


@query
def reorder_node_ids(spark, d):
    return R.node_ids_by_degree(trade(spark, d))


@query
def reorder_labels(spark, d):
    return R.labels_by_frequency(geo(spark, d).node_label_counts())


@query
def reordered_edges(spark, d):
    return R.reordered(trade(spark, d), node_label=False, edge_label=False).graph.edges


@query
def csr_offsets(spark, d):
    return R.offsets(trade(spark, d))


@query
def csr_edge_index(spark, d):
    return R.edge_index(trade(spark, d))


@query
def complete_pairs(spark, d):
    return C.complete_graph_unlabeled(spark, 60, directed=False).edge_indices()


@query
def complete_directed_pairs(spark, d):
    return C.complete_graph_unlabeled(spark, 60).edge_indices()


@query
def gnm_counts(spark, d):
    """As many nodes as customers, and as many random edges as orders."""
    n, m = table(spark, d, "customer").count(), table(spark, d, "orders").count()
    g = C.random_gnm_graph(spark, n, m, ["a", "b"], ["x"], seed=3)
    e = g.edges.agg(F.count("*").alias("edges"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"), F.countDistinct("src", "dst").alias("different"))
    return e.select(F.lit(g.node_count()).cast("long").alias("nodes"), "edges", "loops", "different")


@query
def gnp_bounds(spark, d):
    n = table(spark, d, "supplier").count()
    none, every = (C.random_gnp_graph(spark, n, p, directed=False).edge_count() for p in (0, 1))
    return spark.createDataFrame([(none, every)], "none long, every long")


@query
def densify(spark, d):
    g = geo(spark, d)
    dense = C.densified(g, 6)
    kept = dense.edges.join(g.edges, ["src", "dst", "label"], "left_semi").count()
    return spark.createDataFrame([(dense.node_count(), dense.edge_count(), kept)], "nodes long, edges long, kept long")


def _csv(spark, d) -> PropertyGraph:
    path = _path(spark)
    csv_files.write_csv_graph(geo(spark, d), f"{path}/nodes", f"{path}/edges")
    return csv_files.read_csv_graph(spark, f"{path}/nodes", f"{path}/edges")


@query
def csv_roundtrip(spark, d):
    return _csv(spark, d).nodes


@query
def csv_roundtrip_edges(spark, d):
    return _csv(spark, d).edges


@query
def snapshot_roundtrip(spark, d):
    path = _path(spark)
    snapshot.export(trade(spark, d), path)
    return snapshot.load(spark, path).edges


@query
def compact_roundtrip(spark, d):
    path = _path(spark)
    snapshot.export_compact(geo(spark, d), path)
    return snapshot.load_compact(spark, path).edges


@query
def ldbc_load(spark, d):
    """The geography written as benchmark files, and read again."""
    return _ldbc(spark, d).nodes


@query
def ldbc_load_edges(spark, d):
    return _ldbc(spark, d).edges


def _ldbc(spark, d) -> PropertyGraph:
    path = ldbc_files(spark, d)
    return ldbc.read_ldbc_graph(spark, path)


def ldbc_files(spark, d) -> str:
    """A folder with nations as places and customers as persons in them."""
    path = _path(spark)
    files = {
        "place_0_0.csv": table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("url"), F.lit("country").alias("type")),
        "person_isLocatedIn_place_0_0.csv": table(spark, d, "customer").select(F.col("c_custkey").alias("Person.id"), F.col("c_nationkey").alias("Place.id")),
    }
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, df in files.items():
        df.coalesce(1).write.option("sep", "|").option("header", True).csv(f"{path}/tmp/{name}")
        folder = fs.Path(f"{path}/tmp/{name}")
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        part = next(s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith("part-"))
        system.rename(part, fs.Path(f"{path}/{name}"))
    return path
