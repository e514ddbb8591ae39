"""Re-encoding: ids by degree, labels by frequency, and compact adjacency."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ordering import numbered
from ..graph import PropertyGraph, canonical
from ..scratch import cut

BAND = 65536


@dataclass(frozen=True)
class Reordered:
    """The new graph, and old_id and new_id of its nodes."""

    graph: PropertyGraph
    node_ids: DataFrame

    def take_graph(self) -> PropertyGraph:
        return self.graph

    def get_node_id_map(self) -> DataFrame:
        return self.node_ids

    def get_original_node_id(self, new_id: int) -> int | None:
        row = self.node_ids.where(F.col("new_id") == new_id).first()
        return row and row["old_id"]

    def find_new_node_id(self, old_id: int) -> int | None:
        row = self.node_ids.where(F.col("old_id") == old_id).first()
        return row and row["new_id"]


def node_ids_by_degree(g: PropertyGraph) -> DataFrame:
    """old_id, new_id: ascending degree plus in-degree, ties by id."""
    return numbered(g.total_degrees(), [F.col("total"), F.col("id")], "new_id").select(F.col("id").alias("old_id"), "new_id")


def dense_node_ids(g: PropertyGraph) -> DataFrame:
    """old_id, new_id: 0, 1, 2 ... in the order of the ids."""
    return numbered(g.nodes.select("id"), [F.col("id")], "new_id").select(F.col("id").alias("old_id"), "new_id")


def labels_by_frequency(counts: DataFrame) -> DataFrame:
    """label_id, label: ascending frequency, ties by label; labels without use are gone."""
    return numbered(counts, [F.col("n"), F.col("label")], "label_id").select("label_id", "label")


def with_node_ids(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """The graph under new ids; every node must have one (nodes without lose their edges)."""
    at = lambda c: ids.select(F.col("old_id").alias(c), F.col("new_id").alias(f"new_{c}"))
    nodes = g.nodes.join(at("id"), "id").select(F.col("new_id").alias("id"), "label")
    edges = g.edges.join(at("src"), "src").join(at("dst"), "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "label")
    return replace(g, nodes=nodes, edges=canonical(edges, g.directed), seen_id=None)


def reordered(g: PropertyGraph, node: bool = True, node_label: bool = True, edge_label: bool = True) -> Reordered:
    """Node ids by degree, and dictionaries by label frequency, as asked for."""
    ids = node_ids_by_degree(g) if node else g.nodes.select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))
    new = with_node_ids(g, ids) if node else g
    if node_label:
        new = replace(new, node_dictionary=labels_by_frequency(g.node_label_counts()))
    if edge_label:
        new = replace(new, edge_dictionary=labels_by_frequency(g.edge_label_counts()))
    return Reordered(new, ids)


def compact(g: PropertyGraph) -> DataFrame:
    """id, offset, neighbors, edge_labels for every node: adjacency in id order, as arrays.

    offset counts the neighbours of all lesser ids. Ids should be dense (with_node_ids(g, dense_node_ids(g)));
    gaps only leave gaps.
    """
    pairs = g.adjacency().groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "label"))).alias("out"))
    rows = g.nodes.select("id").join(pairs, "id", "left").select("id", F.coalesce(F.col("out.dst"), F.array().cast("array<long>")).alias("neighbors"), F.col("out.label").alias("edge_labels"))
    return rows.join(offsets(g), "id").select("id", "offset", "neighbors", F.coalesce("edge_labels", F.array().cast(rows.schema["edge_labels"].dataType)).alias("edge_labels"))


def offsets(g: PropertyGraph) -> DataFrame:
    """id, degree, offset: the sum of the degrees of all lesser ids. The edges are read once; degrees are added up
    within bands of BAND nodes, in parallel, and over the bands' totals."""
    place = cut(numbered(cut(g.degrees()), [F.col("id")], "n").withColumn("band", F.floor(F.col("n") / BAND)))
    bands = place.groupBy("band").agg(F.sum("degree").alias("sum"))
    lesser = bands.select("band", F.coalesce(F.sum("sum").over(W.orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("lesser"))
    within = W.partitionBy("band").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    return place.join(lesser, "band").select("id", "degree", (F.coalesce(F.sum("degree").over(within), F.lit(0)) + F.col("lesser")).alias("offset"))


def edge_index(g: PropertyGraph) -> DataFrame:
    """src, dst, edge_index: each edge's place in the flat adjacency, ordered by src and dst."""
    return numbered(g.adjacency().select("src", "dst"), [F.col("src"), F.col("dst")], "edge_index")


def find_edge_index(g: PropertyGraph, start: int, target: int) -> int | None:
    row = edge_index(g).where((F.col("src") == start) & (F.col("dst") == target)).first()
    return row and row["edge_index"]


def from_compact(rows: DataFrame, nodes: DataFrame, directed: bool = True) -> PropertyGraph:
    """A graph from id, neighbors and edge_labels (null or empty: unlabelled), and its nodes."""
    wrong = rows.where("size(edge_labels) > 0 and size(edge_labels) <> size(neighbors)")
    if not wrong.isEmpty():
        raise ValueError("edge_labels and neighbors differ in length")
    label = F.get("edge_labels", F.col("k"))
    edges = rows.select(F.col("id").alias("src"), F.posexplode("neighbors").alias("k", "dst"), "edge_labels").select("src", "dst", label.alias("label"))
    if not directed:
        edges = edges.where("src <= dst")
    return PropertyGraph(nodes, edges, directed)


def from_vectors(
    spark, offsets: list[int], targets: list[int], labels: list | None = None, node_labels: list | None = None,
    directed: bool = True, names: tuple[list, list] | None = None,
) -> PropertyGraph:
    """A graph from flat vectors: offsets (one more than nodes), targets, and label values or, with names, their ids."""
    n = len(offsets) - 1
    if labels is not None and len(labels) != len(targets):
        raise ValueError("labels and targets differ in length")
    of = lambda k, i: names[k][i] if names and i is not None else i
    edges = [(s, targets[k], None if labels is None else of(1, labels[k])) for s in range(n) for k in range(offsets[s], offsets[s + 1])]
    kind = lambda values: "long" if any(isinstance(v, int) for v in values) else "string"
    nodes = [(i, None if node_labels is None else of(0, node_labels[i])) for i in range(n)]
    e = spark.createDataFrame([x for x in edges if directed or x[0] <= x[1]], f"src long, dst long, label {kind([x[2] for x in edges])}")
    return PropertyGraph(spark.createDataFrame(nodes, f"id long, label {kind([x[1] for x in nodes])}"), e, directed)
