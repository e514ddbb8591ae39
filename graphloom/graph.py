"""PropertyGraph: a labelled graph as two DataFrames.

nodes (id long, label) has each id once; edges (src long, dst long, label) each pair once. A label is any
atomic type or null (unlabelled); node and edge labels may differ in type. Self loops are allowed, parallel
edges are not. An undirected edge is one row with src <= dst and is seen from both ends in adjacency().

All calls but those that return a Python value are lazy. The constructor takes tables that keep these rules;
of() makes them so. edge_count counts stored edges, so re-adding an edge never inflates it. max_seen_id
doesn't fall when nodes are removed. What asks for a node or edge that isn't there gives no row, False or
None, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import dictionary as D

#: Largest ids of 32-bit unsigned numbers, the default width.
MAX_ID = MAX_LABEL_ID = 4294967295


class GraphImpl(Enum):
    """The kinds of storage a caller may name; here all are tables."""

    GRAPHMAP = "graphmap"
    STATICGRAPH = "staticgraph"
    STATICGRAPHMMAP = "staticgraphmmap"

    @classmethod
    def parse(cls, name: str) -> GraphImpl:
        try:
            return cls(name.lower())
        except ValueError:
            raise ValueError(f"{name!r} names no graph implementation") from None


def label_type(df: DataFrame) -> T.DataType:
    kind = df.schema["label"].dataType
    return T.StringType() if isinstance(kind, T.NullType) else kind


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = True
    seen_id: int | None = None
    node_dictionary: DataFrame | None = None
    edge_dictionary: DataFrame | None = None
    impl: GraphImpl = GraphImpl.GRAPHMAP

    # construction

    @classmethod
    def empty(cls, spark: SparkSession, directed: bool = True, node_label: T.DataType | None = None, edge_label: T.DataType | None = None) -> PropertyGraph:
        n = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", node_label or T.StringType())])
        e = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("label", edge_label or T.StringType())])
        return cls(spark.createDataFrame([], n), spark.createDataFrame([], e), directed)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, directed: bool = True, **more) -> PropertyGraph:
        """From any rows: of repeated keys the row with the greatest seq stays (without seq: the greatest label, null
        last); end points without a node row become unlabelled nodes; null ids are dropped."""
        from .operators.mutate import latest

        n = nodes.where("id is not null").withColumn("id", F.col("id").cast("long"))
        e = edges.where("src is not null and dst is not null").withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")})
        e = latest(canonical(e, directed), ["src", "dst"])
        return cls(with_end_points(latest(n, ["id"]), e), e, directed, **more)

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = True) -> PropertyGraph:
        """Unlabelled graph of src and dst."""
        pairs = edges.select("src", "dst", F.lit(None).cast("string").alias("label"))
        none = edges.sparkSession.createDataFrame([], "id long, label string")
        return cls.of(none, pairs, directed)

    def with_label_maps(self, node_dictionary: DataFrame, edge_dictionary: DataFrame) -> PropertyGraph:
        """The same graph with given dictionaries, so that label ids agree between graphs."""
        return replace(self, node_dictionary=node_dictionary, edge_dictionary=edge_dictionary)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    # views

    def adjacency(self) -> DataFrame:
        """src, dst, label as seen from src: undirected edges from both ends, self loops once."""
        if self.directed:
            return self.edges
        back = self.edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label")
        return self.edges.unionByName(back)

    def is_directed(self) -> bool:
        return self.directed

    def implementation(self) -> GraphImpl:
        return self.impl

    def as_graph(self) -> PropertyGraph:
        return self

    as_labeled_graph = as_general_graph = as_mut_graph = as_graph

    def as_digraph(self) -> PropertyGraph | None:
        return self if self.directed else None

    # lookup

    def get_node(self, node_id: int) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def _between(self, start: int, target: int) -> Column:
        s, t = (start, target) if self.directed else (min(start, target), max(start, target))
        return (F.col("src") == s) & (F.col("dst") == t)

    def get_edge(self, start: int, target: int) -> DataFrame:
        """The edge, with src and dst as asked for; the filter reaches the scan."""
        return self.edges.where(self._between(start, target)).select(F.lit(start).cast("long").alias("src"), F.lit(target).cast("long").alias("dst"), "label")

    def has_node(self, node_id: int) -> bool:
        return not self.get_node(node_id).isEmpty()

    def has_edge(self, start: int, target: int) -> bool:
        return not self.edges.where(self._between(start, target)).isEmpty()

    def has_nodes(self, ids: DataFrame) -> DataFrame:
        """id and found for a table of ids."""
        known = self.nodes.select("id", F.lit(True).alias("found"))
        return ids.join(known, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """src, dst and found for a table of pairs, in the direction asked for."""
        key = canonical(pairs.withColumns({"__s": F.col("src"), "__d": F.col("dst")}), self.directed)
        known = self.edges.select("src", "dst", F.lit(True).alias("found"))
        return key.join(known, ["src", "dst"], "left").select(F.col("__s").alias("src"), F.col("__d").alias("dst"), F.coalesce("found", F.lit(False)).alias("found"))

    def node_indices(self) -> DataFrame:
        return self.nodes.select("id")

    def edge_indices(self) -> DataFrame:
        return self.edges.select("src", "dst")

    def get_node_label(self, node_id: int):
        row = self.get_node(node_id).first()
        return row and row["label"]

    def get_edge_label(self, start: int, target: int):
        row = self.get_edge(start, target).first()
        return row and row["label"]

    def max_seen_id(self) -> int | None:
        top = self.nodes.agg(F.max("id")).first()[0]
        return max((x for x in (top, self.seen_id) if x is not None), default=None)

    @staticmethod
    def max_possible_id() -> int:
        return MAX_ID

    @staticmethod
    def max_possible_label_id() -> int:
        return MAX_LABEL_ID

    # neighbourhoods

    def neighbors(self, node_id: int) -> DataFrame:
        """Ids of out-neighbours (all neighbours of an undirected node), ascending."""
        return self.adjacency().where(F.col("src") == node_id).select(F.col("dst").alias("id")).orderBy("id")

    def in_neighbors(self, node_id: int) -> DataFrame:
        """Ids of in-neighbours, ascending; none in an undirected graph."""
        at = self.edges.where(F.col("dst") == node_id) if self.directed else self.edges.limit(0)
        return at.select(F.col("src").alias("id")).orderBy("id")

    def non_less_neighbors(self, node_id: int) -> DataFrame:
        return self.neighbors(node_id).where(F.col("id") >= node_id)

    def has_neighbor(self, node_id: int, other: int) -> bool:
        return self.has_edge(node_id, other)

    def has_in_neighbor(self, node_id: int, other: int) -> bool:
        return self.directed and self.has_edge(other, node_id)

    def neighbors_full(self, node_id: int) -> DataFrame:
        """id, edge_label, label of the out-neighbours, ascending."""
        at = self.adjacency().where(F.col("src") == node_id).select(F.col("dst").alias("id"), F.col("label").alias("edge_label"))
        return at.join(self.nodes, "id").select("id", "edge_label", "label").orderBy("id")

    def neighbor_lists(self) -> DataFrame:
        """id, neighbors (ascending array, empty for none) for every node."""
        return self._lists(self.adjacency(), "src", "dst", "neighbors")

    def in_neighbor_lists(self) -> DataFrame:
        return self._lists(self.edges if self.directed else self.edges.limit(0), "dst", "src", "in_neighbors")

    def _lists(self, edges: DataFrame, key: str, other: str, name: str) -> DataFrame:
        lists = edges.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(other)).alias(name))
        return self.nodes.select("id").join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<long>")))

    # aggregates

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    refine_edge_count = edge_count

    def degrees(self) -> DataFrame:
        """id, degree for every node: out-degree, or the number of neighbours; a self loop counts once."""
        return self._counts(self.adjacency(), "src", "degree")

    def in_degrees(self) -> DataFrame:
        return self._counts(self.edges if self.directed else self.edges.limit(0), "dst", "in_degree")

    def _counts(self, edges: DataFrame, key: str, name: str) -> DataFrame:
        counts = edges.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))
        return self.nodes.select("id").join(counts, "id", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))

    def total_degrees(self) -> DataFrame:
        """id, total: degree plus in-degree (an undirected graph has in-degree 0), in one aggregation."""
        ends = self.adjacency().select(F.col("src").alias("id"))
        if self.directed:
            ends = ends.unionByName(self.edges.select(F.col("dst").alias("id")))
        return self.nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("total")), "id", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))

    def degree(self, node_id: int) -> int:
        return self.adjacency().where(F.col("src") == node_id).count()

    def in_degree(self, node_id: int) -> int:
        return self.edges.where(F.col("dst") == node_id).count() if self.directed else 0

    def max_degree(self) -> DataFrame:
        """One row: the greatest degree (0 for a graph without edges)."""
        return self.adjacency().groupBy("src").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("max_degree"))

    def average_degree(self) -> int:
        """2 * edges / nodes, rounded down; 0 without nodes."""
        n = self.node_count()
        return 2 * self.edge_count() // n if n else 0

    def node_label_counts(self) -> DataFrame:
        """label, n for the labels in use; sort by n for the most common."""
        return self.nodes.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))

    def edge_label_counts(self) -> DataFrame:
        return self.edges.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))

    def node_label_id_counts(self) -> DataFrame:
        return self.node_label_counts().join(self.node_labels(), "label").select("label_id", "n")

    def edge_label_id_counts(self) -> DataFrame:
        return self.edge_label_counts().join(self.edge_labels(), "label").select("label_id", "n")

    # labels

    def node_labels(self) -> DataFrame:
        """label_id, label: the graph's own dictionary, or the labels in use by the least id that has each."""
        return self.node_dictionary if self.node_dictionary is not None else D.build(self.nodes, seen_at="id")

    def edge_labels(self) -> DataFrame:
        return self.edge_dictionary if self.edge_dictionary is not None else D.build(self.edges, seen_at=F.struct("src", "dst"))

    get_node_label_map = node_labels
    get_edge_label_map = edge_labels

    def has_node_labels(self) -> bool:
        return not self.node_labels().isEmpty()

    def has_edge_labels(self) -> bool:
        return not self.edge_labels().isEmpty()

    def num_of_node_labels(self) -> int:
        return self.node_labels().count()

    def num_of_edge_labels(self) -> int:
        return self.edge_labels().count()

    def nodes_with_label_ids(self) -> DataFrame:
        return D.encoded(self.nodes, self.node_labels()).select("id", "label_id", "label")

    def edges_with_label_ids(self) -> DataFrame:
        return D.encoded(self.edges, self.edge_labels()).select("src", "dst", "label_id", "label")

    def __add__(self, other: PropertyGraph) -> PropertyGraph:
        from .operators.setops import union

        return union(self, other)

    def __sub__(self, other: PropertyGraph) -> PropertyGraph:
        from .operators.setops import minus

        return minus(self, other)


def canonical(edges: DataFrame, directed: bool) -> DataFrame:
    """Undirected edges with src <= dst."""
    return edges if directed else edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def with_end_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, and an unlabelled node for every end point that isn't among them."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(ends.select("id", F.lit(None).cast(label_type(nodes)).alias("label")))
