"""Snapshots: a graph as Parquet, by rows or as compact adjacency, read back lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.reorder import compact, from_compact


def export(g: PropertyGraph, path: str) -> None:
    """nodes, edges (clustered by src, so that lookups skip row groups), dictionaries and meta under path."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    parts = max(1, int(g.spark.conf.get("spark.sql.shuffle.partitions")))
    g.edges.repartitionByRange(parts, "src", "dst").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    for name, d in (("node_dictionary", g.node_dictionary), ("edge_dictionary", g.edge_dictionary)):
        if d is not None:
            d.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = [(g.directed, g.max_seen_id(), g.node_dictionary is not None, g.edge_dictionary is not None)]
    g.spark.createDataFrame(meta, "directed boolean, seen_id long, node_dictionary boolean, edge_dictionary boolean").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> PropertyGraph:
    meta = spark.read.schema("directed boolean, seen_id long, node_dictionary boolean, edge_dictionary boolean").json(f"{path}/meta").first()
    table = lambda name: spark.read.parquet(f"{path}/{name}") if meta[name] else None
    return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), meta["directed"], meta["seen_id"], table("node_dictionary"), table("edge_dictionary"))


def export_compact(g: PropertyGraph, path: str) -> None:
    """A row of arrays for each node, in id order: out (or all) neighbours, and in-neighbours of a directed graph."""
    compact(g).join(g.nodes, "id").orderBy("id").write.mode("overwrite").parquet(f"{path}/out")
    if g.directed:
        g.in_neighbor_lists().orderBy("id").write.mode("overwrite").parquet(f"{path}/in")
    g.spark.createDataFrame([(g.directed,)], "directed boolean").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def compact_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """The out and in tables of a compact snapshot."""
    directed = spark.read.schema("directed boolean").json(f"{path}/meta").first()["directed"]
    return spark.read.parquet(f"{path}/out"), spark.read.parquet(f"{path}/in") if directed else None


def load_compact(spark: SparkSession, path: str) -> PropertyGraph:
    out, into = compact_tables(spark, path)
    return from_compact(out.select("id", "neighbors", "edge_labels"), out.select("id", F.col("label")), into is not None)


class CompactGraph:
    """Lookups on a compact snapshot as it lies, without taking its arrays apart: the id reaches the scan, and the rows
    are in id order, so that only the row group that has it is read. What isn't there gives empty lists, False or None."""

    def __init__(self, spark: SparkSession, path: str):
        self.out, self.into = compact_tables(spark, path)

    def is_directed(self) -> bool:
        return self.into is not None

    def has_node(self, node_id: int) -> bool:
        return not self.out.where(F.col("id") == node_id).isEmpty()

    def node_count(self) -> int:
        return self.out.count()

    def edge_count(self) -> int:
        """Stored edges: of an undirected graph each but a loop stands in two rows."""
        twice = F.size("neighbors") + F.size(F.filter("neighbors", lambda x: x == F.col("id")))
        return (self.out.agg(F.coalesce(F.sum(F.size("neighbors") if self.is_directed() else twice), F.lit(0))).first()[0]) // (1 if self.is_directed() else 2)

    def _row(self, table: DataFrame | None, node_id: int, column: str):
        row = table.where(F.col("id") == node_id).select(column).first() if table is not None else None
        return row and row[0]

    def inner_neighbors(self, node_id: int) -> list[int]:
        return self._row(self.out, node_id, "neighbors") or []

    def inner_in_neighbors(self, node_id: int) -> list[int]:
        """None of an undirected graph."""
        return self._row(self.into, node_id, "in_neighbors") or []

    def get_node_label(self, node_id: int):
        return self._row(self.out, node_id, "label")

    def edges_between(self, pairs: DataFrame) -> DataFrame:
        """src, dst, found, label, edge_index (its place in the flat vector) for a table of pairs."""
        at = F.array_position("neighbors", F.col("dst"))
        joined = pairs.select("src", "dst").join(self.out.select(F.col("id").alias("src"), "offset", "neighbors", "edge_labels"), "src", "left").withColumn("at", F.coalesce(at, F.lit(0)))
        index = F.when(F.col("at") > 0, F.col("offset") + F.col("at") - 1)
        return joined.select("src", "dst", (F.col("at") > 0).alias("found"), F.when(F.col("at") > 0, F.get("edge_labels", F.col("at").cast("int") - 1)).alias("label"), index.alias("edge_index"))

    def _between(self, start: int, target: int):
        pair = self.out.sparkSession.createDataFrame([(start, target)], "src long, dst long")
        return self.edges_between(pair).first()

    def has_edge(self, start: int, target: int) -> bool:
        return self._between(start, target)["found"]

    def get_edge_label(self, start: int, target: int):
        return self._between(start, target)["label"]

    def find_edge_index(self, start: int, target: int) -> int | None:
        return self._between(start, target)["edge_index"]


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    dictionary.write.mode("overwrite").parquet(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
