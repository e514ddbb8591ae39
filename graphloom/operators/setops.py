"""Union, difference, equality and fingerprints of graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import together
from ..graph import PropertyGraph, canonical, label_type


def _second_wins(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    rows = a.select(*key, "label", F.lit(0).alias("of")).unionByName(b.select(*key, F.col("label").cast(label_type(a)).alias("label"), F.lit(1).alias("of")))
    return together(rows, key).groupBy(*key).agg(F.max_by(F.struct("label"), "of").alias("b")).select(*key, F.col("b.label").alias("label"))


def union(g0: PropertyGraph, g1: PropertyGraph) -> PropertyGraph:
    """All nodes and edges of both. Where both have one, g1's label counts, null included. g0 says whether edges
    are directed. One aggregation for each table."""
    edges = _second_wins(g0.edges, canonical(g1.edges, g0.directed), ["src", "dst"])
    return PropertyGraph(_second_wins(g0.nodes, g1.nodes, ["id"]), edges, g0.directed)


def minus(g0: PropertyGraph, g1: PropertyGraph) -> PropertyGraph:
    """g0 without g1's nodes, the edges at them, and g1's edges."""
    gone = g1.nodes.select("id")
    edges = g0.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    edges = edges.join(canonical(g1.edges, g0.directed).select("src", "dst"), ["src", "dst"], "left_anti")
    return PropertyGraph(g0.nodes.join(gone, "id", "left_anti"), edges.select("src", "dst", "label"), g0.directed)


def copy(g: PropertyGraph) -> PropertyGraph:
    """Tables never change, so a graph is its own copy."""
    return g


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, nulls being equal to nulls."""
    rows = a.select("*", F.lit(1).alias("side")).unionByName(b.select("*", F.lit(-1).alias("side")))
    return rows.groupBy(*a.columns).agg(F.sum("side").alias("side")).where("side <> 0")


def equal(g0: PropertyGraph, g1: PropertyGraph) -> bool:
    """The same direction, nodes, edges and labels by value; symmetric."""
    if g0.directed != g1.directed:
        return False
    return differences(g0.nodes, g1.nodes).isEmpty() and differences(g0.edges, g1.edges).isEmpty()


def fingerprint(g: PropertyGraph) -> DataFrame:
    """One row with a number that is equal for equal graphs, whatever the order of their rows."""
    number = lambda df, cols: df.agg(F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).alias("h"), F.count("*").alias("n"))
    n, e = number(g.nodes, ["id", "label"]), number(g.edges, ["src", "dst", "label"])
    parts = n.select(F.lit("n").alias("k"), "h", "n").unionByName(e.select(F.lit("e").alias("k"), "h", "n"))
    return parts.agg(F.xxhash64(F.lit(g.directed), F.array_sort(F.collect_list(F.concat_ws(":", "k", "h", "n")))).alias("fingerprint"))
