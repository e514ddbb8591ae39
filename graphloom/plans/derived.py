"""Graphs made of the relational tables, on which the queries run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ordering import numbered, together
from ..graph import PropertyGraph

NATION, CUSTOMER, SUPPLIER, ORDER = 100, 1_000_000, 10_000_000, 100_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(column: str, base: int = 0) -> Column:
    return (F.col(column).cast("long") + F.lit(base)).cast("long")


def _union(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first


def geo(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, their nations, and the nations' customers and suppliers: five trees."""
    r, n, c, s = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    node = lambda df, key, base, label: df.select(_key(key, base).alias("id"), label.alias("label"))
    edge = lambda df, src, sb, dst, db, label: df.select(_key(src, sb).alias("src"), _key(dst, db).alias("dst"), F.lit(label).alias("label"))
    nodes = _union(
        node(r, "r_regionkey", 0, F.lit("region")), node(n, "n_nationkey", NATION, F.lit("nation")),
        node(c, "c_custkey", CUSTOMER, F.col("c_mktsegment")), node(s, "s_suppkey", SUPPLIER, F.lit("supplier")),
    )
    edges = _union(
        edge(n, "n_regionkey", 0, "n_nationkey", NATION, "hasNation"),
        edge(c, "c_nationkey", NATION, "c_custkey", CUSTOMER, "hasCustomer"),
        edge(s, "s_nationkey", NATION, "s_suppkey", SUPPLIER, "hasSupplier"),
    )
    return PropertyGraph(nodes, edges)


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers to suppliers of their orders, labelled with the greatest return flag."""
    g = geo(spark, sf_dir)
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = line.select("l_orderkey", "l_suppkey", "l_returnflag").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = joined.groupBy(_key("o_custkey", CUSTOMER).alias("src"), _key("l_suppkey", SUPPLIER).alias("dst")).agg(F.max("l_returnflag").alias("label"))
    return PropertyGraph(g.nodes.where(F.col("id") >= CUSTOMER), edges)


def supply(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts and suppliers, undirected, labelled with the greatest line status."""
    line = table(spark, sf_dir, "lineitem")
    pairs = line.select(_key("l_partkey").alias("src"), _key("l_suppkey", SUPPLIER).alias("dst"), "l_linestatus")
    edges = together(pairs, ["src", "dst"]).groupBy("src", "dst").agg(F.max("l_linestatus").alias("label"))
    parts = table(spark, sf_dir, "part").select(_key("p_partkey").alias("id"), F.lit("part").alias("label"))
    suppliers = table(spark, sf_dir, "supplier").select(_key("s_suppkey", SUPPLIER).alias("id"), F.lit("supplier").alias("label"))
    nodes = _union(parts, suppliers)
    return PropertyGraph(nodes, edges, directed=False)


def clicks(spark: SparkSession, sf_dir: str, directed: bool = True) -> PropertyGraph:
    """Event types, and which follows which within a user's events; with cycles and self loops."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = e.select(before.alias("a"), F.col("event_type").alias("b")).where("a is not null").distinct()
    kinds = e.select("event_type").distinct()
    nodes = numbered(kinds, [F.col("event_type")], "id").select("id", F.col("event_type").alias("label"))
    at = lambda c, to: nodes.select(F.col("id").alias(to), F.col("label").alias(c))
    edges = steps.join(at("a", "src"), "a").join(at("b", "dst"), "b").select("src", "dst", F.lit(None).cast("string").alias("label"))
    return PropertyGraph(nodes, edges) if directed else PropertyGraph.of(nodes, edges, False)


def star(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers with orders, and all orders, undirected; a component for each customer."""
    o = table(spark, sf_dir, "orders")
    edges = o.select(_key("o_custkey", CUSTOMER).alias("src"), _key("o_orderkey", ORDER).alias("dst"), F.col("o_orderpriority").alias("label"))
    nodes = _union(edges.select(F.col("src").alias("id"), F.lit("customer").alias("label")).distinct(), edges.select(F.col("dst").alias("id"), F.lit("order").alias("label")))
    return PropertyGraph(nodes, edges, directed=False)
