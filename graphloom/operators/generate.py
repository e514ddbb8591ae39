"""Generated graphs. All randomness is seeded, so a graph can be made again."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..scratch import cut
from .mutate import remove_edge_labels

#: Rows that one task sorts where a random choice is cut off.
SORTED = 10_000


def _pick(labels: list | None, seed: int) -> Column:
    if not labels:
        return F.lit(None).cast("string")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), (F.floor(F.rand(seed) * len(labels)) + 1).cast("int"))


def empty_graph(spark: SparkSession, n: int, node_labels: list | None = None, directed: bool = True, seed: int = 0) -> PropertyGraph:
    """Nodes 0 to n - 1, each with a random one of the labels, and no edges."""
    g = PropertyGraph.empty(spark, directed)
    return replace(g, nodes=spark.range(n).select("id", _pick(node_labels, seed).alias("label")))


def pairs(spark: SparkSession, n: int, directed: bool) -> DataFrame:
    """All pairs of different nodes, each made from its first node: src < dst, or both orders if directed."""
    one = spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if directed else one


def complete_graph(spark: SparkSession, n: int, node_labels: list | None = None, edge_labels: list | None = None, directed: bool = True, seed: int = 0) -> PropertyGraph:
    edges = pairs(spark, n, directed).select("src", "dst", _pick(edge_labels, seed + 1).alias("label"))
    return replace(empty_graph(spark, n, node_labels, directed, seed), edges=edges)


def random_gnp_graph(spark: SparkSession, n: int, p: float, node_labels: list | None = None, edge_labels: list | None = None, directed: bool = True, seed: int = 0) -> PropertyGraph:
    """Every pair is an edge with probability p."""
    if not 0 <= p <= 1:
        raise ValueError("p must lie between 0 and 1")
    if p == 0:
        return empty_graph(spark, n, node_labels, directed, seed)
    if p == 1:
        # all pairs, made when they are read; their number is the square of n
        return complete_graph(spark, n, node_labels, edge_labels, directed, seed)
    edges = pairs(spark, n, directed).where(F.rand(seed + 2) < p).select("src", "dst", _pick(edge_labels, seed + 1).alias("label"))
    return replace(empty_graph(spark, n, node_labels, directed, seed), edges=cut(edges))


def random_gnm_graph(spark: SparkSession, n: int, m: int, node_labels: list | None = None, edge_labels: list | None = None, directed: bool = True, seed: int = 0) -> PropertyGraph:
    """Exactly m different pairs, uniformly."""
    most = n * (n - 1) // (1 if directed else 2)
    if m > most:
        raise ValueError(f"{n} nodes have {most} pairs at most")
    if 4 * m >= most:
        # a random double is a multiple of 2**-53
        chosen = _least(cut(pairs(spark, n, directed).select("src", "dst", (F.rand(seed + 2) * 2**53).cast("long").alias("r"))), m)
    else:
        chosen = _drawn(spark, n, m, directed, seed, None)
    edges = chosen.select("src", "dst", _pick(edge_labels, seed + 1).alias("label"))
    return replace(empty_graph(spark, n, node_labels, directed, seed), edges=cut(edges))


def _drawn(spark: SparkSession, n: int, m: int, directed: bool, seed: int, but: DataFrame | None) -> DataFrame:
    """m different random pairs out of many more, without those in `but`: drawn with repeats, then thinned."""
    found, tries = None, 0
    while True:
        tries += 1
        many = spark.range(2 * m + 16).select(F.floor(F.rand(seed + 100 * tries) * n).cast("long").alias("src"), F.floor(F.rand(seed + 100 * tries + 1) * (n - 1)).cast("long").alias("other"))
        drawn = many.select("src", (F.col("other") + (F.col("other") >= F.col("src")).cast("long")).alias("dst"))
        if not directed:
            drawn = drawn.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        drawn = drawn if found is None else drawn.unionByName(found)
        found = cut((drawn if but is None else drawn.join(but, ["src", "dst"], "left_anti")).distinct())
        if found.count() >= m:
            return _least(found.select("src", "dst", F.xxhash64(F.lit(seed), "src", "dst").alias("r")), m)


def _least(rows: DataFrame, m: int) -> DataFrame:
    """src, dst of the m rows with the least (r, src, dst). Rows are counted by leading bits of r until the one group that
    is cut through is small; that alone is sorted, so no task holds m rows, and nothing is moved."""
    taken, rest, shift = F.lit(False), F.lit(True), 64
    while True:
        shift -= 16
        group = F.shiftright("r", shift)
        counts = sorted((x["g"], x["n"]) for x in rows.where(rest).groupBy(group.alias("g")).agg(F.count("*").alias("n")).collect())
        for g, n in counts:
            if m < n:
                break
            m -= n
        else:
            return rows.where(taken | rest).select("src", "dst")
        taken, rest = taken | (rest & (group < g)), rest & (group == g)
        if n <= SORTED or not shift:
            break
    return rows.where(taken).select("src", "dst").unionByName(rows.where(rest).orderBy("r", "src", "dst").limit(m).select("src", "dst"))


def empty_graph_unlabeled(spark: SparkSession, n: int, directed: bool = True) -> PropertyGraph:
    return empty_graph(spark, n, directed=directed)


def complete_graph_unlabeled(spark: SparkSession, n: int, directed: bool = True) -> PropertyGraph:
    return complete_graph(spark, n, directed=directed)


def random_gnp_graph_unlabeled(spark: SparkSession, n: int, p: float, directed: bool = True, seed: int = 0) -> PropertyGraph:
    return random_gnp_graph(spark, n, p, directed=directed, seed=seed)


def random_gnm_graph_unlabeled(spark: SparkSession, n: int, m: int, directed: bool = True, seed: int = 0) -> PropertyGraph:
    return random_gnm_graph(spark, n, m, directed=directed, seed=seed)


def densified(g: PropertyGraph, average_degree: int, seed: int = 0) -> PropertyGraph:
    """With random unlabelled edges between existing nodes until 2 * edges = average_degree * nodes.

    No loops and no edges that exist; a graph that is dense enough stays as it is.
    """
    n, e = g.node_count(), g.edge_count()
    more = average_degree * n // 2 - e
    if more <= 0:
        return g
    most = n * (n - 1) // (1 if g.directed else 2)
    loops = g.edges.where("src = dst").count()
    if e - loops + more > most:
        raise ValueError("there are not enough pairs of nodes")
    from ..graph import canonical
    from .reorder import dense_node_ids

    ids = cut(dense_node_ids(g))
    at = lambda c, to: ids.select(F.col("old_id").alias(c), F.col("new_id").alias(to))
    old = g.edges.where("src <> dst").join(at("src", "a"), "src").join(at("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    old = cut(canonical(old, g.directed))
    if 4 * (e + more) >= most:
        new = _least(cut(pairs(g.spark, n, g.directed).join(old, ["src", "dst"], "left_anti").select("src", "dst", F.xxhash64(F.lit(seed), "src", "dst").alias("r"))), more)
    else:
        new = _drawn(g.spark, n, more, g.directed, seed, old)
    back = lambda c, to: ids.select(F.col("new_id").alias(c), F.col("old_id").alias(to))
    from ..graph import label_type

    named = new.select("src", "dst").join(back("src", "a"), "src").join(back("dst", "b"), "dst")
    new = named.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(None).cast(label_type(g.edges)).alias("label"))
    return replace(g, edges=g.edges.unionByName(cut(canonical(new, g.directed))))


def relabelled_randomly(g: PropertyGraph, seed: int = 0, sides: int = 15, above: int = 10) -> PropertyGraph:
    """Without edge labels; each node throws a number under `sides` and takes it as its label if it is over `above`."""
    from ..graph import label_type

    throw = cut(g.nodes.select("id", "label", F.floor(F.rand(seed) * sides).cast("long").alias("r")))
    kind = label_type(g.nodes)
    nodes = throw.select("id", F.when(F.col("r") > above, F.col("r").cast(kind)).otherwise(F.col("label")).alias("label"))
    return remove_edge_labels(replace(g, nodes=nodes, node_dictionary=None))
