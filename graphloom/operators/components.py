"""Connected components of links between 64-bit ids.

The stars of Kiveris et al. (2014): in turn every id hands its larger neighbours to the least id it knows,
and its smaller ones to the least of them, until every component is a star around its least id. Links only
shrink. Each round is two aggregations and two joins on an id; rounds grow with the logarithm of the size. A round reads
its links once for each of them, and what its plans left on the driver goes before the next if the driver's heap has grown.
Before a round one aggregation looks for ids that are not yet at their place, so that links which are stars take no round and
none is made to see that nothing changes. Beyond SPLIT links the aggregates are written before they are joined, so that both
sides of a join are exchanged as they are and Spark may split the rows of a hub. Nothing goes to the driver but two counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, shuffles_freed


#: Links beyond which a hub is worth a table of its own in each round.
SPLIT = 1_000_000


def stars(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """id, component (the least id of its component) for every id that has a link, itself included.

    Links count in both directions; a link of an id to itself makes it known; nulls are ignored.
    """
    a, b = F.col(src), F.col(dst)
    known = links.where(a.isNotNull() & b.isNotNull())
    loops = known.where(a == b).select(a.alias("id"))
    star = cut(known.where(a != b).select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).distinct())
    while True:
        with shuffles_freed(star.sparkSession):
            size, amiss = _unsettled(star).first()
        if not amiss:
            break
        written = cut if size > SPLIT else lambda df: df
        both = _either(star, ("big", "small"), ("small", "big"))
        least = written(both.groupBy("big").agg(F.least("big", F.min("small")).alias("to")))
        large = written(both.where("small > big").join(least, "big").select(F.col("small").alias("big"), F.col("to").alias("small")).distinct())
        least = written(large.groupBy("big").agg(F.min("small").alias("to")))
        star = cut(_either(large.join(least, "big"), ("small", "to"), ("big", "to")).where("big <> small").distinct())
        del both, least, large
    # an id is a root, or alone with itself, where it has no lesser one
    found = _either(star, ("big", "small"), ("small", "small")).select(F.col("big").alias("id"), F.col("small").alias("component"))
    return found.unionByName(loops.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _either(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """big, small: of each row these pairs of its columns, in one pass (a union would be a pass and tasks for each)."""
    made = F.array(*[F.struct(F.col(a).alias("big"), F.col(b).alias("small")) for a, b in pairs])
    return rows.select(F.explode(made).alias("pair")).select("pair.big", "pair.small")


def _unsettled(star: DataFrame) -> DataFrame:
    """One row: the links (each there once), and the ids that keep them from being stars: these have two lesser ids, or one and a larger one."""
    ends = F.array(F.struct(F.col("big").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("small").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ids = star.select(F.explode(ends).alias("end")).groupBy("end.id").agg(F.sum("end.up").alias("up"), F.max("end.down").alias("down"))
    return ids.agg(F.sum("up"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)))


# what graphs ask of components


def components(g, include_isolated: bool = False) -> DataFrame:
    """id, component (its least id). Edges count in both directions. Nodes without an edge are unknown unless asked for."""
    found = stars(g.edges)
    if not include_isolated:
        return found
    alone = g.nodes.select("id").join(found, "id", "left_anti")
    return found.unionByName(alone.select("id", F.col("id").alias("component")))


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("component").agg(F.count("*").alias("size"))


def component_count(found: DataFrame) -> int:
    return found.select("component").distinct().count()


def are_connected(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, connected for a table of pairs; False if either is unknown."""
    side = lambda name: found.select(F.col("id").alias(name), F.col("component").alias(f"c_{name}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.select("a", "b", F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False)).alias("connected"))


def is_connected(found: DataFrame, a: int, b: int) -> bool:
    pair = found.sparkSession.createDataFrame([(a, b)], "a long, b long")
    return are_connected(found, pair).first()["connected"]


def roots(found: DataFrame, ids: DataFrame) -> DataFrame:
    """id, root for a table of ids: the least id of each one's component, null if it is unknown."""
    return ids.join(found.select("id", F.col("component").alias("root")), "id", "left").select("id", "root")


def get_root(found: DataFrame, node_id: int) -> int | None:
    row = found.where(F.col("id") == node_id).first()
    return row and row["component"]


#: Components are stars, so a node's parent is its root.
get_parent = get_root


def connected_nodes(found: DataFrame, node_id: int) -> DataFrame | None:
    """Ids of the node's component, or None if it is unknown."""
    row = found.where(F.col("id") == node_id).first()
    return row and found.where(F.col("component") == row["component"]).select("id")


class ConnectedSubgraphs:
    """A graph's components as graphs of their own. Nodes without edges are components by themselves."""

    def __init__(self, g):
        self.graph = g
        self.of = cut(components(g, include_isolated=True))

    def nodes(self) -> DataFrame:
        """id, label, component."""
        return self.graph.nodes.join(self.of, "id")

    def edges(self) -> DataFrame:
        """src, dst, label, component."""
        return self.graph.edges.join(self.of.withColumnRenamed("id", "src"), "src").select("src", "dst", "label", "component")

    def roots(self) -> DataFrame:
        return self.of.select("component").distinct()

    def subgraph(self, component: int):
        from ..graph import PropertyGraph

        own = F.col("component") == component
        return PropertyGraph(self.nodes().where(own).select("id", "label"), self.edges().where(own).drop("component"), self.graph.directed)
