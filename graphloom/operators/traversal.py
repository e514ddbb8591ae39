"""Breadth-first and depth-first order of a whole graph.

Both visit every node: where a tree is exhausted they go on at the least id not yet found. Rank the start
first and all other nodes by id. A node belongs to the tree of the least-ranked node that reaches it, and all
paths from that root to it stay within the tree. So roots spread along edges until nothing changes, edges
between trees fall away, and all trees are walked at the same time.

Without start the least id is first; a start that isn't a node, or an empty graph, raises ValueError.
reachable_only keeps the start's tree alone.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..graph import PropertyGraph
from ..scratch import configured, cut
from ..shipping import ship

#: Ranks before all ids.
FIRST = -(1 << 63)
#: Levels that stay tables of their own.
MERGE = 16
#: Rows and bytes that a walk takes in at once.
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


def _start(g: PropertyGraph, start: int | None) -> int:
    if start is None:
        start = g.nodes.agg(F.min("id")).first()[0]
        if start is None:
            raise ValueError("the graph has no nodes")
    elif not g.has_node(start):
        raise ValueError(f"there is no node {start}")
    return start


def _rank(*starts: int):
    return F.when(F.col("id").isin(*starts), F.lit(FIRST)).otherwise(F.col("id")) if starts else F.col("id")


def _adjacent(g: PropertyGraph) -> DataFrame:
    """src, dst as seen from src, without loops. Edges may be costly to make, so they are written once and not made in every round."""
    once = cut(g.edges.where("src <> dst").select("src", "dst"))
    return once if g.directed else once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def trees(g: PropertyGraph, starts: list[int], reachable_only: bool, edges: DataFrame | None = None) -> DataFrame:
    """id, tree: the rank of the root of each node's tree; the starts share one. Only nodes whose tree changed hand it on."""
    edges = _adjacent(g) if edges is None else edges
    if reachable_only:
        found = changed = cut(g.nodes.where(F.col("id").isin(*starts)).select("id", F.lit(FIRST).alias("tree")))
    else:
        found = changed = cut(g.nodes.select("id", _rank(*starts).alias("tree")))
    while True:
        offers = edges.join(changed.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("tree").alias("offer"))
        better = offers.join(found, "id", "left").where("tree is null or offer < tree").select("id", F.col("offer").alias("tree"))
        changed = cut(better)
        if changed.isEmpty():
            return found
        found = cut(found.join(changed.select("id"), "id", "left_anti").unionByName(changed))


def bfs(g: PropertyGraph, start: int | None = None, reachable_only: bool = False) -> DataFrame:
    """id, root, level, pos: breadth-first order, neighbours ascending, pos counting from 0."""
    start = _start(g, start)
    edges = _adjacent(g)
    tree = trees(g, [start], reachable_only, edges)
    inside = cut(_inside(g, edges, tree))
    frontier = cut(tree.where(_rank(start) == F.col("tree")).select("id", "tree", F.lit(0).alias("level"), F.lit(0).cast("long").alias("at")))
    # a level is written once; only every MERGE levels what was found is brought into one table
    levels, level = [frontier], 0
    while True:
        level += 1
        seen = reduce(DataFrame.unionByName, levels)
        offers = inside.join(frontier.select(F.col("id").alias("src"), "at"), "src").groupBy(F.col("dst").alias("id"), "tree").agg(F.min("at").alias("parent"))
        new = cut(offers.join(seen.select("id"), "id", "left_anti"))
        many = new.count()
        if not many:
            break
        # places within a level need only grow in the right order; pos is counted once, at the end
        ordered = numbered(new, [F.col("tree"), F.col("parent"), F.col("id")], "at", many > 100_000)
        frontier = cut(ordered.select("id", "tree", F.lit(level).alias("level"), "at"))
        levels = [*levels, frontier] if len(levels) < MERGE else [cut(seen), frontier]
    return numbered(seen, [F.col("tree"), F.col("level"), F.col("at")], "pos").select("id", _root(start), "level", "pos")


def _inside(g: PropertyGraph, edges: DataFrame, tree: DataFrame) -> DataFrame:
    """Edges within trees: src, dst, tree. Both ends of an undirected edge are in one tree."""
    a, b = tree.select(F.col("id").alias("src"), "tree"), tree.select(F.col("id").alias("dst"), F.col("tree").alias("other"))
    if g.directed:
        edges = edges.join(b, "dst")
    within = edges.join(a, "src")
    return (within.where("tree = other") if g.directed else within).select("src", "dst", "tree")


def _root(start: int):
    return F.when(F.col("tree") == FIRST, F.lit(start)).otherwise(F.col("tree")).alias("root")


def dfs(g: PropertyGraph, start: int | None = None, reachable_only: bool = False) -> DataFrame:
    """id, root, pos: depth-first order. All undiscovered neighbours are marked as they are pushed, ascending,
    so the greatest is visited first. A tree is walked by one task: its edges lie on that worker's disk, each is read
    once, and memory grows with its nodes alone."""
    return _depth_first(g, [_start(g, start)], reachable_only)


def dfs_from_parts(g: PropertyGraph, stack: list[int], undiscovered: DataFrame) -> DataFrame:
    """id, root, pos: what is left of a depth-first order, from its stack (the last is next) and a table of the ids not
    discovered yet. root is null for what the stack leads to. The stack's ids count as discovered."""
    known = cut(undiscovered.select(F.col("id").cast("long").alias("id")).unionByName(g.spark.createDataFrame([(x,) for x in stack], "id long")).distinct())
    ends = lambda c: known.select(F.col("id").alias(c))
    left = replace(g, nodes=g.nodes.join(known, "id", "left_semi"), edges=g.edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select("src", "dst", "label"))
    order = _depth_first(left, stack, False)
    return order.select("id", F.when(F.col("root") != F.lit(FIRST), F.col("root")).alias("root"), "pos")


def _depth_first(g: PropertyGraph, stack: list[int], reachable_only: bool) -> DataFrame:
    """From a stack whose nodes are discovered. Of several in it the root is FIRST."""
    edges = _adjacent(g)
    tree = trees(g, stack, reachable_only, edges)
    lists = _inside(g, edges, tree).groupBy("src").agg(F.collect_list("dst").alias("after"))
    # a node without edges has an empty list
    rows = tree.join(lists.withColumnRenamed("src", "id"), "id", "left").select("id", "tree", F.coalesce("after", F.array().cast("array<long>")).alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree, at in walked(batches, stack):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), tree)), pa.array(np.arange(at, at + len(ids)))], names=["id", "tree", "at"])

    ship(g.spark)
    sizes = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    with configured(g.spark, sizes):
        order = cut(rows.repartition("tree").mapInArrow(run, "id long, tree long, at long"))
    return numbered(order, [F.col("tree"), F.col("at")], "pos").select("id", _root(stack[0] if len(stack) == 1 else FIRST), "pos")


def walked(batches: Iterator[pa.RecordBatch], stack: list[int]) -> Iterator[tuple[np.ndarray, int, int]]:
    """Parts of the order of each tree: ids, the tree, and the place of the first. batches: id, tree, after (the node's
    neighbours in any order), whole trees. The lists go to a file as they come and are read when their node is visited."""
    with tempfile.TemporaryFile(buffering=1 << 20) as file:
        parts = []
        for batch in batches:
            after = batch.column(2)
            file.write(np.ascontiguousarray(after.flatten().to_numpy(zero_copy_only=False), np.int64).tobytes())
            # copies, since a view would keep its whole batch
            parts.append((batch.column(0).to_numpy().copy(), batch.column(1).to_numpy().copy(), pc.list_value_length(after).to_numpy(zero_copy_only=False).astype(np.int64)))
        if not parts:
            return
        file.flush()
        ids, tree, size = (np.concatenate(c) for c in zip(*parts))
        del parts
        first = np.cumsum(size) - size
        order = np.lexsort((ids, tree))
        ids, tree, size, first = (c[order] for c in (ids, tree, size, first))
        del order
        ends = [*(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), len(tree)]
        for a, b in zip([0, *ends], ends):
            yield from _walk(file.fileno(), ids[a:b], int(tree[a]), size[a:b], first[a:b], stack)


def _walk(file: int, ids: np.ndarray, tree: int, size: np.ndarray, first: np.ndarray, stack: list[int]) -> Iterator[tuple[np.ndarray, int, int]]:
    """ids ascending, with the number of each one's neighbours and their place in the file."""
    roots = np.array(stack if tree == FIRST else [tree], np.int64)
    at = np.searchsorted(ids, roots)
    left = at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == roots)]
    # a node is put on once, so the stack has room for all
    todo, top, found = np.empty(len(ids) + len(left), np.int64), len(left), np.zeros(len(ids), bool)
    todo[:top], found[left] = left, True
    done, place = [], 0
    while top:
        top -= 1
        k = int(todo[top])
        done.append(k)
        if n := int(size[k]):
            new = np.searchsorted(ids, np.frombuffer(os.pread(file, 8 * n, 8 * int(first[k])), np.int64))
            new = np.unique(new[~found[new]])
            found[new] = True
            todo[top : top + len(new)] = new
            top += len(new)
        if len(done) == 1 << 16:
            yield ids[done], tree, place
            done, place = [], place + len(done)
    if done:
        yield ids[done], tree, place


def reachable(g: PropertyGraph, start: int) -> DataFrame:
    """Ids that can be reached from start, itself included."""
    return trees(g, [_start(g, start)], True).select("id")


class Traversal:
    """An order as an iterator over ids; reset() begins anew."""

    def __init__(self, g: PropertyGraph, start: int | None = None, depth_first: bool = False, reachable_only: bool = False):
        self.order = cut((dfs if depth_first else bfs)(g, start, reachable_only))
        self.reset()

    def reset(self) -> None:
        self._rows: Iterator = self.order.orderBy("pos").toLocalIterator()

    def __iter__(self) -> Traversal:
        return self

    def __next__(self) -> int:
        return next(self._rows)["id"]
