"""Changes to a graph, each for a whole batch: a new graph comes back, the old one stays as it is.

Batches have a column seq that orders them; of several rows for one key the last one counts. Without seq the
greatest label counts, null last. A row for a key that exists replaces its label, by null too.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, canonical, label_type, with_end_points


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key, as key and label. Summed up before the shuffle, like any aggregate."""
    order = [F.col("seq")] if "seq" in rows.columns else []
    best = F.max(F.struct(*order, F.col("label").isNotNull().alias("has"), F.col("label").alias("label")))
    return rows.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.label").alias("label"))


def _after(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    kind = label_type(old)
    rows = new.select(*key, F.col("label").cast(kind).alias("label"), *(["seq"] if "seq" in new.columns else []))
    last = latest(rows, key)
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def add_nodes(g: PropertyGraph, batch: DataFrame) -> PropertyGraph:
    """batch: id, label, seq. Existing ids get the new label, null included."""
    return replace(g, nodes=_after(g.nodes, batch.withColumn("id", F.col("id").cast("long")), ["id"]))


def are_new_nodes(g: PropertyGraph, batch: DataFrame) -> DataFrame:
    """id, added: False for ids that the graph has already."""
    return batch.select("id").distinct().join(g.nodes.select("id", F.lit(False).alias("added")), "id", "left").withColumn("added", F.coalesce("added", F.lit(True)))


def add_edges(g: PropertyGraph, batch: DataFrame) -> PropertyGraph:
    """batch: src, dst, label, seq. Missing end points become unlabelled nodes."""
    rows = canonical(batch.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")}), g.directed)
    edges = _after(g.edges, rows, ["src", "dst"])
    return replace(g, nodes=with_end_points(g.nodes, rows), edges=edges)


def are_new_edges(g: PropertyGraph, batch: DataFrame) -> DataFrame:
    return g.has_edges(batch.select("src", "dst").distinct()).select("src", "dst", (~F.col("found")).alias("added"))


def remove_nodes(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Without the nodes and all edges at them, self loops included. The greatest id seen stays known."""
    gone = ids.select(F.col("id").cast("long").alias("id")).distinct()
    edges = g.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return replace(g, nodes=g.nodes.join(gone, "id", "left_anti"), edges=edges.select("src", "dst", "label"), seen_id=g.max_seen_id())


def remove_edges(g: PropertyGraph, pairs: DataFrame) -> PropertyGraph:
    """Without these edges; undirected ones in either order."""
    gone = canonical(pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), g.directed)
    return replace(g, edges=g.edges.join(gone, ["src", "dst"], "left_anti"))


def _relabelled(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    change = latest(new.select(*key, F.col("label").cast(label_type(old)).alias("label"), *(["seq"] if "seq" in new.columns else [])), key)
    joined = old.join(change.select(*key, F.struct("label").alias("change")), key, "left")
    return joined.select(*key, F.when(F.col("change").isNotNull(), F.col("change.label")).otherwise(F.col("label")).alias("label"))


def update_node_labels(g: PropertyGraph, batch: DataFrame) -> PropertyGraph:
    """Existing nodes get the batch's labels; other ids are ignored."""
    return replace(g, nodes=_relabelled(g.nodes, batch, ["id"]))


def update_edge_labels(g: PropertyGraph, batch: DataFrame) -> PropertyGraph:
    return replace(g, edges=_relabelled(g.edges, canonical(batch, g.directed), ["src", "dst"]))


def set_node_labels(g: PropertyGraph, label: Column) -> PropertyGraph:
    """Labels by an expression over id and label."""
    return replace(g, nodes=g.nodes.select("id", label.alias("label")))


def set_edge_labels(g: PropertyGraph, label: Column) -> PropertyGraph:
    return replace(g, edges=g.edges.select("src", "dst", label.alias("label")))


def remove_node_labels(g: PropertyGraph) -> PropertyGraph:
    return replace(set_node_labels(g, F.lit(None).cast(label_type(g.nodes))), node_dictionary=None)


def remove_edge_labels(g: PropertyGraph) -> PropertyGraph:
    return replace(set_edge_labels(g, F.lit(None).cast(label_type(g.edges))), edge_dictionary=None)


def remove_labels(g: PropertyGraph) -> PropertyGraph:
    return remove_edge_labels(remove_node_labels(g))
