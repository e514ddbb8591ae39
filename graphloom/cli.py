"""Tools on graph files: python -m graphloom.cli TOOL ...

csv-to-static     CSV files to a compact snapshot, with ids reordered by degree and labels by frequency if asked
ldbc-to-graph     a benchmark directory to a snapshot
graph-to-csv      a snapshot to CSV files
graph-to-compact  a snapshot to compact adjacency
stats             counts, greatest degree and label histograms of a snapshot
remove-labels     a snapshot without labels
vary-labels       a snapshot with random node labels
vary-density      snapshots with random edges up to given average degrees, each from the graph as it is
"""

from __future__ import annotations

import argparse
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .graph import PropertyGraph
from .operators import generate as C
from .operators import mutate as M
from .operators import reorder as R
from .scratch import cut
from .sources import csv, ldbc, snapshot


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    tools = p.add_subparsers(dest="tool", required=True)
    t = tools.add_parser("csv-to-static")
    t.add_argument("edges")
    t.add_argument("out")
    t.add_argument("--nodes")
    t.add_argument("--separator", default="comma")
    t.add_argument("--no-headers", action="store_true")
    t.add_argument("--flexible", action="store_true")
    t.add_argument("--undirected", action="store_true")
    t.add_argument("--reorder-node-id", action="store_true")
    t.add_argument("--reorder-label-id", action="store_true")
    t = tools.add_parser("ldbc-to-graph")
    t.add_argument("directory")
    t.add_argument("out")
    t.add_argument("--undirected", action="store_true")
    for name in ("graph-to-csv", "graph-to-compact", "remove-labels"):
        t = tools.add_parser(name)
        t.add_argument("graph")
        t.add_argument("out")
    t = tools.add_parser("stats")
    t.add_argument("graph")
    t.add_argument("--top", type=int, default=50)
    t = tools.add_parser("vary-labels")
    t.add_argument("graph")
    t.add_argument("out")
    t.add_argument("--seed", type=int, default=0)
    t = tools.add_parser("vary-density")
    t.add_argument("graph")
    t.add_argument("out")
    t.add_argument("degrees", type=int, nargs="+")
    t.add_argument("--seed", type=int, default=0)
    return p


def stats(g, top: int) -> dict:
    """Counts, the greatest degree, and the most common labels (a report of `top` rows each)."""
    common = lambda df: [tuple(r) for r in df.orderBy(F.desc("n"), "label").limit(top).collect()]
    numbers = {"nodes": g.node_count(), "edges": g.edge_count(), "max_degree": g.max_degree().first()[0], "average_degree": g.average_degree()}
    return numbers | {"node_labels": common(g.node_label_counts()), "edge_labels": common(g.edge_label_counts())}


def _written(g: PropertyGraph) -> PropertyGraph:
    return replace(g, nodes=cut(g.nodes), edges=cut(g.edges))


def run(spark: SparkSession, arguments: list[str]) -> object:
    a = _parser().parse_args(arguments)
    if a.tool == "csv-to-static":
        g = csv.read_csv_graph(spark, a.nodes, a.edges, not a.undirected, a.separator, not a.no_headers, a.flexible)
        # each step reads its graph several times, so it is written before
        g = _written(g)
        g = _written(R.with_node_ids(g, R.dense_node_ids(g)))
        g = _written(R.reordered(g, a.reorder_node_id, a.reorder_label_id, a.reorder_label_id).graph)
        snapshot.export(g, f"{a.out}/graph")
        snapshot.export_compact(g, f"{a.out}/compact")
        return g
    if a.tool == "ldbc-to-graph":
        g = ldbc.read_ldbc_graph(spark, a.directory, not a.undirected)
        path = f"{a.out}/ldbc_{g.node_count()}_{g.edge_count()}"
        snapshot.export(g, path)
        return path
    g = snapshot.load(spark, a.graph)
    if a.tool == "graph-to-csv":
        return csv.write_csv_graph(g, f"{a.out}/nodes", f"{a.out}/edges")
    if a.tool == "graph-to-compact":
        return snapshot.export_compact(g, a.out)
    if a.tool == "stats":
        return stats(g, a.top)
    if a.tool == "remove-labels":
        return snapshot.export(M.remove_labels(g), a.out)
    if a.tool == "vary-labels":
        return snapshot.export(C.relabelled_randomly(g, a.seed), a.out)
    paths = []
    for k in a.degrees:
        paths.append(f"{a.out}/degree_{k}")
        snapshot.export(C.densified(g, k, a.seed), paths[-1])
    return paths


def main() -> None:
    import sys

    began = time.time()
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    found = run(spark, sys.argv[1:])
    if isinstance(found, dict):
        for name, value in found.items():
            print(name, value if not isinstance(value, list) else "".join(f"\n  {x}: {n}" for x, n in value))
    elif isinstance(found, (str, list)):
        print(found)
    print(f"Finished in {time.time() - began:.1f} seconds.")


if __name__ == "__main__":
    main()
