"""The calls of the graph engine that the other queries don't make, each as a query with its SQL beside it."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cli import run
from ..functions import dictionary as D
from ..graph import GraphImpl, PropertyGraph
from ..operators import components as K
from ..operators import generate as C
from ..operators import mutate as M
from ..operators import reorder as R
from ..operators import setops as U
from ..operators import traversal as T
from ..sources import csv as csv_files
from ..sources import snapshot
from .derived import geo, supply, table, trade
from .oracle import GEO, SUPPLY, TRADE, _comp, _with
from .queries import Query, _path, ldbc_files

_ALL: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> object:
    def add(f: Query) -> Query:
        _ALL[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


GEO_SQL, TRADE_SQL = _with(GEO), _with(TRADE)
GEO_IDS = "(select id, row_number() over (order by id) - 1 as k from geo_nodes)"
LABEL_IDS = "(select label, row_number() over (order by min(id), label) - 1 as label_id from geo_nodes group by label)"


# lookups and counts


@query(GEO_SQL + """select true as directed, 'graphmap' as impl, true as digraph, (select max(id) from geo_nodes) as max_seen_id,
 (select max(id) from geo_nodes where id < 10000000) as top_id, 4294967295 as max_id, 4294967295 as max_label_id,
 (select label from geo_nodes where id = 1000007) as node_label, (select label from geo_edges where src = 3 and dst = 103) as edge_label, null::varchar as no_label,
 (select count(distinct label) from geo_nodes where id < 10000000) as node_labels, (select count(distinct label) from geo_edges where dst < 10000000) as edge_labels, true as labelled,
 (2 * (select count(*) from geo_edges where dst < 10000000)) // (select count(*) from geo_nodes where id < 10000000) as average_degree, (select count(*) from geo_edges where dst < 10000000) as edges""")
def graph_facts(spark, d):
    """What a graph says of itself after its suppliers are removed; in a first edge of nation 103 the label of its region."""
    g = geo(spark, d)
    g = M.remove_nodes(g, g.nodes.where("id >= 10000000"))
    first = g.in_neighbors(103).first()["id"]
    row = (g.is_directed(), GraphImpl.parse("GraphMap").value if g.implementation() is GraphImpl.GRAPHMAP else None, g.as_digraph() is not None, g.max_seen_id(), g.nodes.agg(F.max("id")).first()[0], g.max_possible_id(),
           g.max_possible_label_id(), g.get_node_label(1000007), g.get_edge_label(first, 103), g.get_node_label(-5), g.num_of_node_labels(), g.num_of_edge_labels(), g.has_node_labels() and g.has_edge_labels(), g.average_degree(), g.refine_edge_count())
    return spark.createDataFrame([row], "directed boolean, impl string, digraph boolean, max_seen_id long, top_id long, max_id long, max_label_id long, node_label string, edge_label string, no_label string, node_labels long, edge_labels long, labelled boolean, average_degree long, edges long")


@query(GEO_SQL + "select id from geo_nodes")
def node_indices(spark, d):
    return geo(spark, d).node_indices()


@query(TRADE_SQL + "select src, dst from trade_edges")
def edge_indices(spark, d):
    return trade(spark, d).edge_indices()


@query(GEO_SQL + f", l as {LABEL_IDS} select label_id, count(*) as n from geo_nodes join l using (label) group by label_id")
def node_label_id_counts(spark, d):
    return geo(spark, d).node_label_id_counts()


@query(TRADE_SQL + ", l as (select label, row_number() over (order by min((src, dst)), label) - 1 as label_id from trade_edges group by label) select label_id, count(*) as n from trade_edges join l using (label) group by label_id")
def edge_label_id_counts(spark, d):
    return trade(spark, d).edge_label_id_counts()


@query(GEO_SQL + """select 'out' as kind, dst as id from geo_edges where src = 103 union all select 'in', src from geo_edges where dst = 103
 union all select 'not less', dst from geo_edges where src = 103 and dst >= 103 union all select 'degree', count(*) from geo_edges where src = 103
 union all select 'in degree', count(*) from geo_edges where dst = 103 union all select 'has', 1 from geo_edges where src = 103 and dst = 1000001
 union all select 'has in', 1 from geo_edges where src = 3 and dst = 103""")
def one_node(spark, d):
    """The node-local calls, of nation 103."""
    g = geo(spark, d)
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "id")
    facts = [("degree", g.degree(103)), ("in degree", g.in_degree(103))] + [("has", 1)] * g.has_neighbor(103, 1000001) + [("has in", 1)] * g.has_in_neighbor(103, 3)
    return reduce(DataFrame.unionByName, [named("out", g.neighbors(103)), named("in", g.in_neighbors(103)), named("not less", g.non_less_neighbors(103)), spark.createDataFrame(facts, "kind string, id long")])


@query(GEO_SQL + "select n.id, e.label as edge_label, n.label from geo_edges e join geo_nodes n on n.id = e.dst where e.src = 103")
def neighbors_in_full(spark, d):
    return geo(spark, d).neighbors_full(103)


# construction


@query(TRADE_SQL + "select id, null::varchar as label from (select src as id from trade_edges union select dst from trade_edges)")
def from_edges(spark, d):
    return PropertyGraph.from_edges(trade(spark, d).edges).nodes


def _vectors(spark, d) -> PropertyGraph:
    """Regions and nations as flat vectors: nodes 0 to 4 and 5 to 29, edges both ways, nation names as labels' ids."""
    rows = sorted((r["n_nationkey"], r["n_regionkey"], r["n_name"]) for r in table(spark, d, "nation").collect())
    out = [[(5 + n, n) for n, r, _ in rows if r == k] for k in range(5)] + [[(r, n)] for n, r, _ in rows]
    offsets = [sum(len(x) for x in out[:k]) for k in range(len(out) + 1)]
    names = [n for _, _, n in rows]
    return R.from_vectors(spark, offsets, [t for x in out for t, _ in x], [n for x in out for _, n in x], [0] * 5 + [1] * 25, True, (["region", "nation"], names))


@query("select n_regionkey::bigint as src, 5 + n_nationkey::bigint as dst, n_name as label from nation union all select 5 + n_nationkey::bigint, n_regionkey::bigint, n_name from nation")
def from_vectors_edges(spark, d):
    return _vectors(spark, d).edges


@query("select r_regionkey::bigint as id, 'region' as label from region union all select 5 + n_nationkey::bigint, 'nation' from nation")
def from_vectors_nodes(spark, d):
    return _vectors(spark, d).nodes


@query(GEO_SQL + ", l as (select label, row_number() over (order by label) - 1 as label_id from (select distinct label from geo_nodes)) select id, label_id, label from geo_nodes join l using (label)")
def given_label_maps(spark, d):
    """Label ids by a dictionary that another graph may share: here in the labels' own order."""
    g = geo(spark, d)
    labels = sorted(r["label"] for r in g.nodes.select("label").distinct().collect())
    return g.with_label_maps(D.from_values(spark, labels), g.edge_labels()).nodes_with_label_ids()


@query("select row_number() over (order by c_custkey) - 1 as id, true as label_known from customer")
def empty_graph_nodes(spark, d):
    """As many nodes as customers, each with one of the market segments."""
    customers = table(spark, d, "customer")
    segments = sorted(r[0] for r in customers.select("c_mktsegment").distinct().collect())
    return C.empty_graph(spark, customers.count(), segments).nodes.select("id", F.col("label").isin(*segments).alias("label_known"))


@query(GEO_SQL + "select count(*) as nodes, (select count(*) from geo_edges) as edges, count(*) filter (id is null) as strange, count(*) filter (id is null) as edge_labels from geo_nodes")
def relabelled_randomly(spark, d):
    """Counts, node labels that are neither old nor numbers from 11 to 14, and edge labels that stayed."""
    g = geo(spark, d)
    new = C.relabelled_randomly(g)
    strange = new.nodes.join(g.nodes.withColumnRenamed("label", "old"), "id").where(~(F.col("label").eqNullSafe(F.col("old")) | F.col("label").isin("11", "12", "13", "14")))
    return spark.createDataFrame([(new.node_count(), new.edge_count(), strange.count(), new.edges.where("label is not null").count())], "nodes long, edges long, strange long, edge_labels long")


# changes


@query(GEO_SQL + "select src, dst, null::varchar as label from geo_edges")
def strip_edge_labels(spark, d):
    return M.remove_edge_labels(geo(spark, d)).edges


@query(GEO_SQL + "select id, case when id % 2 = 0 then label || '!' end as label from geo_nodes")
def set_all_node_labels(spark, d):
    return M.set_node_labels(geo(spark, d), F.when(F.col("id") % 2 == 0, F.concat("label", F.lit("!")))).nodes


@query(GEO_SQL + "select src, dst, label || ':' || src as label from geo_edges")
def set_all_edge_labels(spark, d):
    return M.set_edge_labels(geo(spark, d), F.concat_ws(":", "label", "src")).edges


def _reversed(spark, d) -> PropertyGraph:
    """Some edges of supply, written from the other end, under other labels."""
    g = supply(spark, d)
    edges = g.edges.where("src % 3 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.when(F.col("src") % 2 == 0, "second").alias("label"))
    return replace(g, nodes=g.nodes.where("id % 3 = 0 and id < 10000000").select("id", F.lit("second").alias("label")), edges=edges)


@query(_with(SUPPLY) + "select src, dst, case when src % 6 = 0 then 'second' when src % 3 = 0 then null else label end as label from supply_edges")
def undirected_union(spark, d):
    return (supply(spark, d) + _reversed(spark, d)).edges


@query(_with(SUPPLY) + "select src, dst, label from supply_edges where src % 3 <> 0")
def undirected_minus(spark, d):
    """Without the other graph's edges, given from the other end; its nodes stay."""
    g, other = supply(spark, d), _reversed(spark, d)
    return (g - replace(other, nodes=other.nodes.limit(0))).edges


@query(GEO_SQL + "select id, label from geo_nodes")
def cloned_nodes(spark, d):
    return U.copy(geo(spark, d)).nodes


# dictionaries


@query(GEO_SQL + f", l as {LABEL_IDS} select (select string_agg(label, ',' order by label_id) from l) as items, (select count(*) from l) as size, (select label_id from l where label = 'supplier') as found, (select label from l where label_id = 1) as item, (select max_by(label, label_id) from l) as popped, (select count(*) - 1 from l) as left_over, not exists (from l where label = 'nothing') as absent")
def dictionary_calls(spark, d):
    full = D.build(geo(spark, d).nodes, seen_at="id")
    again = D.from_values(spark, D.values(full) * 2)
    rest, last = D.pop_item(again)
    same = D.fingerprint(full).first() == D.fingerprint(again).first() != D.fingerprint(rest).first()
    row = (",".join(D.values(again)) if same else None, D.size(again), D.find_index(again, "supplier"), D.get_item(again, 1), last, D.size(rest), not D.contains(again, "nothing"))
    return spark.createDataFrame([row], "items string, size long, found long, item string, popped string, left_over long, absent boolean")


@query(GEO_SQL + """select string_agg(label, ',' order by label) = string_agg(label, ',' order by label) as itself, string_agg(label, ',' order by label) = string_agg(label, ',' order by label desc) as turned,
 count(*) = count(*) - 1 as popped, count(*) = 0 as cleared from (select distinct label from geo_nodes)""")
def dictionary_hash(spark, d):
    """Whether the numbers of dictionaries are equal: the same in other partitions, turned round, without the last, emptied."""
    full = D.from_values(spark, sorted(r["label"] for r in geo(spark, d).nodes.select("label").distinct().collect()))
    of = lambda x: D.fingerprint(x).first()[0]
    own = of(full)
    row = (of(full.repartition(3)) == own, of(D.from_values(spark, D.values(full)[::-1])) == own, of(D.pop_item(full)[0]) == own, of(D.clear(full)) == own)
    return spark.createDataFrame([row], "itself boolean, turned boolean, popped boolean, cleared boolean")


@query(GEO_SQL + f"select label_id, label from {LABEL_IDS}")
def dictionary_file(spark, d):
    path = _path(spark)
    snapshot.save_dictionary(geo(spark, d).node_labels(), path)
    return snapshot.load_dictionary(spark, path)


# order, traversal and components


DEGREES = TRADE + """, d as (select id, count(x) as n from trade_nodes left join (select src as x from trade_edges union all select dst from trade_edges) on x = id group by id),
m as (select id, row_number() over (order by n, id) - 1 as k from d)"""


@query(_with(DEGREES) + "select (select k from m where id = 1000001) as new_id, (select id from m where k = 0) as old_id, (select count(*) from m) as ids, (select k from m where id = -1) as nothing")
def reorder_result(spark, d):
    found = R.reordered(trade(spark, d), node_label=False, edge_label=False)
    ids = found.get_node_id_map().count()
    row = (found.find_new_node_id(1000001), found.get_original_node_id(0), ids if found.take_graph().node_count() == ids else -1, found.find_new_node_id(-1))
    return spark.createDataFrame([row], "new_id long, old_id long, ids long, nothing long")


FIRST_FINDS = TRADE + """, f as (select n.id, coalesce(min(e.src), n.id) as root from trade_nodes n left join trade_edges e on e.dst = n.id group by n.id)"""


@query(_with(FIRST_FINDS) + "select id, root, (id <> root)::int as level, row_number() over (order by root, id <> root, id) - 1 as pos from f")
def bfs_trade(spark, d):
    """Every customer is a start in turn; a supplier comes after the least customer that leads to it."""
    return T.bfs(trade(spark, d))


@query(_with(FIRST_FINDS) + "select id, root, row_number() over (order by root, id <> root, -id) - 1 as pos from f")
def dfs_trade(spark, d):
    return T.dfs(trade(spark, d))


BOTH_WAYS = SUPPLY + ", ways as (select src, dst from supply_edges union select dst, src from supply_edges)"
#: Shortest paths from the least node; of a node's shortest paths the least one tells its place.
PATHS = "w(id, lvl, path) as (select min(id), 0, [min(id)] from supply_nodes union all select b.dst, w.lvl + 1, min(list_append(w.path, b.dst)) from w join ways b on b.src = w.id where w.lvl < 8 and not list_contains(w.path, b.dst) group by 1, 2)"


@query(_with(BOTH_WAYS, PATHS, recursive=True) + ", f as (select id, min(lvl) as lvl, min_by(path, lvl) as path from w group by id) select id, (select min(id) from supply_nodes) as root, lvl as level, row_number() over (order by lvl, path) - 1 as pos from f")
def bfs_supply(spark, d):
    """Undirected, connected, with many cycles."""
    return T.bfs(supply(spark, d))


#: A stack walked step by step: of what it leads to, what isn't found yet is put on, ascending.
WALK = """adj as (select src as id, list(dst order by dst) as ns from ways group by src),
w(stack, seen, popped, n) as (select {stack}, {seen}, null::bigint, 0
 union all select list_concat(list_slice(w.stack, 1, len(w.stack) - 1), new), list_concat(w.seen, new), w.stack[len(w.stack)], w.n + 1
 from (select *, list_filter(coalesce((select ns from adj where id = stack[len(stack)]), []), lambda x: not list_contains(seen, x)) as new from w where len(stack) > 0) w)"""


@query(_with(BOTH_WAYS, WALK.format(stack="[(select min(id) from supply_nodes)]", seen="[(select min(id) from supply_nodes)]"), recursive=True) + "select popped as id, (select min(id) from supply_nodes) as root, n - 1 as pos from w where n > 0")
def dfs_supply(spark, d):
    return T.dfs(supply(spark, d))


@query(_with(BOTH_WAYS, WALK.format(stack="[3::bigint, 1, 2]", seen="list_concat([3::bigint, 1, 2], (select list(id) from supply_nodes where id % 2 = 1 and id < 10000000 and id > 3))"), recursive=True) + "select popped as id, null::bigint as root, n - 1 as pos from w where n > 0")
def dfs_resumed(spark, d):
    """From a stack of parts 3, 1 and 2, when the other odd parts were found before."""
    g = supply(spark, d)
    return T.dfs_from_parts(g, [3, 1, 2], g.nodes.where("id % 2 = 0 or id >= 10000000").where("id not in (1, 2, 3)").select("id"))


@query(_with(GEO, _comp("geo"), recursive=True) + "select 1000000 + c_custkey as id, component as root from customer left join comp_geo on id = 1000000 + c_custkey union all select -7, null")
def component_roots(spark, d):
    ids = table(spark, d, "customer").select((F.col("c_custkey") + 1000000).alias("id")).union(spark.createDataFrame([(-7,)], "id long"))
    return K.roots(K.components(geo(spark, d)), ids)


@query(_with(GEO, _comp("geo"), recursive=True) + "select (select component from comp_geo where id = 1000001) as root, (select component from comp_geo where id = 1000001) as parent, (select component from comp_geo where id = -1) as nothing, (select count(distinct component) from comp_geo) as count")
def component_of_one(spark, d):
    found = K.components(geo(spark, d))
    row = (K.get_root(found, 1000001), K.get_parent(found, 1000001), K.get_root(found, -1), K.component_count(found))
    return spark.createDataFrame([row], "root long, parent long, nothing long, count long")


# compact adjacency


@query(GEO_SQL + """, pairs as (select 100 + (c_nationkey + c_custkey % 2) % 25 as src, 1000000 + c_custkey as dst from customer), i as (select src, dst, row_number() over (order by src, dst) - 1 as k from geo_edges)
select p.src, p.dst, e.src is not null as found, e.label, i.k as edge_index from pairs p left join geo_edges e on e.src = p.src and e.dst = p.dst left join i on i.src = p.src and i.dst = p.dst""")
def compact_lookup(spark, d):
    """Edges of nations to customers, half of them from the wrong nation, asked of compact rows."""
    path = _path(spark)
    snapshot.export_compact(geo(spark, d), path)
    pairs = table(spark, d, "customer").select((F.col("c_nationkey").cast("long") + F.col("c_custkey") % 2) % 25 + 100, F.col("c_custkey") + 1000000).toDF("src", "dst")
    return snapshot.CompactGraph(spark, path).edges_between(pairs)


@query(GEO_SQL + "select 'out' as kind, dst as id from geo_edges where src = 103 union all select 'in', src from geo_edges where dst = 103 union all select 'nodes', count(*) from geo_nodes union all select 'edges', count(*) from geo_edges union all select 'has', id from geo_nodes where id = 1000007")
def compact_node(spark, d):
    path = _path(spark)
    snapshot.export_compact(geo(spark, d), path)
    c = snapshot.CompactGraph(spark, path)
    rows = [("out", x) for x in c.inner_neighbors(103)] + [("in", x) for x in c.inner_in_neighbors(103)] + [("nodes", c.node_count()), ("edges", c.edge_count())] + [("has", 1000007)] * (c.has_node(1000007) and not c.has_node(-1))
    return spark.createDataFrame(rows, "kind string, id long")


# files and tools


@query("""with rows as (select c_custkey, 0 as later, case when c_custkey % 7 = 0 then null else c_custkey end as id, case when c_custkey % 5 = 0 then null else c_nationkey end as label, c_custkey % 13 = 0 as short from customer
 union all select c_custkey, 1, c_custkey, 1000 + c_nationkey, false from customer where c_custkey % 11 = 0)
select id, max_by(struct_pack(l := label), later).l::bigint as label from rows where id is not null and not short group by id""")
def csv_rules(spark, d):
    """Ids that are no numbers, labels that can't be read, rows that are too short, and keys that come again."""
    c = table(spark, d, "customer")
    key = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), "c_custkey")).otherwise(F.col("c_custkey").cast("string"))
    label = F.when(F.col("c_custkey") % 5 == 0, F.lit("none")).otherwise(F.col("c_nationkey").cast("string"))
    line: Column = F.when(F.col("c_custkey") % 13 == 0, key).otherwise(F.concat_ws("\t", key, label))
    lines = c.select(F.lit(1).alias("part"), "c_custkey", line.alias("line")).union(c.where("c_custkey % 11 = 0").select(F.lit(2), "c_custkey", F.concat_ws("\t", "c_custkey", (F.col("c_nationkey") + 1000))))
    path = _path(spark)
    head = spark.createDataFrame([(0, 0, ":LABEL")], "part int, c_custkey long, line string").select("part", "c_custkey", F.lit("nodeId:ID\t:LABEL").alias("line"))
    head.unionByName(lines).coalesce(1).sortWithinPartitions("part", "c_custkey").select("line").write.text(f"{path}/nodes")
    spark.createDataFrame([(":START_ID\t:END_ID\t:TYPE",)], "line string").coalesce(1).write.text(f"{path}/edges")
    reader = csv_files.CSVReader(spark, f"{path}/nodes", f"{path}/edges", sep="tab", node_label="long").headers(True).flexible(False)
    return reader.read().nodes


LDBC = """k as (select 'person' || c_custkey as key, 'person' as label from customer union all select 'place' || n_nationkey, 'country' from nation), i as (select key, label, row_number() over (order by key) - 1 as id from k)"""
_SQL["ldbc_load"] = _with(LDBC) + "select id, label from i"
_SQL["ldbc_load_edges"] = _with(LDBC) + "select a.id as src, b.id as dst, 'isLocatedIn' as label from customer join i a on a.key = 'person' || c_custkey join i b on b.key = 'place' || c_nationkey"


def _files(spark, d) -> tuple[str, str]:
    path = _path(spark)
    csv_files.write_csv_graph(geo(spark, d), f"{path}/nodes", f"{path}/edges")
    return path, f"{path}/out"


def _graph_file(spark, d) -> str:
    path = _path(spark)
    snapshot.export(geo(spark, d), path)
    return path


GEO_ORDER = GEO + ", t as (select id, row_number() over (order by (select count(*) from geo_edges where src = id) + (select count(*) from geo_edges where dst = id), id) - 1 as k from geo_nodes)"


@query(_with(GEO_ORDER) + "select a.k as src, b.k as dst, label from geo_edges join t a on a.id = src join t b on b.id = dst")
def tool_csv_to_static(spark, d):
    path, out = _files(spark, d)
    run(spark, ["csv-to-static", f"{path}/edges", out, "--nodes", f"{path}/nodes", "--reorder-node-id", "--reorder-label-id"])
    return snapshot.load_compact(spark, f"{out}/compact").edges


@query(_with(LDBC) + "select id, label from i")
def tool_ldbc_to_graph(spark, d):
    return snapshot.load(spark, run(spark, ["ldbc-to-graph", ldbc_files(spark, d), _path(spark)])).nodes


@query(GEO_SQL + "select src, dst, label from geo_edges")
def tool_graph_to_csv(spark, d):
    out = _path(spark)
    run(spark, ["graph-to-csv", _graph_file(spark, d), out])
    return csv_files.read_csv_graph(spark, f"{out}/nodes", f"{out}/edges").edges


@query(GEO_SQL + "select id, label from geo_nodes")
def tool_graph_to_compact(spark, d):
    out = _path(spark)
    run(spark, ["graph-to-compact", _graph_file(spark, d), out])
    return snapshot.load_compact(spark, out).nodes


@query(GEO_SQL + """select 'nodes' as name, null::varchar as label, count(*) as n from geo_nodes union all select 'edges', null, count(*) from geo_edges
 union all select 'max_degree', null, max(n) from (select count(*) as n from geo_edges group by src) union all select 'average_degree', null, 2 * (select count(*) from geo_edges) // count(*) from geo_nodes
 union all select 'node_labels', label, count(*) from geo_nodes group by label union all select 'edge_labels', label, count(*) from geo_edges group by label""")
def tool_stats(spark, d):
    found = run(spark, ["stats", _graph_file(spark, d)])
    rows = [r for name, x in found.items() for r in ([(name, label, n) for label, n in x] if isinstance(x, list) else [(name, None, x)])]
    return spark.createDataFrame(rows, "name string, label string, n long")


@query(GEO_SQL + "select id, null::varchar as label from geo_nodes")
def tool_remove_labels(spark, d):
    out = _path(spark)
    run(spark, ["remove-labels", _graph_file(spark, d), out])
    return snapshot.load(spark, out).nodes


@query(GEO_SQL + "select src, dst, null::varchar as label from geo_edges")
def tool_vary_labels(spark, d):
    out = _path(spark)
    run(spark, ["vary-labels", _graph_file(spark, d), out])
    return snapshot.load(spark, out).edges


@query(GEO_SQL + "select 4 as degree, 4 * count(*) // 2 as edges from geo_nodes union all select 7, 7 * count(*) // 2 from geo_nodes")
def tool_vary_density(spark, d):
    paths = run(spark, ["vary-density", _graph_file(spark, d), _path(spark), "4", "7"])
    return spark.createDataFrame([(k, snapshot.load(spark, p).edge_count()) for k, p in zip((4, 7), paths)], "degree int, edges long")
