"""The derived graphs and the queries over them in DuckDB's SQL."""

from __future__ import annotations

GEO = """geo_nodes as (
 select r_regionkey::bigint as id, 'region' as label from region union all select 100 + n_nationkey::bigint, 'nation' from nation
 union all select 1000000 + c_custkey, c_mktsegment from customer union all select 10000000 + s_suppkey, 'supplier' from supplier),
geo_edges as (
 select n_regionkey::bigint as src, 100 + n_nationkey::bigint as dst, 'hasNation' as label from nation
 union all select 100 + c_nationkey::bigint, 1000000 + c_custkey, 'hasCustomer' from customer
 union all select 100 + s_nationkey::bigint, 10000000 + s_suppkey, 'hasSupplier' from supplier)"""
TRADE = GEO + """, trade_nodes as (select * from geo_nodes where id >= 1000000),
trade_edges as (select 1000000 + o_custkey as src, 10000000 + l_suppkey as dst, max(l_returnflag) as label
 from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)"""
SUPPLY = """supply_nodes as (select p_partkey as id, 'part' as label from part union all select 10000000 + s_suppkey, 'supplier' from supplier),
supply_edges as (select l_partkey as src, 10000000 + l_suppkey as dst, max(l_linestatus) as label from lineitem group by 1, 2)"""
CLICKS = """clicks_nodes as (select dense_rank() over (order by event_type) - 1 as id, event_type as label from (select distinct event_type from events)),
steps as (select lag(event_type) over (partition by user_id order by ts, event_id) as a, event_type as b from events),
clicks_edges as (select distinct x.id as src, y.id as dst from steps join clicks_nodes x on a = x.label join clicks_nodes y on b = y.label)"""
STAR = """star_edges as (select 1000000 + o_custkey as src, 100000000 + o_orderkey as dst, o_orderpriority as label from orders),
star_nodes as (select distinct src as id, 'customer' as label from star_edges union all select dst, 'order' from star_edges)"""
#: Undirected components of the edges of {g}, by least id.
COMPONENTS = """both_{g} as (select src, dst from {g}_edges union select dst, src from {g}_edges),
reach_{g}(id, root) as (select src, src from both_{g} union select b.dst, r.root from reach_{g} r join both_{g} b on b.src = r.id where r.root < b.dst),
comp_{g} as (select id, min(root) as component from reach_{g} group by id)"""
SECOND = """second_nodes as (select id, case when id % 2 = 0 then null else 'second' end as label from geo_nodes where id % 3 = 0
 union all select 500000000 + id, label from geo_nodes where id % 7 = 0),
second_edges as (select src, dst, case when dst % 2 = 0 then null else 'second' end as label from geo_edges where dst % 3 = 0)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n"


def _comp(g: str) -> str:
    return COMPONENTS.format(g=g)


def oracle_sql() -> dict[str, str]:
    geo, trade, clicks = _with(GEO), _with(TRADE), _with(CLICKS)
    second = _with(GEO, SECOND)
    batch = "batch as (select id, case when id % 4 = 0 then null else 'new' end as label from geo_nodes where id % 5 = 0 union all select 700000000 + n_nationkey, 'added' from nation)"
    links = "batch as (select src, dst, case when dst % 4 = 0 then null else 'new' end as label from geo_edges where dst % 5 = 0 union all select r_regionkey::bigint, 800000000 + r_regionkey, 'added' from region)"
    after_links = "after_links as (select * from geo_edges e where not exists (select 1 from batch b where b.src = e.src and b.dst = e.dst) union all select * from batch)"
    return {
        "node_scan": geo + "select id, label from geo_nodes",
        "edge_scan": geo + "select src, dst, label from geo_edges",
        "node_lookup": geo + "select id, label from geo_nodes where id in (0, 100, 1000007, 10000003)",
        "edge_lookup": trade + "select src, dst, label from trade_edges where src = 1000001 and dst = (select min(dst) from trade_edges where src = 1000001)",
        "edge_exists": trade + "select n.id as src, m.id as dst, exists (select 1 from trade_edges e where e.src = n.id and e.dst = m.id) as found from trade_nodes n, trade_nodes m where n.id between 1000000 and 1000019 and m.id between 10000000 and 10000009",
        "node_exists": geo + "select r.i as id, exists (select 1 from geo_nodes where id = r.i) as found from range(0, 200) r(i)",
        "undirected_edge_exists": _with(SUPPLY) + "select m.id as src, n.id as dst, exists (select 1 from supply_edges e where e.src = n.id and e.dst = m.id) as found from supply_nodes n, supply_nodes m where n.id < 20 and m.id between 10000000 and 10000009",
        "out_degree": trade + "select id, count(dst) as degree from trade_nodes left join trade_edges on src = id group by id",
        "in_degree": trade + "select id, count(src) as in_degree from trade_nodes left join trade_edges on dst = id group by id",
        "total_degree": trade + "select id, (select count(*) from trade_edges where src = id) + (select count(*) from trade_edges where dst = id) as total from trade_nodes",
        "undirected_degree": clicks + ", u as (select distinct least(src, dst) as a, greatest(src, dst) as b from clicks_edges), v as (select a, b from u union select b, a from u) select id, count(b) as degree from clicks_nodes left join v on a = id group by id",
        "supply_degree": _with(SUPPLY) + ", v as (select src, dst from supply_edges union select dst, src from supply_edges) select id, count(dst) as degree from supply_nodes left join v on src = id group by id",
        "neighbor_lists": geo + "select id, coalesce(string_agg(dst::varchar, ',' order by dst), '') as neighbors from geo_nodes left join geo_edges on src = id group by id",
        "in_neighbor_lists": geo + "select id, coalesce(string_agg(src::varchar, ',' order by src), '') as in_neighbors from geo_nodes left join geo_edges on dst = id group by id",
        "neighbors_of": geo + "select dst as id from geo_edges where src = 103",
        "graph_summary": trade + "select (select count(*) from trade_nodes) as nodes, (select count(*) from trade_edges) as edges, (select max(n) from (select count(*) as n from trade_edges group by src)) as max_degree, 2 * (select count(*) from trade_edges) // (select count(*) from trade_nodes) as average_degree, (select max(id) from trade_nodes) as max_seen_id",
        "node_label_counts": geo + "select label, count(*) as n from geo_nodes where label is not null group by label",
        "edge_label_counts": trade + "select label, count(*) as n from trade_edges where label is not null group by label",
        "most_common_labels": geo + "select label, count(*) as n, row_number() over (order by count(*) desc, label) as place from geo_nodes group by label",
        "label_dictionary": geo + "select label, row_number() over (order by min(id), label) - 1 as label_id from geo_nodes group by label",
        "edge_label_dictionary": geo + "select label, row_number() over (order by min((src, dst)), label) - 1 as label_id from geo_edges group by label",
        "dictionary_add": geo + ", d as (select label, row_number() over (order by min(id), label) - 1 as label_id from geo_nodes group by label) select label_id, label from d union all select (select count(*) from d) + row_number() over (order by min(src), label) - 1, label from geo_edges group by label",
        "node_labels_joined": geo + ", d as (select label, row_number() over (order by min(id), label) - 1 as label_id from geo_nodes group by label) select id, label_id, label from geo_nodes join d using (label)",
        "upsert_nodes": _with(GEO, batch) + "select id, label from geo_nodes where id not in (select id from batch) union all select id, label from batch",
        "upsert_nodes_added": _with(GEO, batch) + "select id, id not in (select id from geo_nodes) as added from batch",
        "upsert_edges": _with(GEO, links, after_links) + "select src, dst, label from after_links",
        "upsert_edges_nodes": _with(GEO, links) + "select id, label from geo_nodes union all select dst, null from batch where dst not in (select id from geo_nodes)",
        "remove_nodes": geo + "select src, dst, label from geo_edges where src % 3 <> 0 and dst % 3 <> 0",
        "remove_edges": geo + "select src, dst, label from geo_edges where not (dst % 4 = 1)",
        "update_node_labels": geo + "select id, case when id % 6 = 0 then 'changed' when id % 6 = 1 then null else label end as label from geo_nodes",
        "update_edge_labels": geo + "select src, dst, case when dst % 6 = 0 then 'changed' else label end as label from geo_edges",
        "strip_labels": geo + "select id, null::varchar as label from geo_nodes",
        "union_graphs_nodes": second + "select coalesce(a.id, b.id) as id, case when b.id is not null then b.label else a.label end as label from geo_nodes a full join second_nodes b on a.id = b.id",
        "union_graphs_edges": second + "select coalesce(a.src, b.src) as src, coalesce(a.dst, b.dst) as dst, case when b.src is not null then b.label else a.label end as label from geo_edges a full join second_edges b on a.src = b.src and a.dst = b.dst",
        "minus_graphs_nodes": geo + "select id, label from geo_nodes where label <> 'nation' or id % 2 = 0",
        "minus_graphs_edges": geo + ", gone as (select id from geo_nodes where label = 'nation' and id % 2 = 1) select src, dst, label from geo_edges where src not in (select id from gone) and dst not in (select id from gone)",
        "graph_equal": geo + "select not exists (from geo_edges except from geo_edges) as itself, not exists (select * from geo_edges except select src, dst, 'x' from geo_edges) as relabelled, not exists (from geo_edges except from geo_edges where dst % 2 = 0) as smaller",
        "graph_fingerprint": geo + "select not exists (from geo_edges except from geo_edges) as itself, not exists (select * from geo_edges except select src, dst, 'x' from geo_edges) as relabelled, not exists (from geo_edges except from geo_edges where dst % 2 = 0) as smaller",
        "components": _with(GEO, _comp("geo"), recursive=True) + "select id, component from comp_geo",
        "star_components": _with(STAR, _comp("star"), recursive=True) + "select id, component from comp_star",
        "component_sizes": _with(STAR, _comp("star"), recursive=True) + "select component, count(*) as size from comp_star group by component",
        "component_count": _with(STAR, _comp("star"), recursive=True) + "select count(distinct component) as components from comp_star",
        "same_component": _with(GEO, _comp("geo"), recursive=True) + "select a, b, coalesce(x.component = y.component, false) as connected from (select 1000000 + c_custkey as a, 100 + c_custkey % 30 as b from customer) left join comp_geo x on x.id = a left join comp_geo y on y.id = b",
        "component_members": _with(GEO, _comp("geo"), recursive=True) + "select id from comp_geo where component = (select component from comp_geo where id = 104)",
        "connected_subgraph_nodes": _with(STAR, _comp("star"), recursive=True) + "select id, label, component from star_nodes join comp_star using (id)",
        "connected_subgraph_edges": _with(STAR, _comp("star"), recursive=True) + "select src, dst, label, component from star_edges join comp_star on id = src",
        "incremental_components": _with(STAR, _comp("star"), recursive=True) + "select id, component from comp_star",
        "bfs_order": _with(GEO, "t(id, lvl, p) as (select id, 0, [id] from geo_nodes where label = 'region' union all select e.dst, t.lvl + 1, list_append(t.p, e.dst) from t join geo_edges e on e.src = t.id)", recursive=True) + "select id, p[1] as root, lvl as level, row_number() over (order by p[1], lvl, p) - 1 as pos from t",
        "bfs_cyclic": _with(CLICKS, "w(id, d) as (select 2, 0 union select e.dst, w.d + 1 from w join clicks_edges e on e.src = w.id where w.d < 5), f as (select id, min(d) as d from w group by id)", recursive=True) + "select id, d as level from f",
        "dfs_order": _with(GEO, "t(id, k) as (select id, [id] from geo_nodes where label = 'region' union all select e.dst, list_append(t.k, -e.dst) from t join geo_edges e on e.src = t.id)", recursive=True) + "select id, k[1] as root, row_number() over (order by k) - 1 as pos from t",
        "reachable_from": _with(GEO, "t(id) as (select 2::bigint union select e.dst from t join geo_edges e on e.src = t.id)", recursive=True) + "select id from t",
        "reorder_node_ids": trade + ", d as (select id, count(x) as n from trade_nodes left join (select src as x from trade_edges union all select dst from trade_edges) on x = id group by id) select id as old_id, row_number() over (order by n, id) - 1 as new_id from d",
        "reorder_labels": geo + "select label, row_number() over (order by count(*), label) - 1 as label_id from geo_nodes group by label",
        "reordered_edges": trade + ", d as (select id, count(x) as n from trade_nodes left join (select src as x from trade_edges union all select dst from trade_edges) on x = id group by id), m as (select id, row_number() over (order by n, id) - 1 as k from d) select a.k as src, b.k as dst, label from trade_edges join m a on a.id = src join m b on b.id = dst",
        "csr_offsets": trade + ", d as (select id, count(dst) as degree from trade_nodes left join trade_edges on src = id group by id) select id, degree, (sum(degree) over (order by id) - degree)::bigint as offset from d".replace("as offset", 'as "offset"'),
        "csr_edge_index": trade + "select src, dst, row_number() over (order by src, dst) - 1 as edge_index from trade_edges",
        "complete_pairs": "select s.i as src, t.i as dst from range(0, 60) s(i), range(0, 60) t(i) where s.i < t.i",
        "complete_directed_pairs": "select s.i as src, t.i as dst from range(0, 60) s(i), range(0, 60) t(i) where s.i <> t.i",
        "gnm_counts": "select (select count(*) from customer) as nodes, count(*) as edges, count(*) filter (o_orderkey is null) as loops, count(distinct o_orderkey) as different from orders",
        "gnp_bounds": "select count(*) filter (s_suppkey is null) as none, (count(*) * (count(*) - 1)) // 2 as every from supplier",
        "densify": geo + "select (select count(*) from geo_nodes) as nodes, 6 * (select count(*) from geo_nodes) // 2 as edges, (select count(*) from geo_edges) as kept",
        "csv_roundtrip": geo + "select id, label from geo_nodes",
        "csv_roundtrip_edges": geo + "select src, dst, label from geo_edges",
        "snapshot_roundtrip": trade + "select src, dst, label from trade_edges",
        "compact_roundtrip": geo + "select src, dst, label from geo_edges",
    }
