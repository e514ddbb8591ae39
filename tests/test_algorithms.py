"""Traversal, components, re-encoding, generators and files, against literal simulations."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import components as K
from graphloom.operators import generate as C
from graphloom.operators import reorder as R
from graphloom.operators import setops as U
from graphloom.operators import traversal as T
from graphloom.sources import csv, ldbc, snapshot
from graphloom.scratch import clear
from graphloom.streaming.incremental import IncrementalComponents

from .test_graph import graph, ids, rows


def in_order(df):
    return [r["id"] for r in df.orderBy("pos").collect()]


def walk(nodes, edges, directed, start, depth_first):
    """A queue or stack over ascending neighbours, marked when they are put on; on at the least id not found."""
    after = {n: set() for n in nodes}
    for s, d in edges:
        after[s].add(d)
        if not directed:
            after[d].add(s)
    todo, out, work = set(nodes), [], [start]
    todo.discard(start)
    while work or todo:
        if not work:
            work.append(min(todo))
            todo.discard(work[0])
        at = work.pop() if depth_first else work.pop(0)
        out.append(at)
        for n in sorted(after[at] & todo):
            todo.discard(n)
            work.append(n)
    return out


def random_graph(seed):
    r = random.Random(seed)
    nodes = r.sample(range(100), 12)
    return nodes, list({(r.choice(nodes), r.choice(nodes)) for _ in range(14)}), r.choice(nodes)


@pytest.mark.parametrize("seed,directed", [(1, True), (2, False)])
def test_traversal_orders(spark, seed, directed):
    nodes, edges, start = random_graph(seed)
    g = graph(spark, [(n, None) for n in nodes], edges, directed)
    assert in_order(T.bfs(g, start)) == walk(nodes, edges, directed, start, False)
    assert in_order(T.dfs(g, start)) == walk(nodes, edges, directed, start, True)


def test_traversal_details(spark):
    g = graph(spark, [], [(0, 1), (0, 2), (2, 3), (2, 4), (4, 1)])
    assert in_order(T.dfs(g, 0)) == [0, 2, 4, 3, 1]
    assert in_order(T.bfs(graph(spark, [], [(2, 1), (3, 1)]), 1)) == [1, 2, 3]
    assert in_order(T.bfs(graph(spark, [], [(2, 1), (3, 1)]), 2, reachable_only=True)) == [2, 1]
    t = T.Traversal(graph(spark, [], [(1, 2), (2, 3)], False), 1, depth_first=True)
    assert list(t) == [1, 2, 3]
    t.reset()
    assert next(t) == 1
    for bad in (PropertyGraph.empty(spark), None):
        with pytest.raises(ValueError):
            T.bfs(bad or g, None if bad else 77)


def test_dfs_keeps_large_ids_whole(spark):
    big = (1 << 62) + 1
    assert in_order(T.dfs(graph(spark, [], [(1, big), (big, big - 1)]), 1)) == [1, big, big - 1]


@pytest.mark.parametrize("directed", [True, False])
def test_components(spark, directed):
    found = K.components(graph(spark, [(9, None)], [(1, 2), (3, 4)], directed))
    assert K.component_count(found) == 2 and K.is_connected(found, 1, 2) and not K.is_connected(found, 2, 3)
    assert not K.is_connected(found, 9, 9) and K.connected_nodes(found, 9) is None
    assert sorted(ids(K.connected_nodes(found, 4))) == [3, 4]
    with_all = K.components(graph(spark, [(9, None)], [(1, 2), (5, 5)], directed), include_isolated=True)
    assert rows(with_all.select("id", "component")) == [(1, 1), (2, 1), (5, 5), (9, 9)]


def test_components_of_chains_and_random_links(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + r.randrange(300), 1000 + r.randrange(300)) for _ in range(200)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    found = K.components(graph(spark, [], edges))
    assert rows(found.select("id", "component")) == sorted((x, top(x)) for x in parent)


def test_connected_subgraphs(spark):
    g = graph(spark, [(1, "0"), (2, "1"), (3, "2"), (4, "3"), (8, None)], [(1, 2, "10"), (3, 4, "20")], False)
    parts = K.ConnectedSubgraphs(g)
    assert sorted(ids(parts.roots())) == [1, 3, 8]
    sub = parts.subgraph(3)
    assert rows(sub.nodes) == [(3, "2"), (4, "3")] and sub.get_edge_label(4, 3) == "20" and parts.subgraph(8).edge_count() == 0


def test_reorder(spark):
    g = graph(spark, [], [(1, 0, "a"), (2, 0, "a"), (2, 3, "b"), (3, 0, "a"), (3, 1, "a"), (3, 2, "a")])
    new = R.reordered(g)
    assert rows(new.graph.edge_indices()) == [(0, 1), (2, 1), (2, 3), (3, 0), (3, 1), (3, 2)]
    assert new.find_new_node_id(1) == 0 and new.get_original_node_id(3) == 3 and new.get_original_node_id(9) is None
    assert rows(new.graph.edge_labels()) == [(0, "b"), (1, "a")]
    g = graph(spark, [(0, "n"), (1, "n"), (2, "m"), (3, None)], [(0, 1, "a"), (1, 2, "b"), (2, 0)], False)
    assert rows(R.reordered(g).graph.edges) == [(1, 2, "a"), (1, 3, None), (2, 3, "b")]


def test_compact_form(spark):
    g = R.from_vectors(spark, [0, 2, 3, 4], [1, 2, 0, 0], [0, 1, 0, 1], [1, 0, 1], names=(["a", "b"], ["a", "b"]))
    assert (g.node_count(), g.edge_count()) == (3, 4) and ids(g.neighbors(0)) == [1, 2]
    assert g.get_node_label(0) == "b" and g.get_edge_label(0, 2) == "b" and g.get_edge_label(1, 2) is None
    assert rows(R.compact(g)) == [(0, 0, [1, 2], ["a", "b"]), (1, 2, [0], ["a"]), (2, 3, [0], ["b"])]
    assert R.find_edge_index(g, 2, 0) == 3 and R.find_edge_index(g, 2, 1) is None
    und = R.from_vectors(spark, [0, 2, 4, 6], [1, 2, 0, 2, 0, 1], directed=False)
    assert rows(und.edge_indices()) == [(0, 1), (0, 2), (1, 2)]
    gaps = graph(spark, [(5, None), (100, None)], [(5, 200), (200, 5)])
    assert rows(R.offsets(gaps)) == [(5, 1, 0), (100, 0, 1), (200, 1, 1)]
    assert rows(R.dense_node_ids(gaps)) == [(5, 0), (100, 1), (200, 2)]
    with pytest.raises(ValueError):
        R.from_vectors(spark, [0, 1], [0], [1, 2])


@pytest.mark.parametrize("directed", [True, False])
def test_generated_graphs(spark, directed):
    assert U.equal(C.random_gnp_graph(spark, 30, 0, directed=directed), C.empty_graph_unlabeled(spark, 30, directed))
    assert U.equal(C.random_gnp_graph_unlabeled(spark, 30, 1, directed), C.complete_graph_unlabeled(spark, 30, directed))
    for m in (20, 300):
        g = C.random_gnm_graph(spark, 30, m, ["a", "b"], ["x"], directed, seed=m)
        assert g.node_count() == 30 and g.edge_indices().distinct().count() == m and g.edges.where("src = dst").isEmpty()
        assert set(g.node_label_counts().toPandas().label) <= {"a", "b"} and g.edge_label_counts().first() == ("x", m)
    with pytest.raises(ValueError):
        C.random_gnm_graph(spark, 3, 7, directed=directed)
    with pytest.raises(ValueError):
        C.random_gnp_graph(spark, 3, 1.5)


def test_densify_and_relabel(spark):
    g = graph(spark, [(n * 7, "l") for n in range(20)], [(0, 7, "x"), (7, 7, "y")], False)
    dense = C.densified(g, 4, seed=1)
    assert dense.edge_count() == 40 and dense.get_edge_label(7, 0) == "x" and dense.edges.where("src > dst").isEmpty()
    assert C.densified(dense, 2).edge_count() == 40
    new = C.relabelled_randomly(g, seed=2)
    assert set(new.node_label_counts().toPandas().label) <= {"l", "11", "12", "13", "14"} and not new.has_edge_labels()


@pytest.mark.parametrize("directed,labels", [(True, True), (False, True), (True, False)])
def test_csv_round_trip(spark, tmp_path, directed, labels):
    g = C.random_gnm_graph(spark, 10, 20, ["a", "b"] if labels else None, [1, 2, 3] if labels else None, directed)
    csv.write_csv_graph(g, f"{tmp_path}/n", f"{tmp_path}/e", "tab")
    back = csv.read_csv_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e", directed, "tab", edge_label="int" if labels else "string")
    assert U.equal(g, back)


def test_csv_tolerance(spark, tmp_path):
    (tmp_path / "n.csv").write_text(":LABEL,nodeId:ID,more\n1,5,q\nbad,6,q\n2,x,q\n3,-1,q\n4,5,q\n7\n")
    (tmp_path / "e.csv").write_text(":START_ID,:END_ID,:TYPE\n5,6,9\n6,8,word\n,5,1\n")
    g = csv.read_csv_graph(spark, f"{tmp_path}/n.csv", f"{tmp_path}/e.csv", node_label="int", edge_label="int")
    assert rows(g.nodes) == [(5, 4), (6, None), (8, None)] and rows(g.edges) == [(5, 6, 9), (6, 8, None)]
    (tmp_path / "p.csv").write_text("1 2 a\n2 3\n")
    reader = csv.CSVReader(spark, None, f"{tmp_path}/p.csv", "space").headers(False)
    assert rows(reader.read().edges) == [(1, 2, "a")] and reader.nodes().isEmpty()
    assert rows(reader.flexible(True).read().edges) == [(1, 2, "a"), (2, 3, None)]
    with pytest.raises(ValueError):
        csv.separator("::")


def test_snapshots(spark, tmp_path):
    g = graph(spark, [(0, "a"), (9, None)], [(0, 1, "x"), (1, 0, None)], True)
    snapshot.export(g.with_label_maps(g.node_labels(), g.edge_labels()), f"{tmp_path}/s")
    back = snapshot.load(spark, f"{tmp_path}/s")
    assert U.equal(g, back) and back.max_seen_id() == 9 and back.num_of_node_labels() == 1
    for directed in (True, False):
        one = graph(spark, [(0, "a"), (2, None)], [(0, 1, "x"), (1, 1, None)], directed)
        snapshot.export_compact(one, f"{tmp_path}/c{directed}")
        assert U.equal(one, snapshot.load_compact(spark, f"{tmp_path}/c{directed}"))


def test_ldbc(spark, tmp_path):
    (tmp_path / "place_0_0.csv").write_text("id|name|url|type\n1|Rome|u|city\n2|Italy|u|country\n")
    (tmp_path / "place_isPartOf_place_0_0.csv").write_text("Place.id|Place.id\n1|2\n")
    (tmp_path / "person_isLocatedIn_place_0_0.csv").write_text("Person.id|Place.id\n7|1\n8|3\n")
    (tmp_path / "person_knows_person_0_0.csv").write_text("Person.id|Person.id|creationDate\n7|8|x\n")
    (tmp_path / "xperson_knows_person_0_0.csv").write_text("Person.id|Person.id\n70|80\n")
    g = ldbc.read_ldbc_graph(spark, str(tmp_path))
    assert rows(g.nodes) == [(0, "person"), (1, "person"), (2, "city"), (3, "country"), (4, "place")]
    assert rows(g.edges) == [(0, 1, "knows"), (0, 2, "isLocatedIn"), (1, 4, "isLocatedIn"), (2, 3, "isPartOf")]


def test_incremental_components(spark, tmp_path):
    state = IncrementalComponents(spark)
    batches = [[(5, 6), (1, 2)], [(6, 2), (9, 9)], [(9, 1), (20, 21)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, "src long, dst long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state.run(stream, f"{tmp_path}/ck").awaitTermination()
    assert rows(state.components().select("id", "component")) == [(1, 1), (2, 1), (5, 1), (6, 1), (9, 1), (20, 20), (21, 20)]
    state.on_batch(spark.createDataFrame([(20, 1)], "src long, dst long"), 0)
    assert state.components().where(F.col("id") == 20).first()["component"] == 20


def test_incremental_components_after_a_restart(spark, tmp_path, monkeypatch):
    """Random batches, pieces brought together on the way; a new driver goes on with the state and skips a batch that it has."""
    monkeypatch.setattr("graphloom.streaming.incremental.PIECES", 2)
    r, links = random.Random(6), []
    batches = [[(r.randrange(60), r.randrange(60)) for _ in range(9)] for _ in range(6)]
    for k, b in enumerate(batches):
        state = IncrementalComponents(spark, f"{tmp_path}/state")
        assert state.done == (k - 1 if k else None)
        state.on_batch(spark.createDataFrame(b, "src long, dst long"), k)
        state.on_batch(spark.createDataFrame([(1000, 1001)], "src long, dst long"), k)
        links += b
        whole = K.components(graph(spark, [], list({(min(x), max(x)) for x in links}), False))
        assert rows(state.components().select("id", "component")) == rows(whole.select("id", "component"))
    # what a batch wrote before it failed doesn't count
    state.scratch.keep(spark.createDataFrame([(7777, 7777)], "id long, component long"), f"ids-{state.version + 1}")
    clear()
    again = IncrementalComponents(spark, f"{tmp_path}/state")
    assert again.version == state.version and again.components().where("id = 7777").isEmpty()
    again.reset()
    assert again.components().isEmpty() and IncrementalComponents(spark, f"{tmp_path}/state").version == 0


@pytest.mark.parametrize("directed", [True, False])
def test_depth_first_goes_on_from_its_parts(spark, directed):
    """After any number of steps, stack and undiscovered nodes give the rest of the order."""
    for seed in (3, 8):
        nodes, edges, start = random_graph(seed)
        g = graph(spark, [(n, None) for n in nodes], edges, directed)
        after = {n: set() for n in nodes}
        for s, d in edges:
            after[s].add(d)
            if not directed:
                after[d].add(s)
        whole = walk(nodes, edges, directed, start, True)
        todo, stack = set(nodes) - {start}, [start]
        for step in range(5):
            if not stack:
                break
            at = stack.pop()
            new = sorted(after[at] & todo)
            todo -= set(new)
            stack += new
            if step % 2:
                left = spark.createDataFrame([(x,) for x in todo], "id long")
                assert in_order(T.dfs_from_parts(g, stack, left)) == whole[step + 1 :], (seed, step)


def test_levels_are_brought_together(spark, monkeypatch):
    monkeypatch.setattr(T, "MERGE", 2)
    chain = graph(spark, [], [(k, k + 1) for k in range(9)] + [(9, 0), (4, 1)])
    found = T.bfs(chain, 3)
    assert in_order(found) == walk(range(10), [(k, k + 1) for k in range(9)] + [(9, 0), (4, 1)], True, 3, False)


@pytest.mark.parametrize("directed", [True, False])
def test_compact_lookups(spark, tmp_path, directed):
    g = graph(spark, [(0, "b"), (1, "a"), (2, None), (3, "c")], [(0, 1, "a"), (0, 2, None), (2, 2, "b"), (1, 0, "c")] if directed else [(0, 1, "a"), (0, 2, None), (2, 2, "b")], directed)
    snapshot.export_compact(g, f"{tmp_path}/c")
    c = snapshot.CompactGraph(spark, f"{tmp_path}/c")
    assert c.is_directed() == directed and c.node_count() == 4 and c.edge_count() == g.edge_count()
    for a in range(5):
        assert c.inner_neighbors(a) == ids(g.neighbors(a)) and c.inner_in_neighbors(a) == ids(g.in_neighbors(a)) and c.get_node_label(a) == g.get_node_label(a) and c.has_node(a) == g.has_node(a)
        for b in range(5):
            assert (c.has_edge(a, b), c.get_edge_label(a, b)) == (g.has_edge(a, b), g.get_edge_label(a, b)) and c.find_edge_index(a, b) == R.find_edge_index(g, a, b)


def test_a_hub_of_many_links(spark, monkeypatch):
    """A star of 10^5 leaves and a chain at one of them, with aggregates written before they are joined."""
    monkeypatch.setattr(K, "SPLIT", 1000)
    edges = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).unionByName(spark.range(100_000, 100_020).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    found = K.stars(edges)
    assert found.count() == 100_021 and found.where("component <> 0").isEmpty()


def test_a_round_of_components_reads_its_links_once(spark):
    """Tasks take the driver's memory, however few the rows: a chain of 40 links at 16 partitions, loops and repeated links beside it."""
    from graphloom.scratch import configured

    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(7, 7), (99, 99), (99, 99), (3, 2)], "src long, dst long").repartition(16)
    context = spark.sparkContext
    with configured(spark, {"spark.sql.shuffle.partitions": 16, "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        context.setJobGroup("rounds", "components")
        found = {tuple(r) for r in K.stars(links).collect()}
        context.setLocalProperty("spark.jobGroup.id", None)
    assert found == {(k, 0) for k in range(41)} | {(99, 99)}
    seen = context.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("rounds") for s in seen.getJobInfo(j).stageIds}
    tasks = sum(i.numTasks for i in map(seen.getStageInfo, stages) if i and i.numCompletedTasks)
    assert tasks < 1300, tasks


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    """What is settled is seen before a round; links that are not yet stars in any one way take rounds until they are."""
    rounds, either = [], K._either
    monkeypatch.setattr(K, "_either", lambda rows, *pairs: rounds.append(pairs) or either(rows, *pairs))
    for links, least_rounds in (
        ([(9, 1), (1, 8), (7, 1), (3, 2), (2, 3), (5, 5), (4, None)], 0),
        ([], 0),
        ([(9, 1), (9, 2)], 1),
        ([(9, 5), (5, 1)], 1),
        ([(k, k + 1) for k in range(9)], 2),
    ):
        rounds.clear()
        found = {tuple(r) for r in K.stars(spark.createDataFrame(links, "src long, dst long")).collect()}
        ids = {x for pair in links if None not in pair for x in pair}
        want = {x: x for x in ids}
        for _ in ids:
            for a, b in links:
                if b is not None:
                    want[a] = want[b] = min(want[a], want[b])
        assert found == set(want.items())
        # two passes in each round, one for the result
        made = (len(rounds) - 1) // 2
        assert made == 0 if least_rounds == 0 else made >= least_rounds, (links, made)


def test_csv_rows_count_in_file_order(spark, tmp_path):
    """The last row of a key wins over several files and splits, whatever their sizes."""
    lines = ["nodeId:ID,:LABEL"] + [f"{k % 50},v{k}" for k in range(4000)]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "n" / "b.csv").write_text("nodeId:ID,:LABEL\n3,last\n")
    (tmp_path / "e.csv").write_text(":START_ID,:END_ID,:TYPE\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = dict(rows(csv.read_csv_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e.csv").nodes))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {k: f"v{3950 + k}" if k != 3 else "last" for k in range(50)}


def test_a_depth_first_tree_takes_memory_by_its_nodes():
    """Of a complete graph the lists come batch by batch and stay on disk; the greatest neighbour is next."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n = 1500
    every = np.arange(n)

    def batches(of=range(n)):
        for i in of:
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([7]), pa.array([every[every != i]])], names=["id", "tree", "after"])

    # once before, for what is imported on the way
    list(T.walked((pa.RecordBatch.from_arrays([pa.array([7]), pa.array([7]), pa.array([np.array([7])])], names=["id", "tree", "after"]) for _ in range(1)), [7]))
    tracemalloc.start()
    found = [x for ids, tree, at in T.walked(batches(), [7]) for x in ids.tolist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [7, *[i for i in reversed(range(n)) if i != 7]]
    assert peak < 8 * n * n / 4, peak


def test_edges_are_made_once_for_a_traversal(spark):
    """However many rounds it takes: a chain of 6 nodes, whose edges count how often they are made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(k, k + 1, "x") for k in range(5)], "src long, dst long, label string").mapInArrow(count, "src long, dst long, label string")
    g = PropertyGraph(spark.range(6).select("id", F.lit(None).cast("string").alias("label")), edges, False)
    assert in_order(T.bfs(g)) == in_order(T.dfs(g)) == list(range(6))
    assert made.value == 2 * 5, made.value


@pytest.mark.parametrize("small", [1, 10_000])
def test_the_least_rows_are_chosen_without_one_task(spark, monkeypatch, small):
    """Cut off within a group of equal leading bits, among equal numbers, and at the end."""
    monkeypatch.setattr(C, "SORTED", small)
    data = [(k, k + 1, (k % 7 - 3) << 50 | k % 5) for k in range(200)]
    rows = spark.createDataFrame(data, "src long, dst long, r long")
    for m in (0, 1, 57, 199, 200):
        want = sorted(x[:2] for x in sorted(data, key=lambda x: (x[2], x[0], x[1]))[:m])
        assert sorted(map(tuple, C._least(rows, m).collect())) == want, m


@pytest.mark.parametrize("directed", [True, False])
def test_all_or_no_pairs_are_not_written(spark, directed):
    g = C.random_gnp_graph(spark, 50, 1, edge_labels=["x"], directed=directed)
    assert "Generate" in g.edges._jdf.queryExecution().optimizedPlan().toString()
    assert g.edge_count() == 50 * 49 // (1 if directed else 2) and g.edges.where("label = 'x' and src <> dst").count() == g.edge_count()
    assert C.random_gnp_graph(spark, 50, 0, directed=directed).edge_count() == 0


def test_csv_to_static_reads_its_files_once(spark, tmp_path, monkeypatch):
    """The edges count how often they are made."""
    from graphloom import cli

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    nodes = spark.createDataFrame([(k, "a") for k in range(4)], "id long, label string")
    edges = spark.createDataFrame([(0, 1, "x"), (1, 2, "y"), (2, 3, "x")], "src long, dst long, label string").mapInArrow(count, "src long, dst long, label string")
    monkeypatch.setattr(csv, "read_csv_graph", lambda *_: PropertyGraph(nodes, edges))
    cli.run(spark, ["csv-to-static", "edges", f"{tmp_path}/out", "--nodes", "nodes", "--reorder-node-id", "--reorder-label-id"])
    assert made.value == 3, made.value
    assert snapshot.load_compact(spark, f"{tmp_path}/out/compact").edge_count() == 3


def test_strings_of_a_key_are_not_sorted_before_they_are_dealt_out(spark, tmp_path, monkeypatch):
    """A task's memory follows the shuffle's partitions, whose number grows with the table, and not a file's split."""
    from graphloom.functions import ordering
    from graphloom.plans.derived import supply

    lines = spark.range(20_000).select((F.col("id") % 5000).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("l_linestatus"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("part", "supplier"):
        spark.range(1).select(F.col("id").alias(f"{name[0]}_{name[:4]}key")).write.parquet(f"{tmp_path}/{name}.parquet")
    g = supply(spark, str(tmp_path))
    rows = lines.collect()
    plain = {}
    for r in rows:
        key = (r["l_partkey"], r["l_suppkey"] + 10_000_000)
        plain[key] = max(plain.get(key, ""), r["l_linestatus"])
    for table, n in ((g.edges, 1), ((g + g).edges, 2)):
        assert {(r["src"], r["dst"]): r["label"] for r in table.collect()} == plain
        plan = table._jdf.queryExecution().executedPlan().toString()
        first = plan[: plan.index("FileScan")].rsplit("Exchange hash", 1)[-1]  # what is done to the file before anything is exchanged
        assert "Aggregate" not in first and "Sort" not in first and plan.count("Exchange hash") >= n, plan
    size = int(lines.sparkSession.read.parquet(f"{tmp_path}/lineitem.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(ordering, "TOGETHER", size // 50)
    assert supply(spark, str(tmp_path)).edges.rdd.getNumPartitions() >= 40
    joined = lines.join(lines.withColumnRenamed("l_linestatus", "other").hint("merge"), ["l_partkey", "l_suppkey"])
    assert ordering.together(joined.select("l_partkey", "l_suppkey", "other"), ["l_partkey", "l_suppkey"]).rdd.getNumPartitions() <= 4
