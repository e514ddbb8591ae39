"""The stages one after another, on the small tables and on odd rows."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from graphloom.llm import common, near_copies, pieces, pii, simhash, toxicity
from graphloom.scratch import Scratch

from .test_text_operators import as_sample, base_spans, distance_in, plain_redacted, plain_vote

SF = "/root/testdata/sf0.001"


def test_stages_hold_together(spark):
    docs = common.table(spark, SF, "documents")
    sizes, kept = [docs.count()], docs
    for k, (_, stage) in enumerate(P.STAGES):
        kept = stage(spark, kept, SF)
        if k < 4:
            assert kept.columns == docs.columns
        kept = kept.persist()
        sizes.append(kept.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0.5 * sizes[0]


def test_stages_on_odd_and_empty_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, __hits string"
    rows = [(1, "one two three", None, "s", None, "r", "h"), (1, "one two three", None, "s", None, "r", "h"), (2, None, "en", None, 5, None, None), (None, "", "en", "s", 0, None, None), (None, None, None, None, None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n = docs.count()
        for name, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
        assert docs.count() == (2 if n else 0)


def plain_groups(texts):
    """For each text the first of its group: five-word shingle sets linked at a Jaccard similarity of 0.8, by comparing all pairs that share a shingle."""
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for w in words]
    parent, holders, shared = list(range(len(texts))), {}, Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        for x in own or [None]:
            others = holders.setdefault(x, [])
            shared.update((j, i) for j in others)
            others.append(i)
    for (i, j), n in shared.items():
        if not sets[i] or n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_one_document_of_each_group_stays(spark, sf):
    """Of each group by five words and 0.8 the least id stays in the stage; of each of operator 9's groups in operator 9."""
    folder = f"/root/testdata/{sf}"
    docs = common.table(spark, folder, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = sorted({rows[i][0] for i in plain_groups([t for _, t in rows])})
    assert sorted(r["doc_id"] for r in P.without_near_duplicates(spark, docs, folder).collect()) == want and len(want) < len(rows)
    groups = sorted(r["component_id"] for r in simhash.classes(docs).select("component_id").distinct().collect())
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == groups


def test_near_copies_like_brute_force(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(5000)}" for _ in range(r.randint(30, 300))] for _ in range(40)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(r.randint(0, 5)):
            new = list(r.choice([b, texts[-1]]))
            for _ in range(r.randint(1, 1 + len(b) // 60)):
                new[r.randrange(len(new))] = "new"
            texts.append(new)
    texts = [" ".join(t) for t in texts] + ["", " ", "one two", "ONE  two", "x y z"]
    want = sorted(set(plain_groups(texts)))
    assert len(want) < len(texts)
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = P.without_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns and sorted(x["doc_id"] for x in got.collect()) == want


def test_near_copies_carry_on_stars_and_leave_no_tables(spark, monkeypatch):
    """After the first step only a star for each root and the new pairs are looked at; the tables of the steps go."""
    from pathlib import Path

    from graphloom.scratch import shared_folder

    r, texts = random.Random(5), []
    for k in range(6):
        base = [f"w{k}_{j}" for j in range(200)]
        for _ in range(12):
            new = list(base)
            for _ in range(r.randint(0, 4)):
                new[r.randrange(200)] = "new"
            texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_copies.prints(docs, ["doc_id"], "text", "fp", "bands", "code").groupBy("fp").agg(*[F.first(c).alias(c) for c in ("bands", "code")])
    sets, seen, plain = found.count(), [], near_copies.stars
    monkeypatch.setattr(near_copies, "stars", lambda links: seen.append(links.count()) or plain(links))
    folder = Path(shared_folder(spark).removeprefix("file:")) / "graphloom"
    before = set(folder.rglob("*.parquet"))
    rooted = near_copies.components(found, docs, "text")
    assert set(folder.rglob("*.parquet")) <= before
    assert sets - rooted.count() + rooted.select("root").distinct().count() == len(set(plain_groups(texts)))
    assert seen[-1] == rooted.count() < max(seen), (sets, seen)


def test_pairs_of_a_family_by_prefixes_and_places(spark):
    """Of a family whose copies differ by many edits: no near pair is lost, and few others are judged."""
    r = random.Random(11)
    base, texts = [f"w{k}" for k in range(120)], set()
    for _ in range(260):
        new = list(base)
        for _ in range(r.randint(0, 14)):
            new[r.randrange(len(new))] = r.choice(["the", "of", "and", "x1", "x2", "x3", "x4", "x5"])
        texts.add(" ".join(new[r.randint(0, 3) : len(new) - r.randint(0, 3)]))
    sets = [near_copies.shingles(t) for t in texts]
    keys = [int(np.array([near_copies.key_of(x)], np.uint64).view(np.int64)[0]) for x in sets]
    near = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(zip(keys, sets)) for b, y in list(zip(keys, sets))[:i] if near_copies.similarity(x, y) >= 0.8}
    named = spark.createDataFrame([(0, 1, k, k) for k in keys], "band int, value long, fp long, root long")
    found = near_copies.apart(named, spark.createDataFrame(list(zip(keys, texts)), "fp long, text string"), Scratch(spark))
    pairs = {(x["src"], x["dst"]) for x in found.collect()}
    every = len(keys) * (len(keys) - 1) // 2
    assert near <= pairs and len(near) > 500 and len(pairs) - len(near) < 0.1 * (every - len(near)), (len(near), len(pairs), every)


def test_rows_of_bands_and_prefixes_are_not_broadcast(spark):
    """A set becomes a row for each of its bands, or of its first shingles; Spark takes these for as few bytes as the set."""
    texts = [" ".join(f"w{k}" for k in range(i, 40)) for i in range(4)]
    keys = [int(np.array([near_copies.key_of(near_copies.shingles(t))], np.uint64).view(np.int64)[0]) for t in texts]
    found = spark.createDataFrame([(k, [1, 2 + i // 2]) for i, k in enumerate(keys)], "fp long, bands array<long>")
    banded = near_copies.in_shared_bands(found)
    assert sorted((x["band"], x["value"], x["fp"]) for x in banded.collect()) == sorted([(0, 1, k) for k in keys] + [(1, 2 + i // 2, k) for i, k in enumerate(keys)])
    named = spark.createDataFrame([(0, 1, k, k) for k in keys], "band int, value long, fp long, root long")
    paired = near_copies.apart(named, spark.createDataFrame(list(zip(keys, texts)), "fp long, text string"), Scratch(spark))
    assert not paired.isEmpty()
    for df in (banded, paired):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan, plan


def test_all_stages_like_plain_python(spark, tmp_path):
    """run() over a small folder, against each stage's plain version on what the one before keeps."""
    import sentencepiece

    r = random.Random(8)
    text = lambda n, bad: " ".join("".join(r.choice("aeioult") for _ in range(r.randint(2, 7))) if r.random() > bad else r.choice(["vexqor", "vexqam", "drubzik"]) for _ in range(n))
    rows = [(i, text(r.randint(20, 60), 0.2 * (i % 5 == 0)), "en", f"s{i % 3}") for i in range(240)]
    items = [(k, text(14, 0)) for k in range(6)]
    for i in range(1, 60, 4):
        rows[i] = (i, rows[i][1] + " " + items[i % 6][1][: -(i % 3)  or None] + " end", "en", "s")
    for i in range(2, 80, 4):
        rows[i] = (i, rows[i][1] + r.choice([" a.b@c.de ", " 4111 1111 1111 1111", " +1 (974) 555-3436,", " (212) 555-1234"]) + " tail", None, "s")
    rows += [(300 + i, rows[i][1] + " extra", "en", "copy") for i in range(3, 100, 7)] + [(500, None, None, None), (501, "", "en", "s"), (502, rows[3][1], "en", "s")]
    said = [(i, 1, int(i % 5 == 0)) for i in range(240) if i % 8]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(said, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    texts = dict((i, t) for i, t, _, _ in rows)
    use = [(i, y) for i, _, y in said if crc32(str(i).encode()) % 3 != 1]
    distinct = {}
    for i, y in use:
        distinct.setdefault((texts[i], y), i)
    sample = [(texts[i], y) for (_, y), i in sorted(distinct.items(), key=lambda x: x[1])]
    model = toxicity.fitted(as_sample((i, t, y) for i, (t, y) in zip(sorted(distinct.values()), sample)))
    kept = {i: t for i, t in texts.items() if np.interp(plain_vote(sample, t or ""), model.steps, model.values) < 0.7}
    counts = [len(texts), len(kept)]
    order = sorted(kept)
    groups = plain_groups([kept[i] for i in order])
    kept = {i: kept[i] for k, i in enumerate(order) if groups[k] == k}
    counts.append(len(kept))
    plain = lambda t: " ".join((t or "").lower().split())
    kept = {i: t for i, t in kept.items() if not any(distance_in(plain(x), plain(t)) <= len(plain(x)) // 12 for _, x in items)}
    counts.append(len(kept))
    assert all(a > b for a, b in zip(counts, counts[1:])), counts
    left = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    spans = {x["doc_id"]: [(int(a), int(b), k) for k, a, b in (s.split(":") for s in x["spans"].split(",") if s)] for x in pii.digest(left, ["doc_id"]).collect()}
    assert all(set(filter(None, base_spans(t).split(","))) <= {f"{k}:{a}:{b}" for a, b, k in spans[i]} for i, t in kept.items()) and any(spans.values())
    lib = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_file(pieces.MODEL))
    want = {i: lib.encode(plain_redacted(t or "", spans[i]), add_bos=True, add_eos=True) for i, t in kept.items()}
    found = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in P.run(spark, str(tmp_path)).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert found == {i: (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(lib.decode(ids).encode())) for i, ids in want.items()}


def test_unlike_rows_with_one_id_both_stay(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (None, b)], "doc_id long, text string")
    for stage in (lambda: simhash.deduplicated(docs), lambda: P.without_near_duplicates(spark, docs, SF)):
        assert sorted((r["doc_id"], r["text"]) for r in stage().collect()) == [(1, a), (1, b)]
