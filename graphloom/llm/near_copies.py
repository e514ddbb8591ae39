"""Near copies by SimHash and exact Jaccard similarity of word shingles: operator 9 as a stage for five words and
a similarity of 0.8 or more.

Texts are sets of shingles of SHINGLE words (lower case). Candidates are, first, sets whose SimHash fingerprints meet at
an anchor and differ by at most two bits (operator 9). But sets at SIMILARITY itself differ by some ten of 64 bits,
farther than any covering reaches, so further candidates come from the sets' least hashes: BANDS bands of ROWS each; two sets of
similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS, so a pair at SIMILARITY itself is missed about 3
times in a million, and nearer ones less. Each candidate pair is judged by the exact similarity of its two sets,
unless its ends are already in one component by other pairs, where the answer changes nothing. So that groups don't
cost the square of their size, every set is first judged against the least one of its fingerprint, fingerprints by
their least sets, and every set against one other of its bands; then against the least set of each of its bands, and
of two or three bands in a row. What then still shares a band with another component goes through an exact join by prefixes and places (apart).

Equal sets are one; only sets that share a band with another have their texts moved. Null and empty texts are
the empty set. A component stays with one row, the least by (doc_id, text), null ids last.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import stars
from ..scratch import Scratch, cut, tidy
from . import common as C
from . import simhash
from .words import mixed

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 32, 5
#: Shingles that are hashed at once.
PIECE = 1 << 12
_MULTIPLIERS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_PLACES = mixed(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The different shingles' hashes (uint64), sorted; a shorter text is one shingle."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(sizes)
    take = min(SHINGLE, len(words))
    first, last = (ends - sizes)[: len(words) - take + 1].tolist(), (ends[take - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64))


def key_of(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def least_hashes(own: np.ndarray) -> np.ndarray:
    """BANDS * ROWS min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), PIECE):
        np.minimum(least, mixed(own[at : at + PIECE, None] * _MULTIPLIERS).min(0), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    return mixed((least.reshape(BANDS, ROWS) * _PLACES).sum(1, dtype=np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def prints(docs: DataFrame, carry: list[str], text: str, fp: str, bands: str = "", code: str = "") -> DataFrame:
    """Every row's `carry` columns, its set's key as a (signed) long, and its bands and SimHash if named."""

    def make() -> Callable[[list[str]], dict[str, list]]:
        def work(texts: list[str]) -> dict[str, list]:
            sets = [shingles(t) for t in texts]
            made = {fp: np.array([key_of(s) for s in sets], np.uint64).view(np.int64)}
            if bands:
                made[bands] = [bands_of(least_hashes(s)).view(np.int64) for s in sets]
            if code:
                made[code] = np.array([simhash.of_hashes([s]) for s in sets], np.uint64).view(np.int64)
            return made

        return work

    out = [T.StructField(fp, C.LONG)] + ([T.StructField(bands, T.ArrayType(C.LONG))] if bands else []) + ([T.StructField(code, C.LONG)] if code else [])
    return C.map_texts(docs, carry, text, make, T.StructType(out))


def judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose sets are near. texts: fp, text."""
    side = lambda name: texts.select(F.col("fp").alias(name), F.col("text").alias(f"text_{name}"))
    both = pairs.join(side("src").hint("merge"), "src").join(side("dst").hint("merge"), "dst")
    whole = both.select("src", "dst", F.to_json(F.array("text_src", "text_dst")).alias("texts"))

    def make() -> Callable[[list[str]], dict[str, list]]:
        import json

        def work(rows: list[str]) -> dict[str, list]:
            pairs, sets = [json.loads(r) for r in rows], {}
            for t in {t for pair in pairs for t in pair}:
                sets[t] = shingles(t)
            return {"near": [similarity(sets[a], sets[b]) >= SIMILARITY for a, b in pairs]}

        return work

    return C.map_texts(whole, ["src", "dst"], "texts", make, C.struct(near=C.BOOL)).where("near").select("src", "dst")


def by_fingerprint(found: DataFrame) -> DataFrame:
    """Candidates src, dst by SimHash: sets of one fingerprint with its least set, and the least sets of fingerprints that link."""
    codes = cut(found.groupBy("code").agg(F.min("fp").alias("lead"), F.max("fp").alias("last")))
    same = found.join(codes.where("lead < last"), "code").where("lead < fp").select(F.col("lead").alias("src"), F.col("fp").alias("dst"))
    end = lambda c: codes.select(F.col("code").alias(c), F.col("lead").alias(f"lead_{c}"))
    linked = simhash.links(codes.select(F.col("code").alias("fp"))).join(end("src"), "src").join(end("dst"), "dst")
    return same.unionByName(linked.select(F.least("lead_src", "lead_dst").alias("src"), F.greatest("lead_src", "lead_dst").alias("dst")))


def in_shared_bands(found: DataFrame) -> DataFrame:
    """band, value, first, fp: the bands that several sets have, with the least of them and each."""
    every = found.select("fp", F.posexplode("bands").alias("band", "value"))
    shared = every.groupBy("band", "value").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where("first < last")
    # Spark takes the exploded rows to be no more than the sets; they must not be broadcast
    return every.hint("merge").join(shared, ["band", "value"]).select("band", "value", "first", "fp")


def components(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """fp, root for every set that is near to another. found: fp, bands, code, a row for each set."""
    scratch = Scratch(docs.sparkSession)
    members = C.settled(scratch, in_shared_bands(found), "members")
    close = cut(by_fingerprint(found.select("fp", "code")))
    needed = members.select("fp").union(close.select("src")).union(close.select("dst")).distinct()
    own = prints(docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")), ["text"], "text", "fp")
    # texts are moved in these steps alone; their exchanged rows go from the disks once a step is written
    texts = C.settled(scratch, own.join(needed.hint("merge"), "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text")), "texts")
    led = members.where("first < fp").select(F.col("first").alias("src"), F.col("fp").alias("dst"))
    tried = cut(led.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst").unionByName(close).distinct())
    # what is known is carried on as a star around each root, with the pairs of the last step
    near = C.settled(scratch, judged(tried, texts), "tried")
    for step in ("led", "finer", "apart"):
        tidy(docs.sparkSession)
        rooted = cut(stars(near).select(F.col("id").alias("fp"), F.col("component").alias("root")))
        root = lambda c: rooted.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}"))
        placed = lambda df, c: df.join(root(c), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        if step == "led":
            more = placed(placed(led.distinct(), "src"), "dst").where("root_src <> root_dst").select("src", "dst")
        else:
            named = placed(members.drop("first"), "fp").withColumnRenamed("root_fp", "root")
            mixed_bands = named.groupBy("band", "value").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band", "value")
            named = C.settled(scratch, named.join(mixed_bands, ["band", "value"]), f"mixed_{step}")
            more = finer(named, found) if step == "finer" else apart(named, texts, scratch)
        more = cut(more.join(tried, ["src", "dst"], "left_anti"))
        tried = tried.unionByName(more)
        known = rooted.select(F.col("root").alias("src"), F.col("fp").alias("dst"))
        near = known.unionByName(C.settled(scratch, judged(more, texts), step))
    scratch.drop("texts")
    tidy(docs.sparkSession)
    rooted = cut(stars(near).select(F.col("id").alias("fp"), F.col("component").alias("root")))
    scratch.drop()
    return rooted


def finer(named: DataFrame, found: DataFrame) -> DataFrame:
    """src, dst: sets that share two or three bands in a row with the least set that does, roots unlike; these are likelier
    near than the band's least set, and what they join needn't be paired later."""
    next_band = lambda k: F.get("bands", (F.col("band") + k) % BANDS).alias(f"next{k}")
    named = named.join(found.select("fp", "bands"), "fp").select("band", "value", next_band(1), next_band(2), "fp", "root")
    pairs = []
    for key in (["band", "value", "next1"], ["band", "value", "next1", "next2"]):
        leads = named.groupBy(*key).agg(F.min(F.struct("fp", "root")).alias("lead"))
        own = named.join(leads, key).where("lead.root <> root")
        pairs.append(own.select(F.least("lead.fp", "fp").alias("src"), F.greatest("lead.fp", "fp").alias("dst")))
    return pairs[0].union(pairs[1]).distinct()


def apart(named: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """src, dst: pairs that may be near, of the sets in bands that have sets of several roots, roots unlike.

    A join by prefixes and places, which loses no pair: shingles are put in one order, the rarest first. Two near sets have
    a shingle in common among the first of either, and from the first one that they have in common on both must be long
    enough for the overlap that they need. Edits come first in that order, so what many copies share meets nothing.
    named: band, value, fp, root.
    """
    some = named.select("fp", "root").distinct()

    def make() -> Callable[[list[str]], dict[str, list]]:
        return lambda rows: {"own": [shingles(t).view(np.int64) for t in rows]}

    sets = C.map_texts(some.join(texts.hint("merge"), "fp"), ["fp", "root"], "text", make, C.struct(own=T.ArrayType(C.LONG)))
    sets = C.settled(scratch, sets, "sets")
    every = sets.select("fp", "root", F.size("own").alias("n"), F.explode("own").alias("h"))
    often = every.groupBy("h").agg(F.count("*").alias("times")).where("times > 1")
    ranked = every.join(often.hint("merge"), "h", "left").groupBy("fp", "root", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "h"))).alias("order"))
    first = F.slice("order", F.lit(1), F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9).cast("int") + 1)
    tokens = C.settled(scratch, ranked.select("fp", "root", "n", F.posexplode(first).alias("at", "x")).where("x.times > 1").select("fp", "root", "n", "at", F.col("x.h").alias("h")), "tokens")
    side = lambda x: tokens.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "root", "n", "at")])
    overlap = (F.col("n_x") + F.col("n_y")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9
    enough = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= overlap
    # the file is many times smaller than its rows, so it isn't broadcast
    pairs = side("x").join(side("y").hint("merge"), "h").where((F.col("root_x") < F.col("root_y")) & enough)
    return pairs.select(F.least("fp_x", "fp_y").alias("src"), F.greatest("fp_x", "fp_y").alias("dst")).distinct()


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, as they are: of each component the one with the least (doc_id, text), once."""
    tidy(docs.sparkSession)
    found = C.settled(Scratch(docs.sparkSession), prints(docs, [doc_id], text, "fp", "bands", "code").groupBy(F.col("fp")).agg(F.min(doc_id).alias("least"), F.first("bands").alias("bands"), F.first("code").alias("code")), "found")
    joined = found.join(components(found, docs, text), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return C.one_each(docs, prints(docs, docs.columns, text, C.fresh(docs, "fp")), C.fresh(docs, "fp"), joined, doc_id, text)
