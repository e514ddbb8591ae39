"""Removal of every byte that a string of LENGTH bytes covers which starts anywhere else too.

Suffixes are sorted by a distributed merge sort that knows common prefixes (Bingmann, Sanders and Schimek
2020): tasks sort their own suffixes, exchange them as front-coded runs (each suffix without the bytes that
it shares with the one before), and merge the runs with a loser tree that keeps, for each run, how much of
its head is known to agree with the last output; two heads are compared only from there on. The merge gives
the common prefixes of neighbours for nothing.

Two steps keep the sort small without losing a match.

* Not every suffix is sorted. Of the WINDOW grams of GRAM bytes that begin in a string's first WINDOW
  places, the one with the least hash (the first of them) is the string's anchor. Equal strings have equal
  anchors at equal offsets. So one suffix for each anchor is sorted, along with the bytes to its left that
  its strings reach; about one place in 85 is an anchor. Strings with one anchor are equal if they agree to
  its right, which the sort finds, and to its left, which hashes of the left bytes within stretches of equal
  right bytes find, offset by offset.
* Anchors whose gram occurs once can't lie in a repeat, and anchors with equal surroundings (128-bit hashes)
  are one suffix with a number. So copies of passages cost one suffix, and the counts are summed
  before they are shuffled. Copies of whole texts are one text with a number before any of that. A suffix with an equal one elsewhere needs no merge to be known as repeated.

A task merges the suffixes of a range of leading grams; those that share their first GRAM bytes in different
surroundings meet in one task, in which they cost n log n.

Documents are told apart by the hash of their text, since equal texts have equal results. Null and empty
texts have no bytes, and texts under LENGTH bytes lose none. Every row gives one row, repeated rows and null
ids included; an empty table gives an empty result; other columns are neither read nor touched.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import common as C
from .words import _powers, mixed

LENGTH, WINDOW, GRAM = 200, 168, 33
#: Bytes that are handled at once, and suffixes in a merge (on average).
PIECE, PER_MERGE, RUN_BLOCK = 1 << 19, 40_000, 4096
#: Ranges of leading grams, and heads that the driver sees for each; where there must be more parts, the grams of a
#: range are dealt out further by hash.
RANGES, HEADS = 256, 32


def _window_least(key: np.ndarray, window: int) -> np.ndarray:
    least, size = key, 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = window - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all texts: number of the text, anchor's place, least and greatest offset of its strings, gram hash."""
    found: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for at in range(0, len(t) - LENGTH + 1, PIECE):
            part = t[at : at + PIECE + LENGTH - 1]
            group.append((i, at, part))
            held += len(part)
            if held >= PIECE:
                found.append(_anchors(group))
                group, held = [], 0
    if group:
        found.append(_anchors(group))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.empty(0, d) for d in (np.int64, np.int64, np.int64, np.int64, np.uint64))


def _anchors(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    n = len(data)
    power, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    gram = mixed((prefix[GRAM:] - prefix[:-GRAM]) * inverse[: n + 1 - GRAM])
    places = np.uint64((1 << 21) - 1)
    at = (_window_least(gram & ~places | np.arange(len(gram), dtype=np.uint64), WINDOW) & places).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in group])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    of = np.repeat(np.arange(len(group)), sizes)
    string = np.arange(n - LENGTH + 1)
    whole = string + LENGTH <= (starts + sizes)[of[: len(string)]]
    string, at = string[whole], at[: len(whole)][whole]
    new = np.ones(len(string), bool)
    new[1:] = (at[1:] != at[:-1]) | (of[string[1:]] != of[string[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(string)]]) - 1
    a, lo, hi = at[first], string[first], string[last]
    g = of[lo]
    number, base = np.array([i for i, _, _ in group])[g], np.array([b for _, b, _ in group])[g]
    return number, a - starts[g] + base, a - hi, a - lo, gram[a]


def _pack(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return at << 16 | low << 8 | high


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """k1, k2 (two hashes of the text) and the text's bytes."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2"), t.cast("binary").alias("bytes"))


def _places(docs: DataFrame, text: str, grams_only: bool) -> DataFrame:
    """gram of every anchor, and unless grams_only its text's k1 and k2 and its packed place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, at, low, high, gram = anchors(b.column(2).to_pylist())
            columns = [pa.array(gram.view(np.int64))]
            if not grams_only:
                columns += [b.column(0).take(pa.array(number)), b.column(1).take(pa.array(number)), pa.array(_pack(at, low, high))]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "k1", "k2", "place"][: len(columns)])

    return _keyed(docs, text).mapInArrow(run, "gram long" if grams_only else "gram long, k1 long, k2 long, place long")


def _surroundings(joined: DataFrame) -> DataFrame:
    """Of texts with their places and copies: k1, k2, copies, place, the bytes around it and their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            k1, k2, copies, place, full, around = [], [], [], [], [], []
            for a, c, t, some, many in zip(*(b.column(i).to_pylist() for i in range(5))):
                for p in some:
                    at, low, high = p >> 16, p >> 8 & 255, p & 255
                    s = t[at - high : at + LENGTH - low]
                    k1.append(a)
                    k2.append(c)
                    copies.append(many)
                    place.append(p)
                    around.append(s)
                    full.append(xxhash.xxh3_128_digest(s, seed=high))
            numbers, bytes_of = [pa.array(x, pa.int64()) for x in (k1, k2, copies, place)], [pa.array(x, pa.binary()) for x in (full, around)]
            yield pa.RecordBatch.from_arrays([*numbers, *bytes_of], names=["k1", "k2", "copies", "place", "full", "around"])

    return joined.mapInArrow(run, "k1 long, k2 long, copies long, place long, full binary, around binary")


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7 >> 3)


def front_coded(run: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared, tails, before = [], [], b""
    for s in run:
        k = common(before, s, 0)
        shared.append(k)
        tails.append(s[k:])
        before = s
    return shared, tails


class LoserTree:
    """Merges front-coded sorted runs. Yields (run, place in the run, string, prefix shared with the output before)."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(len(runs), 1):
            self.size *= 2
        self.head: list[bytes | None] = [None] * self.size
        self.known = [0] * self.size
        self.at = [-1] * self.size
        self.compared = 0
        for r in range(len(runs)):
            self._advance(r)
        self.loser = [0] * self.size
        self.winner = self._play(1)

    def _advance(self, r: int) -> None:
        shared, tails = self.runs[r]
        self.at[r] += 1
        k = self.at[r]
        if k == len(shared):
            self.head[r] = None
        else:
            # the head was the last output, so what the next shares with it is what it shares with the output
            self.head[r] = (self.head[r] or b"")[: shared[k]] + tails[k]
            self.known[r] = shared[k]

    def _less(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if self.known[a] != self.known[b]:
            return (a, b) if self.known[a] > self.known[b] else (b, a)
        k = common(x, y, self.known[a])
        self.compared += 1
        if x[k : k + 1] < y[k : k + 1] or (k == len(x) == len(y) and a < b):
            self.known[b] = k
            return a, b
        self.known[a] = k
        return b, a

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, self.loser[node] = self._less(self._play(2 * node), self._play(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        while (head := self.head[self.winner]) is not None:
            w = self.winner
            yield w, self.at[w], head, self.known[w]
            self._advance(w)
            node = w + self.size >> 1
            while node:
                w, self.loser[node] = self._less(w, self.loser[node])
                node >>= 1
            self.winner = w


def repeated_offsets(shared: np.ndarray, lefts: list[bytes], low: np.ndarray, high: np.ndarray) -> list[int]:
    """For suffixes in order, with what each shares with the one before: the offsets (as bits) at which
    another suffix has the same string."""
    n = len(shared)
    out = [0] * n
    if n < 2:
        return out
    width = int(high.max()) + 1
    left = np.zeros((n, width), np.uint8)  # left[i, o]: the byte o + 1 places before the anchor
    for i, s in enumerate(lefts):
        left[i, : len(s)] = np.frombuffer(s[::-1], np.uint8)
    hashed = np.zeros(n, np.uint64)
    for o in range(width):
        if o:
            hashed = mixed(hashed * np.uint64(0x9E3779B97F4A7C15) + left[:, o - 1] + np.uint64(1))
        stretch = np.cumsum(shared < LENGTH - o)
        some = np.flatnonzero((low <= o) & (o <= high))
        some = some[np.bincount(stretch[some], minlength=stretch[-1] + 1)[stretch[some]] > 1] if len(some) else some
        if len(some) < 2:
            continue
        key = mixed(stretch[some].astype(np.uint64)) ^ hashed[some]
        _, back, number = np.unique(key, return_inverse=True, return_counts=True)
        for i in some[number[back] > 1].tolist():
            out[i] |= 1 << o
    return out


def _runs(suffixes: DataFrame, splitters: list[bytes], dealt: int) -> DataFrame:
    """Each task's suffixes, sorted and front-coded, in blocks for the parts between splitters, each dealt out once more."""
    sent = suffixes.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, bytes, bytes, int, int]] = []
        count = 0

        def sorted_run() -> Iterator[pa.RecordBatch]:
            nonlocal count
            rows.sort()
            cuts = sent.value
            blocks: list[dict] = []
            parts: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                gram = r[0][:GRAM]
                parts.setdefault(bisect_right(cuts, gram) * dealt + (crc32(gram) % dealt if dealt > 1 else 0), []).append(i)
            for part, all_of in parts.items():
                for k in range(0, len(all_of), RUN_BLOCK):
                    some = [rows[i] for i in all_of[k : k + RUN_BLOCK]]
                    shared, tails = front_coded([r[0] for r in some])
                    rest = {name: [r[j] for r in some] for j, name in enumerate(("left", "full", "low", "high"), 1)}
                    blocks.append({"part": part, "run": f"{some[0][2].hex()}:{count}:{k}", "shared": shared, "tails": tails} | rest)
            rows.clear()
            count += 1
            if blocks:
                yield pa.RecordBatch.from_pylist(blocks, schema=schema)

        lists = {"shared": pa.int16(), "tails": pa.binary(), "left": pa.binary(), "full": pa.binary(), "low": pa.int16(), "high": pa.int16()}
        schema = pa.schema([("part", pa.int32()), ("run", pa.string()), *((name, pa.list_(kind)) for name, kind in lists.items())])
        for b in batches:
            for full, around, place in zip(*(b.column(i).to_pylist() for i in range(3))):
                low, high = place >> 8 & 255, place & 255
                rows.append((around[high:], around[:high], full, low, high))
            if len(rows) >= 200_000:
                yield from sorted_run()
        yield from sorted_run()

    out = "part int, run string, shared array<short>, tails array<binary>, left array<binary>, full array<binary>, low array<short>, high array<short>"
    return suffixes.select("full", "around", "place").mapInArrow(run, out)


def _merged(blocks: DataFrame, parts: int) -> DataFrame:
    """full, offsets (20-odd bytes, a bit for each): suffixes with strings that another suffix has too."""

    def resolve(part: list[dict]) -> Iterator[tuple[bytes, bytes]]:
        tree = LoserTree([(b["shared"], b["tails"]) for b in part])
        order, shared = [], []
        for r, k, _, known in tree:
            order.append((r, k))
            shared.append(known)
        take = lambda name: [part[r][name][k] for r, k in order]
        bits = repeated_offsets(np.array(shared), take("left"), np.array(take("low")), np.array(take("high")))
        for full, x in zip(take("full"), bits):
            if x:
                yield full, x.to_bytes(WINDOW // 8, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and row["part"] != held[0]["part"]:
                    yield out(resolve(held))
                    held = []
                held.append(row)
        if held:
            yield out(resolve(held))

    def out(found: Iterator[tuple[bytes, bytes]]) -> pa.RecordBatch:
        full, offsets = [list(c) for c in zip(*found)] or [[], []]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.binary()), pa.array(offsets, pa.binary())], names=["full", "offsets"])

    return blocks.repartition(parts, "part").sortWithinPartitions("part", "run").mapInArrow(run, "full binary, offsets binary")


def repeats(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """k1, k2, places: for texts (by their hashes) the anchors at which strings repeat, with the offsets
    (null: all of the anchor's)."""
    C.small_batches(docs.sparkSession)
    # what is joined is written first: Spark splits a hot side only where both sides come straight from their exchanges
    grams = scratch.keep(_places(docs, text, True).groupBy("gram").count().where("count > 1").select("gram"), "grams")
    some = scratch.keep(_places(docs, text, False).join(grams, "gram").groupBy("k1", "k2").agg(F.collect_set("place").alias("some")), "some")
    # of equal texts one is cut up, with their number; they are brought together before they are exchanged
    texts = _keyed(docs, text).groupBy("k1", "k2").agg(F.first("bytes").alias("bytes"), F.count("*").alias("copies"))
    found = C.settled(scratch, _surroundings(texts.join(some, ["k1", "k2"]).select("k1", "k2", "bytes", "some", "copies")), "found")
    scratch.drop("grams")
    scratch.drop("some")
    single = scratch.keep(found.groupBy("full").agg(F.sum("copies").alias("n"), F.min("around").alias("around"), F.min(F.col("place").bitwiseAND(65535)).alias("place")), "single")
    # grams that stand in one surrounding only are known already
    gram = F.xxhash64(F.substring("around", F.col("place").bitwiseAND(255).cast("int") + 1, F.lit(GRAM)))
    several = scratch.keep(single.groupBy(gram.alias("gram")).count().where("count > 1").select("gram"), "several")
    suffixes = scratch.keep(single.withColumn("gram", gram).join(several, "gram").select("full", "around", "place"), "suffixes")
    number = suffixes.count()
    parts = max(1, number // PER_MERGE)
    head = F.substring("around", F.col("place").bitwiseAND(255).cast("int") + 1, F.lit(GRAM))
    ranges = min(parts, RANGES)
    # between one and two times HEADS * ranges of them, by hash
    every = max(1, number // (HEADS * ranges))
    heads = sorted(bytes(r[0]) for r in suffixes.where(F.pmod(F.xxhash64("full"), F.lit(every)) == 0).select(head).collect()) if parts > 1 else []
    splitters = [heads[k * len(heads) // ranges] for k in range(1, ranges)] if heads else []
    dealt = -(-parts // ranges)
    merged = _merged(_runs(suffixes, splitters, dealt), ranges * dealt)
    once = merged.join(single.where("n = 1").select("full"), "full")
    known = single.where("n > 1").select("full", F.lit(None).cast("binary").alias("offsets")).unionByName(once)
    places = scratch.keep(found.select("k1", "k2", "place", "full").join(known, "full").groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "offsets")).alias("places")), "places")
    for name in ("found", "single", "several", "suffixes"):
        scratch.drop(name)
    return places


def kept_bytes(data: bytes, places: list[tuple[int, bytes | None]]) -> tuple[np.ndarray, int]:
    """Which bytes stay, and the number of maximal removed runs."""
    edge = np.zeros(len(data) + 1, np.int64)
    for place, offsets in places:
        at, low, high = place >> 16, place >> 8 & 255, place & 255
        if offsets is None:
            edge[at - high] += 1
            edge[at - low + LENGTH] -= 1
        else:
            o = np.flatnonzero(np.unpackbits(np.frombuffer(offsets, np.uint8), bitorder="little"))
            edge[at - o] += 1
            edge[at - o + LENGTH] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return ~gone, int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))


def deduplicated(docs: DataFrame, carry: list[str], text: str = "text", kept: bool = False) -> DataFrame:
    """Every row's `carry` columns with n_bytes, n_removed, n_spans and kept_sha256; kept adds the bytes that stay."""
    scratch = Scratch(docs.sparkSession)
    known = repeats(docs, scratch, text)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(7), t).alias("k2"), t.cast("binary").alias("bytes"))
    joined = keyed.join(known, ["k1", "k2"], "left").select("row", "bytes", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, spans, digests, rest = [], [], [], [], []
            for data, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                left, count = data, 0
                if places:
                    stays, count = kept_bytes(data, [(p["place"], p["offsets"]) for p in places])
                    left = np.frombuffer(data, np.uint8)[stays].tobytes()
                n.append(len(data))
                removed.append(len(data) - len(left))
                spans.append(count)
                digests.append(hashlib.sha256(left).hexdigest())
                rest.append(left if kept else None)
            made = [*(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digests, pa.string()), pa.array(rest, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    from pyspark.sql import types as T

    out = T.StructType([joined.schema["row"], *C.struct(n_bytes=C.LONG, n_removed=C.LONG, n_spans=C.LONG, kept_sha256=C.STRING, kept=C.BINARY)])
    done = joined.mapInArrow(run, out)
    return done.select(*[F.col("row").getField(c).alias(c) for c in carry], "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept else []))
