"""SimHash near duplicates by anchor-point covering.

A fingerprint has 64 bits. Two blocks of 23 bits are read as words of the space that the binary Golay code
covers perfectly: every word lies within 3 bits of exactly one codeword. Beyond MANY fingerprints a third block of
15 bits is read by Hamming's perfect code of radius 1. The tuples of codewords are the anchors. A fingerprint's
home is the anchor nearest to it, within the covering radius in each block. It is also sent to every anchor within the
radius plus the threshold: those that are home to some fingerprint at most THRESHOLD bits away, so that both of a pair
meet at the home of either. Fingerprints are compared, on all 64 bits, only where one's home is among the other's
anchors.

Only different fingerprints take part, so copies cost nothing. With two blocks each goes to some 60 of 2**24 anchors,
with three to some 150 of 2**35: n fingerprints are compared n * n * 60 / 2**24 times, or n * n * 150 / 2**35 times.
A fingerprint has at most 2080 others within two bits, so links can't grow with the square of a group. A root with very
many fingerprints is no hot key either: what is joined to it is written first, so that Spark may split its rows.

Null and empty texts have fingerprint zero. Equal rows share a fingerprint. A component's id is its least
doc_id; a null doc_id takes part but never is one, so a component without other ids has a null id. An empty
table gives an empty result. Other columns are kept or left unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars
from ..scratch import cut
from . import common as C

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Shingles whose bits are counted at once.
PIECE = 1 << 15
#: Generator polynomial, bits and covering radius of the perfect codes: twice Golay's, then Hamming's.
BLOCKS = ((0b101011100011, 23, 3), (0b101011100011, 23, 3), (0b10011, 15, 1))
#: Different fingerprints beyond which anchors take the third block too.
MANY = 1 << 24


def fingerprint(text: str) -> int:
    """Unsigned 64-bit SimHash of the text's shingles of SHINGLE words, repeats included."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    take = min(SHINGLE, len(words))
    first, last = starts[: len(words) - take + 1].tolist(), (ends[take - 1 :] - 1).tolist()
    hashed = xxhash.xxh64_intdigest
    return of_hashes(np.array([hashed(joined[a:b], SEED) for a, b in zip(first[at : at + PIECE], last[at : at + PIECE])], np.uint64) for at in range(0, len(first), PIECE))


def of_hashes(pieces: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes (uint64)."""
    total, n = np.zeros(64, np.int64), 0
    for h in pieces:
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return sum(1 << k for k in np.flatnonzero(2 * total > n).tolist())


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """Every row's `carry` columns with the fingerprint as a (signed) long."""
    from pyspark.sql import types as T

    def make() -> Callable[[list[str]], dict[str, list]]:
        return lambda texts: {name: np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    return C.map_texts(docs, carry, text, make, T.StructType([T.StructField(name, C.LONG)]))


class Code:
    """A perfect code's words, and for every syndrome the errors that lead to near codewords."""

    def __init__(self, generator: int, bits: int, radius: int, threshold: int):
        self.generator, self.bits, self.degree = generator, bits, generator.bit_length() - 1
        code = np.zeros(1, np.int64)
        for k in range(bits - self.degree):
            code = np.concatenate([code, code ^ (generator << k)])
        errors = [0]
        for _ in range(radius):
            errors = sorted({e ^ (1 << k) for e in errors for k in range(bits)} | set(errors), key=lambda e: (e.bit_count(), e))
        leader = {}
        for e in errors:
            leader.setdefault(self.syndrome(e), e)
        self.leader = np.array([leader[s] for s in range(1 << self.degree)], np.int64)
        weight = np.bitwise_count(self.leader[:, None] ^ code[None, :])
        #: near[d][s]: what to add to a word's codeword for all codewords within radius + d of it
        self.near = [[code[weight[s] <= radius + d] for s in range(1 << self.degree)] for d in range(threshold + 1)]
        self.table = np.array([self.syndrome(1 << k) for k in range(bits)], np.int64)

    def syndrome(self, word: int) -> int:
        for k in range(self.bits - 1, self.degree - 1, -1):
            if word >> k & 1:
                word ^= self.generator << (k - self.degree)
        return word

    def nearest(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codewords, and the syndromes."""
        syndrome = np.zeros(len(word), np.int64)
        for k in range(self.bits):
            syndrome ^= np.where(word >> k & 1, self.table[k], 0)
        return word ^ self.leader[syndrome], syndrome


class Anchors:
    """Tuples of codewords, one for each block of the fingerprint."""

    def __init__(self, threshold: int = THRESHOLD, blocks: int = 2):
        self.codes = [_CODES.get((k, threshold)) or _CODES.setdefault((k, threshold), Code(*k, threshold)) for k in BLOCKS[:blocks]]
        self.at = [sum(c.bits for c in self.codes[:k]) for k in range(blocks)]
        #: How many bits each block may differ by; together at most the threshold.
        self.shares = [d for d in product(range(threshold + 1), repeat=blocks) if sum(d) == threshold]
        self.offsets: dict[tuple[int, ...], np.ndarray] = {}

    def of(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home of each fingerprint (uint64), and all anchors it is sent to with its number."""
        found = [c.nearest((fp >> np.uint64(a)).astype(np.int64) & ((1 << c.bits) - 1)) for c, a in zip(self.codes, self.at)]
        homes = np.zeros(len(fp), np.int64)
        for (word, _), a in zip(found, self.at):
            homes |= word << a
        parts = []
        for key in zip(*(s.tolist() for _, s in found)):
            known = self.offsets.get(key)
            if known is None:
                known = np.unique(np.concatenate([self._near(key, d) for d in self.shares]))
                if len(self.offsets) < 1 << 15:
                    self.offsets[key] = known
            parts.append(known)
        number = np.repeat(np.arange(len(fp)), [len(p) for p in parts])
        return homes, np.concatenate(parts) ^ homes[number] if parts else homes, number

    def _near(self, key: tuple[int, ...], shares: tuple[int, ...]) -> np.ndarray:
        every = np.zeros(1, np.int64)
        for code, a, s, d in zip(self.codes, self.at, key, shares):
            every = (every[:, None] | code.near[d][s][None, :] << a).ravel()
        return every


_CODES: dict[tuple, Code] = {}
_READY: dict[tuple[int, int], Anchors] = {}


def anchored(fps: DataFrame, homes: bool, threshold: int, blocks: int = 2) -> DataFrame:
    """anchor, fp: each fingerprint at its home, or at every anchor that it is sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _READY.get((threshold, blocks)) or _READY.setdefault((threshold, blocks), Anchors(threshold, blocks))
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            home, sent, number = a.of(fp)
            columns = (home, fp) if homes else (sent, fp[number])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].view(np.int64))], names=["anchor", "fp"])

    C.small_batches(fps.sparkSession)
    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """src, dst: all pairs of different fingerprints at most `threshold` bits apart, the lesser first.

    fps: fp, each once. blocks: of the fingerprint that make up an anchor; the pairs are the same for any.
    """
    blocks = blocks or (2 if fps.count() <= MANY else 3)
    # few bytes, so few partitions, but each row becomes many; of that Spark's sizes know nothing, so neither side may be broadcast
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    home = anchored(fps, True, threshold, blocks).withColumnRenamed("fp", "src")
    sent = anchored(fps, False, threshold, blocks).withColumnRenamed("fp", "dst")
    return home.join(sent.hint("merge"), "anchor").where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= threshold)).select("src", "dst")


def components(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """fp, root, component_id for every fingerprint of a table of doc_id and fp."""
    single = cut(prints.groupBy("fp").agg(F.min(doc_id).alias("least")))
    joined = stars(links(single.select("fp"))).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    rooted = single.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that both sides of the join are exchanged as they are and a root with many rows can be split
    ids = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id: a row for each document."""
    prints = cut(fingerprints(docs, [doc_id], text))
    found = prints.join(components(prints, doc_id), "fp")
    return found.select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, as they are: of each component the one with the least (doc_id, text), once; null ids last."""
    prints = cut(fingerprints(docs, [doc_id], text))
    least = prints.groupBy("fp").agg(F.min(doc_id).alias("least"))
    rooted = least.join(components(prints, doc_id).select("fp", "root"), "fp")
    fp = C.fresh(docs, "fp")
    return C.one_each(docs, fingerprints(docs, docs.columns, text, fp), fp, rooted, doc_id, text)
