"""Toxicity by the nearest labelled examples.

Terms are the words of a text (lower case) and the first SIZES bytes of longer words, so that new words of a
known stem still share terms. The vocabulary is every term that two rows of the labelled sample have. A
document's vector is its TF-IDF over all of them, at length one. How alike two documents are is the cosine of
their vectors, in which a term counts by its gain: the log of how many times as common it is among toxic
rows, above FLOOR (tf.idf.rf, relevance weighting). A term without gain still counts in the lengths, so a
single such word in a long text says little. Its K nearest toxic and its K nearest clean examples are found
exactly with a block-max inverted index: examples stand in blocks of BLOCK, each of one class, every term knows
its greatest weight in each block, and only blocks are opened whose highest possible score reaches the K-th
best. The neighbours vote, each with its similarity, and isotonic regression turns votes into scores. It is
fitted on votes taken out of fold: for each of FOLDS parts of the sample the vocabulary's weights and the index
are made of the other parts.

The sample is bounded: SAMPLE labelled rows by the hash of their ids (all if there are fewer), one for each
id, one for each text and label, no text of over 1/64 of SAMPLE_BYTES, and SAMPLE_BYTES of text in all. Rows
whose crc32(doc_id as text) mod 3 is 1 are held out. What is broadcast is bounded by SAMPLE_BYTES. Every text
is scored whole, and nothing is shuffled but the sample.

Null and empty texts are scored as texts without terms, by votes of zero. Ties in similarity go to the smaller
id within a class. Of several labels for one id the highest counts; label rows with nulls are ignored; without
labelled rows every score is 0.5. A null doc_id is not held out. Repeated rows get equal scores; an empty table
gives an empty result. Other columns are kept or left unread, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..scratch import cut
from . import common as C
from .words import PIECE, mixed, spans_hashed

SIZES = (4, 6)
SAMPLE, SAMPLE_BYTES, K, BLOCK, FOLDS = 8192, 24 << 20, 15, 64, 10
#: How many times as common among toxic rows a term must be to gain weight.
FLOOR = 2.0
THRESHOLD = 0.7
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def terms(text: str) -> Iterator[np.ndarray]:
    """The text's terms (uint64, with repeats), piece by piece; pieces end at a space."""
    raw = text.lower().encode("utf-8", "replace").translate(_TABLE)
    at = 0
    while at < len(raw):
        stop = len(raw)
        if stop - at > PIECE:
            stop = raw.rfind(b" ", at, at + PIECE) + 1 or raw.find(b" ", at + PIECE) + 1 or len(raw)
        data = np.frombuffer(raw[at:stop], np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], data != 32, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            # of a long word its beginnings, told apart from words of the same letters
            longer = [starts[ends - starts > k] for k in SIZES]
            found = spans_hashed(data, np.concatenate([starts, *longer]), np.concatenate([ends, *(s + k for s, k in zip(longer, SIZES))]))
            found[len(starts) :] = mixed(found[len(starts) :])
            yield found
        at = stop


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's different terms, sorted, and how often each occurs."""
    parts = list(terms(text))
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def ragged(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0]-1, first[1] .. last[1]-1, and so on."""
    size = last - first
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


class BlockMaxIndex:
    """Weights of examples by term; the postings of a term and block are a run that knows its greatest weight."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        number = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
        term, weight = (np.concatenate([np.empty(0, kind), *(r[k] for r in rows)]) for k, kind in ((0, np.int64), (1, np.float64)))
        self._build(len(rows), number, term, weight, n_terms)

    @classmethod
    def of(cls, n: int, number: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> BlockMaxIndex:
        """Of n examples, from the example, term and weight of every posting, examples ascending."""
        index = cls.__new__(cls)
        index._build(n, number, term, weight, n_terms)
        return index

    def _build(self, n: int, number: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> None:
        self.n, self.blocks = n, -(-n // BLOCK)
        order = np.argsort(term, kind="stable")
        self.number, self.weight, term = number[order].astype(np.int32), weight[order], term[order].astype(np.int64)
        key = term * max(self.blocks, 1) + self.number // BLOCK
        self.run = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
        self.block = self.number[self.run[:-1]] // BLOCK
        self.greatest = np.maximum.reduceat(self.weight, self.run[:-1]) if len(key) else np.empty(0)
        self.runs_of = np.searchsorted(term[self.run[:-1]], np.arange(n_terms + 1))

    def top(self, at: np.ndarray, w: np.ndarray, k: int, but: int = -1, parts: tuple[tuple[int, int], ...] | None = None):
        """The k examples of greatest positive score, best first, ties by number; `but` is left out.

        With parts (ranges of blocks), a list of the same for each part.
        """
        first, last = self.runs_of[at], self.runs_of[at + 1]
        runs, share = ragged(first, last), np.repeat(w, last - first)
        block = self.block[runs]
        bound = np.bincount(block, share * self.greatest[runs], self.blocks)
        found = [self._best(runs, share, block, bound, k, but, a, z) for a, z in (parts or ((0, self.blocks),))]
        return found if parts else found[0]

    def _best(self, runs: np.ndarray, share: np.ndarray, block: np.ndarray, bound: np.ndarray, k: int, but: int, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        likely = a + np.flatnonzero(bound[a:z] > 0)
        likely = likely[np.argsort(-bound[likely], kind="stable")]
        ids, scores, least, step = np.empty(0, np.int64), np.empty(0), 0.0, 2
        while len(likely):
            some, likely, step = likely[:step], likely[step:], step * 4
            use = np.isin(block, some)
            places = ragged(self.run[runs[use]], self.run[runs[use] + 1])
            new = np.bincount(self.number[places], np.repeat(share[use], self.run[runs[use] + 1] - self.run[runs[use]]) * self.weight[places], self.n)
            some = np.flatnonzero(new > 0)
            some = some[some != but]
            ids, scores = np.concatenate([ids, some]), np.concatenate([scores, new[some]])
            best = np.lexsort((ids, -np.round(scores, 9)))[:k]
            ids, scores = ids[best], scores[best]
            least = scores[-1] if len(scores) == k else 0.0
            likely = likely[bound[likely] >= least - 1e-9]
        return ids, scores


@dataclass
class Sample:
    """Labelled rows in flat arrays, so that their memory goes back when they do: the ids, whether each is toxic, and the terms
    (or their places) and counts of all rows one after another."""

    ids: list
    toxic: np.ndarray
    size: np.ndarray
    terms: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(rows: Iterable[tuple[object, int, bytes, bytes]]) -> Sample:
        """From id, toxic, terms (uint64) and counts (uint32) of each row; by id."""
        ids, toxic, size, terms, n = [], [], [], bytearray(), bytearray()
        for i, y, t, c in rows:
            ids.append(i)
            toxic.append(y > 0)
            size.append(len(c) // 4)
            terms += t
            n += c
        order = sorted(range(len(ids)), key=lambda k: ids[k])
        size, ends = np.array(size, np.int64), np.cumsum(np.array(size, np.int64))
        at = ragged(ends[order] - size[order], ends[order])
        return Sample([ids[k] for k in order], np.array(toxic, bool)[order], size[order], np.frombuffer(terms, np.uint64)[at], np.frombuffer(n, np.uint32)[at].astype(np.float32))

    def placed(self, vocabulary: np.ndarray) -> Sample:
        """With places in the vocabulary for the terms that it has."""
        row, kept, step = np.repeat(np.arange(len(self.ids)), self.size), [], 1 << 18
        for k in range(0, len(self.terms), step):
            at = np.searchsorted(vocabulary, self.terms[k : k + step])
            at[at == len(vocabulary)] = 0
            known = vocabulary[at] == self.terms[k : k + step] if len(vocabulary) else np.zeros(len(at), bool)
            kept.append((at[known].astype(np.int32), np.flatnonzero(known) + k))
        at = np.concatenate([np.empty(0, np.int32), *(a for a, _ in kept)])
        left = np.concatenate([np.empty(0, np.int64), *(x for _, x in kept)])
        return Sample(self.ids, self.toxic, np.bincount(row[left], minlength=len(self.ids)), at, self.n[left])

    def some(self, use: np.ndarray) -> Sample:
        """The rows marked in `use`."""
        own = np.repeat(use, self.size)
        return Sample([], self.toxic[use], self.size[use], self.terms[own], self.n[own])


@dataclass
class Weights:
    """What the terms of the vocabulary weigh; made of any rows of the sample."""

    idf: np.ndarray
    gain: np.ndarray

    @staticmethod
    def of(sample: Sample, size: int) -> Weights:
        every = np.bincount(sample.terms, minlength=size)
        bad = np.bincount(sample.terms[np.repeat(sample.toxic, sample.size)], minlength=size)
        n, n_bad = len(sample.toxic), int(sample.toxic.sum())
        ratio = ((bad + 0.5) / (n_bad + 1)) / ((every - bad + 0.5) / (n - n_bad + 1))
        return Weights(np.maximum(np.log((n + 1) / (every + 0.5)), 0), np.where(bad >= 2, np.maximum(np.log(ratio / FLOOR), 0), 0.0))

    def weighed(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (1 + np.log(n.astype(np.float64))) * self.idf[at]

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms that gain, and their TF-IDF weights in the vector of length one over all terms."""
        w = self.weighed(at, n)
        length, use = np.sqrt(w @ w), self.gain[at] > 0
        return at[use], w[use] / (length or 1.0)


class Neighbours:
    """An index over a placed sample, toxic rows first; each class begins a block."""

    def __init__(self, sample: Sample, size: int):
        self.weights = Weights.of(sample, size)
        bad, good = np.flatnonzero(sample.toxic), np.flatnonzero(~sample.toxic)
        gap = -len(bad) % BLOCK
        #: The row behind each number of the index; between the classes are empty ones.
        self.order = np.concatenate([bad, np.full(gap, -1), good]).astype(np.int64)
        self.middle = (len(bad) + gap) // BLOCK
        row = np.repeat(np.arange(len(sample.toxic)), sample.size)
        w = self.weights.weighed(sample.terms, sample.n)
        length = np.sqrt(np.bincount(row, w * w, len(sample.toxic)))
        use = np.flatnonzero(self.weights.gain[sample.terms] > 0)
        number = np.empty(len(sample.toxic), np.int64)
        number[bad], number[good] = np.arange(len(bad)), len(bad) + gap + np.arange(len(good))
        use = use[np.argsort(number[row[use]], kind="stable")]
        weight = w[use] / np.where(length > 0, length, 1.0)[row[use]]
        self.index = BlockMaxIndex.of(len(self.order), number[row[use]], sample.terms[use], weight, size)

    def vote(self, at: np.ndarray, n: np.ndarray) -> tuple[float, list[tuple[int, float]]]:
        """The neighbours' vote, and the neighbours (example, similarity) of either class."""
        at, w = self.weights.vector(at, n)
        if not len(at):
            return 0.0, []
        sides = self.index.top(at, w * self.weights.gain[at], K, parts=((0, self.middle), (self.middle, self.index.blocks)))
        near = [(int(self.order[i]), float(s)) for ids, scores in sides for i, s in zip(ids, scores)]
        return (float(sides[0][1].sum()) - float(sides[1][1].sum())) / K, near


def isotonic(x: np.ndarray, y: np.ndarray, prior: float = 0.0, strength: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps that fit y best (pool adjacent violators), as points at both ends of each pool.

    With `strength`, a pool leans to `prior` as if it had so many rows more.
    """
    pools: list[list[float]] = []  # sum of y, count, least x, greatest x
    for k in np.argsort(x, kind="stable"):
        pools.append([float(y[k]), 1.0, float(x[k]), float(x[k])])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    value = np.maximum.accumulate([(p[0] + prior * strength) / (p[1] + strength) for p in pools])
    return np.array([e for p in pools for e in p[2:]]), np.repeat(value, 2)


@dataclass
class Model:
    vocabulary: np.ndarray
    near: Neighbours | None
    ids: list
    steps: np.ndarray
    values: np.ndarray

    def score(self, text: str) -> tuple[float, str]:
        """A calibrated score, and the nearest examples as id:similarity, comma-joined."""
        if self.near is None:
            return float(self.values[0]), ""
        vote, near = self.near.vote(*placed(self.vocabulary, *term_counts(text)))
        near = sorted(near, key=lambda p: (-round(p[1], 9), p[0]))[:3]
        return float(np.interp(vote, self.steps, self.values)), ",".join(f"{self.ids[i]}:{s:.3f}" for i, s in near)


def placed(vocabulary: np.ndarray, found: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted vocabulary of the terms that it has, and their counts."""
    if not len(vocabulary):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    at = np.searchsorted(vocabulary, found)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == found
    return at[known].astype(np.int32), n[known].astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, sample: int, sample_bytes: int) -> DataFrame:
    """id, toxic, text: at most `sample` rows that aren't held out, and `sample_bytes` of text."""
    use = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(F.col(doc_id)))
    chosen = use.groupBy(F.col(doc_id).alias("id")).agg(F.max(toxic).cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.octet_length("text") <= sample_bytes // 64).join(F.broadcast(chosen), "id")
    rows = cut(rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).groupBy("text", "toxic").agg(F.min("id").alias("id")))
    # a row of numbers for each sampled document, so one task can add them up
    held = F.sum("size").over(W.orderBy(F.xxhash64("id"), "id").rowsBetween(W.unboundedPreceding, 0))
    fits = rows.select("id", F.octet_length("text").alias("size")).select("id", held.alias("held"))
    return rows.join(F.broadcast(fits.where(F.col("held") <= sample_bytes).select("id")), "id", "left_semi")


def fitted(sample: Sample) -> Model:
    if not sample.ids:
        return Model(np.empty(0, np.uint64), None, [], np.zeros(1), np.full(1, 0.5))
    every = np.sort(sample.terms)
    vocabulary = every[1:][every[1:] == every[:-1]]
    vocabulary = vocabulary[np.append(True, vocabulary[1:] != vocabulary[:-1])] if len(vocabulary) else vocabulary
    del every
    rows = sample.placed(vocabulary)
    ends = np.cumsum(rows.size)
    fold = mixed(np.array([crc32(str(i).encode()) for i in rows.ids], np.uint64)) % np.uint64(FOLDS)
    votes = np.zeros(len(rows.ids))
    for k in range(FOLDS):
        own = np.flatnonzero(fold == k)
        if 0 < len(own) < len(rows.ids):
            others = Neighbours(rows.some(fold != k), len(vocabulary))
            votes[own] = [others.vote(rows.terms[z - m : z], rows.n[z - m : z])[0] for z, m in zip(ends[own], rows.size[own])]
    steps, values = isotonic(votes, rows.toxic.astype(float), float(rows.toxic.mean()), 1.0)
    return Model(vocabulary, Neighbours(rows, len(vocabulary)), rows.ids, steps, values)


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of the labelled sample, fitted by one task, so that the sample never comes to the driver."""
    rows = labelled_sample(docs, labels, doc_id, text, toxic, sample, sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[object, int, bytes, bytes]]:
            for batch in batches:
                for i, y, t in zip(*(c.to_pylist() for c in batch.columns)):
                    found, n = term_counts(t)
                    yield i, y, found.tobytes(), n.astype(np.uint32).tobytes()

        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted(Sample.of(each())))], pa.binary())], names=["model"])

    C.small_batches(docs.sparkSession)
    made = rows.select("id", "toxic", "text").coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fitted(Sample.of([]))


def scored(docs: DataFrame, carry: list[str], model: Model, text: str = "text", score: str = "score", evidence: str = "evidence") -> DataFrame:
    """Every row's `carry` columns with score and evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[str]], dict[str, list]]:
        m = sent.value

        def work(texts: list[str]) -> dict[str, list]:
            found = [m.score(t) for t in texts]
            return {score: [a for a, _ in found], evidence: [b for _, b in found]}

        return work

    return C.map_texts(docs, carry, text, make, T.StructType([T.StructField(score, C.DOUBLE), T.StructField(evidence, C.STRING)]))


def digest(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence."""
    found = scored(docs, [doc_id], trained(docs, labels, doc_id, text), text)
    return found.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, as they are, whose score is under THRESHOLD. Nothing but the sample is shuffled."""
    score = C.fresh(docs, "score")
    evidence = C.fresh(docs, "evidence")
    return scored(docs, docs.columns, trained(docs, labels, doc_id, text), text, score, evidence).where(F.col(score) < THRESHOLD).drop(score, evidence)
