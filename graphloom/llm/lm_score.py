"""Cross-entropy difference (Moore and Lewis 2010) with word bigrams.

A target model is counted on the documents that are labelled good, a background model on all documents.
Both are matched: the same order, the same smoothing and one shared vocabulary, in which every word of
either corpus and every pair of words has an exact count under its full 64-bit key. The tables of counts grow
with the corpus and are nowhere whole: they lie in buckets of keys, whose number grows with the bytes of
text. A document's score is the mean over its tokens of background loss less target loss: higher means more
like the target.

Counting and scoring: documents are gathered into chunks of CHUNK_CHARS characters. A chunk asks each bucket
for its own keys, once each and sorted, along with what it adds to their counts, so a hot source or a large
group of copies only makes counts larger. A bucket adds up, and answers each chunk with the counts in the order
asked. Documents travel to the answers as places among the chunk's words, never again as texts.

Null and empty texts have no tokens and losses and score 0. Repeated rows count and are scored each on
their own; documents without label belong to the background alone, a document with several labels is good
if any says so. Without any labelled document the target model is uniform. Empty tables give no rows.
Other columns are neither read nor touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch, cut
from . import common as C
from .words import mixed, word_hashes

#: Of cells(), small models that fit in arrays; scored() counts keys exactly.
VOCABULARY, PAIRS = 1 << 18, 1 << 21
#: What a task scores together, and bytes of text for each bucket of keys.
CHUNK_CHARS, CHUNK_ROWS, BUCKET_BYTES = 4 << 20, 1 << 14, 16 << 20
TURNS = 4
#: Good documents whose ids are broadcast at most.
FEW = 1_000_000
ASK_COLUMNS = ("__kind", "__chunk", "__bucket", "__keys", "__target", "__background")
#: Weight of the pair counts against the word counts, and of the word counts against equal shares. Weights, unlike
#: added counts, mean the same for corpora of different sizes.
WEIGHT, WORD_WEIGHT = 0.7, 0.9


def cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word classes of a text, and for each word the cell of it and the word before it."""
    h = word_hashes(text.encode("utf-8", "replace"))
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h
    pairs = mixed(before * np.uint64(0xD6E8FEB86659FD93) + h)
    return (h % np.uint64(VOCABULARY)).astype(np.int64), (pairs % np.uint64(PAIRS)).astype(np.int64)


def pair_keys(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A key for each word with the one before it, in texts of so many words one after another."""
    before = np.concatenate([np.zeros(1, np.uint64), words])[:-1]
    before[(np.cumsum(size) - size)[size > 0]] = 0
    return mixed(before * np.uint64(0xD6E8FEB86659FD93) + words)


def packed(values: np.ndarray) -> bytes:
    """Compressed byte planes: high bytes are nearly all zero."""
    return len(values).to_bytes(8, "little") + pa.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Of sorted keys."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def log_model(words: np.ndarray, pairs: np.ndarray, total: int | None = None, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word probabilities, word counts and pair counts. total, size: tokens and different words, if words are only some of them."""
    total, size = words.sum() if total is None else total, size or len(words)
    share = WORD_WEIGHT * words / total + (1 - WORD_WEIGHT) / size if total else np.full(len(words), 1 / max(size, 1))
    return share, words.astype(np.float64), pairs.astype(np.float64)


def losses(model: tuple[np.ndarray, np.ndarray, np.ndarray], words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """-log p for each word; a word seen never before falls back to the words alone."""
    alone, seen, together = model
    p = alone[words].astype(np.float64)
    before = np.zeros(len(words))
    before[1:] = seen[words[:-1]]
    with np.errstate(divide="ignore", invalid="ignore"):
        follows = np.where(before > 0, np.minimum(together[pairs], before) / before, 0)
    return -np.log(np.where(before > 0, WEIGHT * follows + (1 - WEIGHT) * p, p))


#: What asked() makes: a document's row, or the keys of words or pairs of a chunk in one bucket.
DOCUMENT, WORDS, PAIRS_OF = 0, 1, 2
ASKED = "__kind int, __chunk string, __bucket int, __keys binary, __target binary, __background binary"


def asked(joined: DataFrame, carry: list[str], buckets: int) -> DataFrame:
    """Chunks of documents, and the n-grams that each has, once each, with what it adds to their counts.

    joined: carry, __good, __text. Documents come as their words' places among the chunk's sorted words.
    """
    C.small_batches(joined.sparkSession)
    fields = T.StructType([joined.schema[c] for c in carry] + list(T._parse_datatype_string(ASKED)))
    types = [C._arrow(f.dataType) for f in fields]
    names = fields.fieldNames()
    n, shift = len(carry), np.uint64(64 - int(buckets).bit_length() + 1)

    def of_chunk(held: list[pa.RecordBatch], texts: list[str], good: list[bool]) -> Iterator[pa.RecordBatch]:
        chunk, each = uuid.uuid4().hex, [word_hashes(t.encode("utf-8", "replace")) for t in texts]
        size = np.array([len(h) for h in each], np.int64)
        words, ends = np.concatenate(each), np.cumsum(size)
        del each
        places = np.empty(0, np.int32)
        weight = np.repeat(np.array(good, np.float64), size)
        for kind in (WORDS, PAIRS_OF):
            every, back = np.unique(words if kind == WORDS else pair_keys(words, size), return_inverse=True)
            places = back.astype(np.int32) if kind == WORDS else places
            target, background = (np.bincount(back, w, len(every)).astype(np.int64) for w in (weight, None))
            where = (every >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(every), np.int64)
            cut_at = np.searchsorted(where, np.arange(buckets + 1))
            some = [(b, a, z) for b, (a, z) in enumerate(zip(cut_at, cut_at[1:])) if z > a]
            for at in range(0, len(some), 16):
                part = some[at : at + 16]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), t) for t in types[:n]] + [
                    pa.array([kind] * len(part), types[n]), pa.array([chunk] * len(part), types[n + 1]), pa.array([b for b, _, _ in part], types[n + 2]),
                    *(pa.array([f(v[a:z]) for _, a, z in part], types[n + 3]) for f, v in ((packed_keys, every), (packed, target), (packed, background)))], names=names)
        row = 0
        for batch in held:
            spans = [(int(ends[k] - size[k]), int(ends[k])) for k in range(row, row + batch.num_rows)]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(n)] + [
                pa.array([DOCUMENT] * len(spans), types[n]), pa.array([chunk] * len(spans), types[n + 1]), pa.nulls(len(spans), types[n + 2]),
                pa.array([packed(places[a:z]) for a, z in spans], types[n + 3]), *(pa.nulls(len(spans), types[n + 3]) for _ in range(2))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, good, chars = [], [], [], 0
        for batch in batches:
            held.append(batch)
            new = batch.column(n + 1).to_pylist()
            texts += new
            good += [bool(g) for g in batch.column(n).to_pylist()]
            chars += sum(map(len, new))
            if chars >= CHUNK_CHARS or len(texts) >= CHUNK_ROWS:
                yield from of_chunk(held, texts, good)
                held, texts, good, chars = [], [], [], 0
        if held:
            yield from of_chunk(held, texts, good)

    return joined.select(*[F.col(f"`{c}`") for c in carry], "__good", "__text").mapInArrow(run, fields)


def answered(asks: DataFrame) -> DataFrame:
    """For each chunk and bucket the whole corpus's counts of the asked keys, in their order (words with their keys); and for each bucket of words a row
    without chunk: its number of different words, and its tokens in both corpora."""

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("__kind")[0].as_py(), table.column("__bucket")[0].as_py()
        keys = [unpacked_keys(x.as_py()) for x in table.column("__keys")]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for name in ("__target", "__background"):
            own = np.concatenate([unpacked(x.as_py(), np.int64) for x in table.column(name)])
            total = np.zeros(len(every), np.int64)
            np.add.at(total, back, own)
            sums.append(total)
        ends = np.cumsum([len(k) for k in keys])
        out = [[packed(s[back[z - len(k) : z]]) for k, z in zip(keys, ends)] + [None] for s in sums]
        m = len(keys) + 1
        return pa.table({"__kind": pa.array([kind] * m, pa.int32()), "__chunk": pa.array([*table.column("__chunk").to_pylist(), None], pa.string()), "__bucket": pa.array([bucket] * m, pa.int32()),
                         "__keys": pa.array([*(table.column("__keys").to_pylist() if kind == WORDS else [None] * len(keys)), None], pa.binary()),
                         "__target": pa.array(out[0], pa.binary()), "__background": pa.array(out[1], pa.binary()),
                         "__sums": pa.array([None] * (m - 1) + [[len(every), int(sums[0].sum()), int(sums[1].sum())]], pa.list_(pa.int64()))})

    return asks.groupBy("__kind", "__bucket").applyInArrow(run, f"{ASKED}, __sums array<bigint>")


def scored(docs: DataFrame, labels: DataFrame, carry: list[str], doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Every row's `carry` columns with n_words, target_loss, background_loss (means) and score."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    said = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg((F.max(quality) == 1).alias("__good"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(doc_id).alias("__id"), body.alias("__text"))
    size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    buckets = 1 << max(0, (size // BUCKET_BYTES).bit_length())
    good = cut(said.where("__good"))
    # labels have no size bound: they are broadcast only where they are few, else texts are moved to them
    few = good.count() <= FEW
    joined = read.join(F.broadcast(good), "__id", "left") if few else read.hint("merge").join(good.hint("merge"), "__id", "left")
    made = C.settled(scratch, asked(joined, carry, buckets), "asked")
    # in turns, so that only some of the keys lie on the disks twice
    turns = [C.settled(scratch, answered(made.where((F.col("__kind") != DOCUMENT) & (F.col("__bucket") % TURNS == k)).select(*ASK_COLUMNS)), f"answers{k}") for k in range(min(TURNS, buckets))]
    answers = reduce(DataFrame.unionByName, turns)
    rows = C.settled(scratch, made.where(F.col("__kind") == DOCUMENT), "rows")
    scratch.drop("asked")
    sums = answers.where(F.col("__chunk").isNull() & (F.col("__kind") == WORDS)).agg(*[F.coalesce(F.sum(F.col("__sums")[k]), F.lit(0)) for k in range(3)]).first()
    n_words, totals = sums[0], (sums[1], sums[2])
    out = T.StructType([docs.schema[c] for c in carry] + [T.StructField("n_words", C.LONG), *(T.StructField(c, C.DOUBLE) for c in ("target_loss", "background_loss", "score"))])
    n, kinds = len(carry), [C._arrow(f.dataType) for f in out]

    def run(table: pa.Table) -> pa.Table:
        kind = np.array(table.column("__kind").to_pylist())
        bucket = np.array(table.column("__bucket").to_pylist(), float)
        sides = []
        of_kind = {k: sorted(np.flatnonzero(kind == k).tolist(), key=lambda i: bucket[i]) for k in (WORDS, PAIRS_OF)}
        for name, total in zip(("__target", "__background"), totals):
            column = table.column(name)
            counts = [np.concatenate([np.empty(0, np.int64), *(unpacked(column[i].as_py(), np.int64) for i in own)]) for own in of_kind.values()]
            sides.append(log_model(*counts, total, n_words))
        keys = np.concatenate([np.empty(0, np.uint64), *(unpacked_keys(table.column("__keys")[i].as_py()) for i in of_kind[WORDS])])
        docs_of = table.take(pa.array(np.flatnonzero(kind == DOCUMENT)))
        places = [unpacked(w.as_py(), np.int32) for w in docs_of.column("__keys")]
        size = np.array([len(w) for w in places], np.int64)
        # sorted, these are the pairs in the order in which they were asked for
        pairs = np.unique(pair_keys(keys[np.concatenate([np.empty(0, np.int32), *places])], size), return_inverse=True)[1]
        made: list[list] = [[], [], [], []]
        for words, end in zip(places, np.cumsum(size)):
            a, b = (float(losses(m, words, pairs[end - len(words) : end]).mean()) if len(words) else 0.0 for m in sides)
            for into, v in zip(made, (len(words), a, b, b - a)):
                into.append(v)
        return pa.Table.from_arrays([docs_of.column(c) for c in range(n)] + [pa.array(v, t) for v, t in zip(made, kinds[n:])], names=out.fieldNames())

    none = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in carry]
    replies = answers.where(F.col("__chunk").isNotNull()).select(*none, *ASK_COLUMNS[:3], "__keys", "__target", "__background")
    return rows.unionByName(replies).groupBy("__chunk").applyInArrow(run, out)
