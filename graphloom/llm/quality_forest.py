"""Quality rules, and an isolation forest over their statistics.

Each whole text gets the rules' counts and a few rates made of them, once; these are written. An isolation forest
(Liu, Ting and Zhou 2008) is grown on the labelled rows: TREES trees, each splitting SUBSAMPLE rows, as the method
has it, drawn from all labelled ones; a document whose paths are short is unlike the others. The score above which a
document goes is calibrated on all labelled rows that the base rules keep, for only there the forest decides: of the
thresholds that lose at most GOOD_LOSS of the good ones, the one that catches most bad ones; if none catches any, nothing
goes but what the rules reject.

Of several documents for one id the least by rates counts when the forest is fitted. Only the rows that trees split (at
most TREES * SUBSAMPLE) come to the driver. Everything covers every row and every byte. Windows of words are compared by
64-bit hashes.

Null and empty texts have no words and fail the base rules. A label row for an id without document, or
with a null, is ignored; of several labels for one id the worst counts. Without labels the base rules
alone decide. Repeated rows each get the same result; an empty table gives an empty result. Other columns
are neither read nor touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import numbered
from ..scratch import Scratch, cut
from . import common as C
from .words import SPACES, word_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
TREES, SUBSAMPLE, GOOD_LOSS, SEED = 128, 256, 0.005, 7
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("log_words", "chars_per_word", "symbols", "dup_lines", "repeats", "digits", "capitals", "marks", "distinct_words", "words_per_line")
_POWERS = np.multiply.accumulate(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))


def repeat_words(h: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    n = len(h) - WINDOW + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key += h[k : k + n] * _POWERS[k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The rules' counts and the forest's rates."""
    raw = text.encode("utf-8", "replace")
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    h = word_hashes(raw)
    n = len(h)
    chars = int(len(raw) - of[0x80:0xC0].sum())
    word_chars = chars - int(of[list(SPACES)].sum())
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    symbols, repeats = int(of[list(SYMBOLS)].sum()), repeat_words(h)
    per = 1 / max(n, 1)
    marks = int(of[33:48].sum() + of[58:65].sum() + of[91:97].sum() + of[123:127].sum())
    rates = [
        float(np.log1p(n)), word_chars * per, symbols * per, dup / max(lines, 1), repeats * per, int(of[48:58].sum()) * per,
        int(of[65:91].sum()) * per, marks * per, len(np.unique(h)) * per ** 0.9, float(np.log1p(n / max(lines, 1))),
    ]
    return [n, word_chars, symbols, dup, repeats], rates


def draws(n: int, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> np.ndarray:
    """For each tree the numbers, out of n, of the rows that it splits."""
    rng = np.random.default_rng((seed, 1))
    return np.array([rng.choice(n, min(subsample, n), replace=False) for _ in range(trees)])


class Forest:
    """Random splits; nodes of all trees in arrays, leaves pointing at themselves."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, drawn: np.ndarray | None = None):
        """drawn: for each tree the rows of x that it splits; else they are drawn from all of x."""
        rng = np.random.default_rng(seed)
        self.feature, self.split, self.left, self.right, self.depth = [], [], [], [], []
        drawn = draws(len(x), trees, subsample, seed) if drawn is None else drawn
        size = drawn.shape[1]
        self.limit = int(np.ceil(np.log2(max(size, 2))))
        self.norm = max(self.expected(size), 1e-9)
        self.roots = [self._grow(x[own], 0, rng) for own in drawn]
        for k in ("feature", "split", "left", "right", "depth", "roots"):
            setattr(self, k, np.array(getattr(self, k)))

    @staticmethod
    def expected(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, depth: int, rng) -> int:
        at = len(self.feature)
        low, high = x.min(0), x.max(0)
        free = np.flatnonzero(high > low)
        leaf = depth >= self.limit or len(x) < 2 or not len(free)
        f = 0 if leaf else int(rng.choice(free))
        s = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
        if not leaf and s >= high[f]:  # rounding; both sides must get rows
            s = float(low[f])
        for k, v in (("feature", f), ("split", s), ("left", at), ("right", at), ("depth", depth + self.expected(len(x)))):
            getattr(self, k).append(v)
        if not leaf:
            under = x[:, f] <= s
            self.left[at] = self._grow(x[under], depth + 1, rng)
            self.right[at] = self._grow(x[~under], depth + 1, rng)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; about 0.5 for ordinary rows, higher for anomalous ones."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.limit):
            node = np.where(x[row, self.feature[node]] <= self.split[node], self.left[node], self.right[node])
        return 2.0 ** (-self.depth[node].mean(1) / self.norm)


def threshold(scores: np.ndarray, bad: np.ndarray, good_loss: float = GOOD_LOSS) -> float:
    """Rows at or above it go; infinite if no threshold catches a bad row within the bound."""
    if not bad.any() or bad.all():
        return float("inf")
    good = np.sort(scores[~bad])[::-1]
    allowed = int(np.floor(good_loss * len(good)))
    floor = good[allowed]  # the best good row that must stay
    caught = scores[bad & (scores > floor)]
    return float(caught.min()) if len(caught) else float("inf")


def _measured(docs: DataFrame, carry: list[str], text: str, counts: str, rates: str) -> DataFrame:
    def make() -> Callable[[list[str]], dict[str, list]]:
        def work(texts: list[str]) -> dict[str, list]:
            found = [statistics(t) for t in texts]
            return {counts: [a for a, _ in found], rates: [b for _, b in found]}

        return work

    return C.map_texts(docs, carry, text, make, C.struct(**{counts: T.ArrayType(C.LONG), rates: T.ArrayType(C.DOUBLE)}))


def _scored(rows: DataFrame, carry: list[str], counts: str, rates: str, model: Broadcast, out: T.StructType) -> DataFrame:
    """`carry` and, of COUNTS, base_failed, anomaly and kept, those that `out` has. model: the forest and its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, limit = model.value
        for batch in batches:
            n = batch.num_rows
            found = batch.column(len(carry)).flatten().to_numpy(zero_copy_only=False).reshape(n, len(COUNTS))
            x = batch.column(len(carry) + 1).flatten().to_numpy(zero_copy_only=False).reshape(n, len(RATES))
            made: dict[str, list] = {k: found[:, i] for i, k in enumerate(COUNTS)}
            made["anomaly"] = forest.score(x) if forest and n else np.zeros(n)
            made["base_failed"] = [base_failed(a, b) for a, b in zip(made["n_words"].tolist(), made["n_repeat_words"].tolist())]
            made["kept"] = [not f and s < limit for f, s in zip(made["base_failed"], made["anomaly"].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(carry))] + [pa.array(made[f.name]) for f in out], names=[*carry, *out.names])

    C.small_batches(rows.sparkSession)
    read = rows.select(*[F.col(f"`{c}`") for c in [*carry, counts, rates]])
    return read.mapInArrow(run, T.StructType([rows.schema[c] for c in carry] + list(out)))


def fitted(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> tuple[Forest | None, float]:
    """The forest and its threshold, from all labelled rows. measured: __id, __counts, __rates."""
    spark = measured.sparkSession
    said = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.min(quality).alias("__quality"))
    own = measured.groupBy("__id").agg(F.min(F.struct("__rates", "__counts")).alias("own"))
    rows = own.join(said, "__id").select("__id", (F.col("__quality") != 1).alias("bad"), "own.__rates", "own.__counts")
    rows = cut(numbered(rows, [F.xxhash64("__id"), F.col("__id")], "at", many=True))
    n = rows.count()
    if not n:
        return None, float("inf")
    drawn = draws(n)
    wanted, place = np.unique(drawn, return_inverse=True)
    some = spark.createDataFrame([(k,) for k in wanted.tolist()], "at long")
    x = np.array([r["__rates"] for r in sorted(rows.select("at", "__rates").join(F.broadcast(some), "at").collect())])
    forest = Forest(x, drawn=place.reshape(drawn.shape))
    model = spark.sparkContext.broadcast((forest, float("inf")))
    scored = _scored(rows, ["__id", "bad"], "__counts", "__rates", model, C.struct(base_failed=C.BOOL, anomaly=C.DOUBLE))
    return forest, threshold_of(cut(scored.where("not base_failed").select("__id", "bad", "anomaly")))


def threshold_of(scored: DataFrame, good_loss: float = GOOD_LOSS) -> float:
    """threshold() of a table of any size. scored: __id (each once), bad, anomaly."""
    bad, n = scored.agg(F.count_if("bad"), F.count("*")).first()
    if bad in (0, n):
        return float("inf")
    allowed = int(np.floor(good_loss * (n - bad)))
    good = numbered(scored.where("not bad"), [F.col("anomaly").desc(), F.col("__id")], "at", many=True)
    floor = good.where(F.col("at") == allowed).first()["anomaly"]
    caught = scored.where(F.col("bad") & (F.col("anomaly") > floor)).agg(F.min("anomaly")).first()[0]
    return float("inf") if caught is None else caught


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


def judged(docs: DataFrame, labels: DataFrame, carry: list[str], doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Every row's `carry` columns with the counts, base_failed, anomaly (the forest's score) and kept."""
    of_id, counts, rates = (C.fresh(docs, k) for k in ("id", "counts", "rates"))
    known = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text])], F.col(f"`{doc_id}`").alias(of_id))
    measured = C.settled(Scratch(docs.sparkSession), _measured(known, [*carry, of_id], text, counts, rates), "measured")
    named = measured.select(F.col(of_id).alias("__id"), F.col(counts).alias("__counts"), F.col(rates).alias("__rates"))
    model = docs.sparkSession.sparkContext.broadcast(fitted(named, labels, doc_id, quality))
    out = C.struct(**dict.fromkeys(COUNTS, C.LONG), base_failed=C.BOOL, anomaly=C.DOUBLE, kept=C.BOOL)
    return _scored(measured, carry, counts, rates, model, out)
