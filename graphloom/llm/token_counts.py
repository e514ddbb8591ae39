"""Exact histogram of encoded lengths, and what its suffix sums answer.

Every whole text is encoded once and only its length is kept; documents of one length become one row.
Suffix sums over the lengths then give, for every context limit, how many documents and tokens lie at or
above it, and how many tokens are left if each document is cut to the limit. A quantile is the least
length up to which that share of the documents reaches.

Null and empty texts have length 0. Repeated rows count as often as they occur; an empty table gives an
empty histogram; limits beyond the longest document cut nothing; documents of equal length (ties) are one row. Other columns are neither read nor touched.

The suffix sums are taken within bands of BAND lengths, in parallel, and over the bands' totals; so no
task gets more than BAND rows or a row for each band.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..scratch import cut
from . import common as C

#: Name of a public vocabulary file; any other is given by its path.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BAND = 256
_READY: dict = {}


def encoding(raw: bytes, pattern: str):
    import tiktoken

    if (key := (hash(raw), pattern)) not in _READY:
        _READY.clear()
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, raw.splitlines())}
        _READY[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _READY[key]


def encoded_lengths(docs: DataFrame, carry: list[str], vocabulary: str | None = None, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """Every row's `carry` columns with n_tokens (long). vocabulary: a path on the driver; tasks get its bytes."""
    with open(vocabulary or C.tokenizer_file(VOCABULARY), "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def make() -> Callable[[list[str]], dict[str, list]]:
        e = encoding(raw.value, pattern)
        return lambda texts: {"n_tokens": [len(e.encode_ordinary(t)) for t in texts]}

    return C.map_texts(docs, carry, text, make, C.struct(n_tokens=C.LONG))


def histogram(lengths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., n_tokens, n_docs: one row for each length that occurs."""
    return lengths.groupBy(*(by or []), "n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each length L as a context limit: docs_at_least, tokens_at_least, docs_total, tokens_total,
    truncated_tokens (the sum of min(length, L)) and docs_share (share of documents up to L)."""
    by = by or []
    # a row for each length; kept, since it is read twice and every text stands behind it
    hist = cut(hist).withColumn("band", F.floor(F.col("n_tokens") / BAND))
    tokens = F.col("n_docs") * F.col("n_tokens")
    bands = hist.groupBy(*by, "band").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = W.partitionBy(*by).orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    bands = bands.select(
        *by, "band",
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in "dt"],
    )
    within = W.partitionBy(*by, "band").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, 0)
    summed = hist.join(bands, [*by, "band"]).select(
        *by, "n_tokens", "n_docs",
        (F.sum("n_docs").over(within) + F.col("d_above")).alias("docs_at_least"),
        (F.sum(tokens).over(within) + F.col("t_above")).alias("tokens_at_least"),
        F.col("d_total").alias("docs_total"), F.col("t_total").alias("tokens_total"),
    )
    return summed.select(
        "*",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("docs_share"),
    )


def at_limits(sums: DataFrame, limits: list[int], by: list[str] | None = None) -> DataFrame:
    """The answers for any context limits, whether or not a document has that length.

    Between two lengths that occur, the counts are those of the longer one.
    """
    by = by or []
    wanted = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit")
    next_length = F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens")
    found = sums.select("*", wanted).where("n_tokens >= context_limit").groupBy(*by, "context_limit").agg(next_length.alias("a"))
    totals = sums.groupBy(*by).agg(F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total"))
    base = totals.where("docs_total is not null").select("*", wanted).join(found, [*by, "context_limit"], "left")
    docs, tokens = (F.coalesce(F.col(f"a.{c}"), F.lit(0)) for c in ("docs_at_least", "tokens_at_least"))
    return base.select(
        *by, "context_limit", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "docs_total", "tokens_total",
        (F.col("tokens_total") - tokens + F.col("context_limit") * docs).alias("truncated_tokens"),
    )


def quantiles(sums: DataFrame, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """The least length up to which each share of the documents reaches."""
    by = by or []
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return sums.select("*", wanted).where("docs_share >= share").groupBy(*by, "share").agg(F.min("n_tokens").alias("n_tokens"))
