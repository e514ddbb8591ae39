"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch, shuffles_freed, tidy
from ..shipping import ship

#: Rows and bytes that one Arrow batch holds at most (a single longer text makes a batch of its own).
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Call before Python runs on executors: bounds the batches, and sends this package along."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_texts(
    df: DataFrame,
    carry: list[str],
    text: str,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    out: T.StructType,
) -> DataFrame:
    """Rows of df as its columns `carry` and those of `out`, computed from whole texts in Python.

    make() runs once in a task and returns the function from a list of texts (null: empty) to
    columns. Only `carry` and `text` leave the scan; rows keep their partition, so nothing is shuffled.
    """
    small_batches(df.sparkSession)
    kept = [F.col(f"`{c}`") for c in carry]
    at = carry.index(text) if text in carry and df.schema[text].dataType == STRING else len(carry)
    read = df.select(*kept, *([F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(fresh(df, "read"))] if at == len(carry) else []))
    types = {f.name: _arrow(f.dataType) for f in out}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(carry))] + [pa.array(made[k], types[k]) for k in types],
                names=[*carry, *types],
            )

    return read.mapInArrow(run, T.StructType([df.schema[c] for c in carry] + list(out)))


def tokenizer_file(name: str) -> str:
    """Where the installed package of public vocabularies has a file; asked on the driver alone."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name in taken:
        name += "_"
    return name


def one_each(docs: DataFrame, printed: DataFrame, fp: str, rooted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Of each root one row of docs, the least by (doc_id, text), null ids last.

    printed: docs with the column fp; rooted: fp, least (its least doc_id), root. Only rows that hold the root's least id, or
    that have no id where no row has, are moved.
    """
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    stay = rooted.join(best, "root").where(F.col("least").eqNullSafe(F.col("best")))
    name, root = fresh(printed, "best"), fresh(printed, "root")
    stay = stay.select(F.col("fp").alias(fp), F.col("best").alias(name), F.col("root").alias(root))
    held = printed.join(stay.hint("merge"), fp).where(F.col(f"`{doc_id}`").eqNullSafe(F.col(name)))
    whole = F.struct(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in docs.columns if c != text])
    return held.groupBy(root).agg(F.min(whole).alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def settled(scratch: Scratch, df: DataFrame, name: str) -> DataFrame:
    """scratch.keep(), after which the rows that were shuffled for it go from the disks."""
    with shuffles_freed(df.sparkSession):
        held = scratch.keep(df, name)
    tidy(df.sparkSession, if_grown=True)
    return held


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LONG, STRING, DOUBLE, BOOL, INT, BINARY = (
    T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.BinaryType(),
)
