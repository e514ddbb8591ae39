"""Label dictionaries: label_id (dense, from 0, in first-seen order) and label.

One table serves as hash map and as vector map. A label's id is the rank of the first place at which it was
seen; adding a label that is there changes nothing; null is no label. A dictionary may hold labels that
nothing uses (see used_labels of the graph for those in use).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import numbered


def empty(spark: SparkSession, kind: T.DataType | None = None) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField("label_id", T.LongType()), T.StructField("label", kind or T.StringType())]))


def build(items: DataFrame, label: str = "label", seen_at: str | Column = "seq") -> DataFrame:
    """Dictionary of the labels in items, by the least seen_at of each (ties by label)."""
    at = F.col(seen_at) if isinstance(seen_at, str) else seen_at
    first = items.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.min(at).alias("first"))
    return numbered(first, [F.col("first"), F.col("label")], "label_id").select("label_id", "label")


def from_values(spark: SparkSession, values: list, kind: T.DataType | None = None) -> DataFrame:
    """From a list, repeats dropped."""
    kept = list(dict.fromkeys(v for v in values if v is not None))
    return spark.createDataFrame(list(enumerate(kept)), T.StructType([T.StructField("label_id", T.LongType()), T.StructField("label", kind or T.StringType())]))


def add(dictionary: DataFrame, items: DataFrame, label: str = "label", seen_at: str = "seq") -> DataFrame:
    """The dictionary with the new labels of items behind, in first-seen order."""
    new = items.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(seen_at).alias("seq"))
    fresh = build(new.join(dictionary.select("label"), "label", "left_anti"))
    size = dictionary.agg(F.coalesce(F.max("label_id") + 1, F.lit(0)).alias("n")).first()["n"]
    return dictionary.unionByName(fresh.select((F.col("label_id") + size).alias("label_id"), "label"))


def find_index(dictionary: DataFrame, label) -> int | None:
    row = dictionary.where(F.col("label") == F.lit(label)).select("label_id").first()
    return row and row[0]


def get_item(dictionary: DataFrame, label_id: int):
    row = dictionary.where(F.col("label_id") == label_id).select("label").first()
    return row and row[0]


def contains(dictionary: DataFrame, label) -> bool:
    return find_index(dictionary, label) is not None


def items(dictionary: DataFrame) -> DataFrame:
    return dictionary.orderBy("label_id")


def size(dictionary: DataFrame) -> int:
    return dictionary.count()


def pop_item(dictionary: DataFrame) -> tuple[DataFrame, object | None]:
    """The dictionary without its last label, and that label."""
    last = dictionary.orderBy(F.desc("label_id")).first()
    return (dictionary.where(F.col("label_id") != last["label_id"]), last["label"]) if last else (dictionary, None)


def clear(dictionary: DataFrame) -> DataFrame:
    return dictionary.limit(0)


def values(dictionary: DataFrame) -> list:
    """All labels in order, as a list: the inverse of from_values. For dictionaries that fit on the driver."""
    return [r["label"] for r in dictionary.orderBy("label_id").toLocalIterator()]


def fingerprint(dictionary: DataFrame) -> DataFrame:
    """One row with a number that is equal for dictionaries with the same labels in the same order."""
    own = F.xxhash64("label_id", "label").cast("decimal(38,0)")
    return dictionary.agg(F.xxhash64(F.coalesce(F.sum(own), F.lit(0).cast("decimal(38,0)")).cast("string"), F.count("*")).alias("fingerprint"))


def encoded(df: DataFrame, dictionary: DataFrame, label: str = "label", name: str = "label_id") -> DataFrame:
    """df with the id of its label (null for no label). Dictionaries are small, but Spark decides on a broadcast by size."""
    return df.join(dictionary.select(F.col("label").alias(label), F.col("label_id").alias(name)), label, "left")
