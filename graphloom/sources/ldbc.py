"""Graphs from a directory of social-network benchmark files (separated by |, with header).

Entities have string keys, type and raw id, which get dense ids in key order. Entities of the node files have
a label from a column; those that only relations name have their type as label. A relation's name labels its
edges. Of a pair of entities with several relations the greatest name stays (a pair has one edge).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import numbered
from ..graph import PropertyGraph
from ..scratch import cut

SEPARATOR = "|"
#: Node files as (type, column of the id, column of the label); relation files as
#: (start type, relation, target type), ids in columns 0 and 1.
NODE_FILES = [("organisation", 0, 1), ("place", 0, 3)]
RELATIONS = [
    ("comment", "hasCreator", "person"), ("comment", "hasTag", "tag"), ("comment", "isLocatedIn", "place"), ("comment", "replyOf", "comment"),
    ("comment", "replyOf", "post"), ("forum", "containerOf", "post"), ("forum", "hasMember", "person"), ("forum", "hasModerator", "person"),
    ("forum", "hasTag", "tag"), ("organisation", "isLocatedIn", "place"), ("person", "hasInterest", "tag"), ("person", "isLocatedIn", "place"),
    ("person", "knows", "person"), ("person", "likes", "comment"), ("person", "likes", "post"), ("person", "studyAt", "organisation"),
    ("person", "workAt", "organisation"), ("place", "isPartOf", "place"), ("post", "hasCreator", "person"), ("post", "hasTag", "tag"),
    ("post", "isLocatedIn", "place"), ("tag", "hasType", "tagclass"), ("tagclass", "isSubclassOf", "tagclass"),
]


def file_names(spark: SparkSession, directory: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile())


def matching(names: list[str], prefix: str) -> list[str]:
    return [n for n in names if re.match(rf"{re.escape(prefix)}[_\d]*\.csv$", n)]


def _columns(spark: SparkSession, directory: str, names: list[str], places: list[int]) -> DataFrame:
    read = spark.read.option("sep", SEPARATOR).option("header", True).csv([f"{directory}/{n}" for n in names])
    plain = read.toDF(*[f"c{k}" for k in range(len(read.columns))])
    return plain.select(*[F.col(f"c{k}") if k < len(read.columns) else F.lit(None).cast("string") for k in places])


def read_ldbc_graph(spark: SparkSession, directory: str, directed: bool = True) -> PropertyGraph:
    names = file_names(spark, directory)
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    nodes, edges = [], []
    for kind, at, label in NODE_FILES:
        if found := matching(names, f"{kind}_"):
            nodes.append(_columns(spark, directory, found, [at, label]).toDF("a", "b").select(key(kind, "a").alias("key"), F.col("b").alias("label")))
    for start, relation, target in RELATIONS:
        if found := matching(names, f"{start}_{relation}_{target}_"):
            ends = key(start, "a").alias("s"), F.lit(start).alias("st"), key(target, "b").alias("t"), F.lit(target).alias("tt")
            edges.append(_columns(spark, directory, found, [0, 1]).toDF("a", "b").select(*ends, F.lit(relation).alias("label")))
    n = reduce(DataFrame.unionByName, nodes, spark.createDataFrame([], "key string, label string"))
    e = reduce(DataFrame.unionByName, edges, spark.createDataFrame([], "s string, st string, t string, tt string, label string")).where("s is not null and t is not null")
    end = lambda k, kind: F.struct(F.col(k).alias("key"), F.col(kind).alias("label"))
    ends = e.select(F.explode(F.array(end("s", "st"), end("t", "tt"))).alias("x")).select("x.*", F.lit(0).alias("known"))
    labelled = n.where("key is not null").select("key", "label", F.lit(1).alias("known")).unionByName(ends).groupBy("key").agg(F.max_by(F.struct("label"), F.struct("known", "label")).alias("x"))
    ids = cut(numbered(labelled.select("key", F.col("x.label").alias("label")), [F.col("key")], "id"))
    at = lambda c: ids.select(F.col("key").alias(c), F.col("id").alias(f"id_{c}"))
    linked = e.join(at("s"), "s").join(at("t"), "t").select(F.col("id_s").alias("src"), F.col("id_t").alias("dst"), "label")
    return PropertyGraph.of(ids.select("id", "label"), linked, directed)
