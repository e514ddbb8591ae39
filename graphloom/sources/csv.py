"""Graphs in CSV files: nodes (nodeId:ID, :LABEL) and edges (:START_ID, :END_ID, :TYPE).

With headers columns go by name, in any order, and others are ignored; without, by place. A row without a
readable id is skipped; a label that can't be read is null. Rows with another number of fields than the
header are skipped, unless flexible. Rows count in the order of the file, and files in the order of their names,
however Spark splits them: the last of a key wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import PropertyGraph
from ..operators.mutate import latest

#: Header names and separator names.
NODE_COLUMNS = {"id": "nodeId:ID", "label": ":LABEL"}
EDGE_COLUMNS = {"src": ":START_ID", "dst": ":END_ID", "label": ":TYPE"}
SEPARATORS = {"comma": ",", "space": " ", "tab": "\t"}


def separator(name: str) -> str:
    sep = SEPARATORS.get(name, name)
    if len(sep.encode()) != 1:
        raise ValueError(f"{name!r} is no separator")
    return sep


class CSVReader:
    def __init__(
        self, spark: SparkSession, nodes: str | None, edges: str, sep: str = ",", headers: bool = True,
        flexible: bool = False, node_label: str = "string", edge_label: str = "string",
    ):
        self.spark, self.paths, self.sep = spark, (nodes, edges), separator(sep)
        self.has_headers, self.is_flexible, self.kinds = headers, flexible, (node_label, edge_label)

    def headers(self, yes: bool) -> CSVReader:
        self.has_headers = yes
        return self

    def flexible(self, yes: bool) -> CSVReader:
        self.is_flexible = yes
        return self

    def _rows(self, path: str, columns: dict[str, str], label: str) -> DataFrame:
        names = list(columns.values())
        if self.has_headers:
            first = self.spark.read.option("sep", self.sep).csv(path).head()
            names = [str(x) for x in first] if first else names
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))] + [T.StructField("bad", T.StringType())])
        options = {"sep": self.sep, "header": self.has_headers, "enforceSchema": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
        read = self.spark.read.schema(schema).options(**options).csv(path)
        read = read.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("seq"))
        if not self.is_flexible:
            read = read.where("bad is null")
        place = {n: f"c{k}" for k, n in reversed(list(enumerate(names)))}
        found = {k: F.col(place[v]) if v in place else F.lit(None).cast("string") for k, v in columns.items()}
        keys = [k for k in columns if k != "label"]
        kept = read.select(*[found[k].try_cast("long").alias(k) for k in keys], found["label"].try_cast(label).alias("label"), "seq")
        for k in keys:
            kept = kept.where(F.col(k) >= 0)
        return kept

    def nodes(self) -> DataFrame:
        """id, label, seq (by which rows are ordered); empty without a nodes file."""
        if self.paths[0] is None:
            return self.spark.createDataFrame([], f"id long, label {self.kinds[0]}, seq long")
        return self._rows(self.paths[0], NODE_COLUMNS, self.kinds[0])

    def edges(self) -> DataFrame:
        """src, dst, label, seq."""
        return self._rows(self.paths[1], EDGE_COLUMNS, self.kinds[1])

    def read(self, directed: bool = True) -> PropertyGraph:
        return PropertyGraph.of(latest(self.nodes(), ["id"]), self.edges(), directed)


def read_csv_graph(
    spark: SparkSession, nodes: str | None, edges: str, directed: bool = True, sep: str = ",", headers: bool = True,
    flexible: bool = False, node_label: str = "string", edge_label: str = "string",
) -> PropertyGraph:
    return CSVReader(spark, nodes, edges, sep, headers, flexible, node_label, edge_label).read(directed)


def write_csv_graph(g: PropertyGraph, nodes: str, edges: str, sep: str = ",") -> None:
    """Folders of CSV files with headers; undirected edges once."""
    for df, columns, path in ((g.nodes, NODE_COLUMNS, nodes), (g.edges, EDGE_COLUMNS, edges)):
        df.select(*[F.col(k).cast("string").alias(v) for k, v in columns.items()]).write.mode("overwrite").option("header", True).option("sep", separator(sep)).csv(path)
