"""Connected components of a growing graph.

Two tables make up the state: ids with the component that each had when it was first seen, one piece for each batch
and never rewritten; and merges, saying into which component such a component has gone by now. A batch of links is
first written in terms of the components that its ends have already; what is left is a small graph of components, whose
components are found. New ids are added, and merges are brought up to date: they have a row only for components that
were joined to another. The result after any batch is that of all links so far at once.

With a path the state outlives the driver. A batch counts once its merges are written, under a name that holds the
batch's number: what was written before and not finished is written again, and a batch that comes again is skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.components import stars
from ..scratch import Scratch

#: Pieces of the ids beyond which they are brought into one.
PIECES = 32


class IncrementalComponents:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.scratch = spark, Scratch(spark, path and path.rstrip("/"))
        self._recover()

    def _recover(self) -> None:
        """The last batch that was finished: merges-VERSION-BATCH-FIRST, with pieces FIRST to VERSION of the ids."""
        names = [n.split("-")[1:] for n in self.scratch.written() if n.startswith("merges-")]
        version, done, first = max(names, key=lambda n: int(n[0]), default=("0", "none", "1"))
        self.version, self.first = int(version), int(first)
        self.done: int | None = None if done == "none" else int(done)

    def _ids(self) -> DataFrame:
        pieces = [self.scratch.read(f"ids-{k}", "id long, component long") for k in range(self.first, self.version + 1)]
        return reduce(DataFrame.unionByName, pieces, self.spark.createDataFrame([], "id long, component long"))

    def _merges(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], "component long, to long")
        return self.scratch.read(self._name(self.version, self.done, self.first), "component long, to long")

    @staticmethod
    def _name(version: int, batch: int | None, first: int) -> str:
        return f"merges-{version}-{'none' if batch is None else batch}-{first}"

    def components(self) -> DataFrame:
        """id, component."""
        return self._ids().join(self._merges(), "component", "left").select("id", F.coalesce("to", "component").alias("component"))

    def process(self, links: DataFrame, number: int | None = None) -> None:
        """Add src and dst of a batch, which may have a number."""
        new_version, old, merges = self.version + 1, self.components(), self._merges()
        ends = links.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        batch = self.scratch.keep(ends, "batch")
        at = lambda c: old.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
        contracted = batch.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select(F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst"))
        merged = stars(contracted)
        # a component that was there is named by one of its ids; the others are ids that were never seen
        known = self._ids().select("id")
        added, moved = merged.join(known, "id", "left_anti"), merged.join(known, "id", "left_semi").where("id <> component")
        self.scratch.keep(added.select("id", "component"), f"ids-{new_version}")
        to = moved.select(F.col("id").alias("to"), F.col("component").alias("now"))
        after = merges.join(to, "to", "left").select("component", F.coalesce("now", "to").alias("to"))
        first = self.first
        after = after.unionByName(moved.select(F.col("id").alias("component"), F.col("component").alias("to")))
        number = self.done if number is None else number
        if new_version - first >= PIECES:
            # one piece again; it takes the place of this batch's, with everything merged
            whole = self._ids().unionByName(self.scratch.read(f"ids-{new_version}", "id long, component long"))
            settled = self.scratch.keep(whole.join(after, "component", "left").select("id", F.coalesce("to", "component").alias("component")), f"whole-{new_version}")
            self.scratch.keep(settled, f"ids-{new_version + 1}")
            self.scratch.drop(f"whole-{new_version}")
            new_version, first, after = new_version + 1, new_version + 1, self.spark.createDataFrame([], "component long, to long")
        self.scratch.keep(after, self._name(new_version, number, first))
        before, old_name, old_first = self.version, self._name(self.version, self.done, self.first), self.first
        self.version, self.first, self.done = new_version, first, number
        self.scratch.drop("batch")
        if before:
            self.scratch.drop(old_name)
        for k in range(old_first, first):
            self.scratch.drop(f"ids-{k}")

    def on_batch(self, links: DataFrame, batch: int) -> None:
        """For foreachBatch; a batch that comes again after a failure is not a new one."""
        if self.done is None or batch > self.done:
            self.process(links, batch)

    def run(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Follow a stream of src and dst. Give the constructor a path, kept along with the checkpoint, to go on after a restart."""
        writer = stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def reset(self) -> None:
        self.scratch.drop()
        self._recover()
