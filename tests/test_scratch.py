"""What intermediate tables leave on the disks."""

import platform
import re
import time

from pyspark.sql import functions as F

from graphloom.operators import components as K
from graphloom import scratch
from graphloom.scratch import cut


def shuffled(spark):
    """Numbers of the shuffles whose rows lie on the disks."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(k).getName() for k in range(files.size())]
    return {m[1] for n in names if (m := re.match(r"shuffle_(\d+)_", n))}


def left(spark, before):
    """What is there besides `before`, once Spark had the time to delete."""
    for _ in range(50):
        if not shuffled(spark) - before:
            break
        time.sleep(0.2)
    return shuffled(spark) - before


def test_shuffled_rows_go_once_a_table_is_cut(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffled(spark), spark.conf.get(key, None)
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    kept = cut(counted.join(spark.range(10).withColumnRenamed("id", "k").repartition(3, "k"), "k"))
    assert not left(spark, before) and spark.conf.get(key, None) == was
    assert sorted(map(tuple, kept.collect())) == [(k, 100) for k in range(10)]


def test_rounds_of_components_leave_no_shuffled_rows(spark):
    before = shuffled(spark)
    found = K.stars(spark.range(50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert not left(spark, before)
    assert found.count() == 51 and found.where("component <> 0").isEmpty()


def test_rounds_of_components_collect_only_where_the_heap_has_grown(spark, monkeypatch):
    """A collection in each short round makes the JVM take more heap."""
    links = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    asked = []
    monkeypatch.setattr(scratch.gc, "collect", lambda: asked.append(1))
    for share, collects in ((1.0, False), (0.0, True)):
        monkeypatch.setattr(scratch, "GROWN", share)
        asked.clear()
        assert K.stars(links).where("component <> 0").isEmpty()
        assert bool(asked) == collects
    asked.clear()
    monkeypatch.setattr(scratch, "GROWN", 1.0)
    scratch.tidy(spark)
    assert asked


def test_tidy_gives_freed_memory_back_to_the_system(spark, monkeypatch):
    """After a collection; where the JVM can't, nothing is raised."""
    asked, plain = [], scratch.trim
    monkeypatch.setattr(scratch, "trim", lambda s: asked.append(plain(s)))
    scratch.tidy(spark)
    assert len(asked) == 1 and isinstance(asked[0], bool)
    version = spark.sparkContext._jvm.java.lang.Runtime.version()
    if (version.feature(), version.update()) >= (17, 9) and "glibc" in platform.libc_ver():
        assert asked[0]
