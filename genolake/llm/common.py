"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    while any(name.lower() in (c.lower() for c in df.columns) for df in tables):
        name += "_"
    return name


#: What this worker process keeps from task to task: that of one operator only, so stages don't add up.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What make() gave for the key in this process; anything kept for another key is let go."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


_OWNER: list[str] = []


def taken_over(owner: str) -> None:
    """A task of this module begins in this process: what another module's tasks keep is let go, even if this one keeps nothing."""
    if _OWNER != [owner]:
        _KEPT.clear()
        _OWNER[:] = [owner]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives freed memory back to the system, as a process outlives its tasks.

    Arrays of a megabyte or more are mapped one by one, so they leave no gaps behind (where the C library has that switch).
    """

    owner = run.__module__

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())
        taken_over(owner)
        yield from run(batches)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="genolake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Spark's switch by which a query's shuffle files go when it has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage; the rows go to the shared folder, so they outlive an executor, and the shuffles behind them go.

    Else these would stay on disk until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        return df.select("*").checkpoint()  # a query of its own, as df itself may run again
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def splitters(df: DataFrame, col: str, buckets: int) -> list[int]:
    """At most buckets - 1 ascending values of the long column that cut its rows into ranges of like size.

    They are approximate quantiles of all rows. The list grows with the buckets asked for, 8 bytes for each.
    """
    if buckets < 2:
        return []
    cuts = F.expr("array(" + ",".join(f"{i / buckets!r}D" for i in range(1, buckets)) + ")")
    row = df.agg(F.percentile_approx(col, cuts, F.lit(max(20_000, 8 * buckets))).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"bigint('{x}')" for x in values) + ")")


def range_of(col: Column, cuts: list[int]) -> Column:
    """Number of splitters at or below the value, so ranges count from 0; null goes to range 0.

    The splitters are a constant of the plan, searched in two steps of about the square root of their number.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    fine = F.expr("array(" + ",".join("array(" + ",".join(f"bigint('{x}')" for x in cuts[i : i + step]) + ")" for i in range(0, len(cuts), step)) + ")")
    coarse = F.size(F.filter(_longs(cuts[::step]), lambda s: s <= col))
    within = F.size(F.filter(F.element_at(fine, F.greatest(coarse, F.lit(1))), lambda s: s <= col))
    return F.when(col.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + within)


def held_out(doc_id: Column) -> Column:
    """Rows of which no label may be learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns a, b (long). Returns node, component: for each node the least node that it reaches.
    Each round takes the least label around a node, then jumps along the labels; rounds are few, as the
    jumps double the reach. Lineage is cut in each round by a checkpoint in the shared folder.
    """
    both = checkpoint(edges.where("a <> b").selectExpr("inline(array(struct(a, b), struct(b AS a, a AS b)))").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        around = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lowered = labels.join(around, "node").select("node", "component", F.least("component", "near").alias("low"))
        target = labels.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        after = checkpoint(lowered.join(target, "low", "left").select("node", F.col("component").alias("was"), F.least("low", F.coalesce("jump", "low")).alias("component")))
        if not after.where("was <> component").limit(1).count():
            return after.select("node", "component")
        labels = after.select("node", "component")


def local_path(uri: str) -> str:
    return uri[len("file://") :] if uri.startswith("file://") else uri[len("file:") :] if uri.startswith("file:") else uri


def filesystem(uri: str):
    """pyarrow file system and path of a folder that executors share (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(local_path(uri))
    return fs.FileSystem.from_uri(uri)
