"""Interval operators: chrom, start, end, 0-based half-open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LONG_MAX = (1 << 63) - 1


def expand(df: DataFrame, before: int, after: int) -> DataFrame:
    """Move starts down (not below 0) and ends up (not above the largest long)."""
    start = F.greatest(F.col("start") - before, F.lit(0).cast("long"))
    end = F.when(F.col("end") <= LONG_MAX - after, F.col("end") + after).otherwise(LONG_MAX)
    return df.withColumns({"start": start, "end": end})


def merge(df: DataFrame, touching: bool = False, bin_size: int = 1 << 16) -> DataFrame:
    """Union of overlapping intervals; book-ended ones are joined only if touching.

    Islands are found within bins of the start, so one long chromosome is spread over tasks; what reaches over
    from earlier bins comes from a table with one row per bin.
    """
    base = df.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).withColumn("bin", F.floor(F.col("start") / bin_size))
    bins = base.groupBy("chrom", "bin").agg(F.max("end").alias("hi"))
    earlier = W.partitionBy("chrom").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    reach = bins.select("chrom", "bin", F.max("hi").over(earlier).alias("reach"))
    order = W.partitionBy("chrom", "bin").orderBy("start", "end")
    last = F.greatest(F.col("reach"), F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    gap = F.expr("last IS NULL OR start > last" if touching else "last IS NULL OR start >= last")
    marked = base.join(reach, ["chrom", "bin"]).withColumn("last", last).withColumn("mark", F.when(gap, F.col("start")))
    opened = marked.groupBy("chrom", "bin").agg(F.max("mark").alias("mark"))
    opened = opened.select("chrom", "bin", F.max("mark").over(earlier).alias("open"))
    islands = marked.withColumn("own", F.max("mark").over(order.rowsBetween(W.unboundedPreceding, 0))).join(opened, ["chrom", "bin"])
    islands = islands.select("chrom", F.coalesce("own", "open").alias("start"), "end")
    return islands.groupBy("chrom", "start").agg(F.max("end").alias("end"))


def _binned(intervals: DataFrame, bin_size: int) -> DataFrame:
    low, high = F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size)
    return intervals.where("end > start").withColumn("bin", F.explode(F.sequence(low, high)))


def points_in(points: DataFrame, intervals: DataFrame, pos: str = "pos", bin_size: int = 1 << 14, how: str = "inner") -> DataFrame:
    """Points joined with the intervals that hold them (or left_semi / left_anti): an equi-join on (chrom, bin)."""
    right = _binned(intervals, bin_size)
    keyed = points.withColumn("bin", F.floor(F.col(pos) / bin_size))
    if how != "inner":
        right = right.select(F.col("chrom").alias("c"), F.col("bin").alias("b"), F.col("start").alias("s"), F.col("end").alias("e"))
        return keyed.join(right, (keyed.chrom == right.c) & (keyed.bin == right.b) & (keyed[pos] >= right.s) & (keyed[pos] < right.e), how).drop("bin")
    return keyed.join(right, ["chrom", "bin"]).where((F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end"))).drop("bin")


def points_held(points: DataFrame, intervals: DataFrame, pos: str = "pos", bin_size: int = 1 << 12) -> DataFrame:
    """intervals with held, the number of points (chrom, pos) in each; pairs aren't made.

    What an interval holds are the points before its end less those before its start, so the points' places are counted up
    to each edge: within bins, and with a table of one row per bin for what comes before.
    """
    counted = points.where("chrom IS NOT NULL").where(F.col(pos).isNotNull()).groupBy("chrom", F.col(pos).alias("at")).agg(F.count("*").alias("n"))
    edges = intervals.where("end > start").select("chrom", F.explode(F.array("start", "end")).alias("at")).where("chrom IS NOT NULL").distinct()
    each = counted.unionByName(edges.withColumn("n", F.lit(0).cast("long"))).groupBy("chrom", "at").agg(F.sum("n").alias("n")).withColumn("bin", F.floor(F.col("at") / bin_size))
    earlier = W.partitionBy("chrom").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    before = each.groupBy("chrom", "bin").agg(F.sum("n").alias("n")).select("chrom", "bin", F.sum("n").over(earlier).alias("earlier"))
    within = F.sum("n").over(W.partitionBy("chrom", "bin").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    passed = each.withColumn("within", within).join(before, ["chrom", "bin"]).select("chrom", "at", (F.coalesce("within", F.lit(0)) + F.coalesce("earlier", F.lit(0))).alias("passed"))
    spans = intervals.where("end > start").select("chrom", "start", "end").distinct()
    spans = spans.join(passed.withColumnsRenamed({"at": "start", "passed": "low"}), ["chrom", "start"]).join(passed.withColumnsRenamed({"at": "end", "passed": "high"}), ["chrom", "end"])
    spans = spans.select("chrom", "start", "end", (F.col("high") - F.col("low")).alias("held"))
    return intervals.join(spans, ["chrom", "start", "end"], "left").withColumn("held", F.coalesce("held", F.lit(0).cast("long")))


def overlaps(left: DataFrame, right: DataFrame, bin_size: int = 1 << 14) -> DataFrame:
    """Pairs of overlapping intervals, each once: chrom, start, end, r_start, r_end and both sides' other columns."""
    a = _binned(left, bin_size)
    b = _binned(right.withColumnsRenamed({"start": "r_start", "end": "r_end"}).withColumns({"start": F.col("r_start"), "end": F.col("r_end")}), bin_size).drop("start", "end")
    met = a.join(b, ["chrom", "bin"]).where("start < r_end AND r_start < end")
    return met.where(F.floor(F.greatest("start", "r_start") / bin_size) == F.col("bin")).drop("bin")


def variant_positions(variants: DataFrame) -> DataFrame:
    """Positions (chrom, pos) that known variants (chrom, pos 0-based, ref, alt) cover.

    A deletion with a kept first base covers what follows it, an insertion the base after its anchor, others all of ref.
    """
    same = F.substring("ref", 1, 1) == F.substring("alt", 1, 1)
    gone = (F.length("alt") == 1) & (F.length("ref") > 1) & same
    added = (F.length("ref") == 1) & (F.length("alt") > 1) & same
    pos = F.col("pos").cast("long")
    covered = F.when(gone, F.sequence(pos + 1, pos + F.length("ref") - 1)).when(added, F.array(pos + 1)).otherwise(F.sequence(pos, pos + F.length("ref") - 1))
    return variants.select("chrom", F.explode(covered).alias("pos")).distinct()


def exclude_known(points: DataFrame, variants: DataFrame) -> DataFrame:
    """Points that no known variant covers."""
    return points.join(variant_positions(variants), ["chrom", "pos"], "left_anti")
