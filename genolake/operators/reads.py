"""Operators on sequencing reads: pairing, grouping, sampling, renaming, order checks, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.readname import in_sample, index_pair
from ..functions.seq import kmers, reverse_complement

SECONDARY = 0x100 | 0x800


def primary(df: DataFrame) -> DataFrame:
    return df.where(F.col("flag").bitwiseAND(SECONDARY) == 0)


def mate_pairs(df: DataFrame) -> DataFrame:
    """Records of a name are paired first with second, third with fourth, by rec_idx; a last odd one is dropped.

    Returns qname, rec_1, rec_2 (the record that is first in template leads if its flag says so), done (the later rec_idx).
    """
    order = W.partitionBy("qname").orderBy("rec_idx")
    n = F.row_number().over(order) - 1
    each = df.select("qname", "rec_idx", "flag", n.alias("n")).withColumn("pair", F.floor(F.col("n") / 2))
    met = each.groupBy("qname", "pair").agg(F.sort_array(F.collect_list(F.struct("rec_idx", "flag"))).alias("r")).where(F.size("r") == 2)
    first, second = F.col("r")[0], F.col("r")[1]
    lead = (second["flag"].bitwiseAND(64) != 0) & (first["flag"].bitwiseAND(64) == 0)
    return met.select("qname", F.when(lead, second["rec_idx"]).otherwise(first["rec_idx"]).alias("rec_1"), F.when(lead, first["rec_idx"]).otherwise(second["rec_idx"]).alias("rec_2"), second["rec_idx"].alias("done"))


def name_group(df: DataFrame) -> DataFrame:
    """Paired primary records, mates side by side, pairs in the order in which they were completed: adds out_idx parts (done, place)."""
    pairs = mate_pairs(primary(df))
    return pairs.select("qname", "done", F.explode(F.array(F.struct(F.col("rec_1").alias("rec_idx"), F.lit(1).alias("place")), F.struct(F.col("rec_2").alias("rec_idx"), F.lit(2).alias("place")))).alias("x")).select("qname", "done", "x.*")


def to_fastq(df: DataFrame) -> DataFrame:
    """Read as sequenced: a reverse read is turned back."""
    back = F.col("flag").bitwiseAND(16) != 0
    return df.withColumns({"seq": F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")), "qual": F.when(back, F.reverse("qual")).otherwise(F.col("qual"))})


def read_groups(df: DataFrame) -> DataFrame:
    """Per read group the name of its first read and the number of reads."""
    return df.groupBy("rg").agg(F.min_by("qname", "rec_idx").alias("first_qname"), F.count("*").alias("n_reads"))


def rename_reads(df: DataFrame) -> DataFrame:
    """Names R1, R2, ... by first appearance; mates share theirs. Ranks come from ranges of the first place, not one task."""
    firsts = df.groupBy("qname").agg(F.min("rec_idx").alias("first"))
    n = firsts.agg(F.min("first").alias("a"), F.max("first").alias("b"), F.count("*").alias("rows")).first()
    width = max(1, ((n["b"] or 0) - (n["a"] or 0)) // max(256, (n["rows"] or 0) // 1_000_000) + 1)
    ranged = firsts.withColumn("part", F.floor((F.col("first") - (n["a"] or 0)) / width))
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))  # a row for each part
    ranked = ranged.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("first")))
    named = ranked.join(F.broadcast(before), "part").select("qname", F.concat(F.lit("R"), (F.coalesce("before", F.lit(0)) + F.col("r")).cast("string")).alias("new_name"))
    return df.join(named, "qname")


def unify_read_group(frames: list[DataFrame], rg: str) -> DataFrame:
    """Union in file order; every read gets the one read group, whatever it had."""
    out = None
    for i, df in enumerate(frames):
        tagged = df.withColumns({"file_idx": F.lit(i), "tags": F.concat(F.filter("tags", lambda t: ~t.startswith("RG:")), F.array(F.lit(f"RG:Z:{rg}")))})
        out = tagged if out is None else out.unionByName(tagged)
    return out


def sample_names(df: DataFrame, rate: float, seed: int = 0, name: str = "qname") -> DataFrame:
    return df.where(in_sample(F.col(name), rate, seed))


def _with_before(df: DataFrame, value: Column, idx: str, chunk: int) -> DataFrame:
    """idx, k (the value) and before: the value of the row before, null for the first row.

    Rows are compared within chunks of the index; the last row of the nearest chunk before that has any comes from a
    table with a row per chunk, so gaps in the index hide nothing.
    """
    given = df.select(idx, value.alias("k")).withColumn("chunk", F.floor(F.col(idx) / chunk))
    lasts = given.groupBy("chunk").agg(F.max_by("k", idx).alias("last"))
    carried = lasts.select("chunk", F.lag("last").over(W.orderBy("chunk")).alias("carried"))
    inside = F.lag(F.struct("k")).over(W.partitionBy("chunk").orderBy(idx))
    met = given.withColumn("inside", inside).join(carried, "chunk")
    return met.select(idx, "k", F.when(F.col("inside").isNotNull(), F.col("inside.k")).otherwise(F.col("carried")).alias("before"))


def order_breaks(df: DataFrame, keys: list[str], idx: str = "rec_idx", chunk: int = 100_000, start: tuple | None = None) -> DataFrame:
    """Rows that don't come strictly after the row before them by the keys; the first is held against start, if given."""
    met = _with_before(df, F.struct(*keys), idx, chunk)
    before = F.col("before") if start is None else F.coalesce("before", F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for v, k in zip(start, keys)]))
    return met.where(before >= F.col("k")).select(idx, "k.*")


def group_starts(df: DataFrame, group: str, idx: str = "rec_idx", chunk: int = 100_000) -> DataFrame:
    """The order of groups: rows where the group differs from the row before; recurs tells a group that came earlier."""
    met = _with_before(df, F.struct(F.col(group)), idx, chunk)
    starts = met.where(F.col("before").isNull() | ~F.col("before")[group].eqNullSafe(F.col("k")[group])).select(idx, F.col("k")[group].alias(group))
    firsts = starts.groupBy(group).agg(F.min(idx).alias("first"))
    met = starts.join(firsts.withColumnRenamed(group, "same"), F.col(group).eqNullSafe(F.col("same")))
    return met.select(idx, group, (F.col(idx) > F.col("first")).alias("recurs"))


def index_counts(df: DataFrame, name: str = "name") -> DataFrame:
    """Counts of first, second and joint index of read names: kind, index, n."""
    pair = index_pair(F.col(name))
    each = df.select(F.explode(F.array(F.struct(F.lit("read1").alias("kind"), pair[0].alias("index")), F.struct(F.lit("read2").alias("kind"), pair[1].alias("index")), F.struct(F.lit("pair").alias("kind"), F.array_join(pair, "+").alias("index")))).alias("x"))
    return each.groupBy("x.kind", "x.index").agg(F.count("*").alias("n"))


def common_index(df: DataFrame, first: int = 5000, idx: str = "rec_idx") -> DataFrame:
    """The most common index of the first reads (ties: the least)."""
    found = df.where(F.col(idx) < first).groupBy("index").agg(F.count("*").alias("n"))
    return found.agg(F.max_by("index", F.struct("n", F.lit(0))).alias("x"), F.max("n").alias("n")).join(found, "n").groupBy("n").agg(F.min("index").alias("index"))


def kmer_counts(df: DataFrame, ks: tuple[int, ...] = (1, 2, 3), seq: str = "seq", by_position: bool = False) -> DataFrame:
    """Counts of k-mers, overall or by 0-based position; combined on the map side."""
    each = df.select(F.inline(F.concat(*[kmers(F.col(seq), k) for k in ks])))
    keys = ["pos", "kmer"] if by_position else ["kmer"]
    return each.groupBy(*keys).agg(F.count("*").alias("n"))


def zip_pairs(left: DataFrame, right: DataFrame, idx: str = "rec_idx") -> DataFrame:
    """Reads of two files in lockstep; a missing partner is an error. Nulls in other columns are values like any."""
    names = [c for c in right.columns if c != idx]
    met = left.withColumn("here", F.lit(True)).join(right.withColumnsRenamed({c: f"{c}_2" for c in names}).withColumn("there", F.lit(True)), idx, "full")
    broken = F.raise_error(F.lit("the files differ in length"))
    return met.withColumn("there", F.when(F.col("there").isNull() | F.col("here").isNull(), broken).otherwise(F.col("there"))).where("there").drop("here", "there")


def reorder(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Total order for a sink: a range-partitioned, spilling sort."""
    return df.orderBy(*keys)
