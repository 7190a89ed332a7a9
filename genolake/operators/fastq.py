"""FASTQ files of two mates: check of names and order with a report, and restoring a file from shuffled reads and its report."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.readname import dnbseq_bam, dnbseq_fastq, illumina_bam, illumina_fastq
from ..functions.seq import once
from .reads import _with_before, common_index, order_breaks

#: Pairs at the start of a file from which the common index is taken.
FIRST = 5000


def _error(*parts: str | Column) -> Column:
    return F.raise_error(F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def illumina_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (rec_idx, name, name_2) with rec_idx, prefix, tile, x, y, index of both mates; what isn't a pair of Illumina names of the first one's prefix is an error."""
    first = pairs.select("rec_idx", "name").orderBy("rec_idx").limit(1).select(illumina_fastq(F.col("name")).alias("a")).collect()
    prefix = first[0]["a"]["prefix"] if first and first[0]["a"] else ""
    names = (F.col("name"), " / ", F.col("name_2"))

    def checked(p: Column) -> Column:
        a, b = p["a"], p["b"]
        same = F.lit(True)
        for part in ("tile", "x", "y", "index"):
            same = same & a[part].eqNullSafe(b[part])
        return (
            F.when(a.isNull() | b.isNull(), _error("not an Illumina name: ", *names))
            .when((a["prefix"] != prefix) | (b["prefix"] != prefix), _error("another prefix: ", *names))
            .when(~same, _error("read 2 doesn't belong to read 1: ", *names))
            .when((a["read"] != 1) | (b["read"] != 2), _error("not reads 1 and 2: ", *names))
            .otherwise(a)
        )

    # one value for both mates' names: a filter that is pushed down repeats it, and would repeat each name's part in it
    found = once(F.struct(illumina_fastq(F.col("name")).alias("a"), illumina_fastq(F.col("name_2")).alias("b")), checked)
    return pairs.select("rec_idx", found.alias("a")).select("rec_idx", "a.prefix", "a.tile", "a.x", "a.y", "a.index")


def illumina_report(pairs: DataFrame, first: int = FIRST, chunk: int = 100_000) -> DataFrame:
    """key and values of the report of a pair of files: READ_PREFIX, COMMON_INDEX (the most common one of the first pairs; ties: the least) and a row SPECIAL_INDEX
    (tile, x, y, index) for each pair with another index. A pair that doesn't come strictly after the one before by tile, y, x is an error, as in illumina_pairs()."""
    checked = illumina_pairs(pairs)
    text = lambda *c: F.array(*[F.col(x).cast("string") for x in c])
    common = common_index(checked, first)
    special = checked.join(F.broadcast(common.select(F.col("index").alias("usual"))), F.col("index") != F.col("usual"))  # one row
    breaks = order_breaks(checked, ["tile", "y", "x"], chunk=chunk, start=(0, 0, 0))
    unordered = breaks.select(_error("unexpected read order at record ", F.col("rec_idx")).cast("string").alias("key"), F.array().cast("array<string>").alias("values"), F.col("rec_idx"))
    head = checked.agg(F.min_by("prefix", "rec_idx").alias("prefix")).where("prefix IS NOT NULL").select(F.lit("READ_PREFIX").alias("key"), text("prefix").alias("values"), F.lit(-2).cast("long").alias("rec_idx"))
    usual = common.select(F.lit("COMMON_INDEX").alias("key"), text("index").alias("values"), F.lit(-1).cast("long").alias("rec_idx"))
    return head.unionByName(usual).unionByName(special.select(F.lit("SPECIAL_INDEX").alias("key"), text("tile", "x", "y", "index").alias("values"), "rec_idx")).unionByName(unordered).select("rec_idx", "key", "values")


def dnbseq_pairs(pairs: DataFrame) -> DataFrame:
    """rec_idx, prefix, group, index (a text) of both mates; what isn't a pair of DNBSeq names is an error."""
    each = pairs.select("rec_idx", "name", "name_2", dnbseq_fastq(F.col("name")).alias("a"), dnbseq_fastq(F.col("name_2")).alias("b"))
    names = (F.col("name"), " / ", F.col("name_2"))
    alike = (F.col("a.prefix") == F.col("b.prefix")) & (F.col("a.group") == F.col("b.group")) & (F.col("a.index") == F.col("b.index")) & (F.col("a.read") == 1) & (F.col("b.read") == 2)
    checked = F.when(F.col("a").isNull() | F.col("b").isNull(), _error("not a DNBSeq name: ", *names)).when(~alike, _error("read 2 doesn't belong to read 1: ", *names)).otherwise(F.col("a"))
    return each.select("rec_idx", checked.alias("a")).select("rec_idx", "a.prefix", "a.group", "a.index")


def dnbseq_report(pairs: DataFrame, chunk: int = 100_000) -> DataFrame:
    """rec_idx, key and values: PREFIX and a GROUP_ORDER row wherever the group changes (also back to an earlier one).

    Another prefix within the file is an error, and so is an index (compared as text) within a group that doesn't come
    strictly after the one before.
    """
    met = _with_before(dnbseq_pairs(pairs), F.struct("prefix", "group", "index"), "rec_idx", chunk)
    k, before = F.col("k"), F.col("before")
    same = before["group"] == k["group"]
    key = (
        F.when(before.isNotNull() & (before["prefix"] != k["prefix"]), _error("unexpected flowcell at record ", F.col("rec_idx")).cast("string"))
        .when(same & (before["index"] >= k["index"]), _error("unexpected read order at record ", F.col("rec_idx")).cast("string"))
        .when(before.isNull() | ~same, "GROUP_ORDER")
    )
    groups = met.select("rec_idx", key.alias("key"), F.array(k["group"]).alias("values")).where("key IS NOT NULL")
    head = met.agg(F.min_by(k["prefix"], "rec_idx").alias("prefix")).where("prefix IS NOT NULL").select(F.lit(-1).cast("long").alias("rec_idx"), F.lit("PREFIX").alias("key"), F.array("prefix").alias("values"))
    return head.unionByName(groups)


def report_lines(report: DataFrame, fastq: dict[str, str]) -> DataFrame:
    """value: the report's lines in order, after the files' names, type and checksums (keys as in FastqInfo) and before the result."""
    given = [(i - (1 << 40), f"{k}\t{v}") for i, (k, v) in enumerate(fastq.items())] + [(1 << 62, "VERIFY_RESULT\tOK")]
    own = report.select("rec_idx", F.concat(F.col("key"), F.lit("\t"), F.array_join("values", "\t")).alias("value"))
    return own.unionByName(report.sparkSession.createDataFrame(given, "rec_idx long, value string")).orderBy("rec_idx").select("value")


#: Keys of a report, and which of them must be there.
INFO_KEYS = ("FASTQ1", "FASTQ2", "FASTQ_TYPE", "FASTQ1_MD5", "FASTQ2_MD5")
ILLUMINA_KEYS, DNBSEQ_KEYS = ("READ_PREFIX", "COMMON_INDEX", "SPECIAL_INDEX"), ("PREFIX", "GROUP_ORDER")


@dataclass
class FastqInfo:
    """A report, read back: its single values, the special indexes by (tile, x, y) and the groups in order."""

    values: dict[str, str] = field(default_factory=dict)
    special: list[tuple[int, int, int, str]] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)


def load_info(lines: list[str], kind: str) -> FastqInfo:
    """A report's lines (kind: Illumina or DNBSeq); an unknown key, a missing one or a result other than OK is an error."""
    own = ILLUMINA_KEYS if kind == "Illumina" else DNBSEQ_KEYS
    info = FastqInfo()
    for line in lines:
        key, *rest = line.rstrip("\r\n").split("\t")
        if key == "VERIFY_RESULT":
            if rest[:1] != ["OK"]:
                raise ValueError(f"bad verify result: {line}")
        elif key not in (*INFO_KEYS, *own):
            raise ValueError(f"unknown row: {line}")
        elif key == "SPECIAL_INDEX":
            info.special.append((int(rest[0]), int(rest[1]), int(rest[2]), rest[3]))
        elif key == "GROUP_ORDER":
            info.groups.append(rest[0])
        else:
            info.values[key] = rest[0]
    needed = [k for k in (*INFO_KEYS, *own) if k not in ("FASTQ_TYPE", "SPECIAL_INDEX", "GROUP_ORDER")]
    missing = [k for k in needed if not info.values.get(k)] + ["GROUP_ORDER"] * (kind == "DNBSeq" and not info.groups)
    if missing:
        raise ValueError(f"not found in the report: {', '.join(missing)}")
    return info


def with_special_index(reads: DataFrame, special: DataFrame, common: str) -> DataFrame:
    """reads (tile, x, y) with index: that of special (tile, x, y, index; the last row of a place counts), or else the common one."""
    known = special.groupBy("tile", "x", "y").agg(F.last("index").alias("index"))
    return reads.join(known, ["tile", "x", "y"], "left").withColumn("index", F.coalesce("index", F.lit(common)))


def restore_illumina(reads: DataFrame, info: FastqInfo | None, read: str) -> DataFrame:
    """reads (name, seq, qual, in any order) as the file that the report tells of: name, seq, qual, sorted by prefix, tile, y, x, bases and qualities.

    Without a report the names end after the place. Another name or prefix is an error.
    """
    parsed = reads.select(F.when(illumina_bam(F.col("name")).isNull(), _error("read name is not illumina format: ", F.col("name"))).otherwise(illumina_bam(F.col("name"))).alias("p"), "seq", "qual")
    parsed = parsed.select("p.*", "seq", "qual")
    place = F.concat_ws(":", "prefix", "tile", "x", "y")
    if info is not None:
        prefix = info.values["READ_PREFIX"]
        parsed = parsed.withColumn("prefix", F.when(F.col("prefix") != prefix, _error("prefix is not match: ", F.col("prefix"))).otherwise(F.col("prefix")))
        special = reads.sparkSession.createDataFrame(info.special, "tile int, x int, y int, index string")
        parsed = with_special_index(parsed, special, info.values["COMMON_INDEX"])
        place = F.concat(place, F.lit(f" {read}:"), F.col("index"))
    return parsed.orderBy("prefix", "tile", "y", "x", "seq", "qual").select(place.alias("name"), "seq", "qual")


def with_group_rank(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """reads (group) with the rank of their group (groups: group, rank); a group that is not listed is an error."""
    met = reads.join(F.broadcast(groups), "group", "left")  # as many rows as a flow cell has fields
    return met.withColumn("rank", F.when(F.col("rank").isNull(), _error("group name is not found: ", F.col("group")).cast("int")).otherwise(F.col("rank")))


def restore_dnbseq(reads: DataFrame, info: FastqInfo, read: str | None) -> DataFrame:
    """reads (name, seq, qual, in any order) as the file that the report tells of: name, seq, qual, sorted by the groups' order, index, bases and qualities."""
    parsed = reads.select("name", F.when(dnbseq_bam(F.col("name")).isNull(), _error("read name is not DNBSeq format: ", F.col("name"))).otherwise(dnbseq_bam(F.col("name"))).alias("p"), "seq", "qual")
    prefix = info.values["PREFIX"]
    parsed = parsed.select(F.when(F.col("p.prefix") != prefix, _error("unknown prefix: ", F.col("name"))).otherwise(F.col("p.prefix")).alias("prefix"), "p.group", "p.index", "seq", "qual")
    order = {g: i for i, g in enumerate(info.groups)}  # the last place of a repeated group counts
    ranked = with_group_rank(parsed, reads.sparkSession.createDataFrame(list(order.items()), "group string, rank int"))
    name = F.concat("prefix", "group", "index", F.lit(f"/{read}" if read else ""))
    return ranked.orderBy("rank", "index", "seq", "qual").select(name.alias("name"), "seq", "qual")


def ordered_md5(lines: DataFrame, order: str = "rec_idx", column: str = "line") -> str:
    """md5 of all lines, each with a line end, in order: a checksum of uncompressed content, streamed partition by partition."""
    return _streamed_md5(lines.orderBy(order).select(F.concat(F.col(column), F.lit("\n")).alias("text")))


def _streamed_md5(texts: DataFrame) -> str:
    """md5 of texts (one column) in the order that they have. An md5 is one chain, so all of it passes the driver, as compressed blocks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = "".join(batch.column(0).to_pylist()).encode()
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(block, 1)], pa.binary())], ["block"])

    found = hashlib.md5(usedforsecurity=False)
    for (block,) in texts.mapInArrow(pack, "block binary").toLocalIterator(prefetchPartitions=True):
        found.update(zlib.decompress(block))
    return found.hexdigest()


def restore(spark: SparkSession, reads: DataFrame, info: FastqInfo, kind: str, read: int) -> tuple[DataFrame, bool]:
    """The restored file, and whether its checksum is the report's."""
    out = restore_illumina(reads, info, str(read)) if kind == "Illumina" else restore_dnbseq(reads, info, str(read))
    record = F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual", F.lit("\n"))
    return out, _streamed_md5(out.select(record.alias("text"))) == info.values[f"FASTQ{read}_MD5"]
