"""Header lines of aligned reads: read groups, the aligner's command lines, and the rewrites of commands."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The command lines of the two aligners, whose last words are the FASTQ files.
ALIGNERS = tuple(
    re.compile(rf"^@PG\tID:{tool}.*CL:(?P<cmd>.*{tool} mem.*-R\s(@RG[^\s]+ID:(?P<rg>[^\s\\]+)[^\s]+)(\s.+)?\s(?P<fastq1>[^\s]+)(\s+(?P<fastq2>[^\s]+))\s*)$")
    for tool in ("bwa", "bwa-mem2")
)
READ_GROUP_COLUMNS = ("id", "sample", "platform_unit", "fastq1", "fastq2", "cmd")


def _field(line: str, key: str) -> str | None:
    return next((x[len(key) + 1 :] for x in line.split("\t") if x.startswith(key + ":")), None)


def programs(header: list[str]) -> list[dict[str, str]]:
    """rg, fastq1, fastq2 and cmd of each aligner's line, the first pattern that fits."""
    found = (next((m for p in ALIGNERS if (m := p.match(x))), None) for x in header if x.startswith("@PG"))
    return [m.groupdict() for m in found if m]


def read_groups(header: list[str]) -> list[dict[str, str]]:
    """id, sample, platform_unit of each @RG line, with fastq1, fastq2 and cmd of the last aligner's line that names it; what is missing is empty."""
    by_group = {p["rg"]: p for p in programs(header)}
    out = []
    for line in header:
        if line.startswith("@RG"):
            name = _field(line, "ID")
            if name is None:
                raise ValueError("a read group without ID")
            ran = by_group.get(name, {})
            out.append({"id": name, "sample": _field(line, "SM") or "", "platform_unit": _field(line, "PU") or "", **{k: ran.get(k) or "" for k in ("fastq1", "fastq2", "cmd")}})
    return out


def read_group_table(spark: SparkSession, header: list[str], first_reads: DataFrame, path: str = "") -> DataFrame:
    """One row per read group of the header: path, id, sample, platform_unit, read_type, read_prefix, fastq1, fastq2, cmd.

    first_reads (rg, first_qname): the name of each group's first read, of which type and prefix are taken; a group
    without reads has empty ones, a name of neither kind the type UNKNOWN.
    """
    from ..functions.readname import dnbseq_bam, illumina_bam

    groups = spark.createDataFrame([tuple(g[c] for c in READ_GROUP_COLUMNS) for g in read_groups(header)], ", ".join(f"{c} string" for c in READ_GROUP_COLUMNS))
    name = F.col("first_qname").cast("string")
    one, other = illumina_bam(name), dnbseq_bam(name)
    kind = F.when(name.isNull(), "").when(one.isNotNull(), "ILLUMINA").when(other.isNotNull(), "DNBSEQ").otherwise("UNKNOWN")
    met = groups.join(first_reads.select(F.col("rg").alias("id"), "first_qname"), "id", "left")
    return met.select(F.lit(path).alias("path"), "id", "sample", "platform_unit", kind.alias("read_type"), F.coalesce(one["prefix"], other["prefix"], F.lit("")).alias("read_prefix"), "fastq1", "fastq2", "cmd")


def read_group_id(read_group: str) -> str:
    """The ID of a @RG line."""
    found = re.search(r"\bID:([^\s]+)\b", read_group)
    if not found:
        raise ValueError("no ID in the read group")
    return found[1]


def unified(header: list[str], read_group: str, program: str) -> list[str]:
    """Header of a union of files: version, the first file's sequences (UR: cut to the file's name), the one read group, a program line."""
    sequences = [re.sub(r"\tUR:.*/([^\t]*)", r"\tUR:/\1", x) for x in header if x.startswith("@SQ")]
    return ["@HD\tVN:1.6", *sequences, read_group, f"@PG\tID:{program}\tPN:{program}\tDS:concatenate bam files and unify read group."]


def unsorted(header: list[str]) -> list[str]:
    """Header of reads that are no longer sorted."""
    return ["\t".join("SO:unsorted" if f.startswith("SO:") else f for f in x.split("\t")) if x.startswith("@HD") else x for x in header if x]


def with_comment(header: list[str], comment: str) -> list[str]:
    return [*header, f"@CO\t{comment}"]
