"""Readers and writers of the line formats: intervals, variants, reads, gene models, references, mappings, tables.

Every reader keeps the place of a record (rec_idx), as order is data in these formats. Several files read at once come
in the order of their folders, of the numbers of Spark's part files and of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BED = "chrom string, start long, end long, columns array<string>"


def _placed(raw: DataFrame, name: str = "rec_idx") -> DataFrame:
    """Rows as read from files, with their place: the number of the split in the files' order above the number within the scan's task.

    A scan starts with the largest splits, so of several files the splits are ranked by a table with one row for each.
    """
    from pyspark.sql import Window as W

    number = F.monotonically_increasing_id()
    if len(raw.inputFiles()) < 2:
        return raw.select("*", number.alias(name))
    each = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), number.alias("__n"))
    folder, part = F.regexp_replace("__file", "[^/]*$", ""), F.regexp_extract("__file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    rank = F.row_number().over(W.orderBy(folder, part, "__file", "__at")) - 1
    splits = each.select("__file", "__at").distinct().withColumn("__split", rank.cast("long"))
    place = F.shiftleft("__split", 33) + F.col("__n").bitwiseAND((1 << 33) - 1)
    return each.join(F.broadcast(splits), ["__file", "__at"]).select(*[F.col(f"`{c}`") for c in raw.columns], place.alias(name))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """rec_idx and line of text files (any codec that Spark knows by the name's ending), in order within and between files.

    rec_idx orders the lines; it counts bytes' order, not lines: use numbered() where it must be gapless.
    """
    return _placed(spark.read.text(path)).select("rec_idx", F.regexp_replace("value", "\r$", "").alias("line"))


def numbered(df: DataFrame, order: str = "rec_idx") -> DataFrame:
    """Make the order column gapless from 0, by counts per split (one small row each) and ranks within."""
    from pyspark.sql import Window as W

    part, within = F.shiftright(order, 33), F.col(order).bitwiseAND((1 << 33) - 1)
    before = df.groupBy(part.alias("part")).agg(F.count("*").alias("count"), F.min(within).alias("first")).withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    placed = df.withColumn("part", part).join(F.broadcast(before.select("part", (F.coalesce("before", F.lit(0)) - F.col("first")).alias("before"))), "part")
    return placed.withColumn(order, F.col("before") + F.col(order).bitwiseAND((1 << 33) - 1)).drop("part", "before")


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start, end and the other columns; # lines are skipped; too few or non-numeric fields are an error."""
    parts = F.split("line", "\t")
    rows = lines(spark, path).where(~F.col("line").startswith("#")).withColumn("p", parts)
    ok = F.when(F.size("p") < 3, F.raise_error(F.concat(F.lit("fewer than three fields: "), F.col("line")))).otherwise(F.col("p"))
    rows = rows.withColumn("p", ok)
    return rows.select("rec_idx", F.col("p")[0].alias("chrom"), F.col("p")[1].cast("long").alias("start"), F.col("p")[2].cast("long").alias("end"), F.slice("p", F.lit(4), F.greatest(F.size("p") - 3, F.lit(0))).alias("columns"))


def write_bed(df: DataFrame, path: str) -> None:
    extra = F.col("columns") if "columns" in df.columns else F.array().cast("array<string>")
    order = ["rec_idx"] if "rec_idx" in df.columns else ["chrom", "start", "end"]
    df.orderBy(*order).select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), extra).alias("value")).write.mode("overwrite").text(path)


def vcf_header(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Header lines and sample names: only the lines that start with # travel to the driver."""
    head = [r["line"] for r in lines(spark, path).where(F.col("line").startswith("#")).orderBy("rec_idx").collect()]
    names = next((x for x in head if x.startswith("#CHROM")), None)
    if names is None:
        raise ValueError("the header has no #CHROM line")
    return head, names.split("\t")[9:]


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant records: id, alt, filter as arrays (a lone . is empty), info as (key, values), genotypes by sample and field."""
    p = F.split("line", "\t")
    listed = lambda c, sep: F.when(c == ".", F.array().cast("array<string>")).otherwise(F.split(c, sep))
    entry = lambda e: F.struct(F.substring_index(e, "=", 1).alias("key"), F.when(F.instr(e, "=") > 0, F.split(F.substring(e, F.instr(e, "=") + 1, F.length(e)), ",")).otherwise(F.array().cast("array<string>")).alias("values"))
    rows = lines(spark, path).where(~F.col("line").startswith("#") & (F.col("line") != "")).withColumn("p", p)
    at = lambda i: F.col("p")[i]
    return rows.select(
        "rec_idx", at(0).alias("chrom"), at(1).cast("long").alias("pos"), listed(at(2), ";").alias("id"), at(3).alias("ref"), listed(at(4), ",").alias("alt"), at(5).alias("qual_raw"), listed(at(6), ";").alias("filter"),
        F.transform(listed(at(7), ";"), entry).alias("info"), F.split(F.coalesce(F.get("p", F.lit(8)), F.lit("")), ":").alias("format"),
        F.transform(F.slice("p", F.lit(10), F.greatest(F.size("p") - 9, F.lit(0))), lambda g: F.split(g, ":")).alias("genotypes"),
    )


def write_vcf(df: DataFrame, header: list[str], path: str) -> None:
    """One ordered text output: the header, then the records by rec_idx."""
    joined = lambda c, sep: F.when(F.size(c) == 0, ".").otherwise(F.array_join(c, sep))
    info = F.transform("info", lambda e: F.when(F.size(e["values"]) == 0, e["key"]).otherwise(F.concat(e["key"], F.lit("="), F.array_join(e["values"], ","))))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), joined(F.col("id"), ";"), "ref", joined(F.col("alt"), ","), "qual_raw", joined(F.col("filter"), ";"), joined(info, ";"), F.array_join("format", ":"), F.transform("genotypes", lambda g: F.array_join(g, ":")))
    head = df.sparkSession.createDataFrame([(i - len(header), x) for i, x in enumerate(header)], "rec_idx long, value string")
    head.unionByName(df.select("rec_idx", line.alias("value"))).orderBy("rec_idx").select("value").write.mode("overwrite").text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Aligned reads of a SAM text; pos and pnext 0-based."""
    p = F.split("line", "\t")
    rows = lines(spark, path).where(~F.col("line").rlike("^@[A-Z]{2}\t")).withColumn("p", p)
    at = lambda i: F.col("p")[i]
    return rows.select("rec_idx", at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("rname"), (at(3).cast("long") - 1).alias("pos"), at(4).cast("int").alias("mapq"), at(5).alias("cigar"), at(6).alias("rnext"), (at(7).cast("long") - 1).alias("pnext"), at(8).cast("long").alias("tlen"), at(9).alias("seq"), at(10).alias("qual"), F.slice("p", F.lit(12), F.greatest(F.size("p") - 11, F.lit(0))).alias("tags"))


def write_sam(df: DataFrame, header: list[str], path: str) -> None:
    text = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", "rnext", (F.col("pnext") + 1).cast("string"), F.col("tlen").cast("string"), "seq", "qual", "tags")
    head = df.sparkSession.createDataFrame([(i - len(header), x) for i, x in enumerate(header)], "rec_idx long, value string")
    head.unionByName(df.select("rec_idx", text.alias("value"))).orderBy("rec_idx").select("value").write.mode("overwrite").text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a FASTQ file: rec_idx from 0, name, seq, qual; a record without @ or + is an error."""
    each = numbered(lines(spark, path))
    grouped = each.groupBy(F.floor(F.col("rec_idx") / 4).alias("rec_idx")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("rec_idx").alias("i"), "line"))), lambda x: x["line"]).alias("l"))
    ok = (F.size("l") == 4) & F.col("l")[0].startswith("@") & F.get("l", F.lit(2)).startswith("+")
    checked = grouped.withColumn("l", F.when(F.coalesce(ok, F.lit(False)), F.col("l")).otherwise(F.raise_error(F.concat(F.lit("broken record "), F.col("rec_idx").cast("string")))))
    return checked.select("rec_idx", F.substring(F.col("l")[0], 2, 1 << 30).alias("name"), F.col("l")[1].alias("seq"), F.col("l")[3].alias("qual"))


def write_fastq(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    record = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    rows = df.orderBy(*partition_by, "rec_idx").select(record.alias("value"), *partition_by)
    (rows.write.mode("overwrite").partitionBy(*partition_by) if partition_by else rows.write.mode("overwrite")).text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name and seq of each contig, for files below 2 GB, as a contig is one row; others go by read_fasta_pieces()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                names, parts = [], []
                for line in content.decode().splitlines():
                    if line.startswith(">"):
                        names.append(line[1:].split()[0])
                        parts.append([])
                    elif names:
                        parts[-1].append(line.strip())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(["".join(x) for x in parts], pa.string())], ["name", "seq"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, seq string")


def read_fasta_pieces(spark: SparkSession, path: str) -> DataFrame:
    """name, at (0-based) and seq of each sequence line: a contig of any length, spread over the file's splits.

    Names are carried over and lengths summed up within a split; from the splits before come one row for each and the
    contigs that they hold.
    """
    from pyspark.sql import Window as W

    named = F.when(F.col("line").startswith(">"), F.regexp_extract("line", r"^>\s*(\S*)", 1))
    rows = lines(spark, path).select("rec_idx", F.shiftright("rec_idx", 33).alias("part"), named.alias("head"), F.trim("line").alias("seq"))
    heads = rows.groupBy("part").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("rec_idx"))).alias("last"))
    carried = heads.select("part", F.last("last", True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    inside = W.partitionBy("part").orderBy("rec_idx").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.join(F.broadcast(carried), "part").withColumn("name", F.coalesce(F.last("head", True).over(inside), "carried"))
    placed = placed.where("head IS NULL AND name IS NOT NULL AND seq <> ''")
    size = F.octet_length("seq")
    sums = placed.groupBy("part", "name").agg(F.sum(size).alias("n"))
    before = sums.select("part", "name", F.coalesce(F.sum("n").over(W.partitionBy("name").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum(size).over(W.partitionBy("part", "name").orderBy("rec_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    met = placed.withColumn("within", within).join(F.broadcast(before), ["part", "name"])  # a row for each split and contig in it
    return met.select("name", (F.col("before") + F.col("within")).alias("at"), "seq")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases int, line_width int")


def whole_contigs(fai: DataFrame) -> DataFrame:
    """The intervals of all contigs of an index."""
    return fai.select(F.col("name").alias("chrom"), F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))


def read_refgene(spark: SparkSession, path: str) -> DataFrame:
    """Gene models of 16 columns; the exons become an array of (start, end)."""
    schema = "bin int, tx_id string, chrom string, strand string, tx_start long, tx_end long, cds_lo long, cds_hi long, exon_count long, starts string, ends string, score long, gene string, cds_start_stat string, cds_end_stat string, frames string"
    raw = spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST", quote="")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    coding = F.col("cds_lo") < F.col("cds_hi")
    return _placed(raw).select("rec_idx", "tx_id", "chrom", "strand", "tx_start", "tx_end", F.when(coding, F.col("cds_lo")).alias("cds_start"), F.when(coding, F.col("cds_hi")).alias("cds_end"), F.zip_with(numbers("starts"), numbers("ends"), lambda s, e: F.struct(s.alias("start"), e.alias("end"))).alias("exons"), "gene", "cds_start_stat", "cds_end_stat")


def read_mapping(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """from, to of a two-column file (.csv with quotes, else tabs without)."""
    quoted = path.endswith(".csv")
    raw = spark.read.csv(path, sep="," if quoted else "\t", quote='"' if quoted else "", header=header)
    first, second = (F.col(f"`{c}`") for c in raw.columns[:2])
    return _placed(raw.select(first.alias("from"), second.alias("to")), "ord")


def last_of_each(mapping: DataFrame) -> dict[str, str]:
    """A mapping (from, to, ord) as a dictionary on the driver; of a repeated key the last row counts."""
    kept = mapping.groupBy("from").agg(F.max_by("to", "ord").alias("to"))
    return {r["from"]: r["to"] for r in kept.collect()}


def read_categories(spark: SparkSession, path: str, ids: list[str], categories: list[str]) -> DataFrame:
    """sample and category, distinct: every pair of the named id and category columns of each row of a table with a header."""
    raw = spark.read.csv(path, sep="," if path.endswith(".csv") else "\t", header=True)
    given = lambda names: F.array(*[F.col(f"`{c}`") for c in names if c in raw.columns]).cast("array<string>")
    return raw.select(F.explode(given(ids)).alias("sample"), given(categories).alias("c")).select("sample", F.explode("c").alias("category")).where("sample IS NOT NULL AND category IS NOT NULL").distinct()


def read_list(spark: SparkSession, path: str) -> list[str]:
    """A file of one id a line, blank lines left out, as a list on the driver."""
    return [r["line"] for r in lines(spark, path).select("rec_idx", F.trim("line").alias("line")).where("line <> ''").orderBy("rec_idx").collect()]


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """rec_idx and fields of each line, split at tabs; nothing is unquoted."""
    return lines(spark, path).select("rec_idx", F.split("line", "\t").alias("fields"))


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None, header: bool = True) -> None:
    """Texts joined by tabs, nothing quoted, the header first; null is empty."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    sorted_ = df.orderBy(*order) if order else df
    body = sorted_.select(F.monotonically_increasing_id().alias("i"), F.concat_ws("\t", *columns).alias("value"))
    head = df.sparkSession.createDataFrame([(-1, "\t".join(df.columns))] if header else [], "i long, value string")
    head.unionByName(body).orderBy("i").select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Comma-separated, quoted only where needed, null and empty as nothing; each part file has the header."""
    texts = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    (texts.orderBy(*order) if order else texts).write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"', emptyValue="", nullValue="")


def concatenate(spark: SparkSession, paths: list[str], out: str, codec: str = "none") -> None:
    """The lines of files of any codec one after the other, in the files' order, as one ordered output."""
    each = [lines(spark, p).select(F.lit(i).alias("file"), "rec_idx", F.col("line").alias("value")) for i, p in enumerate(paths)]
    joined = each[0]
    for more in each[1:]:
        joined = joined.unionByName(more)
    joined.orderBy("file", "rec_idx").select("value").write.mode("overwrite").option("compression", codec).text(out)


def absolute(path: str) -> str:
    """The path without links and steps back."""
    import os

    return os.path.realpath(path)


def counted(df: DataFrame, name: str = "rows"):
    """df and an observation that holds the number of its rows once it was written."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def hash_lines(hashes: DataFrame, kind: str = "sha256") -> DataFrame:
    """Lines of a checksum list: hash, two spaces, path."""
    return hashes.select(F.concat(F.col(kind), F.lit("  "), F.col("path")).alias("value"))


def content_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """md5, sha1, sha256 and sha512 of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"))
