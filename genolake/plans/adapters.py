"""Genomics-shaped relations derived from the driver's tables, and the same relations in SQL for the oracles."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seq import bases


def scratch(spark: SparkSession, name: str) -> str:
    """A path for files that are written and read back: in the folder that the cluster shares, and gone at the driver's end where that is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="genolake-")
    folder = f"{shared}/files-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return f"{folder}/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task sorts or groups, so a task's memory doesn't grow with the table.
ROWS = 1 << 19


def parts(spark: SparkSession, df: DataFrame) -> int:
    """In how many parts a table's rows are put: a part for each ROWS of them, one for each core at least. A Parquet table's rows are counted in its footers."""
    return max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") * 100 + F.col("l_linenumber") * 7
    return t.select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))


INTERVALS = "iv AS (SELECT 'chr' || (l_suppkey % 22 + 1)::VARCHAR AS chrom, l_partkey * 100 + l_linenumber * 7 AS s, l_partkey * 100 + l_linenumber * 7 + l_quantity::BIGINT AS e FROM lineitem)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    return t.select(F.col("o_orderkey").alias("point"), F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string")).alias("chrom"), (F.col("o_orderkey") * 37 % 200000).alias("pos"))


POINTS = "pt AS (SELECT o_orderkey AS point, 'chr' || (o_custkey % 22 + 1)::VARCHAR AS chrom, o_orderkey * 37 % 200000 AS pos FROM orders)"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    start = F.col("p_partkey") * 613 % 200000
    return t.select(F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("string")).alias("chrom"), start.alias("start"), (start + F.col("p_size") * 20 + 1).alias("end"))


TARGETS = "tg AS (SELECT 'chr' || (p_partkey % 22 + 1)::VARCHAR AS chrom, p_partkey * 613 % 200000 AS s, p_partkey * 613 % 200000 + p_size * 20 + 1 AS e FROM part)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 3
    ref = F.when(kind == 0, "AG").when(kind == 1, "GATTA").otherwise("C")
    alt = F.when(kind == 0, "CT").when(kind == 1, "G").otherwise("CAA")
    return t.select(F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("string")).alias("chrom"), (F.col("p_partkey") * 613 % 200000).alias("pos"), ref.alias("ref"), alt.alias("alt"))


VARIANTS = "kv AS (SELECT 'chr' || (p_partkey % 22 + 1)::VARCHAR AS chrom, p_partkey * 613 % 200000 AS pos, p_partkey % 3 AS kind FROM part), kp AS (SELECT chrom, CASE kind WHEN 0 THEN pos ELSE pos + 1 END AS a, CASE kind WHEN 0 THEN pos + 1 WHEN 1 THEN pos + 4 ELSE pos + 1 END AS b FROM kv)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents")
    return t.select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


SEQUENCES = "sq AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)"


def genotypes(spark: SparkSession, sf_dir: str, by: str = "p") -> DataFrame:
    """Long: variant, n_alt, sample, gt, ad, dp; a row for each part and each customer who ordered it, in parts() by variant (p) or sample (c)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p"))
    n = parts(spark, lines)
    if n > spark.sparkContext.defaultParallelism:
        o, lines = o.repartition(n, "l_orderkey"), lines.repartition(n, "l_orderkey")
    both = lines.join(o, "l_orderkey").select("p", "c").repartition(n, by).distinct()
    c, p = F.col("c"), F.col("p")
    a, b = (c * 7 + p * 3) % 4, (c * 5 + p) % 3
    text = F.concat(F.when(a == 3, ".").otherwise(a.cast("string")), F.lit("/"), b.cast("string"))
    ad = F.array((c + p) % 30, p % 17, c % 11)
    return both.select(p.alias("variant"), (p % 2 + 1).cast("int").alias("n_alt"), c.alias("sample"), text.alias("gt"), ad.alias("ad"), (ad[0] + ad[1] + ad[2]).alias("dp"))


GENOTYPES = "gt AS MATERIALIZED (SELECT p AS variant, (p % 2 + 1)::INT AS n_alt, c AS sample, (c * 7 + p * 3) % 4 AS a, (c * 5 + p) % 3 AS b, [(c + p) % 30, p % 17, c % 11] AS ad FROM (SELECT DISTINCT l_partkey AS p, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey) z), al AS (SELECT variant, n_alt, sample, a AS v FROM gt WHERE a < 3 AND a <= n_alt UNION ALL SELECT variant, n_alt, sample, b FROM gt WHERE b <= n_alt), gf AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM gt WHERE a < 3 AND a <= n_alt AND b <= n_alt)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant records with arrays: alt, info entries, format, one sample's values, annotations."""
    t = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    alts = F.when(n % 5 == 0, F.array().cast("array<string>")).when(n % 2 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("TT")))
    info = F.array(F.struct(F.lit("DP").alias("key"), F.array(n.cast("string")).alias("values")), F.struct(F.lit("AF").alias("key"), F.array((n % 7).cast("string"), (n % 3).cast("string")).alias("values")), F.struct(F.lit("DB").alias("key"), F.array().cast("array<string>").alias("values")))
    word = F.when(F.col("p_size") % 4 == 0, "HIGH").when(F.col("p_size") % 4 == 1, "MODERATE").when(F.col("p_size") % 4 == 2, "LOW").otherwise("MODIFIER")
    ann = lambda alt, gene, tx, hgvs: F.concat_ws("|", F.lit(alt), F.lit("variant"), word, gene, F.lit("id"), F.lit("transcript"), tx, F.lit("coding"), F.lit(""), F.concat(F.lit("c."), n.cast("string")), hgvs)
    anns = F.array(ann("A", F.col("p_brand"), F.concat(F.lit("TX"), (n % 9).cast("string")), F.when(n % 3 == 0, F.concat(F.lit("p."), n.cast("string"))).otherwise("")), ann("TT", F.lit("OTHER"), F.lit("TX1"), F.lit("")), ann("A", F.lit("GENE"), F.lit("TX2"), F.lit("")))
    return t.select(n.alias("variant"), F.concat((n % 22 + 1).cast("string")).alias("chrom"), F.lit("G").alias("ref"), alts.alias("alt"), info.alias("info"), F.array(F.lit("GT"), F.lit("AD"), F.lit("DP")).alias("format"), F.array((n % 3).cast("string"), F.lit("7"), n.cast("string")).alias("sample_values"), anns.alias("ann"), word.alias("word"))


WORD = "CASE p_size % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' ELSE 'MODIFIER' END"


def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    e = F.col("event_id")
    index = F.concat(F.upper(F.substring("event_type", 1, 2)), F.lit("+"), (F.col("user_id") % 5).cast("string"))
    name = F.concat_ws(":", F.lit("A00:1:FC:1"), (1101 + F.col("user_id") % 4).cast("string"), (e % 997).cast("string"), F.concat((e * 31 % 9973).cast("string"), F.lit(" 1")), F.lit("N:0"), index)
    return t.select(e.alias("rec_idx"), name.alias("name"), index.alias("index"), (1101 + F.col("user_id") % 4).cast("int").alias("tile"), (e % 997).cast("int").alias("x"), (e * 31 % 9973).cast("int").alias("y"), "event_type")


READS = "rn AS (SELECT event_id AS rec_idx, upper(substr(event_type, 1, 2)) || '+' || (user_id % 5)::VARCHAR AS idx, (1101 + user_id % 4)::INT AS tile, (event_id % 997)::INT AS x, (event_id * 31 % 9973)::INT AS y, event_type FROM events)"


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads named by order, placed by order and line (distinct by then)."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    rec = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    flag = F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(128) + F.when(F.col("s") % 11 == 0, 256).otherwise(0)
    return t.select(F.col("l_orderkey").alias("qname"), rec.alias("rec_idx"), flag.alias("flag"), F.concat(F.lit("rg"), (F.col("s") % 6).cast("string")).alias("rg"), F.array(F.lit("NM:i:1"), F.concat(F.lit("RG:Z:rg"), (F.col("s") % 6).cast("string"))).alias("tags"))


MATES = "mt AS (SELECT l_orderkey AS qname, l_orderkey * 8 + l_linenumber AS rec_idx, CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN min(l_suppkey) % 11 = 0 THEN 256 ELSE 0 END AS flag, 'rg' || (min(l_suppkey) % 6)::VARCHAR AS rg FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript per order: an exon per line number; in parts() by order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    t = lines.repartition(parts(spark, lines), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg((F.lit(1000) * F.col("l_linenumber") + F.min("l_partkey") % 500).alias("start"), F.min("l_quantity").cast("long").alias("q"))
    exons = t.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + 50 + F.col("q")).alias("end")))).alias("exons"))
    first, last = F.col("exons")[0]["start"], F.element_at("exons", -1)["end"]
    coding = F.col("l_orderkey") % 3 != 0
    return exons.select(
        F.col("l_orderkey").alias("tx_id"), F.concat(F.lit("chr"), (F.col("l_orderkey") % 22 + 1).cast("string")).alias("chrom"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), "exons",
        first.alias("tx_start"), last.alias("tx_end"), F.when(coding, first + 10).alias("cds_start"), F.when(coding, last - 10).alias("cds_end"), F.concat(F.lit("gene"), (F.col("l_orderkey") % 101).cast("string")).alias("gene"), F.col("l_orderkey").alias("rec_idx"),
    )


TRANSCRIPTS = (
    "ex AS (SELECT l_orderkey AS tx_id, 1000 * l_linenumber + min(l_partkey) % 500 AS s, 1000 * l_linenumber + min(l_partkey) % 500 + 50 + min(l_quantity)::BIGINT AS e FROM lineitem GROUP BY l_orderkey, l_linenumber), "
    "tx AS (SELECT tx_id, 'chr' || (tx_id % 22 + 1)::VARCHAR AS chrom, tx_id % 2 = 0 AS fwd, min(s) AS ts, max(e) AS te, sum(e - s)::BIGINT AS len FROM ex GROUP BY tx_id), "
    "pre AS MATERIALIZED (SELECT ex.tx_id, s, e, fwd, coalesce(sum(e - s) OVER (PARTITION BY ex.tx_id ORDER BY CASE WHEN fwd THEN s ELSE -s END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS passed, row_number() OVER (PARTITION BY ex.tx_id ORDER BY s) AS no FROM ex JOIN tx USING (tx_id))"
)
#: Transcript position of each (tx_id, pos) row of a relation q.
PLACED = (
    "away AS (SELECT q.tx_id, q.pos, passed, fwd, e - s AS len, CASE WHEN pos < s THEN s - pos WHEN pos < e THEN 0 ELSE pos - e + 1 END AS d, CASE WHEN (pos < s) = fwd THEN passed ELSE passed + (e - s) - 1 END AS edge, (pos < s) = fwd AS before, CASE WHEN fwd THEN pos - s ELSE e - 1 - pos END AS within, no FROM q JOIN pre USING (tx_id)), "
    "near AS (SELECT *, row_number() OVER (PARTITION BY tx_id, pos ORDER BY d, no) AS r FROM away), "
    "placed AS MATERIALIZED (SELECT tx_id, pos, CASE WHEN d = 0 THEN passed + within ELSE edge END AS base, CASE WHEN d = 0 THEN 0 WHEN before THEN -d ELSE d END AS off FROM near WHERE r = 1)"
)


def places() -> Column:
    """Three genome positions of a transcript, in exons, introns and beyond the ends."""
    return F.array(F.col("tx_start") - 3, F.col("tx_start") + F.col("tx_id") % 97, F.floor((F.col("tx_start") + F.col("tx_end")) / 2))


def tx_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with a row for each of their places()."""
    return transcripts(spark, sf_dir).withColumn("pos", F.explode(places()))


POSITIONS = "q AS (SELECT tx_id, unnest([ts - 3, ts + tx_id % 97, ((ts + te) // 2)::BIGINT]) AS pos FROM tx)"


def alignments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reads of whole sequences against themselves, with every 17th base changed, and the reference."""
    seq = sequences(spark, sf_dir).where("length(seq) > 0")
    n = F.octet_length("seq")
    own = lambda i: bases(F.col("seq"), i, 1)
    changed = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 17 == F.col("doc_id") % 17, F.translate(own(i), "ACGT", "CGTA")).otherwise(own(i))), "")
    reads = seq.select(F.col("doc_id").alias("rec_idx"), F.when(F.col("doc_id") % 2 == 1, 16).otherwise(0).alias("flag"), F.col("doc_id").cast("string").alias("rname"), F.lit(0).cast("long").alias("pos"), F.lit(60).alias("mapq"), F.concat(n.cast("string"), F.lit("M")).alias("cigar"), changed.alias("seq"))
    return reads, seq.select(F.col("doc_id").cast("string").alias("name"), "seq")


ALIGNED = (
    SEQUENCES + ", bs AS (SELECT doc_id, i, substr(seq, i + 1, 1) AS r, (CASE WHEN i = 0 THEN 'N' ELSE substr(seq, i, 1) END) || substr(seq, i + 1, 1) || (CASE WHEN i + 1 = length(seq) THEN 'N' ELSE substr(seq, i + 2, 1) END) AS t, i % 17 = doc_id % 17 AS hit FROM (SELECT doc_id, seq, unnest(range(length(seq))) AS i FROM sq) z), "
    "st AS (SELECT doc_id, i, hit, r, CASE WHEN hit THEN translate(r, 'ACGT', 'CGTA') ELSE r END AS b, t FROM bs), "
    "sr AS (SELECT hit, CASE WHEN doc_id % 2 = 1 THEN translate(r, 'ACGTN', 'TGCAN') ELSE r END AS r, CASE WHEN doc_id % 2 = 1 THEN translate(b, 'ACGTN', 'TGCAN') ELSE b END AS b, CASE WHEN doc_id % 2 = 1 THEN reverse(translate(t, 'ACGTN', 'TGCAN')) ELSE t END AS t FROM st)"
)


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with insertions, deletions and clips in their CIGAR."""
    t = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    cigar = F.concat((n % 9 + 1).cast("string"), F.lit("S30M"), (n % 4 + 1).cast("string"), F.lit("I12M"), (n % 6 + 1).cast("string"), F.lit("D8M"), (n % 3 + 1).cast("string"), F.lit("H"))
    return t.select(n.alias("rec_idx"), F.lit(0).alias("flag"), F.lit("chr1").alias("rname"), (n % 5000).alias("pos"), (n % 61).cast("int").alias("mapq"), cigar.alias("cigar"), F.repeat(F.lit("A"), 80).alias("seq"))


def gapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A read per line item on a contig per supplier modulo 22 (20,000 bases that repeat ACGGT), the reference, and target regions."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    cigar = F.concat(F.lit("2S6M"), (F.col("p") % 5 + 1).cast("string"), F.lit("I4M"), (F.col("s") % 4 + 1).cast("string"), F.lit("D3M"))
    seq = F.concat(F.lit("TT"), F.repeat(F.lit("A"), 6), F.rpad(F.lit("C"), (F.col("p") % 5 + 1).cast("int"), "CAG"), F.repeat(F.lit("G"), 7))
    reads = t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rec_idx"), F.when(F.col("l_linenumber") % 2 == 0, 16).otherwise(0).alias("flag"), F.concat(F.lit("chr"), (F.col("s") % 22 + 1).cast("string")).alias("rname"), (F.col("p") * 97 % 19900 + 1).alias("pos"), F.lit(60).alias("mapq"), cigar.alias("cigar"), seq.alias("seq"))
    reference = spark.range(1, 23).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("name"), F.repeat(F.lit("ACGGT"), 4000).alias("seq"))
    regions = table(spark, sf_dir, "supplier").select(F.concat(F.lit("chr"), (F.col("s_suppkey") % 11 + 1).cast("string")).alias("chrom"), (F.col("s_suppkey") * 131 % 19000).alias("start"), (F.col("s_suppkey") * 131 % 19000 + 700).alias("end"))
    return reads, reference, regions


#: Operations of the reads above: where they stand, their length, and the bases read or deleted.
GAPPED = (
    "rd AS (SELECT l_orderkey * 8 + l_linenumber AS rec_idx, l_linenumber % 2 = 0 AS rev, 'chr' || (min(l_suppkey) % 22 + 1)::VARCHAR AS chrom, min(l_partkey) * 97 % 19900 + 1 AS pos, (min(l_partkey) % 5 + 1)::INT AS ni, (min(l_suppkey) % 4 + 1)::INT AS nd FROM lineitem GROUP BY l_orderkey, l_linenumber), "
    "rg AS (SELECT 'chr' || (s_suppkey % 11 + 1)::VARCHAR AS chrom, s_suppkey * 131 % 19000 AS s, s_suppkey * 131 % 19000 + 700 AS e FROM supplier), "
    "gi AS (SELECT ni AS n, substr('CCAGC', 1, ni) AS bases, rev, chrom, pos + 6 AS place FROM rd), "
    "gd AS (SELECT nd AS n, substr(repeat('ACGGT', 4), ((pos + 10) % 5 + 1)::INT, nd) AS bases, rev, chrom, pos + 10 AS place FROM rd)"
)


def flowcell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names of a DNBSeq file: events in order, in fields of 100, counted up within."""
    e = F.col("event_id")
    name = F.concat(F.lit("V300012L1C"), F.lpad((e / 100 % 900).cast("long").cast("string"), 3, "0"), F.lit("R"), F.lpad((F.floor(e / 100) % 7).cast("string"), 3, "0"), F.lpad(e.cast("string"), 9, "0"))
    return table(spark, sf_dir, "events").select(e.alias("rec_idx"), F.concat(name, F.lit("/1")).alias("name"), F.concat(name, F.lit("/2")).alias("name_2"))


def illumina_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names of an Illumina file in order of tile and y; a few have an index of their own."""
    e, x = F.col("event_id"), F.col("user_id") % 977
    index = F.concat(F.lit("N:0:"), F.when(e % 50 == 7, F.concat(F.lit("AA+"), F.upper(F.substring("event_type", 1, 2)))).otherwise("CC+GG"))
    place = F.concat_ws(":", F.lit("A00:1:FC:1"), (1101 + F.floor(e / 1000)).cast("string"), x.cast("string"), (e % 1000 + 1).cast("string"))
    return table(spark, sf_dir, "events").select(e.alias("rec_idx"), F.concat(place, F.lit(" 1:"), index).alias("name"), F.concat(place, F.lit(" 2:"), index).alias("name_2"))
