"""Sequencing-error profile: aligned reads against the reference.

A CIGAR is walked by column functions: its operations become an array with reference and read offsets. The reference is
cut into chunks with a few bases of their neighbours, and operations that meet it are cut at the same places, so reads
and reference are joined on (contig, chunk): what a read ships is its own bases, and a long contig is many keys. Each
counter is one grouped count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import bases, reverse_complement
from .intervals import exclude_known, merge, points_in, variant_positions

#: Bases of a chunk of the reference, and bases after it that it holds besides (one before).
CHUNK, FLANK = 1024, 64


def cigar_ops(cigar: Column) -> Column:
    """Array of (op, len, ref_at, seq_at): offsets are relative to the alignment's start and the read's first base."""
    raw = F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.regexp_extract(x, r"^\d+", 0).cast("int").alias("len")))
    zero = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("seq"), F.array().cast("array<struct<op:string,len:int,ref_at:int,seq_at:int>>").alias("ops"))

    def step(acc: Column, x: Column) -> Column:
        on_ref = F.when(x["op"].isin("M", "D", "N", "=", "X"), x["len"]).otherwise(0)
        on_seq = F.when(x["op"].isin("M", "I", "S", "=", "X"), x["len"]).otherwise(0)
        placed = F.struct(x["op"].alias("op"), x["len"].alias("len"), acc["ref"].alias("ref_at"), acc["seq"].alias("seq_at"))
        return F.struct((acc["ref"] + on_ref).alias("ref"), (acc["seq"] + on_seq).alias("seq"), F.concat(acc["ops"], F.array(placed)).alias("ops"))

    return F.aggregate(raw, zero, step, lambda acc: acc["ops"])


def walked(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """One row per mapped read and operation: the read's columns, op, len, pos (reference, 0-based) and seq_at."""
    kept = reads.where((F.col("rname") != "*") & (F.col("mapq") >= min_mapq))
    ops = kept.withColumn("x", F.explode(cigar_ops(F.col("cigar"))))
    return ops.select("rec_idx", "flag", F.col("rname").alias("chrom"), F.col("pos").alias("read_pos"), "seq", "x.op", "x.len", (F.col("pos") + F.col("x.ref_at")).cast("long").alias("pos"), "x.seq_at")


def reference_chunks(reference: DataFrame) -> DataFrame:
    """chrom, chunk, padded: the upper-case bases from one before the chunk to FLANK after it; N beyond the contig's ends.

    reference: name and seq, in one row per contig or in pieces with at, the 0-based place of a piece's first base.
    """
    given = reference if "at" in reference.columns else reference.withColumn("at", F.lit(0).cast("long"))
    given = given.where(F.octet_length("seq") > 0)
    size = F.octet_length("seq")
    low = F.floor(F.greatest(F.col("at") - FLANK - CHUNK + 1, F.lit(0)) / CHUNK)
    each = given.withColumn("chunk", F.explode(F.sequence(low, F.floor((F.col("at") + size) / CHUNK))))
    start = F.greatest(F.col("at"), F.col("chunk") * CHUNK - 1)
    end = F.least(F.col("at") + size, (F.col("chunk") + 1) * CHUNK + FLANK)
    each = each.where(start < end).select(F.col("name").alias("chrom"), "chunk", start.alias("from"), F.upper(bases(F.col("seq"), start - F.col("at"), end - start)).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", "part"))), lambda x: x["part"]), "")
    met = each.groupBy("chrom", "chunk").agg(joined.alias("got"), F.min("from").alias("from"))
    got = F.when(F.col("chunk") == 0, F.concat(F.lit("N"), F.col("got"))).otherwise(F.col("got"))
    return met.select("chrom", "chunk", F.rpad(got, CHUNK + FLANK + 1, "N").alias("padded"))


def _cut(ops: DataFrame) -> DataFrame:
    """Operations cut at the chunks' edges: chunk, and the piece's start and end on the reference."""
    first, last = F.floor(F.col("pos") / CHUNK), F.floor((F.col("pos") + F.col("len") - 1) / CHUNK)
    each = ops.withColumn("chunk", F.explode(F.sequence(first, last)))
    return each.withColumns({"start": F.greatest("pos", F.col("chunk") * CHUNK), "end": F.least(F.col("pos") + F.col("len"), (F.col("chunk") + 1) * CHUNK)})


def aligned_pieces(reads: DataFrame, reference: DataFrame, min_mapq: int = 20) -> DataFrame:
    """chrom, flag, start, own (read bases), near (reference bases with one on each side), a row for each aligned run in a chunk."""
    ops = walked(reads, min_mapq).where(F.col("op").isin("M", "=", "X") & (F.col("len") > 0))
    pieces = _cut(ops).select("chrom", "chunk", "flag", "start", F.upper(bases(F.col("seq"), F.col("seq_at") + F.col("start") - F.col("pos"), F.col("end") - F.col("start"))).alias("own"))
    met = pieces.join(reference_chunks(reference), ["chrom", "chunk"])
    return met.select("chrom", "flag", "start", "own", bases(F.col("padded"), F.col("start") - F.col("chunk") * CHUNK, F.octet_length("own") + 2).alias("near"))


def aligned_bases(reads: DataFrame, reference: DataFrame, min_mapq: int = 20, known: DataFrame | None = None, regions: DataFrame | None = None, mismatched: bool = False) -> DataFrame:
    """chrom, pos, flag, ref (base), triplet (reference with one base on each side, N beyond its ends), base.

    reference: name and seq, one row per contig (or pieces, as in reference_chunks()). known: variants (chrom, pos, ref, alt) at whose positions nothing counts;
    regions: intervals (chrom, start, end) outside of which nothing counts. mismatched: only the bases that differ.
    """
    pieces = aligned_pieces(reads, reference, min_mapq)
    if mismatched:
        pieces = pieces.where(bases(F.col("near"), F.lit(1), F.octet_length("own")) != F.col("own"))
    base = lambda i: bases(F.col("own"), i, 1)
    places = F.sequence(F.lit(0), F.octet_length("own") - 1)
    if mismatched:
        places = F.filter(places, lambda i: bases(F.col("near"), i + 1, 1) != base(i))
    each = pieces.select("chrom", "flag", "start", F.inline(F.transform(places, lambda i: F.struct(i.alias("i"), bases(F.col("near"), i, 3).alias("triplet"), base(i).alias("base")))))
    each = each.select("chrom", (F.col("start") + F.col("i")).alias("pos"), "flag", F.substring("triplet", 2, 1).alias("ref"), "triplet", "base")
    return gated(each, known, regions)


def gated(at: DataFrame, known: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Rows (chrom, pos) that lie in a region, if any are given, and on no known variant. Regions are merged, so a row meets few."""
    if regions is not None:
        at = points_in(at, merge(regions.where("end > start"), touching=True), how="left_semi", bin_size=CHUNK)
    return at if known is None else exclude_known(at, known)


def stranded(seq: Column) -> Column:
    """A sequence as the read saw it: turned for reverse reads."""
    return F.when(F.col("flag").bitwiseAND(16) != 0, reverse_complement(seq)).otherwise(seq)


def mismatches(bases: DataFrame) -> DataFrame:
    return bases.where("ref <> base").groupBy(stranded(F.col("ref")).alias("reference"), stranded(F.col("base")).alias("sequenced")).agg(F.count("*").alias("n"))


def mismatch_triplets(bases: DataFrame) -> DataFrame:
    seen = F.concat(F.substring("triplet", 1, 1), F.col("base"), F.substring("triplet", 3, 1))
    return bases.where("ref <> base").groupBy(stranded(F.col("triplet")).alias("reference"), stranded(seen).alias("sequenced")).agg(F.count("*").alias("n"))


def base_counts(bases: DataFrame) -> DataFrame:
    return bases.groupBy(stranded(F.col("ref")).alias("base")).agg(F.count("*").alias("n"))


def triplet_counts(bases: DataFrame) -> DataFrame:
    return bases.groupBy(stranded(F.col("triplet")).alias("triplet")).agg(F.count("*").alias("n"))


def lengths(ops: DataFrame, op: str) -> DataFrame:
    """Counts of insertions (I), deletions (D), soft (S) or hard clips (H) by length."""
    return ops.where(F.col("op") == op).groupBy(F.col("len").alias("length")).agg(F.count("*").alias("n"))


def op_counts(reads: DataFrame, kinds: tuple[str, ...], min_mapq: int = 20) -> DataFrame:
    """chrom, pos, op, len and n: operations of these kinds, counted by place, so alike alignments are walked once."""
    kept = reads.where((F.col("rname") != "*") & (F.col("mapq") >= min_mapq)).groupBy("rname", "pos", "cigar").agg(F.count("*").alias("n"))
    ops = kept.select("rname", "pos", "n", F.inline(F.filter(cigar_ops(F.col("cigar")), lambda x: x["op"].isin(*kinds))))
    return ops.groupBy(F.col("rname").alias("chrom"), (F.col("pos") + F.col("ref_at")).cast("long").alias("pos"), "op", "len").agg(F.sum("n").alias("n"))


def short_indels(reads: DataFrame, reference: DataFrame, longest: int = 3, min_mapq: int = 20) -> DataFrame:
    """op, sequence and n of short_insertions() and short_deletions(), in one pass over the reads."""
    if longest > FLANK:
        raise ValueError("longer deletions than a chunk's flank")
    short = walked(reads, min_mapq).where(F.col("op").isin("I", "D") & (F.col("len") <= longest))
    gone = lambda c: F.when(F.col("op") == "D", c)
    own = F.when(F.col("op") == "I", F.upper(bases(F.col("seq"), F.col("seq_at"), F.col("len"))))
    each = short.groupBy("op", gone(F.col("chrom")).alias("chrom"), gone(F.col("pos")).alias("pos"), gone(F.col("len")).alias("len"), F.col("flag").bitwiseAND(16).alias("flag"), own.alias("own")).agg(F.count("*").alias("n"))
    met = each.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).join(reference_chunks(reference), ["chrom", "chunk"], "left")
    seen = F.when(F.col("op") == "I", F.col("own")).otherwise(bases(F.col("padded"), F.col("pos") - F.col("chunk") * CHUNK + 1, F.col("len")))
    summed = met.groupBy("op", "flag", seen.alias("seen")).agg(F.sum("n").alias("n")).where("seen IS NOT NULL")
    return summed.groupBy("op", stranded(F.col("seen")).alias("sequence")).agg(F.sum("n").alias("n"))


def short_insertions(ops: DataFrame, longest: int = 3) -> DataFrame:
    """Counts of the inserted bases, as the read saw them, of insertions of at most longest bases."""
    short = ops.where((F.col("op") == "I") & (F.col("len") <= longest))
    return short.groupBy(stranded(F.upper(bases(F.col("seq"), F.col("seq_at"), F.col("len")))).alias("sequence")).agg(F.count("*").alias("n"))


def short_deletions(ops: DataFrame, reference: DataFrame, longest: int = 3) -> DataFrame:
    """Counts of the reference's deleted bases, as the read saw them, of deletions of at most longest bases (FLANK at most)."""
    if longest > FLANK:
        raise ValueError("longer deletions than a chunk's flank")
    short = ops.where((F.col("op") == "D") & (F.col("len") <= longest)).select("chrom", F.floor(F.col("pos") / CHUNK).alias("chunk"), "pos", "len", "flag")
    met = short.join(reference_chunks(reference), ["chrom", "chunk"])
    gone = bases(F.col("padded"), F.col("pos") - F.col("chunk") * CHUNK + 1, F.col("len"))
    return met.groupBy(stranded(gone).alias("sequence")).agg(F.count("*").alias("n"))


def totals(reads: DataFrame, min_mapq: int = 20) -> DataFrame:
    """sequenced: all bases of the mapped reads, clipped ones too; reference: the bases that their alignments span."""
    kept = reads.where((F.col("rname") != "*") & (F.col("mapq") >= min_mapq))
    span = F.aggregate(F.filter(cigar_ops(F.col("cigar")), lambda x: x["op"].isin("M", "D", "N", "=", "X")), F.lit(0).cast("long"), lambda n, x: n + x["len"])
    return kept.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).alias("sequenced"), F.coalesce(F.sum(span), F.lit(0)).alias("reference"))


def _region_masks(regions: DataFrame) -> DataFrame:
    """chrom, chunk, open: a sign for each base of a chunk that a region meets, 1 within regions."""
    each = merge(regions.where("end > start"), touching=True)
    each = each.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))))
    low = F.col("chunk") * CHUNK
    runs = each.groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct((F.greatest("start", low) - low).cast("int").alias("a"), (F.least("end", low + CHUNK) - low).cast("int").alias("b")))).alias("runs"))
    before = lambda i: F.coalesce(F.get("runs", i - 1)["b"], F.lit(0))
    shown = F.transform("runs", lambda x, i: F.concat(F.repeat(F.lit("0"), x["a"] - before(i)), F.repeat(F.lit("1"), x["b"] - x["a"])))
    return runs.select("chrom", "chunk", F.rpad(F.array_join(shown, ""), CHUNK, "0").alias("open"))


def _known_masks(known: DataFrame) -> DataFrame:
    """chrom, chunk, shut: a sign for each base of a chunk that holds a known variant, 1 where it covers."""
    each = variant_positions(known).withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    places = each.groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list((F.col("pos") - F.col("chunk") * CHUNK).cast("int"))).alias("at"))
    before = lambda i: F.coalesce(F.get("at", i - 1), F.lit(-1))
    shown = F.transform("at", lambda x, i: F.concat(F.repeat(F.lit("0"), x - before(i) - 1), F.lit("1")))
    return places.select("chrom", "chunk", F.rpad(F.array_join(shown, ""), CHUNK, "0").alias("shut"))


def _seen(reads: DataFrame, reference: DataFrame, min_mapq: int, known: DataFrame | None, regions: DataFrame | None, longest: int) -> DataFrame:
    """kind (M, I, D, S), len, flag (0 or 16), a, b and n: what the reads show at counted places, in one pass.

    M: the triplet and the base read; I and D: the bases of those of at most longest, else null. Alike pieces are counted
    before they meet the chunk's bases and its masks of regions and known variants.
    """
    aligned = F.col("op").isin("M", "=", "X")
    ops = walked(reads, min_mapq).where((aligned & (F.col("len") > 0)) | F.col("op").isin("I", "D", "S"))
    first, last = F.floor(F.col("pos") / CHUNK), F.floor((F.col("pos") + F.col("len") - 1) / CHUNK)
    each = ops.withColumn("chunk", F.explode(F.when(aligned, F.sequence(first, F.greatest(first, last))).otherwise(F.array(first))))
    start = F.when(aligned, F.greatest("pos", F.col("chunk") * CHUNK)).otherwise(F.col("pos"))
    size = F.when(aligned, F.least(F.col("pos") + F.col("len"), (F.col("chunk") + 1) * CHUNK) - start).otherwise(F.col("len"))
    own = F.when(aligned | ((F.col("op") == "I") & (F.col("len") <= longest)), F.upper(bases(F.col("seq"), F.col("seq_at") + start - F.col("pos"), size)))
    kind = F.when(aligned, "M").otherwise(F.col("op"))
    alike = each.groupBy("chrom", "chunk", kind.alias("kind"), start.alias("start"), size.cast("int").alias("len"), F.col("flag").bitwiseAND(16).alias("flag"), own.alias("own")).agg(F.count("*").alias("n"))
    met = alike.join(reference_chunks(reference), ["chrom", "chunk"], "left")
    met = met.withColumn("open", F.lit(None).cast("string")) if regions is None else met.join(_region_masks(regions), ["chrom", "chunk"])
    met = met.withColumn("shut", F.lit(None).cast("string")) if known is None else met.join(_known_masks(known), ["chrom", "chunk"], "left")
    met = met.withColumn("from", F.col("start") - F.col("chunk") * CHUNK)
    counts = lambda i: (F.col("open").isNull() | (bases(F.col("open"), i, 1) == "1")) & (F.col("shut").isNull() | (bases(F.col("shut"), i, 1) == "0"))
    shown = lambda size, a, b: F.struct(size.alias("len"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("string")
    places = F.filter(F.sequence(F.lit(0), F.octet_length("own") - 1), lambda i: counts(F.col("from") + i))
    here = F.when(F.col("padded").isNotNull(), F.transform(places, lambda i: shown(F.lit(0), bases(F.col("padded"), F.col("from") + i, 3), bases(F.col("own"), i, 1))))
    gone = F.when((F.col("kind") == "D") & (F.col("len") <= longest), bases(F.col("padded"), F.col("from") + 1, F.col("len")))
    whole = F.when(counts(F.col("from")), F.array(shown(F.col("len"), F.coalesce("own", gone), none)))
    return met.select("kind", "flag", "n", F.inline(F.when(F.col("kind") == "M", here).otherwise(whole))).groupBy("kind", "flag", "len", "a", "b").agg(F.sum("n").alias("n"))


def profile(reads: DataFrame, reference: DataFrame, min_mapq: int = 20, known: DataFrame | None = None, regions: DataFrame | None = None, longest: int = 3) -> DataFrame:
    """All counters as rows (Category, Reference, Sequenced, Count). Reads of contigs without a region count nowhere."""
    if longest > FLANK:
        raise ValueError("longer deletions than a chunk's flank")
    if regions is not None:
        reads = reads.join(F.broadcast(regions.select(F.col("chrom").alias("rname")).distinct()), "rname", "left_semi")  # contigs are few
    row = lambda name, ref, own: F.struct(F.lit(name).alias("Category"), ref.alias("Reference"), own.alias("Sequenced"))
    none, size = F.lit(""), F.col("len").cast("string")
    total = totals(reads, min_mapq).select(F.inline(F.array(*[F.struct(row(f"Total {name} Bases", none, none).alias("x"), F.col(c).alias("Count")) for name, c in (("Sequenced", "sequenced"), ("Reference", "reference"))])))
    a, b, ref = F.col("a"), F.col("b"), F.substring("a", 2, 1)
    changed = F.concat(F.substring("a", 1, 1), b, F.substring("a", 3, 1))
    exact = [row("Total Reference Base", stranded(ref), none), row("Total Reference Triplet", stranded(a), none)]
    other = [row("Mismatch", stranded(ref), stranded(b)), row("Mismatch Triplet", stranded(a), stranded(changed))]
    sized = lambda name: F.when(a.isNull(), F.array(row(f"{name} Length", none, size))).otherwise(F.array(row(f"{name} Length", none, size), row(name, none, stranded(a))))
    kind = F.col("kind")
    shown = F.when(kind == "M", F.when(ref != b, F.array(*exact, *other)).otherwise(F.array(*exact))).when(kind == "I", sized("Insertion")).when(kind == "D", sized("Deletion")).otherwise(F.array(row("Softclip Length", none, size)))
    counted = _seen(reads, reference, min_mapq, known, regions, longest).select("n", F.explode(shown).alias("x")).groupBy("x").agg(F.sum("n").alias("Count"))
    return total.unionByName(counted).select("x.*", "Count")
