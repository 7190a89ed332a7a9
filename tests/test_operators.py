"""Golden values of the reference's semantics, on inline fixtures."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from genolake.functions import genotype, hgvs, readname, seq
from genolake.operators import alleles, errors, fastq, intervals, reads, sam_header, transcripts, variants, vcf_table
from genolake.plans import adapters, queries
from genolake.sources import text


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


REGIONS = [("chr1", 10, 5000), ("chr1", 7000, 10000), ("chr1", 20000, 30000), ("chr1", 30000, 50000), ("chr2", 6000, 60000), ("chr3", 10, 20), ("chr3", 13, 16), ("chr3", 15, 50), ("chr3", 40, 80), ("chr3", 21, 30)]
IV = "chrom string, start long, end long"


def test_merge(spark):
    df = spark.createDataFrame(REGIONS, IV)
    touching = [("chr1", 10, 5000), ("chr1", 7000, 10000), ("chr1", 20000, 50000), ("chr2", 6000, 60000), ("chr3", 10, 80)]
    assert rows(intervals.merge(df, touching=True)) == touching
    assert len(rows(intervals.merge(df))) == 6


def test_merge_across_bins_against_brute_force(spark):
    rng = random.Random(3)
    given = [("c", s := rng.randrange(3000), s + rng.randrange(1, 90)) for _ in range(150)]
    for touching in (False, True):
        out = []
        for _, s, e in sorted(given):
            if out and (s <= out[-1][1] if touching else s < out[-1][1]):
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        for size in (7, 64, 1 << 16):
            assert rows(intervals.merge(spark.createDataFrame(given, IV), touching, size)) == [("c", s, e) for s, e in out]


def test_expand(spark):
    df = spark.createDataFrame([("1", 100, 200), ("1", 300, 400)], IV)
    assert rows(intervals.expand(df, 10, 10))[0] == ("1", 90, 210)
    assert rows(intervals.expand(df, 200, 100)) == [("1", 0, 300), ("1", 100, 500)]
    big = spark.createDataFrame([("1", 0, (1 << 63) - 3)], IV)
    assert rows(intervals.expand(big, 1, 5)) == [("1", 0, (1 << 63) - 1)]


def test_contains_and_overlaps(spark):
    target = spark.createDataFrame([("MT", 10, 5000)], IV)
    at = spark.createDataFrame([("MT", p) for p in (9, 10, 1000, 4999, 5000, 5001)], "chrom string, pos long")
    assert rows(intervals.points_in(at, target, how="left_semi", bin_size=64), "pos") == [(10,), (1000,), (4999,)]
    other = spark.createDataFrame([("MT", 4000, 4999), ("MT", 5000, 6000)], IV)
    assert rows(intervals.overlaps(target, other, 100), "r_start", "r_end") == [(4000, 4999)]


def test_points_held_are_counted_without_pairs(spark):
    rng = random.Random(5)
    given = [(c, s := rng.randrange(-20, 300), s + rng.randrange(0, 90)) for c in "ab" for _ in range(60)] + [("c", 1, 9), (None, 1, 9)]
    at = [(c, rng.choice([None, *range(-30, 400)])) for c in ["a", "b", "d", None] for _ in range(80)]
    iv, points = spark.createDataFrame(given, IV), spark.createDataFrame(at, "chrom string, pos long")
    want = sorted((c or "", s, e, sum(x is not None and x == c and p is not None and s <= p < e for x, p in at)) for c, s, e in given)
    for size in (7, 1 << 12):
        got = intervals.points_held(points, iv, bin_size=size).collect()
        assert sorted((r["chrom"] or "", r["start"], r["end"], r["held"]) for r in got) == want
    # every point in every span: 4e8 pairs
    many, spans = spark.range(20000).selectExpr("'c' AS chrom", "id % 100 AS pos"), spark.range(20000).selectExpr("'c' AS chrom", "-id AS start", "100L AS end")
    held = intervals.points_held(many, spans)
    assert held.agg(F.sum("held")).first()[0] == sum(200 * sum(-i <= p for p in range(100)) for i in range(20000))


def test_known_variants(spark):
    v = spark.createDataFrame([("MT", 1581, "GA", "G"), ("MT", 2087, "T", "A"), ("MT", 4117, "T", "TAA")], "chrom string, pos long, ref string, alt string")
    assert rows(intervals.variant_positions(v)) == [("MT", 1582), ("MT", 2087), ("MT", 4118)]


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTNa",), ("",), ("AC",)], "s string")
    assert rows(df.select(seq.reverse_complement(F.col("s")).alias("r"))) == [("",), ("GT",), ("NNACGT",)]
    assert rows(df.select(F.size(seq.kmers(F.col("s"), 3)).alias("n"))) == [(0,), (0,), (4,)]


def test_genotypes(spark):
    order = [[0, 0], [0, 1], [1, 1], [0, 2], [1, 2], [2, 2]]
    df = spark.createDataFrame([(x,) for x in order], "g array<int>")
    assert [r[0] for r in df.select(genotype.genotype_index(F.col("g"))).collect()] == [0, 1, 2, 3, 4, 5]
    n = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "a int, p int")
    assert [r[0] for r in n.select(genotype.number_of_genotypes(F.col("a"))).collect()] == [3, 6, 10]
    fixed = spark.createDataFrame([(1 / 32,), (7 / 160,), (1 / 160,)], "v double").select(genotype.fixed(F.col("v"), 4).alias("t"))
    assert [r[0] for r in fixed.collect()] == ["0.0312", "0.0437", "0.0063"]
    gt = spark.createDataFrame([("0/1",), ("1|2",), ("./3",)], "g string").select(genotype.decode_gt(F.col("g"), F.lit("GAA"), F.array(F.lit("G"), F.lit("GAAA"))).alias("t"))
    assert [r[0] for r in gt.collect()] == ["GAA/G", "G|GAAA", "./?"]


def test_allele_counts(spark):
    given = [(1, 1, "1/1"), (1, 1, "1/1"), (2, 1, "0/0"), (2, 1, "0/1"), (3, 2, "1/2"), (3, 2, "1/2"), (4, 1, "./."), (4, 1, "x")]
    out = alleles.frequencies(alleles.counts(spark.createDataFrame(given, "v int, n_alt int, gt string"), ["v"])).orderBy("v").collect()
    assert [r["an"] for r in out] == [4, 4, 4, 0]
    assert [r["ac"] for r in out] == [[0, 4], [3, 1], [0, 2, 2], [0, 0]]
    assert [r["genotype_count"] for r in out] == [[0, 0, 2], [1, 1, 0], [0, 0, 0, 0, 2, 0], [0, 0, 0]]
    assert [r["nhomalt"] for r in out] == [[2], [0], [0, 0], [0]]
    assert out[3]["af"] is None


def _counted(gts, n_alt, ploidy):
    called = [sorted(int(a) for a in re.split("[/|]", g) if a != "." and int(a) <= n_alt) if g and re.fullmatch("[0-9.]+([|/][0-9.]+)*", g) else [] for g in gts]
    order = sorted(itertools.combinations_with_replacement(range(n_alt + 1), ploidy), key=lambda g: g[::-1])
    full = [tuple(c) for c in called if len(c) == ploidy]
    flat = [a for c in called for a in c]
    return len(flat), [flat.count(a) for a in range(n_alt + 1)], [full.count(g) for g in order], [full.count((a,) * ploidy) for a in range(1, n_alt + 1)]


@pytest.mark.parametrize("ploidy", [1, 2, 3])
def test_alike_genotypes_are_counted_at_once_against_brute_force(spark, ploidy):
    rng = random.Random(ploidy)
    gt = lambda: rng.choice([None, "x", "./.", "."]) if rng.random() < 0.1 else rng.choice("/|").join(rng.choice("01234.") for _ in range(rng.choice([ploidy, ploidy, 1, 4])))
    given = [(v, v % 5, rng.randrange(12), gt()) for v in range(12) for _ in range(60)]
    of = spark.createDataFrame(given, "v int, n_alt int, sample int, gt string")
    groups = spark.createDataFrame([(s, c) for s in range(10) for c in "AB" if s % 3 or c == "A"] + [(0, "A")], "sample int, category string")
    found = ("an", "ac", "genotype_count", "nhomalt")
    for parts in (None, 7):
        out = alleles.counts(of, ["v"], ploidy=ploidy, parts=parts)
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r["v"]: tuple(r[k] for k in found) for r in out.collect()} == {v: _counted([g for w, _, _, g in given if w == v], v % 5, ploidy) for v in range(12)}
        for r in alleles.by_category(of, groups, ["v"], ploidy=ploidy, parts=parts).collect():
            mine = [g for w, _, s, g in given if w == r["v"] and s < 10 and (s % 3 or r["category"] == "A")]
            assert tuple(r[k] for k in found) == _counted(mine, r["v"] % 5, ploidy)


@pytest.mark.parametrize("name", ["category_allele_counts", "allele_counts", "allele_freq", "genotype_counts", "hom_alt_counts"])
def test_tasks_of_allele_queries_grow_in_number_not_in_size(spark, monkeypatch, name):
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    whole = rows(queries.QUERIES[name](spark, d))
    monkeypatch.setattr(adapters, "ROWS", 200, raising=False)
    out = queries.QUERIES[name](spark, d)
    assert out.rdd.getNumPartitions() == -(-lines // 200)
    assert rows(out) == whole


EXONS = [(100, 150), (200, 230), (250, 300)]


def _tx(spark, strand, exons, cds=(None, None)):
    schema = "strand string, exons array<struct<start:long,end:long>>, tx_start long, tx_end long, cds_start long, cds_end long"
    return spark.createDataFrame([(strand, exons, exons[0][0], exons[-1][1], *cds)], schema)


def test_transcript_positions(spark):
    want = {99: (0, -1), 100: (0, 0), 149: (49, 0), 150: (49, 1), 199: (50, -1), 200: (50, 0), 300: (129, 1)}
    df = _tx(spark, "+", EXONS).withColumn("pos", F.explode(F.array(*[F.lit(x).cast("long") for x in want])))
    found = df.withColumn("p", transcripts.to_transcript(F.col("pos")))
    assert {r["pos"]: (r["p"]["base"], r["p"]["offset"]) for r in found.collect()} == want
    back = found.select("pos", transcripts.to_genome(F.col("p.base"), F.col("p.offset")).alias("g"))
    assert all(r["pos"] == r["g"] for r in back.collect())


def test_positions_are_ordered_within_rows_and_tasks_grow_in_number(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    want = {}
    for r in adapters.tx_positions(spark, d).withColumn("p", transcripts.to_transcript(F.col("pos"))).collect():
        want.setdefault(r["tx_id"], set()).add((r["p"]["base"], r["p"]["offset"], r["pos"]))
    monkeypatch.setattr(adapters, "ROWS", 200, raising=False)
    out = queries.QUERIES["position_order"](spark, d)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() == -(-lines // 200)
    assert rows(out) == sorted((t, ",".join(str(p) for _, _, p in sorted(found))) for t, found in want.items())


def test_transcript_positions_against_walk(spark):
    rng = random.Random(11)
    for strand in "+-":
        edges = sorted(rng.sample(range(5, 120), 8))
        exons = list(zip(edges[::2], edges[1::2]))
        walk = [p for s, e in exons for p in range(s, e)][:: 1 if strand == "+" else -1]

        def place(p):
            if p in walk:
                return walk.index(p), 0
            d, s, e = min((s - p if p < s else p - e + 1, s, e) for s, e in exons)
            before = (p < s) == (strand == "+")
            edge = s if p < s else e - 1
            return walk.index(edge), -d if before else d

        df = _tx(spark, strand, exons).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(130).cast("long")))).withColumn("p", transcripts.to_transcript(F.col("pos")))
        assert {r["pos"]: (r["p"]["base"], r["p"]["offset"]) for r in df.collect()} == {p: place(p) for p in range(131)}


@pytest.mark.parametrize("strand", ["+", "-"])
def test_coding_round_trip(spark, strand):
    df = transcripts.cds_bounds(_tx(spark, strand, [*EXONS, (350, 400)], (210, 270))).withColumn("pos", F.explode(F.sequence(F.lit(100).cast("long"), F.lit(399).cast("long"))))
    found = df.withColumn("c", transcripts.to_cds(transcripts.to_transcript(F.col("pos"))))
    back = found.select("pos", "c", transcripts.cds_to_genome(F.col("c.side"), F.col("c.base"), F.col("c.offset")).alias("g")).collect()
    assert all(r["pos"] == r["g"] for r in back)
    first = 210 if strand == "+" else 269
    assert next(tuple(r["c"]) for r in back if r["pos"] == first) == ("", 0, 0)
    assert df.first()["cds_to"] - df.first()["cds_from"] == 40


def test_hgvs(spark):
    df = spark.createDataFrame([(x,) for x in ("c.-5+2", "n.10", "g.7", "g.-7", "n.*3", "c.*1-4", "c.0", "junk")], "t string")
    got = [r[0] and tuple(r[0]) for r in df.select(hgvs.parse(F.col("t"))).collect()]
    assert got == [("c", "-", 4, 2), ("n", "", 9, 0), ("g", "", 6, 0), None, None, ("c", "*", 0, -4), None, None]
    shown = df.select(hgvs.parse(F.col("t")).alias("p")).where("p IS NOT NULL").select(hgvs.show(F.col("p.kind"), F.col("p.side"), F.col("p.base"), F.col("p.offset")).alias("t"))
    assert [r[0] for r in shown.collect()] == ["c.-5+2", "n.10", "g.7", "c.*1-4"]


def test_error_profile(spark):
    reads_ = spark.createDataFrame([(0, 0, "c", 0, 60, "2S4M1I2M2D3M", "TTACGTAACCCG"), (1, 16, "c", 4, 60, "3M", "ATT"), (2, 0, "*", -1, 0, "*", ""), (3, 0, "c", 0, 3, "3M", "AAA")], "rec_idx long, flag int, rname string, pos long, mapq int, cigar string, seq string")
    reference = spark.createDataFrame([("c", "ACGTAACCGGCCG")], "name string, seq string")
    ops = errors.walked(reads_)
    assert rows(errors.lengths(ops, "I")) == [(1, 1)] and rows(errors.lengths(ops, "D")) == [(2, 1)] and rows(errors.lengths(ops, "S")) == [(2, 1)]
    bases = errors.aligned_bases(reads_, reference)
    assert bases.count() == 12
    # GGC is read as CCG, AA as AC, and the reverse read has ATT over AAC
    assert rows(errors.mismatches(bases)) == [("A", "C", 1), ("C", "G", 1), ("G", "A", 1), ("G", "C", 2), ("T", "A", 1)]


def test_pairs_and_names(spark):
    df = spark.createDataFrame([("a", 0, 128), ("b", 1, 64), ("a", 2, 64), ("a", 3, 64), ("c", 4, 64 | 256), ("c", 5, 128)], "qname string, rec_idx long, flag int")
    assert rows(reads.mate_pairs(df)) == [("a", 2, 0, 2), ("c", 4, 5, 5)]
    assert rows(reads.name_group(df), "qname", "rec_idx", "place") == [("a", 0, 2), ("a", 2, 1)]
    assert rows(reads.rename_reads(df), "rec_idx", "new_name") == [(0, "R1"), (1, "R2"), (2, "R1"), (3, "R1"), (4, "R3"), (5, "R3")]
    name = spark.createDataFrame([("Pi1-9:30:222VLMLT3:7:1101:1925:1032 1:N:0:ACACTAAG+ATATGGAT",)], "n string")
    assert tuple(name.select(readname.illumina(F.col("n")).alias("x")).first()["x"]) == ("Pi1-9:30:222VLMLT3:7", 1101, 1925, 1032, 1, "N:0:ACACTAAG+ATATGGAT")


def test_order(spark):
    values = [1, 2, 2, 5, 4, 6, 7, 3, 8]
    df = spark.createDataFrame(list(enumerate(values)), "rec_idx long, v int")
    want = [(i, v) for i, v in enumerate(values) if i and values[i - 1] >= v]
    for chunk in (1, 2, 3, 100):
        assert rows(reads.order_breaks(df, ["v"], chunk=chunk)) == want
    groups = spark.createDataFrame(list(enumerate("aabbacc")), "rec_idx long, g string")
    for chunk in (1, 3, 100):
        assert rows(reads.group_starts(groups, "g", chunk=chunk)) == [(0, "a", False), (2, "b", False), (4, "a", True), (5, "c", False)]


def test_order_over_gaps_and_from_a_start(spark):
    """Rows are compared with the nearest row before, whatever indexes are missing between them."""
    df = spark.createDataFrame([(98, 5), (101, 3), (350, 4), (351, 4), (900, 1)], "rec_idx long, v int")
    assert rows(reads.order_breaks(df, ["v"], chunk=100)) == [(101, 3), (351, 4), (900, 1)]
    assert rows(reads.order_breaks(df.where("rec_idx = 98"), ["v"], chunk=100, start=(5,))) == [(98, 5)]
    assert rows(reads.order_breaks(df.where("rec_idx = 98"), ["v"], chunk=100, start=(4,))) == []
    groups = spark.createDataFrame([(98, "a"), (101, "a"), (350, "b"), (900, "a"), (901, None)], "rec_idx long, g string")
    assert rows(reads.group_starts(groups, "g", chunk=100)) == [(98, "a", False), (350, "b", False), (900, "a", True), (901, None, False)]


def test_zip_pairs_keeps_nulls(spark):
    a, b = spark.createDataFrame([(0, "x"), (1, None)], "rec_idx long, s string"), spark.createDataFrame([(0, None), (1, "z")], "rec_idx long, s string")
    assert {tuple(r) for r in reads.zip_pairs(a, b).collect()} == {(0, "x", None), (1, None, "z")}


def test_canonical_list(spark):
    log = ["\t\tA\tB\tTX0\t5", "\t\tgeneName\tgeneId\ttranscriptId\tcdsLength", "\t\tABC1\tENSG7\tTX9.2\t1200", "\tno", "\t\tshort\tone", "x", "\t\t D \tENSG8\tTX10"]
    got = variants.canonical_transcripts(spark.createDataFrame(list(enumerate(log)), "rec_idx long, line string"))
    assert rows(got) == [(2, "TX9.2"), (6, "TX10")]
    assert variants.canonical_transcripts(spark.createDataFrame([(0, "\t\ta\tb\tc")], "rec_idx long, line string")).count() == 0


def test_error_profile_over_chunks(spark, monkeypatch):
    """Long reads over chunk edges against a walk base by base; deletions across edges; variants and regions gate."""
    monkeypatch.setattr(errors, "CHUNK", 16)
    monkeypatch.setattr(errors, "FLANK", 4)
    rng = random.Random(9)
    contigs = {c: "".join(rng.choice("ACGTacgt") for _ in range(n)) for c, n in (("a", 100), ("b", 16), ("c", 33))}
    given = []
    for i in range(60):
        c = rng.choice("abc")
        pos, left, seq, ops = rng.randrange(len(contigs[c]) - 8), 0, "", []
        at = pos
        while at < len(contigs[c]) and len(ops) < 6:
            n = rng.randrange(1, 30 if not len(ops) % 2 else 4)
            n = min(n, len(contigs[c]) - at)
            kind = "M" if not len(ops) % 2 else rng.choice("ID")
            if kind == "M":
                seq += "".join(b if rng.random() > 0.1 else rng.choice("ACGT") for b in contigs[c][at : at + n])
            elif kind == "I":
                seq += "".join(rng.choice("ACGT") for _ in range(n))
            ops.append((n, kind))
            at += n if kind != "I" else 0
        given.append((i, 16 * (i % 2), c, pos, 60, "".join(f"{n}{k}" for n, k in ops), seq))
    pieces = [(c, p, s[p : p + 7]) for c, s in contigs.items() for p in range(0, len(s), 7)]
    whole = spark.createDataFrame(list(contigs.items()), "name string, seq string")
    cut = spark.createDataFrame(pieces, "name string, at long, seq string")
    df = spark.createDataFrame(given, "rec_idx long, flag int, rname string, pos long, mapq int, cigar string, seq string")
    turn = str.maketrans("ACGTN", "TGCAN")
    bases_, deleted = [], {}
    for _, flag, c, pos, _, cigar, seq in given:
        ref, at, own = "N" + contigs[c].upper() + "N", pos, 0
        for n, kind in re.findall(r"(\d+)([MID])", cigar):
            n = int(n)
            if kind == "M":
                bases_ += [(c, at + k, flag, ref[at + k + 1], ref[at + k : at + k + 3], seq[own + k].upper()) for k in range(n)]
                at, own = at + n, own + n
            elif kind == "I":
                own += n
            else:
                gone = contigs[c][at : at + n].upper()
                gone = gone.translate(turn)[::-1] if flag else gone
                deleted[gone] = deleted.get(gone, 0) + 1
                at += n
    for reference in (whole, cut):
        assert rows(errors.aligned_bases(df, reference), "chrom", "pos", "flag", "ref", "triplet", "base") == sorted(bases_)
        assert rows(errors.aligned_bases(df, reference, mismatched=True), "chrom", "pos", "flag", "ref", "triplet", "base") == sorted(b for b in bases_ if b[3] != b[5])
        assert dict(rows(errors.short_deletions(errors.walked(df), reference, 4))) == deleted
    regions = spark.createDataFrame([("a", 10, 40), ("c", 0, 33)], IV)
    known = spark.createDataFrame([("a", 12, "AC", "GT"), ("c", 20, "A", "T")], "chrom string, pos long, ref string, alt string")
    inside = [b for b in bases_ if (b[0] == "a" and 10 <= b[1] < 40 and b[1] not in (12, 13)) or (b[0] == "c" and b[1] != 20)]
    assert rows(errors.aligned_bases(df, whole, known=known, regions=regions), "chrom", "pos", "flag", "ref", "triplet", "base") == sorted(inside)
    profile = {tuple(r)[:3]: r["Count"] for r in errors.profile(df, whole, known=known, regions=regions).collect()}
    kept = [g for g in given if g[2] != "b"]
    assert profile["Total Sequenced Bases", "", ""] == sum(len(g[6]) for g in kept)
    assert sum(n for (k, _, _), n in profile.items() if k == "Total Reference Base") == len(inside)


def test_error_counters_read_the_reads_once(spark):
    rng = random.Random(4)
    given = [(i, rng.choice([0, 16]), rng.choice(["c", "d"]), rng.randrange(3000), 60, f"2S5M{rng.randrange(1, 6)}I4M{rng.randrange(1, 6)}D6M", "ACGTA" * 5) for i in range(200)]
    aligned = spark.createDataFrame(given, "rec_idx long, flag int, rname string, pos long, mapq int, cigar string, seq string")
    reference = spark.createDataFrame([("c", "ACGGT" * 620)], "name string, seq string")
    regions = spark.createDataFrame([("c", i, i + 40) for i in range(0, 2600, 3)] + [("d", 100, 90)], "chrom string, start long, end long")
    walked = errors.walked(aligned)
    apart = {("I", r["sequence"], r["n"]) for r in errors.short_insertions(walked).collect()} | {("D", r["sequence"], r["n"]) for r in errors.short_deletions(walked, reference).collect()}
    assert set(rows(errors.short_indels(aligned, reference))) == apart
    counted = errors.gated(errors.op_counts(aligned, ("I",)), regions=regions)
    inside = [g for g in given if g[2] == "c" and any(s <= g[3] + 5 < s + 40 for s in range(0, 2600, 3))]
    assert counted.agg(F.sum("n")).first()[0] == len(inside)
    plan = errors.profile(aligned, reference, regions=regions)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2  # the walk and the totals; the CIGARs were walked for each of nine counters


def test_names_of_two_kinds(spark):
    pairs = [("M01-2:7:000AB:1:1101:15:20 1:N:0:1", "M01-2:7:000AB:1:1101:15:20 2:N:0:1"), ("V350L1C001R0020000017/1", "V350L1C001R0020000017/2"), ("E12BL3C001R00299/1", "E12BL3C001R00299/2")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(readname.name_type(F.col("a"), F.col("b"))).collect()] == ["Illumina", "DNBSeq", "DNBSeq"]
    for bad in (("x", "y"), (pairs[0][0], pairs[0][0]), (pairs[1][0], pairs[2][1])):
        with pytest.raises(Exception, match="read names"):
            spark.createDataFrame([bad], "a string, b string").select(readname.name_type(F.col("a"), F.col("b"))).collect()
    tags = spark.createDataFrame([(["NM:i:1", "RG:Z:a b", "H:H:1F"],)], "t array<string>")
    assert tuple(tags.select(readname.tag_text(F.col("t"), "RG"), readname.tag_text(F.col("t"), "NM"), readname.tag_text(F.col("t"), "XX")).first()) == ("a b", None, None)


def _mates(names, ends=(" 1:N:0:AC", " 2:N:0:AC")):
    return [(i, n + ends[0], n + ends[1]) for i, n in enumerate(names)]


PAIRS = "rec_idx long, name string, name_2 string"


def test_illumina_files(spark):
    places = ["S:1:F:2:1101:9:1", "S:1:F:2:1101:3:5", "S:1:F:2:1101:4:5", "S:1:F:2:1102:1:1"]
    given = _mates(places[:3]) + [(3, places[3] + " 1:N:0:GG", places[3] + " 2:N:0:GG")]
    report = fastq.illumina_report(spark.createDataFrame(given, PAIRS), chunk=2)
    assert [(r["key"], r["values"]) for r in report.orderBy("rec_idx").collect()] == [("READ_PREFIX", ["S:1:F:2"]), ("COMMON_INDEX", ["N:0:AC"]), ("SPECIAL_INDEX", ["1102", "1", "1", "N:0:GG"])]
    with pytest.raises(Exception, match="unexpected read order"):
        fastq.illumina_report(spark.createDataFrame(_mates([places[1], places[0]]), PAIRS)).collect()
    with pytest.raises(Exception, match="another prefix"):
        fastq.illumina_report(spark.createDataFrame(_mates([places[0], "T:1:F:2:1101:9:2"]), PAIRS)).collect()
    with pytest.raises(Exception, match="doesn't belong"):
        fastq.illumina_report(spark.createDataFrame([(0, places[0] + " 1:N:0:AC", places[1] + " 2:N:0:AC")], PAIRS)).collect()
    lines = [r[0] for r in fastq.report_lines(report, {"FASTQ1": "a", "FASTQ2": "b", "FASTQ1_MD5": "x", "FASTQ2_MD5": "y"}).collect()]
    info = fastq.load_info(lines, "Illumina")
    assert info.values["COMMON_INDEX"] == "N:0:AC" and info.special == [(1102, 1, 1, "N:0:GG")]
    shuffled = spark.createDataFrame([(p, "ACGT", "IIII") for p in reversed(places)], "name string, seq string, qual string")
    content = "".join(f"@{n}\nACGT\n+\nIIII\n" for _, n, _ in given)
    info.values["FASTQ1_MD5"] = hashlib.md5(content.encode()).hexdigest()
    out, same = fastq.restore(spark, shuffled, info, "Illumina", 1)
    assert [r["name"] for r in out.collect()] == [n for _, n, _ in given] and same
    for bad in (lines[:2], [*lines[:-1], "VERIFY_RESULT\tNG"], [*lines, "WHAT\tx"]):
        with pytest.raises(ValueError):
            fastq.load_info(bad, "Illumina")


def test_dnbseq_files(spark):
    names = [f"V3L1C{g}{i:05d}" for g, i in (("001R002", 1), ("001R002", 7), ("001R001", 2), ("001R001", 3), ("002R001", 1))]
    df = spark.createDataFrame(_mates(names, ("/1", "/2")), PAIRS)
    report = fastq.dnbseq_report(df, chunk=2)
    assert [(r["key"], r["values"]) for r in report.orderBy("rec_idx").collect()] == [("PREFIX", ["V3L1C"]), *[("GROUP_ORDER", [g]) for g in ("001R002", "001R001", "002R001")]]
    for bad, match in (([names[1], names[0]], "read order"), ([names[0], "V4L1C001R00200002"], "flowcell")):
        with pytest.raises(Exception, match=match):
            fastq.dnbseq_report(spark.createDataFrame(_mates(bad, ("/1", "/2")), PAIRS)).collect()
    info = fastq.FastqInfo({"PREFIX": "V3L1C", "FASTQ2_MD5": ""}, [], ["001R002", "001R001", "002R001"])
    shuffled = spark.createDataFrame([(n, "AC", "II") for n in sorted(names, reverse=True)], "name string, seq string, qual string")
    assert [r["name"] for r in fastq.restore_dnbseq(shuffled, info, "2").collect()] == [n + "/2" for n in names]
    with pytest.raises(Exception, match="group name"):
        fastq.restore_dnbseq(shuffled, fastq.FastqInfo({"PREFIX": "V3L1C"}, [], ["001R002"]), None).collect()


def test_sam_headers(spark):
    header = ["@HD\tVN:1.5\tSO:coordinate", "@SQ\tSN:c\tLN:9\tUR:file:/x/y/ref.fa", "@RG\tID:g1\tSM:s\tPU:u", "@RG\tID:g2", "@PG\tID:bwa-mem2\tCL:bwa-mem2 mem -R @RG\\tID:g1\\tSM:s ref.fa r_1.fq r_2.fq", ""]
    groups = sam_header.read_groups(header)
    assert groups[0] == {"id": "g1", "sample": "s", "platform_unit": "u", "fastq1": "r_1.fq", "fastq2": "r_2.fq", "cmd": "bwa-mem2 mem -R @RG\\tID:g1\\tSM:s ref.fa r_1.fq r_2.fq"}
    assert groups[1]["fastq1"] == "" and sam_header.read_group_id("@RG\tSM:x\tID:ab-1\tPU:z") == "ab-1"
    table = sam_header.read_group_table(spark, header, spark.createDataFrame([("g1", "V3L1C001R00212"), ("zz", "q")], "rg string, first_qname string"), "p")
    assert rows(table, "path", "id", "read_type", "read_prefix") == [("p", "g1", "DNBSEQ", "V3L1C"), ("p", "g2", "", "")]
    assert sam_header.unified(header, "@RG\tID:n", "tool")[:3] == ["@HD\tVN:1.6", "@SQ\tSN:c\tLN:9\tUR:/ref.fa", "@RG\tID:n"]
    assert sam_header.unsorted(header)[0] == "@HD\tVN:1.5\tSO:unsorted" and sam_header.with_comment(["x"], "done")[-1] == "@CO\tdone"
    with pytest.raises(ValueError):
        sam_header.read_groups(["@RG\tSM:x"])


def test_counts_in_info(spark):
    schema = "format array<string>, alt array<string>, info array<struct<key:string,values:array<string>>>, genotypes array<array<string>>"
    info = [("AC", ["9"]), ("X", [])]
    given = [(["DP", "GT"], ["A", "C"], info, [["1", "0/2"], ["1", "2|2"], ["1", "./1"]]), (["DP"], ["A"], info, [["1"], ["1"], ["1"]])]
    out = alleles.add_counts(spark.createDataFrame(given, schema), ["p", "q", "r"], {"K": ["q", "gone"]}).collect()
    got = {e["key"]: e["values"] for e in out[0]["info"]}
    assert [e["key"] for e in out[0]["info"]][:6] == ["AC", "X", "AN", "AF", "GenotypeCount", "nhomalt"]
    assert (got["AN"], got["AC"], got["AF"], got["GenotypeCount"], got["nhomalt"]) == (["5"], ["1", "3"], ["0.2000", "0.6000"], ["0", "0", "0", "1", "0", "1"], ["0", "1"])
    assert (got["AN_K"], got["AC_K"], got["AF_K"], got["nhomalt_K"]) == (["2"], ["0", "2"], ["0.0000", "1.0000"], ["0", "1"])
    none = {e["key"]: e["values"] for e in out[1]["info"]}
    assert (none["AN"], none["AC"], none["AF"], none["GenotypeCount"]) == (["0"], ["0"], ["."], ["0", "0", "0"])


def test_names_and_small_parts(spark, tmp_path):
    assert len(variants.refseq()) == 49 and variants.refseq()["NC_000024.10"] == "Y" and variants.refseq()["NC_012920.1"] == "MT"
    assert variants.contig_mapping(refseq_names=True, add=True)["NC_000001.11"] == "1" and variants.contig_mapping(table={"a": "b"}) == {"a": "b"}
    assert vcf_table.header_with_names(["##contig=<ID=1,assembly=x,length=7>", "##contig=<ID=2>", "#CHROM"], {"1": "chr1"}) == ["##contig=<ID=chr1,length=7>", "##contig=<ID=2>", "#CHROM"]
    assert variants.chosen_fields(["a", "b", "c"], exclude=["b"]) == ["a", "c"] and variants.chosen_fields(["a"], ["c", "a", "c"]) == ["c", "a"]
    assert variants.group_names(["/x/y/a.vcf", "/x/z/b.vcf"]) == ["y/a.vcf", "z/b.vcf"]
    assert sorted(variants.shuffled_samples(["a", "b", "c"], 1)) == ["a", "b", "c"]
    assert variants.sample_index(["s1", "s2", "s3"], {"s3": "C", "s1": "A", "zz": "Z"}) == (["C", "A"], [2, 0])
    assert variants.sample_index(["s1", "s2", "s3"], {"s3": "C", "s1": "A"}, ["A", "Q"]) == (["A"], [0])
    known = spark.createDataFrame([("chr1",), ("1",), ("chr2",), ("3",)], "n string").select(transcripts.chromosome(F.col("n"), ["chr1", "2"]).alias("c"))
    assert [r[0] for r in known.collect()] == ["chr1", "chr1", "2", None]
    with pytest.raises(Exception, match="unknown strand"):
        spark.createDataFrame([("x",)], "s string").select(transcripts.checked(F.col("s"), transcripts.STRANDS, "strand")).collect()
    ranges = spark.createDataFrame([("n.3", "n.3"), ("n.3", "n.9+2")], "a string, b string").select(hgvs.show_range(F.lit("n"), F.col("a"), F.col("b")))
    assert [r[0] for r in ranges.collect()] == ["n.3", "n.3_9+2"]
    at = [("-", 4, 0), ("-", 1, 0), ("", 0, -2), ("", 0, 0), ("", 0, 3), ("", 7, 0), ("*", 0, 0)]
    df = spark.createDataFrame(at, "side string, base long, offset long").withColumn("k", hgvs.order_key(F.struct("base", "offset"), F.col("side")))
    assert [tuple(r)[:3] for r in df.orderBy("k").collect()] == at
    header = ["##fileformat=VCFv4.2", '##INFO=<ID=AF,Number=A,Type=Float,Description="x">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">', "#CHROM"]
    assert variants.create_table_sql("t", vcf_table.table_columns(header, ["#", "POS", "AF", "S__DP", "QUAL", "ALT"])) == "CREATE TABLE t(POS INTEGER, AF REAL, S__DP INTEGER, QUAL REAL, ALT TEXT);"
    (tmp_path / "b.csv").write_text("id,x,y\n1,a,b\n2,a,a\n")
    assert rows(text.read_categories(spark, str(tmp_path / "b.csv"), ["id"], ["x", "y"])) == [("1", "a"), ("1", "b"), ("2", "a")]
    (tmp_path / "l.txt").write_text("TX1\n\n TX2 \n")
    assert text.read_list(spark, str(tmp_path / "l.txt")) == ["TX1", "TX2"]
    (tmp_path / "c.fai").write_text("c\t12\t3\t4\t5\n")
    assert rows(text.whole_contigs(text.read_fai(spark, str(tmp_path / "c.fai")))) == [("c", 0, 12)]
    text.concatenate(spark, [str(tmp_path / "l.txt"), str(tmp_path / "b.csv")], str(tmp_path / "cat"), "gzip")
    assert [r[0] for r in spark.read.text(str(tmp_path / "cat")).collect()] == ["TX1", "", " TX2 ", "id,x,y", "1,a,b", "2,a,a"]
    (tmp_path / "link").symlink_to(tmp_path / "l.txt")
    assert text.absolute(f"{tmp_path}/x/../link") == str(tmp_path / "l.txt")
    (tmp_path / "r.fa").write_text("junk\n>c1 d\nACG\nTT\n\n>c2\nA\n")
    assert rows(text.read_fasta_pieces(spark, str(tmp_path / "r.fa"))) == [("c1", 0, "ACG"), ("c1", 3, "TT"), ("c2", 0, "A")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_in_info_parse_each_genotype_once(spark):
    r = spark.sql("SELECT array('A', 'T') AS alt, array('GT') AS format, array(array('0/1'), array('2/2')) AS genotypes, array(named_struct('key', 'AN', 'values', array('9'))) AS info FROM range(1)")
    assert 1 <= _plan(alleles.add_counts(r, ["S1", "S2"])).count("[/|]") <= 2  # it was parsed for each count, and for each place of it


def test_annotations_are_parsed_once(spark):
    header = ['##INFO=<ID=ANN,Number=.,Type=String,Description="a">']
    record = spark.sql("SELECT 1 AS number, 'c' AS chrom, 1 AS pos, array('i') AS id, 'G' AS ref, array('A') AS alt, '.' AS qual_raw, array('PASS') AS filter, array(named_struct('key', 'ANN', 'values', array('A|e|HIGH|g|x|transcript|t|c||c.1|p.1'))) AS info, array('GT') AS format, array(array('0/1')) AS genotypes FROM range(1)")
    t = vcf_table.to_table(record, header, ["S"], canonical=["t"])
    assert rows(t, "SnpEff", "SnpEff Impact", "GeneImpact__HIGH") == [("t(g):p.1", "HIGH", "g")]
    assert 1 <= _plan(t).count("[|]") <= 2  # it was split for each column, and for each field


def test_names_are_matched_by_few_patterns(spark):
    df = spark.createDataFrame([("A00:1:FC:1:1101:5:7 1:N:0:AC",), ("A00:1:FC:1:1101:5:7 1:N:0:AC\n",), ("A00:1:FC:1:1101:5:99999999999 1:N:0:AC",), ("x\n1\n2\n3\n4\n5",), ("",), (None,)], "n string")
    got = df.select(readname.illumina_fastq(F.col("n")).alias("p"))
    own = ("A00:1:FC:1", 1101, 5, 7, 1, "N:0:AC")
    assert [r["p"] and tuple(r["p"]) for r in got.collect()] == [own, own, ("A00:1:FC:1", 1101, 5, None, 1, "N:0:AC"), None, None, None]
    assert "regexp_extract" not in _plan(df.select("n").sort("n").select(readname.illumina_fastq(F.col("n"))))


def test_md5_of_lines_comes_in_blocks(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    seen, given = [], Classic.toLocalIterator

    def counted(self, *a, **b):
        for row in given(self, *a, **b):
            seen.append(row)
            yield row

    monkeypatch.setattr(Classic, "toLocalIterator", counted)
    df = spark.range(30000).selectExpr("29999 - id AS rec_idx", "concat('@', 29999 - id) AS line")
    assert fastq.ordered_md5(df) == hashlib.md5("".join(f"@{i}\n" for i in range(30000)).encode()).hexdigest()
    assert len(seen) < 100  # a row for each line before


def test_zip_pairs_needs_equal_length(spark):
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "rec_idx long, s string"), spark.createDataFrame([(0, "z")], "rec_idx long, s string")
    with pytest.raises(Exception, match="differ in length"):
        reads.zip_pairs(a, b).collect()


def test_annotations(spark):
    ann = ["A|v|HIGH|G1|i|t|TX1|c||c.1|p.1", "A|v|MODIFIER|G2|i|t|TX1|c||c.2|", "T|v|LOW|G3|i|t|TX2|c||c.3|"]
    df = spark.createDataFrame([(ann,)], "ann array<string>").withColumn("e", variants.of_allele(variants.annotations(F.col("ann")), F.lit("A")))
    out = df.select(variants.highest_impact(F.col("e")).alias("i"), variants.canonical_changes(F.col("e"), F.array(F.lit("TX1"))).alias("c"), variants.genes_of_impact(F.col("e"), "HIGH").alias("g")).first()
    assert tuple(out) == ("HIGH", "TX1(G1):p.1", "G1")
    assert variants.clean_name("a.b é") == "a_b___"


def test_formats_round_trip(spark, tmp_path):
    (tmp_path / "a.bed").write_bytes(b"# x\nX\t1\t2\tA\r\nY\t30\t40\nM\t500\t600\ta\tb c\n")
    bed = text.read_bed(spark, str(tmp_path / "a.bed"))
    assert rows(bed, "chrom", "start", "end", "columns") == [("M", 500, 600, ["a", "b c"]), ("X", 1, 2, ["A"]), ("Y", 30, 40, [])]
    text.write_bed(bed, str(tmp_path / "out"))
    assert rows(text.read_bed(spark, str(tmp_path / "out")), "chrom", "columns") == [("M", ["a", "b c"]), ("X", ["A"]), ("Y", [])]
    header = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"]
    record = "7\t501\t.\tCTT\tC,CTTTT\t41.5\tPASS\tDP=12;FLAG;XY=1,2\tGT:AD\t0/2:3,0\t1|2:.\n"
    (tmp_path / "a.vcf").write_text("\n".join(header) + "\n" + record)
    vcf = text.read_vcf(spark, str(tmp_path / "a.vcf"))
    assert vcf.first()["alt"] == ["C", "CTTTT"] and text.vcf_header(spark, str(tmp_path / "a.vcf")) == (header, ["A", "B"])
    text.write_vcf(vcf, header, str(tmp_path / "vcf"))
    assert "\n".join(r[0] for r in spark.read.text(str(tmp_path / "vcf")).collect()) + "\n" == "\n".join(header) + "\n" + record
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\n@III\n@r2\nAC\n+\nII\n")
    assert rows(text.read_fastq(spark, str(tmp_path / "a.fq"))) == [(0, "r1 x", "ACGT", "@III"), (1, "r2", "AC", "II")]
    (tmp_path / "a.fa").write_text(">c1 d\nAC\nGT\n>c2\nA\n")
    assert rows(text.read_fasta(spark, str(tmp_path / "a.fa"))) == [("c1", "ACGT"), ("c2", "A")]
    (tmp_path / "a.sam").write_text("@SQ\tSN:c\nr\t16\tc\t5\t60\t4M\t*\t0\t0\tACGT\tIIII\tRG:Z:x\n")
    assert rows(text.read_sam(spark, str(tmp_path / "a.sam")), "qname", "pos", "tags") == [("r", 4, ["RG:Z:x"])]


def test_files_are_read_in_their_order(spark, tmp_path):
    """The first part files are the smaller ones, and a scan starts with the larger; a record may go over from one to the next."""
    folder = tmp_path / "a.fq"
    folder.mkdir()
    records = [f"@r{i}\n{'ACGT' * (i + 1)}\n+\n{'@@@@' * (i + 1)}\n" for i in range(40)]
    content = "".join(records).splitlines(keepends=True)
    for i, (a, b) in enumerate([(0, 6), (6, 40), (40, 160)]):
        (folder / f"part-0000{i}-x.txt").write_text("".join(content[a:b]))
    got = text.read_fastq(spark, str(folder))
    assert rows(got, "rec_idx", "name") == [(i, f"r{i}") for i in range(40)]
    table = tmp_path / "m.tsv"
    table.mkdir()
    (table / "part-00000-x.txt").write_text("k\told\n")
    (table / "part-00001-x.txt").write_text("".join(f"other{i}\tv\n" for i in range(50)) + "k\tnew\n")
    (table / "part-100000-x.txt").write_text("k\tlast\n")
    assert text.last_of_each(text.read_mapping(spark, str(table)))["k"] == "last"


def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name in ("interval_merge", "known_site_exclude", "genome_to_cds", "mate_pairs"):
        ours, theirs = __spark_entry__.queries()[name](spark, d), con.sql(__spark_entry__.oracle_sql()[name])
        columns = sorted(ours.columns)
        places = [theirs.columns.index(c) for c in columns]
        assert rows(ours, *columns) == sorted(tuple(r[i] for i in places) for r in theirs.fetchall()), name


def test_vcf_table(spark, tmp_path):
    header = ["##fileformat=VCFv4.2", '##INFO=<ID=AC,Number=A,Type=Integer,Description="x">', '##INFO=<ID=AN,Number=1,Type=Integer,Description="x">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">', '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="x">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="x">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA"]
    lines = ["4\t77\trs1\tC\tT\t9.25\tq10\tAC=3;AN=8\tGT:AD:DP\t0/1:6,2:8", "4\t91\t.\tTA\tT,TAA\t.\t.\tAC=1,2;AN=8\tGT:AD:DP\t1/2:2,3,7:16", "5\t5\t.\tG\tA\t1\t.\tAN=0\tGT:AD:DP\t./.:0,4:0"]
    (tmp_path / "a.vcf").write_text("\n".join(header + lines) + "\n")
    records = text.read_vcf(spark, str(tmp_path / "a.vcf")).withColumn("number", F.when(F.col("pos") == 77, 1).when(F.col("pos") == 91, 2).otherwise(3))
    split = vcf_table.to_table(records, header, ["A"])
    assert split.columns == ["#", "alt #", "CHROM", "POS", "ID", "REF", "ALT", "A__VAF", "QUAL", "FILTER", "AC", "AN", "A__AD__Ref", "A__AD__Alt", "A__DP", "A__GT"]
    assert rows(split) == [
        ("1", "1", "4", "77", "rs1", "C", "T", "0.250", "9.25", "q10", "3", "8", "6", "2", "8", "0/1"),
        ("2", "1", "4", "91", "", "TA", "T", "0.188", "", "", "1", "8", "2", "3", "16", "1/2"),
        ("2", "2", "4", "91", "", "TA", "TAA", "0.438", "", "", "2", "8", "2", "7", "16", "1/2"),
        ("3", "1", "5", "5", "", "G", "A", "inf", "1", "", "", "0", "0", "4", "0", "./."),
    ]
    whole = vcf_table.to_table(records, header, ["A"], split=False).where("`#` = 2").first()
    assert (whole["ALT"], whole["A__VAF"], whole["AC"], whole["A__AD__Alt"]) == ("T,TAA", "0.188,0.438", "1,2", "3,7")


def test_headers():
    header = ["##fileformat=VCFv4.2", "##x=1", "##contig=<ID=2,length=5>", "##contig=<ID=9>", '##INFO=<ID=AN,Number=1,Type=Integer,Description="x">', "#CHROM"]
    assert vcf_table.standard_header(header, ["##y=2"]) == [header[0], "##y=2", header[4], header[2], header[3], "#CHROM"]
    assert vcf_table.header_with_contigs(header, ["X", "2"]) == [header[0], "##x=1", header[4], header[2], "##contig=<ID=X>", "#CHROM"]
    assert len(vcf_table.header_with_counts(header, ["", "_P1"])) == len(header) + 9
