"""Allele and genotype counts over samples, per variant and per category of samples.

Genotypes come long: one row per variant and sample with its GT text, so a sample set is a join and counting is
one aggregation with map-side combination.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import alleles, fixed, genotype_index, number_of_genotypes
from ..functions.seq import once
from .variants import upsert_info


def _called(genotypes: DataFrame, n_alt: str) -> DataFrame:
    inside = F.filter(alleles(F.col("gt")), lambda a: a <= F.col(n_alt))
    return genotypes.withColumn("__called", F.array_sort(inside))


def counts(genotypes: DataFrame, keys: list[str], n_alt: str = "n_alt", ploidy: int = 2, parts: int | None = None) -> DataFrame:
    """Per group of keys and variant: an (called alleles), ac (array, reference first), genotype_count (VCF order), nhomalt (per ALT).

    genotypes: keys, n_alt and gt, one row per sample. Only full genotypes (as many alleles as the ploidy) count
    for genotype_count and nhomalt; alleles out of range and texts that are no genotype are skipped.
    Alike genotypes are counted first, a row for each sample at most, and all else is found from these few.
    parts: for rows in no order of their variants, where combining before the shuffle only holds memory, they are first put into so many parts by keys.
    """
    rows = genotypes.select(*keys, n_alt, "gt")
    each = _called(rows.repartition(parts, *keys) if parts else rows, n_alt)
    alike = each.groupBy(*keys, n_alt, "__called").agg(F.count("*").alias("n"))
    tables = alike.groupBy(*keys, n_alt).agg(F.collect_list(F.struct(F.col("__called").alias("called"), "n")).alias("__seen"))
    zero, alts = F.lit(0).cast("long"), F.col(n_alt).cast("long")
    full = F.filter("__seen", lambda e: F.size(e["called"]) == ploidy)
    homs = F.filter(full, lambda e: F.element_at(e["called"], 1) == F.element_at(e["called"], ploidy))
    alleles_seen = lambda held: F.aggregate("__seen", zero, lambda s, e: s + e["n"] * held(e["called"]))
    table = lambda entries, value: F.map_from_entries(F.transform(entries, lambda e: F.struct(value(e["called"]).cast("long"), e["n"])))

    def row(last: Column, value: Callable[[Column], Column], first: int = 0) -> Column:
        at = F.when(last >= first, F.sequence(F.lit(first).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(at, value)

    def looked_up(entries: Column, last: Column, first: int = 0) -> Column:
        return once(entries, lambda t: row(last, lambda i: F.coalesce(F.try_element_at(t, i), zero), first))

    return tables.select(
        *keys, n_alt, alleles_seen(F.size).alias("an"), row(alts, lambda i: alleles_seen(lambda called: F.size(F.filter(called, lambda a: a == i)))).alias("ac"),
        looked_up(table(full, genotype_index), number_of_genotypes(F.col(n_alt), ploidy) - 1).alias("genotype_count"), looked_up(table(homs, lambda called: F.element_at(called, 1)), alts, 1).alias("nhomalt"),
    )


def by_category(genotypes: DataFrame, categories: DataFrame, keys: list[str], **options) -> DataFrame:
    """counts() for each category of samples (sample, category); samples of no category are left out."""
    mapped = categories.select("sample", "category")
    if options.get("parts"):
        mapped = mapped.repartition(options["parts"], "sample")
    return counts(genotypes.join(mapped.distinct(), "sample"), ["category", *keys], **options)


def frequencies(counted: DataFrame) -> DataFrame:
    """Add af: ac of each ALT over an, null where nothing is called."""
    af = F.when(F.col("an") > 0, F.transform(F.slice("ac", 2, F.greatest(F.size("ac") - 1, F.lit(0))), lambda x: x / F.col("an")))
    return counted.withColumn("af", af)


def allele_fraction(genotypes: DataFrame) -> DataFrame:
    """Add vaf, per sample: depth of each ALT (ad, reference first) over dp; null if either is missing or dp is 0."""
    ok = F.col("ad").isNotNull() & (F.col("dp") > 0)
    return genotypes.withColumn("vaf", F.when(ok, F.transform(F.slice("ad", 2, F.greatest(F.size("ad") - 1, F.lit(0))), lambda x: x / F.col("dp"))))


def row_counts(gts: Column, n_alt: Column, ploidy: int = 2) -> Column:
    """Struct of an, ac, genotype_count and nhomalt, as in counts(), of an array of GT texts within one row."""
    tally = lambda values, last, first: F.when(last >= first, F.transform(F.sequence(F.lit(first).cast("long"), last.cast("long")), lambda i: F.size(F.filter(values, lambda x: x == i)).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def counted(called: Column) -> Column:
        full = F.filter(called, lambda c: F.size(c) == ploidy)
        homs = F.transform(F.filter(full, lambda c: c[0] == c[ploidy - 1]), lambda c: c[0])
        return F.struct(
            F.size(F.flatten(called)).cast("long").alias("an"), once(F.flatten(called), lambda x: tally(x, n_alt, 0)).alias("ac"),
            once(F.transform(full, genotype_index), lambda x: tally(x, number_of_genotypes(n_alt, ploidy) - 1, 0)).alias("genotype_count"), once(homs, lambda x: tally(x, n_alt, 1)).alias("nhomalt"),
        )

    return once(F.transform(gts, lambda g: F.array_sort(F.filter(alleles(g), lambda a: a <= n_alt))), counted)


def add_counts(records: DataFrame, samples: list[str], categories: dict[str, list[str]] | None = None, digits: int = 4) -> DataFrame:
    """Variant records with AN, AC, AF, GenotypeCount and nhomalt in their INFO, over all samples and for each category with _CATEGORY after the keys.

    Categories' samples that the header lacks are left out; AF is . where nothing is called. Counting stays within a row.
    """
    place = F.array_position("format", "GT").cast("int")
    n_alt = F.size("alt")
    places = {"": list(range(len(samples)))} | {f"_{c}": [i for i, s in enumerate(samples) if s in set(ids)] for c, ids in (categories or {}).items()}
    out = records
    most = records.agg(F.max(n_alt)).first()[0] or 0
    for suffix, index in places.items():
        gts = F.transform(F.array(*[F.lit(i) for i in index]).cast("array<int>"), lambda i: F.coalesce(F.get(F.get("genotypes", i), place - 1), F.lit(".")))
        out = out.withColumn("__c", row_counts(F.when(place > 0, gts).otherwise(F.array().cast("array<string>")), n_alt))
        found = ("an", "ac", "genotype_count", "nhomalt")
        out = out.withColumns({f"__{k}": F.col("__c")[k] for k in found}).drop("__c")
        rest = lambda name: F.slice(name, F.lit(2), F.greatest(F.size(name) - 1, F.lit(0)))
        share = lambda k: F.when(F.col("__an") == 0, ".").otherwise(fixed(F.get("__ac", F.lit(k + 1)) / F.nullif(F.col("__an"), F.lit(0)), digits))
        af = F.slice(F.array(*[F.when(n_alt > k, share(k)) for k in range(most)]).cast("array<string>"), F.lit(1), n_alt) if most else F.array().cast("array<string>")
        out = out.withColumn("__af", af)
        text = lambda c: F.transform(c, lambda x: x.cast("string"))
        new = [("AN", F.array(F.col("__an").cast("string"))), ("AC", text(rest("__ac"))), ("AF", F.col("__af")), ("GenotypeCount", text(F.col("__genotype_count"))), ("nhomalt", text(F.col("__nhomalt")))]
        out = out.withColumn("info", upsert_info(F.col("info"), [(k + suffix, v) for k, v in new])).drop("__af", *[f"__{k}" for k in found])
    return out
