"""Operators on variant records and their annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import once

#: Impacts of an annotation, gravest first.
IMPACTS = ("HIGH", "MODERATE", "LOW", "MODIFIER")
#: Human contigs with and without the prefix.
CONTIGS = tuple([str(i) for i in range(1, 23)] + ["X", "Y", "M", "MT"])
#: RefSeq versions of the chromosomes 1 to 22, X and Y in GRCh37 and GRCh38.
REFSEQ_37 = (10, 11, 11, 11, 9, 11, 13, 10, 11, 10, 9, 11, 10, 8, 9, 9, 10, 9, 9, 10, 8, 10, 10, 9)
REFSEQ_38 = (11, 12, 12, 12, 10, 12, 14, 11, 12, 11, 10, 12, 11, 9, 10, 10, 11, 10, 10, 11, 9, 11, 11, 10)


def split_multiallelic(df: DataFrame, alt: str = "alt") -> DataFrame:
    """One row per ALT with its number alt_index from 1; a record without ALT gives none."""
    return df.select(*[c for c in df.columns if c != alt], F.posexplode(alt).alias("at", alt)).withColumn("alt_index", F.col("at") + 1).drop("at")


def keep_info(info: Column, keys: list[str]) -> Column:
    """The entries of an INFO array (key, values) in the order of the list; absent ones are left out."""
    found = F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.try_element_at(F.filter(info, lambda e: e["key"] == k), F.lit(1)))
    return F.filter(found, lambda e: e.isNotNull())


def keep_format(fmt: Column, values: Column, keys: list[str]) -> tuple[Column, Column]:
    """FORMAT and one sample's values, only those of the keys, in the record's order."""
    kept = F.filter(F.arrays_zip(fmt.alias("k"), values.alias("v")), lambda x: x["k"].isin(*keys))
    return F.transform(kept, lambda x: x["k"]), F.transform(kept, lambda x: x["v"])


def replace_names(name: Column, mapping: dict[str, str]) -> Column:
    """Names by a bounded mapping; unmapped ones stay."""
    table = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair]) if mapping else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, name), name)


def add_chr() -> dict[str, str]:
    return {c: "chr" + c for c in CONTIGS}


def remove_chr() -> dict[str, str]:
    return {"chr" + c: c for c in CONTIGS}


def select_samples(genotypes: Column, index: list[int | None]) -> Column:
    """Sample values gathered in a new order; None gives an empty value."""
    return F.transform(F.array(*[F.lit(i).cast("int") for i in index]), lambda i: F.coalesce(F.get(genotypes, i), F.lit("")))


def used_contigs(df: DataFrame) -> DataFrame:
    return df.select("chrom").distinct()


#: Fixed value: how the line starts that heads the list of canonical transcripts in an annotator's log.
CANONICAL_HEAD = "\t\tgeneName\tgeneId\ttranscriptId\tcdsLength"


def canonical_transcripts(lines: DataFrame) -> DataFrame:
    """lines (rec_idx, line): after a line that heads the list, each line that starts with two tabs names one in the third field of what is left when trimmed."""
    heads = F.col("line").startswith(CANONICAL_HEAD)
    first = lines.where(heads).agg(F.min("rec_idx").alias("first")).first()["first"]
    named = lines.where(F.lit(first is not None) & (F.col("rec_idx") > F.lit(first)) & ~heads & F.col("line").startswith("\t\t"))
    third = F.get(F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), "\t"), F.lit(2))
    return named.select("rec_idx", third.alias("transcript")).where("transcript IS NOT NULL")


def chosen_fields(header_ids: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """The ids to keep: those named, or all of the header, without those excluded, in order and once each."""
    return [k for k in dict.fromkeys(header_ids if include is None else include) if k not in (exclude or ())]


def refseq() -> dict[str, str]:
    """RefSeq accessions of the human chromosomes of the two assemblies, and their names."""
    names = [str(i) for i in range(1, 23)] + ["X", "Y"]
    versions = {c: (a, b) for c, a, b in zip(names, REFSEQ_37, REFSEQ_38)}
    return {f"NC_{i:06d}.{v}": c for i, c in enumerate(names, 1) for v in versions[c]} | {"NC_012920.1": "MT"}


def contig_mapping(refseq_names: bool = False, add: bool = False, remove: bool = False, table: dict[str, str] | None = None) -> dict[str, str]:
    """The mapping that the options name; the first of RefSeq names, chr added, chr removed and an own table."""
    return refseq() if refseq_names else add_chr() if add else remove_chr() if remove else dict(table or {})


def upsert_info(info: Column, new: list[tuple[str, Column]]) -> Column:
    """INFO entries (key, values) where each new key's values take the place of its old ones, or come after all others."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("values")) for k, v in new])
    old = lambda values: F.transform(info, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(values, e["key"]), e["values"]).alias("values")))
    added = lambda present, given: F.filter(given, lambda e: ~F.array_contains(present, e["key"]))
    present = F.transform(info, lambda e: e["key"])
    return once(entries, lambda given: F.concat(once(F.map_from_entries(given), old), once(present, lambda x: added(x, given))))


def common_folder(paths: list[str]) -> str:
    """The deepest folder (or path) that all paths share."""
    parts = [p.split("/") for p in paths]
    shared = 0
    while all(len(p) > shared and p[shared] == parts[0][shared] for p in parts):
        shared += 1
    return "/".join(parts[0][:shared])


def group_names(paths: list[str]) -> list[str]:
    """What tells the paths apart: each without the folder that all share."""
    folder = common_folder(paths)
    return [p[len(folder) :].lstrip("/") for p in paths]


def shuffled_samples(samples: list[str], seed: int) -> list[str]:
    """The samples in an order drawn by the seed."""
    import random

    return random.Random(seed).sample(samples, len(samples))


def sample_index(header_samples: list[str], mapping: dict[str, str], order: list[str] | None = None) -> tuple[list[str], list[int | None]]:
    """New names and, for each, the place of its sample in the header: those in header, mapping and order, by the order (default: the mapping's)."""
    by_new = {new: old for old, new in mapping.items() if old in header_samples}
    names = [n for n in (order if order is not None else mapping.values()) if n in by_new]
    return names, [header_samples.index(by_new[n]) for n in names]


def annotations(ann: Column) -> Column:
    """Parsed entries of an ANN value: allele, effect, impact, gene, transcript, hgvs_c, hgvs_p."""

    def entry(text: Column) -> Column:
        at = lambda part, i: F.coalesce(F.get(part, F.lit(i)), F.lit(""))
        named = {"allele": 0, "effect": 1, "impact": 2, "gene": 3, "transcript": 6, "hgvs_c": 9, "hgvs_p": 10}
        return once(F.split(text, r"[|]"), lambda part: F.struct(*[at(part, i).alias(k) for k, i in named.items()], text.alias("text")))

    return F.transform(ann, entry)


def of_allele(entries: Column, alt: Column) -> Column:
    return F.filter(entries, lambda e: e["allele"] == alt)


def ann_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: e["text"]), ",")


def canonical_changes(entries: Column, canonical: Column) -> Column:
    """TX(GENE):change of the canonical transcripts' entries, without MODIFIER ones; if any has a protein change, only those that do."""
    mine = F.filter(entries, lambda e: F.array_contains(canonical, e["transcript"]))
    kept = lambda given, protein: F.filter(given, lambda e: (e["impact"] != "MODIFIER") & (~protein | (e["hgvs_p"] != "")))
    return all_changes(once(mine, lambda given: once(F.exists(given, lambda e: e["hgvs_p"] != ""), lambda protein: kept(given, protein))))


def all_changes(entries: Column) -> Column:
    """TX(GENE):change of every entry, the protein's change where there is one."""
    return F.array_join(F.transform(entries, lambda e: F.concat(e["transcript"], F.lit("("), e["gene"], F.lit("):"), F.when(e["hgvs_p"] != "", e["hgvs_p"]).otherwise(e["hgvs_c"]))), ", ")


def genes_of_impact(entries: Column, impact: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(entries, lambda e: e["impact"] == impact), lambda e: e["gene"]))), ", ")


def highest_impact(entries: Column) -> Column:
    """The gravest impact, MODIFIER if there is none; an unknown word is an error."""
    known = F.array(*[F.lit(i) for i in IMPACTS])
    ranks = F.transform(entries, lambda e: F.when(e["impact"].isin(*IMPACTS), F.array_position(known, e["impact"])).otherwise(F.raise_error(F.concat(F.lit("unknown impact "), e["impact"]))))
    return F.element_at(known, F.coalesce(F.array_min(ranks), F.lit(len(IMPACTS))).cast("int"))


def values_for_alt(values: Column, number: str, alt_index: Column, index: int = 0) -> Column:
    """Cell of a field for one ALT (0-based): by its Number A, R (index 0 the reference) or a count."""
    if number == "A":
        return F.coalesce(F.get(values, alt_index), F.lit(""))
    if number == "R":
        return F.coalesce(F.get(values, F.lit(0) if index == 0 else alt_index + 1), F.lit(""))
    if number.isdigit() and int(number) > 1:
        return F.coalesce(F.get(values, F.lit(index)), F.lit(""))
    return F.array_join(values, ",")


def union_aligned(first: DataFrame, later: DataFrame) -> DataFrame:
    """Rows of both with the first one's columns; what the later lacks is empty."""
    extra = [c for c in later.columns if c not in first.columns]
    return first.unionByName(later.drop(*extra), allowMissingColumns=True).fillna("")


def clean_name(name: str) -> str:
    """Non-alphanumeric bytes become underscores."""
    return "".join(chr(b) if chr(b).isalnum() and b < 128 else "_" for b in name.encode())


def create_table_sql(table: str, columns: list[tuple[str, str]]) -> str:
    """DDL text for columns of (name, header type): Integer and Float become INTEGER and REAL, the rest TEXT."""
    kinds = {"Integer": "INTEGER", "Float": "REAL"}
    inner = ", ".join(f"{clean_name(name)} {kinds.get(kind, 'TEXT')}" for name, kind in columns if name not in ("#", "alt #"))
    return f"CREATE TABLE {clean_name(table)}({inner});"
