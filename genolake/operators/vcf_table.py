"""Variant files as wide tables, and edits of their headers.

The header is read on the driver and decides the projection; the records then go through one select.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import fixed
from .variants import IMPACTS, all_changes, annotations, canonical_changes, genes_of_impact, highest_impact, of_allele, union_aligned

_FIELD = re.compile(r'^##(INFO|FORMAT)=<ID=([^,]+),Number=([^,]+),Type=([^,>]+)')
#: The order of header lines after a clean-up.
HEADER_ORDER = ("fileformat", "additional", "ALT", "FILTER", "INFO", "FORMAT", "contig")


@dataclass(frozen=True)
class Field:
    kind: str
    id: str
    number: str
    type: str


def fields(header: list[str]) -> list[Field]:
    return [Field(*m.groups()) for line in header if (m := _FIELD.match(line))]


def _parts(field: Field, split: bool) -> list[tuple[str, int]]:
    """Suffix and index of each column of a field."""
    if field.number == "R":
        return [("__Ref", 0), ("__Alt", 1)]
    if field.number.isdigit() and int(field.number) > 1:
        return [(f"__{i}", i) for i in range(int(field.number))]
    return [("", 0)]


def _cell(values: Column, field: Field, index: int, split: bool) -> Column:
    """One value of a field: a list is joined by commas, what is missing is empty."""
    values = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())
    at = lambda i: F.coalesce(F.get(values, i), F.lit(""))
    if field.type == "Flag":
        return values
    if field.number == "R":
        if index == 0:
            return at(F.lit(0))
        return at(F.col("alt_at") + 1) if split else F.array_join(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), ",")
    if field.number == "A" and split:
        return at(F.col("alt_at"))
    if field.number.isdigit() and int(field.number) > 1:
        return at(F.lit(index))
    return F.array_join(values, ",")


def _has(key: str) -> Column:
    return F.exists("info", lambda e: e["key"] == key)


def _share(total: Column):
    """Three decimals of a depth over the total; null if either is no number, NaN or inf if the total is 0."""
    whole = F.get(total, F.lit(0)).try_cast("double")

    def share(depth: Column) -> Column:
        own = depth.try_cast("double")
        return F.when((whole == 0) & own.isNotNull(), F.when(own == 0, "NaN").otherwise("inf")).otherwise(fixed(own / F.nullif(whole, F.lit(0.0)), 3))

    return share


def to_table(records: DataFrame, header: list[str], samples: list[str], split: bool = True, info: list[str] | None = None, fmt: list[str] | None = None, priority_info: list[str] | None = None, priority_fmt: list[str] | None = None, canonical: list[str] | None = None, group: str | None = None, names: list[str] | None = None) -> DataFrame:
    """One row per record, or per ALT if split, all texts: #, [Group Name], [alt #], CHROM ... ALT, [Canonical Gene, SnpEff Impact], VAFs,
    the priority INFO and FORMAT columns, [SnpEff and GeneImpact columns], QUAL, FILTER, INFO and FORMAT columns.

    info and fmt choose and order the fields; by default all of the header, by their ids, without the priority ones.
    The annotation columns come if the header has ANN, Canonical Gene if a list of transcripts is given too. names
    replace the samples' names in the columns, group names the input. A record without ALT gives no row when split.
    records also has number, its place in the file from 1. VAF is the ALT's depth over DP with three decimals, empty if
    either is missing.
    """
    first = {"INFO": priority_info or [], "FORMAT": priority_fmt or []}
    known = {(f.kind, f.id): f for f in fields(header)}
    chosen = {kind: [known[kind, i] for i in (sorted(i for k, i in known if k == kind) if ids is None else ids) if (kind, i) in known and i not in first[kind]] for kind, ids in (("INFO", info), ("FORMAT", fmt))}
    rows = records
    if split:
        rows = rows.select("*", F.posexplode("alt").alias("alt_at", "one_alt"))
    of_info = lambda i: F.get(F.transform(F.filter("info", lambda e: e["key"] == i), lambda e: e["values"]), F.lit(0))

    def of_sample(s: int, i: str) -> Column:
        place = F.array_position("format", i).cast("int")
        value = F.get(F.get("genotypes", F.lit(s)), place - 1)
        return F.when((place > 0) & (value != "."), F.split(value, ","))

    def of_info_fields(these: list[Field]) -> list[Column]:
        flags = lambda f: [F.when(_has(f.id), "TRUE").otherwise("FALSE").alias(f.id)]
        return [c for f in these for c in (flags(f) if f.type == "Flag" else [_cell(of_info(f.id), f, k, split).alias(f.id + suffix) for suffix, k in _parts(f, split)])]

    titles = names or samples

    def of_format_fields(these: list[Field]) -> list[Column]:
        return [_cell(of_sample(s, f.id), f, k, split).alias(f"{title}__{f.id}{suffix}") for s, title in enumerate(titles) for f in these for suffix, k in _parts(f, split)]

    out: list[Column] = [F.col("number").cast("string").alias("#")]
    if group is not None:
        out.append(F.lit(group).alias("Group Name"))
    if split:
        out.append((F.col("alt_at") + 1).cast("string").alias("alt #"))
    out += [F.col("chrom").alias("CHROM"), F.col("pos").cast("string").alias("POS"), F.array_join("id", ",").alias("ID"), F.col("ref").alias("REF"), (F.col("one_alt") if split else F.array_join("alt", ",")).alias("ALT")]
    annotated = ("INFO", "ANN") in known
    entries = annotations(F.coalesce(of_info("ANN"), F.array().cast("array<string>")))
    if split:
        entries = of_allele(entries, F.col("one_alt"))
    if annotated:
        rows, entries = rows.withColumn("__ann", entries), F.col("__ann")  # parsed once for all columns that tell of it
    told = lambda c: F.when(_has("ANN"), c).otherwise("")
    if annotated:
        listed = F.array(*[F.lit(x) for x in canonical or []]).cast("array<string>")
        if canonical is not None:
            out.append(told(canonical_changes(entries, listed)).alias("Canonical Gene"))
        mine = entries if canonical is None else F.filter(entries, lambda e: F.array_contains(listed, e["transcript"]))
        out.append(told(highest_impact(mine)).alias("SnpEff Impact"))
    many = 0 if split else records.agg(F.max(F.size("alt"))).first()[0] or 0
    for s, title in enumerate(titles):
        depth, total = of_sample(s, "AD"), of_sample(s, "DP")
        share = _share(total)
        if split:
            out.append(F.coalesce(share(F.get(depth, F.col("alt_at") + 1)), F.lit("")).alias(f"{title}__VAF"))
        else:
            out.append(F.array_join(F.filter(F.array(*[F.when(F.size("alt") > k, share(F.get(depth, F.lit(k + 1)))) for k in range(many)]) if many else F.array().cast("array<string>"), lambda v: v.isNotNull()), ",").alias(f"{title}__VAF"))
    out += of_info_fields([known["INFO", i] for i in first["INFO"]]) + of_format_fields([known["FORMAT", i] for i in first["FORMAT"]])
    if annotated:
        out += [told(all_changes(entries)).alias("SnpEff"), *[told(genes_of_impact(entries, x)).alias(f"GeneImpact__{x}") for x in IMPACTS]]
    raw = F.col("qual_raw")
    out += [F.when(raw == ".", "").otherwise(raw).alias("QUAL"), F.array_join("filter", ",").alias("FILTER")]
    return rows.select(*out, *of_info_fields(chosen["INFO"]), *of_format_fields(chosen["FORMAT"]))


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables with the first one's columns, matched by their names (samples under their new names); what a later table lacks is empty."""
    out = tables[0]
    for later in tables[1:]:
        out = union_aligned(out, later)
    return out


def header_kind(line: str) -> str:
    """fileformat, ALT, FILTER, INFO, FORMAT, contig or other."""
    found = re.match(r"^##(fileformat|ALT|FILTER|INFO|FORMAT|contig)=", line)
    return found[1] if found else "other"


def standard_header(header: list[str], additional: list[str] | None = None) -> list[str]:
    """Header lines of the known kinds in a fixed order, the additional ones after the file format; others go."""
    kinds: dict[str, list[str]] = {k: [] for k in (*HEADER_ORDER, "other")}
    for line in header:
        if line.startswith("##"):
            kinds[header_kind(line)].append(line)
    kinds["additional"] = additional or []
    return [line for k in HEADER_ORDER for line in kinds[k]] + [x for x in header if not x.startswith("##")]


def header_with_contigs(header: list[str], used: list[str]) -> list[str]:
    """Contig lines of the used contigs only, in byte order, just before the column names; known lines keep their text."""
    name = lambda line: re.match(r"^##contig=<ID=([^,>]+)", line)[1]
    known = {name(x): x for x in header if x.startswith("##contig=")}
    lines = [known.get(c, f"##contig=<ID={c}>") for c in sorted(used, key=str.encode)]
    rest = [x for x in header if not x.startswith("##contig=")]
    return [x for x in rest if x.startswith("##")] + lines + [x for x in rest if not x.startswith("##")]


def keep_header_fields(header: list[str], kind: str, keep: list[str]) -> list[str]:
    """All other lines first, then the kept INFO or FORMAT lines in the order of the list, then the column names."""
    mine = {m[2]: x for x in header if (m := _FIELD.match(x)) and m[1] == kind}
    rest = [x for x in header if x.startswith("##") and x not in mine.values()]
    return rest + [mine[k] for k in keep if k in mine] + [x for x in header if not x.startswith("##")]


#: INFO lines of the counts, in the order in which they are added.
COUNT_LINES = (
    ("AC", "A", "Integer", "Allele count in genotypes, for each ALT allele, in the same order as listed"),
    ("AN", "1", "Integer", "Total number of alleles in called genotypes"),
    ("AF", "A", "Float", "Allele Frequency, for each ALT allele, in the same order as listed"),
    ("GenotypeCount", "G", "Integer", "Genotype count in called genotypes. Refer to Genotype Ordering section in VCF v4.3 specification for ordering of genotypes."),
    ("nhomalt", "A", "Integer", "Count of homozygous individuals"),
)


def header_with_counts(header: list[str], suffixes: list[str]) -> list[str]:
    """INFO lines for allele counts, with each suffix, where they are absent."""
    present = {f.id for f in fields(header) if f.kind == "INFO"}
    new = [f'##INFO=<ID={i}{s},Number={n},Type={t},Description="{d}">' for s in suffixes for i, n, t, d in COUNT_LINES if i + s not in present]
    return [x for x in header if x.startswith("##")] + new + [x for x in header if not x.startswith("##")]


def header_with_names(header: list[str], mapping: dict[str, str]) -> list[str]:
    """Contig lines under their new names, with the length only; other lines as they are."""

    def renamed(line: str) -> str:
        name, length = re.search(r"[<,]ID=([^,>]+)", line)[1], re.search(r"[<,]length=(\d+)", line)
        return f"##contig=<ID={mapping.get(name, name)}{',length=' + length[1] if length else ''}>"

    return [renamed(x) if x.startswith("##contig") else x for x in header]


def header_with_samples(header: list[str], names: list[str]) -> list[str]:
    """The column line with other sample names."""
    return ["\t".join([*x.split("\t")[:9], *names]) if x.startswith("#CHROM") else x for x in header]


def table_columns(header: list[str], table_columns_: list[str]) -> list[tuple[str, str]]:
    """Name and type of a table's columns for DDL: of fields as the header declares them, POS an integer, QUAL a float."""
    kinds = {f.id: f.type for f in fields(header) if f.kind == "INFO"}
    formats = {f.id: f.type for f in fields(header) if f.kind == "FORMAT"}
    fixed_kinds = {"POS": "Integer", "QUAL": "Float"}

    def kind(name: str) -> str:
        head, *rest = name.split("__")
        return fixed_kinds.get(name) or (formats.get(rest[0], "String") if rest and rest[0] in formats else kinds.get(head, "String"))

    return [(name, kind(name)) for name in table_columns_]
