"""Column functions on genotypes: parsing, allele counts, VCF genotype order, exact decimals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALID_GT = r"^[0-9.]+([|/][0-9.]+)*$"


def alleles(gt: Column) -> Column:
    """Called allele numbers of a GT text; none if it can't be parsed; missing ones (.) are left out."""
    parts = F.filter(F.split(gt, "[/|]"), lambda a: a.rlike("^[0-9]+$"))
    return F.when(gt.rlike(VALID_GT), F.transform(parts, lambda a: a.cast("int"))).otherwise(F.array().cast("array<int>"))


def genotype_index(sorted_alleles: Column) -> Column:
    """Place of a genotype in the VCF "G" order: sum of C(a_m + m, m + 1) over the ascending alleles."""

    def combination(n: Column, k: Column) -> Column:
        # a product over i = 1..k of (n - k + i) / i, exact at each step
        return F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(1).cast("long"), lambda acc, i: F.floor(acc * (n - k + i) / i).cast("long"))

    placed = F.transform(sorted_alleles, lambda a, m: combination(a + m, m + 1))
    return F.aggregate(placed, F.lit(0).cast("long"), lambda acc, x: acc + x)


def number_of_genotypes(n_alt: Column, ploidy: int = 2) -> Column:
    """How many unordered genotypes n_alt alternatives and the reference allow."""
    out = F.lit(1).cast("long")
    for i in range(1, ploidy + 1):
        out = F.floor(out * (n_alt + i) / i).cast("long")
    return out


def decode_gt(gt: Column, ref: Column, alt: Column) -> Column:
    """A GT text with bases for numbers; separators and . stay, numbers out of range become ?."""
    bases = F.concat(F.array(ref), alt)
    numbers = F.regexp_extract_all(gt, F.lit(r"[0-9]+|\."), F.lit(0))
    marks = F.concat(F.regexp_extract_all(gt, F.lit(r"[/|]"), F.lit(0)), F.array(F.lit("")))
    named = F.transform(numbers, lambda n: F.when(n == ".", ".").otherwise(F.coalesce(F.try_element_at(bases, n.cast("int") + 1), F.lit("?"))))
    return F.array_join(F.zip_with(named, F.slice(marks, 1, F.size(numbers)), lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")


@F.pandas_udf(T.StringType())
def _fixed(value: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else format(v, f".{int(d)}f") for v, d in zip(value, digits)], dtype=object)


def fixed(value: Column, digits: int) -> Column:
    """Decimal text rounded half-even on the exact binary value, which Spark's own formatting isn't."""
    return _fixed(value, F.lit(digits))
