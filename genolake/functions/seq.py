"""Column functions on base sequences."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: what a higher-order function's lambda names is computed again for each element otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reverse_complement(seq: Column) -> Column:
    """A-T and C-G are exchanged, every other sign (lower case too) becomes N, and the order is reversed."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def bases(seq: Column, at: Column, size: Column | int) -> Column:
    """size signs from 0-based place at. Sequences are ASCII, and bytes are found without walking there sign by sign."""
    return F.substring(seq.cast("binary"), at.cast("int") + 1, F.lit(size) if isinstance(size, int) else size.cast("int")).cast("string")


def kmers(seq: Column, k: int) -> Column:
    """Array of (pos, kmer), 0-based; empty for sequences shorter than k."""
    at = F.when(F.octet_length(seq) >= k, F.sequence(F.lit(0), F.octet_length(seq) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), bases(seq, i, k).alias("kmer")))


def gc_bases(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^GC]", ""))
