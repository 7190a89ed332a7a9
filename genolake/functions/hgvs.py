"""HGVS-like positions: parse and print."""

from pyspark.sql import Column
from pyspark.sql import functions as F

POSITION = r"^([gnc])\.([*-]?)(\d+)(?:([+-])(\d+))?$"


def parse(text: Column) -> Column:
    """Struct (kind, side, base 0-based, offset signed); null fields if the text is no position.

    kind g allows neither side nor offset, kind n no side.
    """
    part = lambda i: F.regexp_extract(text, POSITION, i)
    ok = text.rlike(POSITION) & ~((part(1) == "g") & ((part(2) != "") | (part(4) != ""))) & ~((part(1) == "n") & (part(2) != ""))
    base = part(3).try_cast("long")
    offset = F.when(part(5) == "", 0).otherwise(F.concat(part(4), part(5)).try_cast("long"))
    return F.when(ok & (base >= 1), F.struct(part(1).alias("kind"), part(2).alias("side"), (base - 1).alias("base"), offset.cast("long").alias("offset")))


def show(kind: Column, side: Column, base: Column, offset: Column) -> Column:
    """Print a position; base is 0-based, side is "", "-" (before the CDS) or "*" (after it)."""
    tail = F.when(offset > 0, F.concat(F.lit("+"), offset.cast("string"))).when(offset < 0, offset.cast("string")).otherwise("")
    return F.concat(kind, F.lit("."), side, (base + 1).cast("string"), tail)


def show_range(kind: Column, first: Column, last: Column) -> Column:
    """Print a range of two printed positions of one kind, as kind.a_b; a single position if they are equal."""
    body = lambda t: F.substring_index(t, ".", -1)
    return F.concat(kind, F.lit("."), F.when(first == last, body(first)).otherwise(F.concat(body(first), F.lit("_"), body(last))))


def order_key(position: Column, side: Column | None = None) -> Column:
    """A sort key of positions (base, offset): at one base what comes before it, it, and what comes after it; with a side (-, empty, *) before, within and after the coding sequence.

    Before the coding sequence bases count away from it, so there the order is reversed.
    """
    side = F.lit("") if side is None else side
    back = F.when(side == "-", -1).otherwise(1)
    rank = F.when(side == "-", -1).when(side == "*", 1).otherwise(0)
    return F.struct(rank.alias("part"), (back * position["base"]).alias("base"), (back * position["offset"]).alias("offset"))
