"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs, with native column functions only.

A text is cut at line ends and after sentence ends into units. Each unit is hashed to a vector: 126 lanes of
one bit and four wide words. The fingerprint is the sum over the units, each lane modulo 2^20, each wide word
modulo 2^31, and the count of units. So the order of units doesn't matter, equal multisets of units have equal
fingerprints, and a unit is inserted or deleted by one vector addition or subtraction. The lanes, read as
sums of +1 and -1, also estimate the cosine of two multisets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, partitions, range_of, splitters

#: Bits that one long takes from a hash: three lanes, 21 bits apart.
TAKE = 1 | 1 << 21 | 1 << 42
#: A lane's 20 bits, three times; the 21st bit of each is a guard that catches the carry.
LANES = ((1 << 20) - 1) * TAKE
GUARDS = (1 << 20) * TAKE
WIDE = (1 << 31) - 1
PACKED = 42
LENGTH = PACKED + 5
#: Units whose sums are gathered at once; no lane can overflow within so many.
BLOCK = 1 << 20
UNIT_END = r"[\r\n]+|(?<=[.!?])\s+"


def units(text: Column) -> Column:
    """A text's paragraphs, cut further at sentence ends; empty units and surrounding spaces don't count."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), UNIT_END), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def _sum(left: Column, right: Column, i: Column) -> Column:
    return (left + right).bitwiseAND(F.when(i < PACKED, F.lit(LANES)).when(i < LENGTH - 1, F.lit(WIDE)).otherwise(F.lit((1 << 62) - 1)))


def _hashes(unit: Column) -> tuple[Column, Column]:
    """Two hashes of a unit; an empty unit counts for nothing."""
    return F.when(unit == "", F.lit(0).cast("long")).otherwise(F.xxhash64(unit)), F.when(unit == "", F.lit(0).cast("long")).otherwise(F.xxhash64(unit, F.lit(1)))


def _vector(p: Column, q: Column, one: Column) -> list[Column]:
    """The addends of a unit with the hashes p and q."""
    bits = [F.shiftrightunsigned(h, i).bitwiseAND(TAKE) for h in (p, q) for i in range(21)]
    return [*bits, *[F.shiftrightunsigned(h, i).bitwiseAND(WIDE) for h in (p, q) for i in (0, 31)], one]


def fingerprint(units: Column) -> Column:
    """The fingerprint of an array of units: 42 longs of three lanes each, four wide words, the number of units."""
    vectors = F.transform(F.filter(units, lambda u: u != ""), lambda u: F.array(*_vector(*_hashes(u), F.lit(1).cast("long"))))
    return F.aggregate(vectors, F.array_repeat(F.lit(0).cast("long"), LENGTH), combine)


def fingerprint_rows(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """One row for each value of the keys, with the fingerprint of each text column under its new name.

    texts: text column to the fingerprint's name. The units are exploded and summed by partial aggregation in
    generated code, in blocks short enough that no lane overflows; the blocks' sums are then combined.
    """
    def tagged(k: int, text: str) -> Column:
        parts = F.split(F.coalesce(F.col(text), F.lit("")), UNIT_END)
        return F.transform(parts, lambda u, i: F.struct(F.lit(k).alias("kind"), F.floor(i / BLOCK).cast("int").alias("block"), u.alias("unit")))

    kinds = F.concat(*[tagged(k, text) for k, text in enumerate(texts)])
    each = df.select(*keys, F.inline(kinds)).withColumn("unit", F.trim("unit"))
    p, q = _hashes(F.col("unit"))
    hashed = each.select(*keys, "kind", "block", p.alias("p"), q.alias("q"), F.when(F.col("unit") == "", 0).otherwise(1).cast("long").alias("one"))
    sums = hashed.groupBy(*keys, "kind", "block").agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(_vector(F.col("p"), F.col("q"), F.col("one")))])
    packed = sums.select(*keys, F.struct("kind", F.array(*[F.col(f"s{i}").bitwiseAND(LANES if i < PACKED else WIDE if i < LENGTH - 1 else (1 << 62) - 1) for i in range(LENGTH)]).alias("v")).alias("part"))
    gathered = packed.groupBy(*keys).agg(F.collect_list("part").alias("parts"))

    def of(k: int) -> Column:
        mine = F.filter("parts", lambda x: x["kind"] == k)
        return F.when(F.size(mine) == 1, mine[0]["v"]).otherwise(F.aggregate(mine, F.array_repeat(F.lit(0).cast("long"), LENGTH), lambda acc, x: combine(acc, x["v"])))

    return gathered.select(*keys, *[of(k).alias(name) for k, name in enumerate(texts.values())])


def insert(fp: Column, units_: Column) -> Column:
    """The fingerprint after these units were added."""
    return combine(fp, fingerprint(units_))


def combine(left: Column, right: Column) -> Column:
    """The fingerprint of two multisets put together."""
    return F.zip_with(left, F.transform(right, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda a, b: _sum(a, b["x"], b["i"]))


def delete(fp: Column, units_: Column) -> Column:
    """The fingerprint after these units, which it holds, were taken out."""
    return F.transform(
        F.arrays_zip(fp.alias("l"), fingerprint(units_).alias("r")),
        lambda x, i: F.when(i < PACKED, (x["l"].bitwiseOR(GUARDS) - x["r"]).bitwiseAND(LANES)).when(i < LENGTH - 1, (x["l"] - x["r"]).bitwiseAND(WIDE)).otherwise(x["l"] - x["r"]),
    )


def to_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Estimated cosine of two multisets of units, 0 to 1: 1 for equal fingerprints, 0 if just one is empty."""
    n, m = F.element_at(left, LENGTH), F.element_at(right, LENGTH)
    lane = lambda x, k, count: 2 * F.shiftrightunsigned(x, 21 * k).bitwiseAND((1 << 20) - 1) - count
    pairs = F.slice(F.arrays_zip(left.alias("l"), right.alias("r")), 1, PACKED)
    sums = F.aggregate(
        pairs,
        F.struct(*[F.lit(0.0).alias(c) for c in ("d", "l", "r")]),
        lambda acc, x: F.struct(
            (acc["d"] + sum(lane(x["l"], k, n) * lane(x["r"], k, m) for k in range(3))).alias("d"),
            (acc["l"] + sum(lane(x["l"], k, n) * lane(x["l"], k, n) for k in range(3))).alias("l"),
            (acc["r"] + sum(lane(x["r"], k, m) * lane(x["r"], k, m) for k in range(3))).alias("r"),
        ),
        lambda acc: F.when((acc["l"] > 0) & (acc["r"] > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), acc["d"] / F.sqrt(acc["l"] * acc["r"])))).otherwise(0.0),
    )
    return F.when(left == right, F.lit(1.0)).otherwise(sums)


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add next_<column>: the value in the row that follows by ascending key; the first row follows the last.

    Rows are dealt into key ranges by quantiles; the first rows of a range also go, as ghosts, to the range
    before, so that no window spans more than a range. Null keys come first; equal keys are ordered by the columns.
    """
    spark = df.sparkSession
    cuts = splitters(df, key, 4 * partitions(spark))
    first = df.agg(F.min(key).alias("k"), F.count(F.when(F.col(key).isNull(), 1)).alias("nulls")).first()
    own = range_of(F.col(key), cuts)
    starts = F.col(key).isNull() if first["nulls"] else F.coalesce(F.col(key) == F.lit(first["k"]), F.lit(False))
    at = lambda r, lap, ghost: F.struct(r.cast("int").alias("__range"), F.lit(lap).alias("__lap"), F.lit(ghost).alias("__ghost"))
    opens = F.coalesce(F.col(key).isin(cuts), F.lit(False)) if cuts else F.lit(False)
    places = F.filter(
        F.array(at(own, 0, False), F.when(opens, at(own - 1, 0, True)), F.when(starts, at(F.lit(len(cuts)), 1, True))),
        lambda x: x.isNotNull(),
    )
    dealt = df.select("*", F.inline(places))
    w = W.partitionBy("__range").orderBy("__lap", F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in columns if c != key])
    led = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("__ghost")).drop("__range", "__lap", "__ghost")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text (its last half replaced by the next document's first half).

    Returns doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (arrays of longs), near_edited,
    near_next. A null text is empty; an empty text has the zero fingerprint and is like another empty one (1.0).
    Repeated rows stay rows of their own; an empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    led = with_next(base, "doc_id", ["text"]).withColumn("row", F.monotonically_increasing_id())
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    put = F.least(half, F.char_length("next_text"))
    led = led.select("row", "doc_id", n.cast("long").alias("n_chars"), "text", "next_text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), put)).alias("edited"))
    keyed = led.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    out = fingerprint_rows(keyed, ["row", "doc_id", "n_chars", "edited_sha256"], {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": "next_fingerprint"})
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_documents(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", "edited_sha256", to_hex(F.col("fingerprint")).alias("fingerprint"), to_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
