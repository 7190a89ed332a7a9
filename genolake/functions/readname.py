"""Read names of sequencers, and hashes that sample by key."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seq import once

ILLUMINA = r"^(.*):(\d+):(\d+):(\d+)(?: ([12]):(.*))?$"


def illumina(name: Column) -> Column:
    """Struct prefix, tile, x, y, read, index of an Illumina name; null if it is none."""
    part = lambda i: F.regexp_extract(name, ILLUMINA, i)
    return F.when(name.rlike(ILLUMINA), F.struct(part(1).alias("prefix"), part(2).cast("int").alias("tile"), part(3).cast("int").alias("x"), part(4).cast("int").alias("y"), part(5).try_cast("int").alias("read"), part(6).alias("index")))


#: Read names as they stand in FASTQ files (after the @) and in aligned files.
ILLUMINA_FASTQ = r"^([\w\-]+:\w+:\w+:\d):(\d+):(\d+):(\d+) (\d):([NY]:\d+:.*)$"
ILLUMINA_BAM = r"^([\w\-]+:\w+:\w+:\d):(\d+):(\d+):(\d+)( .*)?$"
DNBSEQ_FASTQ = r"^([EV]\d+B?L\dC)(\d{3}R\d{3})(\d+)/([12])$"
DNBSEQ_BAM = r"^([EV]\d+B?L\dC)(\d{3}R\d{3})(\d+)(?:/([12]))?$"


def _parsed(name: Column, pattern: str, parts: tuple[tuple[str, str], ...]) -> Column:
    # the groups hold no line ends, so one replacement tells them all
    got = F.split(F.regexp_replace(name, pattern, "\n".join(f"${i + 1}" for i in range(len(parts)))), "\n")
    return F.when(name.rlike(pattern), once(got, lambda x: F.struct(*[x[i].try_cast(kind).alias(part) for i, (part, kind) in enumerate(parts)])))


def illumina_fastq(name: Column) -> Column:
    """Struct prefix, tile, x, y, read, index of a name in a FASTQ file; null if it is none."""
    return _parsed(name, ILLUMINA_FASTQ, (("prefix", "string"), ("tile", "int"), ("x", "int"), ("y", "int"), ("read", "int"), ("index", "string")))


def illumina_bam(name: Column) -> Column:
    """Struct prefix, tile, x, y of a name in an aligned file; null if it is none."""
    return _parsed(name, ILLUMINA_BAM, (("prefix", "string"), ("tile", "int"), ("x", "int"), ("y", "int")))


def dnbseq_fastq(name: Column) -> Column:
    """Struct prefix, group, index (a text), read of a name in a FASTQ file; null if it is none."""
    return _parsed(name, DNBSEQ_FASTQ, (("prefix", "string"), ("group", "string"), ("index", "string"), ("read", "int")))


def dnbseq_bam(name: Column) -> Column:
    """Struct prefix, group, index, read (null without /1 or /2) of a name in an aligned file; null if it is none."""
    return _parsed(name, DNBSEQ_BAM, (("prefix", "string"), ("group", "string"), ("index", "string"), ("read", "int")))


def name_type(name: Column, name_2: Column) -> Column:
    """Illumina or DNBSeq, by the names of two mates; an error if they are of neither kind or don't belong together."""
    shown = F.concat(name, F.lit(" / "), name_2)
    a, b, c, d = illumina_fastq(name), illumina_fastq(name_2), dnbseq_fastq(name), dnbseq_fastq(name_2)
    mates = lambda x, y, parts: F.coalesce((x["read"] == 1) & (y["read"] == 2) & F.struct(*[x[p] for p in parts]).eqNullSafe(F.struct(*[y[p] for p in parts])), F.lit(False))
    bad = lambda text: F.raise_error(F.concat(F.lit(text), shown)).cast("string")
    return (
        F.when(a.isNotNull(), F.when(mates(a, b, ("prefix", "index")), "Illumina").otherwise(bad("unmatched read names: ")))
        .when(c.isNotNull(), F.when(mates(c, d, ("prefix", "group", "index")), "DNBSeq").otherwise(bad("unmatched read names: ")))
        .otherwise(bad("unknown read names: "))
    )


def tag_text(tags: Column, key: str) -> Column:
    """The value of an optional field KEY:Z:... or KEY:H:..., null for other kinds and where it is missing."""
    return F.get(F.transform(F.filter(tags, lambda t: t.startswith(f"{key}:Z:") | t.startswith(f"{key}:H:")), lambda t: F.substring(t, len(key) + 4, 1 << 30)), F.lit(0))


def index_pair(name: Column) -> Column:
    """The two indexes of a name that ends in :a+b."""
    return F.split(F.trim(F.substring_index(name, ":", -1)), r"\+")


def in_sample(key: Column, rate: float, seed: int = 0) -> Column:
    """Whether a key (a read or pair name) is sampled: a seeded hash of the key alone decides, so mates stay together."""
    if not 0 < rate <= 1:
        raise ValueError("the rate must be above 0 and at most 1")
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30))
