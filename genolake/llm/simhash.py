"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a pigeonring-filtered Hamming join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, components, documents, lean, unused

SEED = 42
BITS = 64
#: Segments of the ring; with d differing bits some chain of SEGMENTS // d - 1 equal neighbours must exist.
SEGMENTS = 16
#: Rows of a chain's bucket up to which its pairs are checked one by one; larger buckets take the exact way by midpoints.
PAIRWISE = 32


def _word_hashes(text: str | None, words: int) -> np.ndarray:
    folded = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(folded)
    if not n:
        return np.empty(0, np.uint64)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(folded), SEED)], np.uint64)
    line = b" ".join(folded)
    ends = np.cumsum(np.fromiter(map(len, folded), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())), np.uint64, n - words + 1)


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint, unsigned: a bit is set if over half of the shingles' hashes have it. No words: zero."""
    return majority(_word_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """The bits, as an unsigned number, that over half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of each row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(lean(run), "doc_id long, fp long")


def _chains(fp, distance: int):
    """Keys of the pigeonring filter: for each segment of the ring, it and the segments after it that must be equal.

    If two fingerprints differ in at most distance bits, some segment starts a chain in which every run of l
    segments has at most l * distance / SEGMENTS differing bits, so its first runs, below one bit, are equal.
    """
    width = BITS // SEGMENTS
    equal = (SEGMENTS - 1) // distance if distance else SEGMENTS
    keys = []
    for s in range(SEGMENTS):
        turned = F.shiftleft(fp, (BITS - s * width) % BITS).bitwiseOR(F.shiftrightunsigned(fp, s * width)) if s else fp
        mask = -1 if equal * width >= BITS else (1 << equal * width) - 1
        keys.append(F.struct(F.lit(s).alias("segment"), turned.bitwiseAND(F.lit(mask)).alias("chain")))
    return F.array(*keys)


def _in_budget(diff, start, distance: int):
    """The whole chain condition: each run of l segments from the start has at most l * distance / SEGMENTS differing bits."""
    width = BITS // SEGMENTS
    turned = F.when(start == 0, diff).otherwise(F.call_function("shiftleft", diff, BITS - start * width).bitwiseOR(F.call_function("shiftrightunsigned", diff, start * width)))
    ok = F.lit(True)
    for run in range(1, SEGMENTS + 1):
        mask = -1 if run == SEGMENTS else (1 << run * width) - 1
        ok = ok & (F.bit_count(turned.bitwiseAND(F.lit(mask))) <= run * distance // SEGMENTS)
    return ok


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Edges a < b among distinct fingerprints (column fp) that keep the components of "at most distance bits differ".

    Every bucket of at most PAIRWISE fingerprints gives its pairs, filtered by the chain's budgets and then by
    the full Hamming distance. In a larger bucket, where pairs would grow with its square, each fingerprint
    gives all values within half the distance; two of them are within the distance just if they have such a
    value in common (for an even distance), so a star around each value keeps the components.
    """
    keyed = fps.select("fp", F.inline(_chains(F.col("fp"), distance)))
    sizes = keyed.groupBy("segment", "chain").agg(F.count("*").alias("n")).where("n > 1")
    crowded = checkpoint(keyed.join(sizes, ["segment", "chain"]))
    few = crowded.where(F.col("n") <= PAIRWISE).select("segment", "chain", "fp")
    pairs = few.select("segment", "chain", F.col("fp").alias("a")).join(few.select("segment", "chain", F.col("fp").alias("b")), ["segment", "chain"]).where("a < b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    near = pairs.where(_in_budget(diff, F.col("segment"), distance) & (F.bit_count(diff) <= distance)).select("a", "b").distinct()
    reach = [0]
    for _ in range(distance // 2):
        reach = sorted({r ^ (1 << b) for r in reach for b in range(BITS)} | set(reach))
    signed = [r - (1 << BITS) if r >= 1 << (BITS - 1) else r for r in reach]
    many = crowded.where(F.col("n") > PAIRWISE).select("fp").distinct()
    balls = many.select("fp", F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in signed]), lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    hubs = balls.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    spokes = balls.join(hubs, "point").where("a <> fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(spokes.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the least doc_id reachable by links of at most distance bits).

    Texts without words have fingerprint zero, linked like any other. Rows with equal ids stay rows; a null id is
    never a component's id unless its component has no other. An empty table gives an empty result.
    """
    if distance % 2:
        raise ValueError("the midpoint way is exact for even distances only")
    marked = checkpoint(fingerprints(docs, id_col, text_col, words))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reached = components(links(nodes.select("fp"), distance))
    placed = nodes.join(reached, nodes.fp == reached.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """docs without the documents that have a near-duplicate of smaller id; columns as they were, whatever their names.

    Rows of one id stay or go together; a row with a null id stays; texts without words (null or empty ones too) count
    as copies of each other. An empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col, words, distance)
    name = unused("gone_id", docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
