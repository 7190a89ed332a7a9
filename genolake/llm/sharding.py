"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal text are a group and stay together. Every group is placed singly, the largest first, into the shard
where the dot product of the group with the residual capacity is highest, among those it fits. Groups that are large
against a shard, a bounded number, are placed first by one packing of all; the others are dealt by a hash of their text
to tasks, and each task packs its own groups into its share of what the large ones leave of each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpoint, documents, lean, partitions, range_of, splitters

#: A group with at least this share of any total is packed on the driver: at most 3 * LARGE of them exist.
LARGE = 4096
#: Groups of one task's packing, about.
GROUPS = 200_000


def pack(items: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The shard of each item. items: rows of (bytes, tokens, rows) as shares of a shard; left: the shards' residual capacity, which is used up.

    The largest item comes first (ties: the one listed first). It goes where its dot product with the residual capacity
    is highest among the shards that it fits; if it fits none in all dimensions, among those that it fits in bytes; if
    none, by the dot product in bytes alone, as bytes are what is to be near equal. Ties go to the first shard.
    """
    out = np.zeros(len(items), np.int64)
    rest = left.tolist()
    shards = range(len(rest))
    for i in np.lexsort((np.arange(len(items)), -items.max(axis=1))).tolist() if len(items) else ():
        a, b, c = items[i].tolist()
        room = [s for s in shards if rest[s][0] >= a - 1e-12]
        fits = [s for s in room if rest[s][1] >= b - 1e-12 and rest[s][2] >= c - 1e-12] or room
        chosen = max(fits, key=lambda s: a * rest[s][0] + b * rest[s][1] + c * rest[s][2]) if fits else max(shards, key=lambda s: a * rest[s][0])
        out[i] = chosen
        rest[chosen] = [x - y for x, y in zip(rest[chosen], (a, b, c))]
    left[:] = rest
    return out


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, n_tokens, shard, slot.

    size is the text's UTF-8 bytes plus 1 (null: no bytes, and a group with the empty text), and the sizes of the shards
    come out near equal. Equal texts share a shard; only a group whose bytes exceed a whole shard's part, so that no
    shard can hold it, is split by row into pieces of at most such a part. Slots count from 0 in each shard by ascending
    doc_id (null first), without gaps; equal ids are ordered by the text's hash. Other columns are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = F.size(F.array_remove(F.split(text, " "), ""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        tokens.cast("long").alias("n_tokens"), F.xxhash64(text).alias("key"), F.xxhash64(text, F.lit(7)).alias("key2"), F.monotonically_increasing_id().alias("row"),
    )
    rows = checkpoint(rows)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("a"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("b"), F.count("*").alias("c")).first()
    sums = [F.sum("size").alias("a"), F.sum("n_tokens").alias("b"), F.count("*").alias("c")]
    whole = np.array([max(1, total[x]) for x in "abc"], np.float64) / shards
    groups = checkpoint(rows.groupBy("key", "key2").agg(*sums))
    large = F.greatest(*[F.col(x) >= F.lit(max(1, total[x]) / LARGE) for x in "abc"])
    big = groups.where(large).orderBy("key", "key2").collect()
    pieces = [max(1, int(np.ceil(r["a"] / whole[0]))) for r in big]
    left = np.ones((shards, 3))
    parts = np.array([[r["a"] / n, r["b"] / n, r["c"] / n] for r, n in zip(big, pieces) for _ in range(n)], np.float64).reshape(-1, 3)
    placed = pack(parts / whole, left).tolist()
    firsts = np.cumsum([0, *pieces]).tolist()
    first = spark.createDataFrame([(r["key"], r["key2"], placed[i : i + n]) for r, n, i in zip(big, pieces, firsts)], "key long, key2 long, shards array<int>")
    small = groups.where(~large)
    n_small = small.count()
    tasks = max(1, min(partitions(spark), n_small // 1000), -(-n_small // GROUPS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if tables:
            table = pa.Table.from_batches(tables).sort_by([("key", "ascending"), ("key2", "ascending")])
            items = np.stack([table[x].to_numpy() for x in "abc"], axis=1) / whole
            # this task's part of what is left, by its own groups' part of all small groups' sizes in each dimension
            room = np.maximum(left, 0)
            room = room / np.maximum(room.sum(axis=0), 1e-300) * items.sum(axis=0)
            turn = int(table["part"][0].as_py()) % shards  # tasks begin with different shards, so small errors cancel out
            where = (pack(items, np.roll(room, -turn, axis=0)) + turn) % shards
            yield from pa.table([table["key"], table["key2"], pa.array(where, pa.int32())], ["key", "key2", "shard"]).to_batches(max_chunksize=10_000)

    part = F.pmod(F.col("key2"), F.lit(tasks)).cast("int")
    dealt = small.withColumn("part", part).repartitionById(tasks, F.col("part"))
    singles = checkpoint(dealt.mapInArrow(lean(run), "key long, key2 long, shard int"))
    by_row = rows.join(F.broadcast(first), ["key", "key2"], "left")  # at most 3 * LARGE rows
    shared = by_row.where("shards IS NOT NULL").withColumn("shard", F.element_at("shards", (F.pmod(F.xxhash64("row"), F.size("shards")) + 1).cast("int"))).drop("shards")
    others = by_row.where("shards IS NULL").drop("shards").join(singles, ["key", "key2"])
    return _slotted(others.unionByName(shared), rows)


def _slotted(sharded: DataFrame, rows: DataFrame) -> DataFrame:
    """Number the rows of each shard without gaps: by ranges of doc_id, and from the counts of the ranges before."""
    spark = rows.sparkSession
    n = rows.count()
    cuts = splitters(rows, "doc_id", max(4 * partitions(spark), -(-n // 1_000_000)))
    sharded = sharded.withColumn("range", range_of(F.col("doc_id"), cuts).cast("int"))
    counts = sharded.groupBy("shard", "range").count()
    before = counts.withColumn("before", F.sum("count").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1))).select("shard", "range", F.coalesce("before", F.lit(0)).alias("before"))
    order = W.partitionBy("range", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "key", "row")
    ranked = sharded.withColumn("rank", F.row_number().over(order) - 1)
    slotted = ranked.join(before, ["shard", "range"])  # a row for each shard and million rows
    return slotted.select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
