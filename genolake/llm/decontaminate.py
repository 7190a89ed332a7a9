"""Benchmark decontamination with native functions only.

The benchmark's windows (runs of normalised words) are a set of checked size that is broadcast. A document's
word windows are not all looked up: each window of L words holds exactly one run of g words that starts at a
multiple of L - g + 1, so only those anchors are scanned against the set of the benchmark's runs of g words.
Around each anchor that is found, every window is then verified in full, first by hash and then by its words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, unused

WINDOW = 10
#: Rows of the benchmark's window table, and bytes of its windows and item ids, up to which it is broadcast; a larger one
#: is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 128 << 20
#: ASCII signs that words can't hold.
SEPARATORS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def words(text: Column) -> Column:
    """Normalised words: A-Z lower-cased, other ASCII signs separate. Null has none."""
    folded = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + SEPARATORS, string.ascii_lowercase + " " * len(SEPARATORS))
    return F.array_remove(F.split(folded, " "), "")


def anchor_length(n: int) -> int:
    return max(1, n // 2)


def _starts(size: Column, n: Column | int, step: Column | int) -> Column:
    """0, step, ... as far as a run of n words fits."""
    return F.when(size >= n, F.sequence(F.lit(0), size - n, F.lit(step))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each distinct window: n (its words), hash, window (joined words), item_ids (sorted, as strings)."""
    worded = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    each = worded.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("n"))
    each = each.select("item", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.slice("w", i + 1, F.col("n")))).alias("run"))
    return each.groupBy("n", F.xxhash64("run").alias("hash"), F.array_join("run", " ").alias("window")).agg(F.array_sort(F.collect_set("item")).alias("item_ids"))


def window_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", row: str | None = None) -> DataFrame:
    """One row for each document row: row, doc_id, n_words, hits (starts and lengths of the windows found), items.

    Each row of docs is a document of its own, even if rows repeat; null ids stay; null and empty texts have no words and
    no hits; very long texts are scanned whole; other columns are ignored. An empty benchmark gives no hits, an empty
    table no rows. row: a column that numbers the rows of docs and stays the same however often it is read; without it
    the rows are numbered here.
    """
    table = benchmark_windows(items, item_id, item_text, window)
    size = F.octet_length("window") + F.aggregate("item_ids", F.lit(0), lambda n, x: n + F.octet_length(x))
    sizes = table.groupBy("n").agg(F.count("*").alias("rows"), F.sum(size).alias("bytes")).collect()  # at most as many rows as a window has words
    small = sum(r["rows"] for r in sizes) * window <= BROADCAST_ROWS and sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES
    bounded = F.broadcast if small else lambda df: df
    lengths = sorted(r["n"] for r in sizes)
    base = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    if not small:
        base = checkpoint(base)  # rows are met again by their number
    none = F.array(F.struct(F.lit(0).alias("len"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("anchor")))

    def anchors(n: int) -> Column:
        g = anchor_length(n)
        return F.transform(_starts(F.size("w"), g, n - g + 1), lambda i: F.struct(F.lit(n).alias("len"), i.alias("at"), F.xxhash64(F.slice("w", i + 1, g)).alias("anchor")))

    scanned = base.select("row", "doc_id", "n_words", "w", F.inline(F.concat(none, *[anchors(n) for n in lengths])))
    runs = None
    for n in lengths:
        g = anchor_length(n)
        parts = table.where(F.col("n") == n).select(F.split("window", " ").alias("w"))
        parts = parts.select(F.lit(n).alias("len"), F.explode(_grams(g)).alias("anchor"))
        runs = parts if runs is None else runs.unionByName(parts)
    if runs is None:
        return base.select("row", "doc_id", "n_words", F.array().cast("array<struct<at:int,len:int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    known = bounded(runs.distinct().withColumn("known", F.lit(True)))
    if small:
        found = scanned.join(known, ["len", "anchor"], "left").where("known OR len = 0")
    else:  # anchors travel without their document's words, which only those found meet again
        anchored = scanned.where("len > 0").select("row", "len", "at", "anchor").join(known, ["len", "anchor"]).select("row", "len", "at")
        found = base.join(anchored.unionByName(base.select("row", F.lit(0).alias("len"), F.lit(0).alias("at"))), "row")
    length = F.col("len")
    first = F.greatest(F.lit(0), F.col("at") - (length - F.greatest(F.lit(1), F.floor(length / 2).cast("int"))))
    last = F.least(F.col("at"), F.size("w") - length)
    tries = F.when(length == 0, F.array(F.lit(-1))).when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    tried = found.select("row", "doc_id", "n_words", "len", F.inline(F.transform(tries, lambda s: F.struct(s.alias("start"), F.when(s >= 0, F.slice("w", s + 1, length)).alias("run")))))
    tried = tried.select("row", "doc_id", "n_words", F.col("len").alias("n"), "start", F.xxhash64("run").alias("hash"), F.array_join("run", " ").alias("window"))
    hit = tried.join(bounded(table), ["n", "hash", "window"], "left").where("start < 0 OR item_ids IS NOT NULL")
    return hit.groupBy("row", "doc_id", "n_words").agg(
        F.collect_set(F.when(F.col("start") >= 0, F.struct(F.col("start").alias("at"), F.col("n").alias("len")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"),
    )


def _grams(g: int) -> Column:
    return F.transform(_starts(F.size("w"), g, 1), lambda i: F.xxhash64(F.slice("w", i + 1, g)))


def hit_positions(hits: Column) -> Column:
    """Sorted positions of the words inside any occurring window."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1)))))


def contamination(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items, contaminated."""
    found = window_hits(docs, items, **columns)
    n_hit = F.size(hit_positions(F.col("hits"))).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("hits") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows without any window of the benchmark, all columns as they were, whatever their names.

    Rows of one id go together, rows with a null id likewise; a null or empty text has no window. An empty benchmark
    leaves all rows.
    """
    name = unused("dirty_id", docs)
    dirty = contamination(docs, items, id_col=id_col, **columns).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dirty, docs[id_col].eqNullSafe(dirty[name]), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """Per document row: doc_id and text without the words inside occurring windows; what separates words stays.

    Null ids stay and null texts become empty; repeated rows are rewritten each. Rows are numbered once and written down,
    so the words found and the text that they are cut from belong to one row.
    """
    texts = checkpoint(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    found = window_hits(texts, items, row="row", **columns).select("row", "hits")
    both = texts.join(found, "row")
    raw = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gaps = F.split("text", raw)  # only here, for the few rows that are rewritten, are the words cut from the raw text
    own = F.regexp_extract_all("text", F.lit(raw), F.lit(0))
    hit = hit_positions(F.col("hits"))
    kept = F.transform(F.arrays_zip(gaps.alias("gap"), own.alias("word")), lambda x, i: F.concat(F.coalesce(x["gap"], F.lit("")), F.when(F.array_contains(F.col("hit"), i), "").otherwise(F.coalesce(x["word"], F.lit("")))))
    return both.withColumn("hit", hit).select("doc_id", F.when(F.size("hits") > 0, F.array_join(kept, "")).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
