"""Near-duplicates by SimHash, with exact similarity of word shingles behind it.

Each text has a SimHash fingerprint of its shingles; fingerprints at 2 or fewer differing bits are found by the pigeonring
join of simhash.py, and such texts are linked if their sets of shingles are similar. Two bits reach the nearest copies
only (few of similarity 0.8), so a set-similarity join by prefixes finds the other similar pairs.

Shingles are put in one order for all texts: by the number of texts that have them, counted over the whole table, then by
value. Two sets of similarity SIMILAR or more share a shingle among the first n - ceil(SIMILAR * n) + 1 of each, so an
equi-join on these misses no pair, and the sizes and the places of a common shingle rule out most others. Shingles of one
text only come first and need no bucket, so just texts that consist of repeated ones nearly all through have partners.
Every bucket of a common shingle has LEADERS leaders at most (mostly the same in all buckets of a group), and each text is first
compared with those (and by SimHash), which settles most of a large group of near copies in linear time; then come only the pairs of
texts that are not yet in one component. Before whole sets travel, a pair is held against its sketches, an exact bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, lean, partitions, unused
from .simhash import _word_hashes, links, majority

#: Jaccard similarity from which texts are near-duplicates, as a fraction.
SIMILAR = (4, 5)
#: Texts of a bucket, at most, with which all others of it are compared first; the result doesn't depend on it.
LEADERS = 16
#: Differing bits of SimHash fingerprints up to which texts are held against each other first.
DISTANCE = 2
#: Texts of a cell, whose sets are compared with those of their partners, and partners of a text in one cell, about.
CELL = 64
#: Pairs whose texts are looked up by a broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Links up to which components are found on the driver (16 bytes a link); more take the rounds of common.components.
DRIVER_LINKS = 200_000
#: Different sets of shingles that a task remembers, so that copies send their prefix once; others send it again.
REMEMBERED = 500_000
#: Shingles, and texts (below 2^16), that a task sends off together to be counted; ranges of shingles for each shuffle partition.
CHUNK, CHUNK_TEXTS, RANGES = 1 << 20, 60_000, 16
#: Bytes of sets that a task puts into one batch, about.
BATCH = 8 << 20


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    return np.unique(_word_hashes(text, words)).view(np.int64)


def _node(found: np.ndarray) -> int:
    n = xxhash.xxh64_intdigest(found.tobytes())
    return n - (1 << 64) if n >> 63 else n


def _pieces(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The array cut at the starts (the last one is its end), as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _sums(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


def _joined(column: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


#: A chunk's texts (range below 0), or its shingles of one range: each once, with the number and the places in the chunk of the texts that have it.
_HEAD = [("ids", pa.list_(pa.int64())), ("nodes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("sketches", pa.list_(pa.binary())), ("prints", pa.list_(pa.int64()))]
_SENT = pa.schema([("chunk", pa.int64()), ("range", pa.int64()), ("shingles", pa.binary()), ("owned", pa.binary()), ("owners", pa.binary()), *_HEAD])
_SENT_SQL = "chunk long, range long, shingles binary, owned binary, owners binary, ids array<long>, nodes array<long>, sizes array<long>, sketches array<binary>, prints array<long>"


def _sent(chunk: int, ranges: int, head: list[list], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of a chunk."""
    row = [pa.array([chunk]), pa.array([-1 - chunk]), *[pa.nulls(1, pa.binary())] * 3, *[pa.array([x], kind) for x, (_, kind) in zip(head, _HEAD)]]
    yield pa.RecordBatch.from_arrays(row, schema=_SENT)
    value = np.concatenate(sets).view(np.uint64)
    if not len(value):
        return
    order = np.argsort(value, kind="stable")
    owners, value = np.repeat(np.arange(len(sets)), [len(x) for x in sets]).astype(np.uint16)[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    value, owned = value[first], np.diff(np.append(first, len(value)))
    place = ((value >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))), len(place))
    n = len(cuts) - 1
    columns = [pa.array(np.full(n, chunk)), pa.array(place[cuts[:-1]]), _pieces(value, cuts), _pieces(owned.astype(np.uint16), cuts), _pieces(owners, _sums(owned)[cuts])]
    yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, kind) for _, kind in _HEAD]], schema=_SENT)


def _repeated(rows: list[tuple]) -> pa.RecordBatch:
    """Of all chunks' rows of one range, the shingles that several texts have, with the number of these."""
    value, owned, owners = (_joined([r[i] for r in rows], kind) for i, kind in ((1, np.uint64), (2, np.uint16), (3, np.uint16)))
    _, at = np.unique(value, return_inverse=True)
    texts = np.bincount(at, weights=owned).astype(np.uint32)[at]
    several = texts > 1
    row = np.repeat(np.arange(len(rows)), [len(r[1]) // 8 for r in rows])[several]
    cuts = np.searchsorted(row, np.arange(len(rows) + 1))
    owners, owned = owners[np.repeat(several, owned)], owned[several]
    columns = [pa.array([r[0] for r in rows], pa.int64()), _pieces(value[several], cuts), _pieces(owned, cuts), _pieces(owners, _sums(owned)[cuts]), _pieces(texts[several], cuts)]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "shingles", "owned", "owners", "texts"]).filter(pa.array(cuts[1:] > cuts[:-1]))


def _prefix(nodes: np.ndarray, sizes: np.ndarray, rows: list[tuple]) -> pa.RecordBatch:
    """The repeated shingles (key) in the prefixes of a chunk's texts, their places (at) in the order of all shingles, and the number of a text's other ones (alone)."""
    p, q = SIMILAR
    value, owned, own, texts = (_joined([r[i] for r in rows], kind) for i, kind in enumerate((np.int64, np.uint16, np.uint16, np.uint32)))
    value, texts = np.repeat(value, owned), np.repeat(texts, owned)
    order = np.lexsort((value, texts, own))
    value, own = value[order], own[order].astype(np.int64)
    several = np.bincount(own, minlength=len(nodes))
    alone = sizes - several
    at = (alone - _sums(several)[:-1])[own] + np.arange(len(own))
    keep = at < (sizes + (-p * sizes // q) + 1)[own]
    own = own[keep]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (value[keep], nodes[own], sizes[own], at[keep], alone[own])], ["key", "node", "n", "at", "alone"])


def _marked(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, node, n, sketch, fp of each row (the last two null if a task had the node before), and the prefixes' rows: key, node, n, at, alone.

    A task sends its shingles to their ranges in chunks; there those of several texts are told and go back to their chunks.
    Copies in different tasks count as several texts, which the order of shingles may do.
    """
    ranges = RANGES * partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        chunk, held, head, sets = TaskContext.get().partitionId() << 32, 0, [[] for _ in _HEAD], []
        for batch in batches:
            for i in range(batch.num_rows):
                found = shingles(batch.column(1)[i].as_py(), words)
                node = _node(found)
                fresh = len(found) > 0 and node not in seen
                if len(seen) < REMEMBERED:
                    seen.add(node)
                fp = majority(found.view(np.uint64)) if fresh else None
                fp = fp - (1 << 64) if fp is not None and fp >> 63 else fp
                for column, x in zip(head, (batch.column(0)[i].as_py(), node, len(found), _sketch(found) if fresh else None, fp)):
                    column.append(x)
                sets.append(found if fresh else found[:0])
                held += len(sets[-1])
                if held >= CHUNK or len(sets) >= CHUNK_TEXTS:
                    yield from _sent(chunk, ranges, head, sets)
                    chunk, held, head, sets = chunk + 1, 0, [[] for _ in _HEAD], []
        if sets:
            yield from _sent(chunk, ranges, head, sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            if rows:
                found = _repeated(rows)
                n = found.num_rows
                columns = [found["chunk"], pa.array(np.full(n, place, np.int64)), found["shingles"], found["owned"], found["owners"], *[pa.nulls(n, kind) for _, kind in _HEAD], found["texts"]]
                yield pa.RecordBatch.from_arrays(columns, schema=_SENT.append(pa.field("texts", pa.binary())))

        place, rows = None, []
        for batch in batches:
            for i, r in enumerate(batch.column(1).to_pylist()):
                if r < 0:
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.nulls(1, pa.binary())], schema=_SENT.append(pa.field("texts", pa.binary())))
                    continue
                if r != place:
                    yield from told()
                    place, rows = r, []
                rows.append(tuple(batch.column(k)[i].as_py() for k in (0, 2, 3, 4)))
        yield from told()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sizes, rows = None, None, []
        for batch in batches:
            for i, r in enumerate(batch.column(0).to_pylist()):
                if r < 0:
                    if rows:
                        yield _prefix(nodes, sizes, rows)
                    nodes, sizes, rows = (*(batch.column(k)[i].values.to_numpy() for k in (5, 6)), [])
                else:
                    rows.append(tuple(batch.column(k)[i].as_py() for k in (1, 2, 3, 4)))
        if rows:
            yield _prefix(nodes, sizes, rows)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = given.mapInArrow(lean(send), _SENT_SQL).repartition("range").sortWithinPartitions("range")
    told = checkpoint(sent.mapInArrow(lean(count), f"{_SENT_SQL}, texts binary"))
    heads = told.where("range < 0").select(F.inline(F.arrays_zip("ids", "nodes", "sizes", "sketches", "prints")).alias("doc_id", "node", "n", "sketch", "fp"))
    back = told.select("chunk", "range", "shingles", "owned", "owners", "texts", "nodes", "sizes").repartition("chunk").sortWithinPartitions("chunk", "range")
    return checkpoint(heads), back.drop("chunk").mapInArrow(lean(order), "key long, node long, n long, at long, alone long")


def _possible(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """False if sets of these sizes whose first common shingle has these places (from 0) can't be similar."""
    p, q = SIMILAR
    return (F.least(n_a - at_a, n_b - at_b) * (p + q) >= (n_a + n_b) * p) & (F.least(n_a, n_b) * q >= F.greatest(n_a, n_b) * p)


def _sketch(found: np.ndarray) -> bytes:
    """The parity of the shingles in each of at least as many cells as there are shingles, a power of two, 64 or more."""
    bits = 1 << max(6, int(len(found) - 1).bit_length())
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def _differing(x: bytes, y: bytes) -> int:
    """Shingles that only one of the sets has are this many at least: each changes one bit of its set's sketch."""
    x, y = (np.frombuffer(s, np.uint8) for s in ((x, y) if len(x) <= len(y) else (y, x)))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs a, b whose sketches don't rule out similarity; every similar pair is among them."""
    p, q = SIMILAR
    x, y = (sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, other = batch.column(2).to_pylist(), batch.column(3), batch.column(4)
            keep = [_differing(one[i].as_py(), other[i].as_py()) * (p + q) <= n * (q - p) for i, n in enumerate(size)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "sketch_a", "sketch_b")
    return checkpoint(met.mapInArrow(lean(run), "a long, b long"))


def _cells(pairs: DataFrame) -> DataFrame:
    """The pairs, each once and turned so that a has the lesser hash, with the cell (a long) in which they are compared.

    Texts with the same first partner share cells, about CELL of them in each, and so their partners, which are mostly the
    same: a set travels to few cells. A text with many partners has cells for about CELL of them each, so it's not one task.
    """
    before = F.xxhash64("a") <= F.xxhash64("b")
    turned = checkpoint(pairs.where("a <> b").select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("b")).distinct())
    texts = turned.groupBy("b").agg(F.min_by("a", F.xxhash64("a")).alias("first"), F.count("*").alias("n"))
    texts = checkpoint(texts.select("b", "first", F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / CELL))).cast("int")).alias("chunks")))
    cells = texts.groupBy("first", "chunks").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    placed = texts.join(cells, ["first", "chunks"]).select("b", "chunks", F.xxhash64("first", "chunks", F.pmod(F.xxhash64("b"), F.col("cells"))).alias("place"))
    return turned.join(placed, "b").select("a", "b", F.xxhash64("place", F.pmod(F.xxhash64("a"), F.col("chunks"))).alias("cell"))


def _verified(pairs: DataFrame, docs: DataFrame, least: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """The pairs a, b of nodes whose sets of shingles are similar.

    Sets are cut from the texts once more and travel to the cells of their pairs. There a shingle is the lower 32 bits of
    its hash; a common one too many turns up in about one of 2^32 / (n_a * n_b) pairs.
    """
    p, q = SIMILAR
    dealt = checkpoint(_cells(pairs))
    asked = dealt.groupBy(F.col("b").alias("node"), "cell").agg(F.collect_list("a").alias("partners")).unionByName(dealt.select(F.col("a").alias("node"), "cell", F.array().cast("array<long>").alias("partners")).distinct())
    asked = checkpoint(asked.groupBy("node").agg(F.collect_list(F.struct("cell", "partners")).alias("cells")).join(least, "node").select(F.col("least").alias("wanted"), "node", "cells"))
    asked = F.broadcast(asked) if dealt.count() <= BROADCAST_ROWS else asked  # at most 40 bytes for each of a pair's two sides
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    given = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("wanted"))).select("text", "node", "cells")
    names = ["cell", "node", "partners", "shingles"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        out, size = [[] for _ in kinds], 0
        for batch in batches:
            for i in range(batch.num_rows):
                node = batch.column(1)[i].as_py()
                found = shingles(batch.column(0)[i].as_py(), words)
                if _node(found) != node:  # another text may have this id too
                    continue
                short = np.unique(found.astype(np.int32))
                for cell in batch.column(2)[i].as_py():
                    for column, x in zip(out, (cell["cell"], node, cell["partners"], short)):
                        column.append(x)
                    size += 4 * len(short) + 64
                    if size >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)
                        out, size = [[] for _ in kinds], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    def similar(known: dict[int, np.ndarray], wanted: dict[int, set[int]]) -> pa.RecordBatch:
        out = []
        for b, partners in wanted.items():
            for a in partners:
                x, y = known[a], known[b]
                both = len(x) + len(y) - len(np.union1d(x, y))
                if both * q >= (len(x) + len(y) - both) * p:
                    out.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([pair[i] for pair in out], pa.int64()) for i in range(2)], ["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, known, wanted = None, {}, {}
        for batch in batches:
            for c, node, partners, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if c != cell:
                    yield similar(known, wanted)
                    cell, known, wanted = c, {}, {}
                known[node] = found.values.to_numpy(zero_copy_only=False)
                wanted.setdefault(node, set()).update(partners)
        yield similar(known, wanted)

    known = given.mapInArrow(lean(sets), "cell long, node long, partners array<long>, shingles array<int>")
    return checkpoint(known.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(compared), "a long, b long").distinct())


def simhash_pairs(prints: DataFrame) -> DataFrame:
    """Pairs a, b of nodes by their fingerprints (columns node, fp): each with the least of its fingerprint, and the least ones
    of fingerprints at DISTANCE or fewer differing bits, as far as these keep the components."""
    least = checkpoint(prints.groupBy("fp").agg(F.min("node").alias("a")))
    same = prints.join(least, "fp").where("a <> node").select("a", F.col("node").alias("b"))
    found = links(least.select("fp"), DISTANCE).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    one, other = (least.select(F.col("fp").alias(f"fp_{c}"), F.col("a").alias(c)) for c in "ab")
    return same.unionByName(found.join(one, "fp_a").join(other, "fp_b").select("a", "b")).distinct()


def _grouped(links: DataFrame) -> DataFrame:
    """components() of the links, in one step if they are few: rounds of small shuffles fill the driver with their plans and tasks."""
    some = links.limit(DRIVER_LINKS + 1).toArrow()
    if some.num_rows > DRIVER_LINKS:
        return components(links)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(some["a"].to_pylist(), some["b"].to_pylist()):
        x, y = sorted((top(root.setdefault(a, a)), top(root.setdefault(b, b))))
        root[y] = x
    placed = pa.table({"node": pa.array(root, pa.int64()), "component": pa.array([top(x) for x in root], pa.int64())})
    return links.sparkSession.createDataFrame(placed)


def _spanning(rows: DataFrame, col: str) -> DataFrame:
    """The rows whose bucket (key) has several values of the column."""
    several = rows.groupBy("key").agg(F.min(col).alias("lo"), F.max(col).alias("hi")).where("lo < hi").select("key")
    return rows.join(several, "key")


def _apart(crowded: DataFrame, near: DataFrame) -> DataFrame:
    """The rows of buckets (key) whose nodes are not all in one component by the links, with the component as root."""
    placed = crowded.join(_grouped(near), "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    return checkpoint(_spanning(placed, "root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, node (the hash of its set of shingles), component_id (the least doc_id of its component).

    Texts with equal sets are linked, those without words too. Rows with equal ids stay rows; a null id is never a
    component's id unless its component has no other. An empty table gives an empty result.
    """
    marked, keyed = _marked(docs, id_col, text_col, words)
    least = checkpoint(marked.groupBy("node").agg(F.min("doc_id").alias("least")))
    crowded = checkpoint(_spanning(checkpoint(keyed.dropDuplicates(["key", "node"])), "node"))
    sketches = checkpoint(marked.where("sketch IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def similar(pairs: DataFrame) -> DataFrame:
        return _verified(_promising(pairs.distinct(), sketches), docs, least, id_col, text_col, words)

    prints = checkpoint(simhash_pairs(marked.where("fp IS NOT NULL").select("node", "fp").distinct()))
    first = F.min_by(F.struct("node", "n", "at"), F.struct("alone", F.xxhash64("node"), "node"))
    leaders = crowded.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("slot")).agg(first.alias("lead"))
    leaders = leaders.select("key", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("node", "n", "at")])
    stars = crowded.join(leaders, "key").where((F.col("lead_node") != F.col("node")) & _possible(F.col("lead_n"), F.col("lead_at"), F.col("n"), F.col("at")))
    near = similar(prints.unionByName(stars.select(F.col("lead_node").alias("a"), F.col("node").alias("b"))))
    apart = _apart(crowded, near)
    left, right = (apart.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "at", "root")]) for side in "ab")
    rest = left.join(right, "key").where((F.col("root_a") < F.col("root_b")) & _possible(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b")))
    reached = _grouped(near.unionByName(similar(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))))
    rooted = least.join(reached, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "node").join(rooted.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "node", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs without the documents that have a near-duplicate of smaller id; columns as they were, whatever their names.

    Rows of one id stay or go together; a row with a null id stays; texts without words (null or empty ones too) count
    as copies of each other. An empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col, words)
    name = unused("gone_id", docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
