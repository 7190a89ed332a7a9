"""Suffix-array dedup: remove bytes that a window of 50 bytes shares with a document of smaller id.

Suffixes are kept only where each window needs one: at its minimizer, the 16-byte anchor with the least hash.
Consecutive windows with the same anchor form a stretch; a record holds the suffix's first 16 bytes as two
words, a hash of the whole stretch, and where it lies. Sampled splitters range-partition the records by those
leading bytes, and each bucket sorts its records by multikey quicksort (first word, then ties by the second,
then by the stretch). Equal stretches settle all their windows at once. Where one anchor continues in different
ways, also across the boundary of two buckets, a second round compares the windows of each different stretch
one by one. Texts travel as compressed blocks, and both rounds ship packed columns that name a block and
places in it, so Spark moves few, large rows. What a round found is checkpointed, so its shuffle is off the disk
before the next one writes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, kept, lean, partitions, unused

LENGTH = 50
ANCHOR = 16
#: Bytes of text that are handled at once; copies within a block are settled in it, so a hot text ships once a block.
BLOCK = 2 << 20
#: Bytes of text per bucket of suffixes.
BUCKET = 16 << 20
#: Splitters come from about this many documents at least and this many records of each; from one more document for each
#: SAMPLE_BUCKETS buckets beyond what these can tell apart. They have no say in the result.
SAMPLE_DOCS, SAMPLE_RECORDS, SAMPLE_BUCKETS = 2000, 32, 8

#: Different stretches of one anchor up to which their bytes are brought together; beyond, single windows are dealt out.
TOGETHER = 1000

_MIX1, _MIX2, _MIX3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_BASE = 0x9DDFEA08EB382D69


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    held = kept(("powers",), dict)
    if len(held.get("up", ())) < n:
        size = max(n, 1 << 18)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                held[name] = np.multiply.accumulate(steps)
    return held["up"][:n], held["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX3
    x = (x ^ (x >> np.uint64(29))) * _MIX1
    return x ^ (x >> np.uint64(32))


class _Text:
    """The texts of some documents one after the other, hashed."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.length = length
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        joined = b"".join(texts)
        n = self.n = len(joined)
        raw = joined + bytes(32)
        #: For each byte, the eight bytes that start there as a big-endian number.
        self.words = np.empty(n + 16, np.uint64)
        for i in range(8):
            part = np.frombuffer(raw, ">u8", (n + 16 - i + 7) // 8, i)
            self.words[i::8] = part
        count = self.count = max(0, n - ANCHOR + 1)
        self.anchors = _mix(self.words[:count] * _MIX1 ^ (self.words[8 : count + 8] + _MIX2) * _MIX2)
        up, self.down = _powers(count + 1)
        self.sums = np.zeros(count + 1, np.uint64)
        np.cumsum(self.anchors * up[:count], out=self.sums[1:])
        #: Starts of the windows that lie within one document.
        inside = np.zeros(n + 1, np.int8)
        long = sizes >= length
        np.add.at(inside, self.offsets[:-1][long], 1)
        np.add.at(inside, self.offsets[1:][long] - length + 1, -1)
        self.inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from start to before end, by the anchors within."""
        last = end - ANCHOR + 1
        return _mix((self.sums[last] - self.sums[start]) * self.down[start] ^ (end - start).astype(np.uint64))

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first and last window start of each run of windows with the same anchor (the leftmost least one)."""
        width, count = self.length - ANCHOR + 1, self.count
        if count < width:
            return (np.empty(0, np.int64),) * 3
        value, at, span = self.anchors, np.arange(count, dtype=np.int32), 1
        while span < width:
            step = min(span, width - span)
            take = value[step:] < value[:-step]
            at = np.where(take, at[step:], at[:-step])
            value = np.where(take, value[step:], value[:-step])
            span += step
        inside = self.inside[: len(at)]
        new = inside.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new)
        ends = inside.copy()
        ends[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
        return at[first].astype(np.int64), first, np.flatnonzero(ends)


#: A third level of compression saves an eighth of a text's block and costs little.
LEVEL = 3


def _pack(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays), *[x for a in arrays for x in (ord(a.dtype.char), len(a))]], np.int64)
    data = head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(n, 2):
        out.append(np.frombuffer(data, np.dtype(chr(kind)), size, at))
        at += out[-1].nbytes
    return out


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by the keys: sorted by the first, then only runs of ties by the next, and so on."""
    order = np.argsort(keys[0], kind="stable")
    tied = np.ones(len(order), bool)
    group = np.zeros(len(order), np.int64)
    for before, key in zip(keys, keys[1:]):
        ordered = before[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (ordered[1:] != ordered[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(fresh)
        tied[:] = False
        same = ~fresh[1:]
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        if not len(places):
            break
        rows = order[places]
        order[places] = rows[np.lexsort((key[rows], group[places]))]
    return order


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column; the first always."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _leasts(values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row the least value of its group; groups are runs that start where new is true."""
    if not len(values):
        return values
    starts = np.flatnonzero(new)
    return np.repeat(np.minimum.reduceat(values, starts), np.diff(np.append(starts, len(values))))


def _blocks(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """Lists of rows with about BLOCK bytes of text, the text as bytes first."""
    rows, size = [[] for _ in range(columns)], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            for i, x in enumerate(row):
                rows[i].append(x)
            size += len(row[0] or b"") + 64
            if size >= BLOCK:
                yield rows
                rows, size = [[] for _ in range(columns)], 0
    if rows[0]:
        yield rows


def _buckets(cuts: list[tuple[int, int, int]], words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of splitters at or below each record's three words."""
    heads = np.array([c[0] for c in cuts], np.uint64)
    out = np.searchsorted(heads, words[0], "left")
    tied = np.flatnonzero(out < np.searchsorted(heads, words[0], "right"))
    for head in np.unique(words[0][tied]) if len(tied) else ():
        rows = tied[words[0][tied] == head]
        for _, second, third in cuts[int(np.searchsorted(heads, head, "left")) : int(np.searchsorted(heads, head, "right"))]:
            w2, w3 = words[1][rows], words[2][rows]
            out[rows] += (w2 > second) | (w2 == second) & (w3 >= third)
    return out


def _records(text: _Text) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """The words of each suffix (its leading 16 bytes and its stretch), anchor, first window and number of windows.

    The stretch's word holds 48 bits of its hash and 8 bits each of the 17 bytes before and after the anchor.
    Any window with the anchor holds one of those two sides in full, so what shares neither shares no window.
    """
    anchor, first, last = text.stretches()
    end = last + text.length
    word = text.hash(first, end) + (anchor - first).astype(np.uint64) * _MIX2
    side = (text.length - ANCHOR + 1) // 2
    before = text.hash(np.maximum(first, anchor - side), anchor + ANCHOR) & np.uint64(255)
    after = text.hash(anchor, np.minimum(end, anchor + ANCHOR + side)) & np.uint64(255)
    word = (word & ~np.uint64(0xFFFF)) | before << np.uint64(8) | after
    return (text.words[anchor], text.words[anchor + 8], word), anchor, first, last - first + 1


SHIP = "bucket int, block long, blob binary"


def _rows(bucket: list[int], block: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "block", "blob"])


def _deltas(places: np.ndarray) -> np.ndarray:
    """Differences of ascending places in four planes of bytes, of which the upper are nearly empty."""
    return np.diff(places.astype(np.int64), prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()


def _undeltas(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.int64)


def _named(kind: int, ids: np.ndarray, offsets: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """What a shipped row begins with: its kind, the ids of its documents, a bit where a record's document begins, the places (ascending).

    About a bit a record tells its document, however few records of a block go to one bucket.
    """
    docs = np.searchsorted(offsets, places, "right") - 1
    fresh = _changes(docs)
    return [np.array([kind]), np.diff(ids[docs[fresh]], prepend=0), np.packbits(fresh), _deltas(places)]


def _settled(kind: int, blocks: np.ndarray, places: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each block with its places (ascending) and what goes with them, packed."""
    if not len(blocks):
        return
    order = np.lexsort((places, blocks))
    blocks, places, columns = blocks[order], places[order], [c[order] for c in columns]
    edges = np.append(np.flatnonzero(_changes(blocks)), len(blocks))
    for s, e in zip(edges[:-1], edges[1:]):
        yield _rows([kind], [int(blocks[s])], [_pack([_deltas(places[s:e]), *[c[s:e] for c in columns]])])


def _places(blobs: list[bytes] | None) -> tuple[np.ndarray, ...] | None:
    if not blobs:
        return None
    parts = [_unpack(b) for b in blobs]
    return np.concatenate([_undeltas(p[0]) for p in parts]), *[np.concatenate([p[i] for p in parts]) for i in range(1, len(parts[0]))]


def _ship(block: int, ids: np.ndarray, offsets: np.ndarray, buckets: np.ndarray, places: np.ndarray, keys: list[np.ndarray], columns: list[np.ndarray], counts: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Settle what has an equal record in a smaller document of the block; ship the others, packed by bucket.

    kind tells what the columns are; a shipped row holds the documents' ids, for comparing by them.
    """
    own = ids[np.searchsorted(offsets, places, "right") - 1]
    if keys:
        order = multikey_order([*keys, own])
        hit = np.empty(len(own), bool)
        hit[order] = own[order] > _leasts(own[order], _changes(*[k[order] for k in keys]))
        yield from _settled(HIT, np.full(int(hit.sum()), block), places[hit], counts[hit].astype(np.uint8))
        keep = np.flatnonzero(~hit)
    else:
        keep = np.arange(len(own))
    by = keep[np.argsort(buckets[keep], kind="stable")]
    edges = np.append(np.flatnonzero(_changes(buckets[by])), len(by))
    for s, e in zip(edges[:-1], edges[1:]):
        part = by[s:e]
        yield _rows([int(buckets[part[0]])], [block], [_pack([*_named(kind, ids, offsets, places[part]), *[c[part] for c in columns]])])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]] | pa.RecordBatch]]:
    """Rows come sorted by bucket: settled ones are handed on, the blobs of a bucket come together with their blocks."""
    bucket, blobs = None, []
    for batch in batches:
        for i, b in enumerate(batch.column(0).to_pylist()):
            if b < 0:
                yield b, batch.slice(i, 1)
                continue
            if b != bucket and blobs:
                yield bucket, blobs
                blobs = []
            bucket = b
            blobs.append((batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
    if blobs:
        yield bucket, blobs


def _opened(blobs: list[tuple[int, bytes]]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Per blob its kind and: its number in the list, for each record, the id of its document, its place, and the other columns."""
    for i, (_, blob) in enumerate(blobs):
        kind, steps, fresh, deltas, *columns = _unpack(blob)
        places = _undeltas(deltas)
        doc = np.cumsum(np.unpackbits(fresh, count=len(places)), dtype=np.int32) - 1
        yield int(kind[0]), [np.full(len(places), i, np.int32), np.cumsum(steps)[doc], places.astype(np.uint32), *columns]


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The parts' columns, each as one array; the parts are let go one column after the other."""
    out = []
    while parts[0]:
        out.append(np.concatenate([p.pop(0) for p in parts]))
    return out


#: Kinds of rows: windows found covered; records asking for the second round, their bytes together or their windows singly.
HIT, ASK, ASK_SINGLY = -1, -2, -3
RECORDS, BYTES, WINDOWS = 0, 1, 2


def _dealt(df: DataFrame, n: int) -> DataFrame:
    """Bucket b to partition b; settled rows, with negative buckets, by their block."""
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("block"), F.lit(n))).otherwise(F.col("bucket")).cast("int")
    return df.repartitionById(n, place).sortWithinPartitions("bucket")


def _text_blocks(base: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (block, data): the texts of some documents, compressed as one, and their other columns.

    Rows are sorted within their partition, so a task that runs again after an executor's loss gives the same blocks,
    in whatever order a shuffle before it hands its rows over: places in a block keep their meaning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, rows in enumerate(_blocks(batches, 1 + len(columns))):
            sizes = np.array([len(t) for t in rows[0]], np.int64)
            nulls = np.array([x is None for x in rows[1]], np.uint8)
            ids = np.array([x or 0 for x in rows[1]], np.int64)
            data = _pack([sizes, nulls, ids, np.frombuffer(b"".join(rows[0]), np.uint8)])
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + i], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])

    return base.sortWithinPartitions(*columns, F.xxhash64("text")).mapInArrow(lean(run), "block long, data binary")


class _Block:
    def __init__(self, data: bytes) -> None:
        sizes, nulls, self.ids, joined = _unpack(data)
        self.nulls, self.offsets = nulls.astype(bool), np.concatenate(([0], np.cumsum(sizes)))
        self.texts = [joined[a:b].tobytes() for a, b in zip(self.offsets[:-1], self.offsets[1:])]
        #: Documents with a null id take no part: their bytes are hidden behind texts that are too short.
        self.seen = [b"" if null else t for t, null in zip(self.texts, self.nulls)]
        self.seen_offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.seen])))


def covered_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows (block, data, hits): blocks of texts, and blobs of the places and counts of covered windows in each."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    total = base.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bytes")).first()
    n_buckets = max(partitions(spark), -(-total["bytes"] // BUCKET))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, 1):
            text = _Text(block[0], length)
            words, _, first, _ = _records(text)
            doc = np.searchsorted(text.offsets, first, "right") - 1
            at = np.flatnonzero(np.arange(len(doc)) % np.maximum(1, np.bincount(doc, minlength=1)[doc] // SAMPLE_RECORDS) == 0) if len(doc) else doc
            yield pa.RecordBatch.from_arrays([pa.array(w[at].view(np.int64)) for w in words], ["a", "b", "c"])

    share = min(1.0, max(SAMPLE_DOCS, n_buckets // SAMPLE_BUCKETS) / max(1, total["n"]))
    picked = base.select("text").sample(share, 1).mapInArrow(lean(sample), "a long, b long, c long").toPandas().to_numpy(np.int64).view(np.uint64)
    picked = picked[np.lexsort((picked[:, 2], picked[:, 1], picked[:, 0]))]
    places = [len(picked) * i // n_buckets for i in range(1, n_buckets)] if len(picked) else []
    cuts = sorted({tuple(map(int, picked[i])) for i in places})
    n_buckets = len(cuts) + 1
    second = max(partitions(spark), n_buckets // 4)
    blocks = checkpoint(_text_blocks(base, ["doc_id"]).repartition(max(partitions(spark), n_buckets), "block"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = _Block(data.as_py())
                words, _, first, count = _records(_Text(block.seen, length))
                yield from _ship(number, block.ids, block.seen_offsets, _buckets(cuts, words), first, list(words), [*words, count.astype(np.uint8)], count, RECORDS)

    def sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _gather(batches):
            if bucket < 0:
                yield blobs
                continue
            numbers = np.array([number for number, _ in blobs], np.int64)
            columns = _joined([columns for _, columns in _opened(blobs)])
            blobs.clear()
            order = multikey_order([*columns[3:6], columns[1]])
            for i, column in enumerate(columns):
                columns[i] = column[order]
            del order, column
            row, ids, place, w1, w2, stretch, count = columns
            new = _changes(w1, w2)
            same = new | _changes(stretch)
            hit = ids > _leasts(ids, same)
            yield from _settled(HIT, numbers[row[hit]], place[hit], count[hit])
            #: Anchors that continue in more than one way and lie in more than one document, or reach into the next bucket.
            groups = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            ways = np.bincount(groups[same])
            several = (ways > 1) & (np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts))
            reaching = np.zeros(len(ids), bool)
            for cut in cuts[max(0, bucket - 1) : bucket + 1]:
                reaching |= (w1 == np.uint64(cut[0])) & (w2 == np.uint64(cut[1]))
            ask = (several[groups] | reaching) & same
            ask &= reaching | _alike(groups, stretch >> np.uint64(8) & np.uint64(255), ask) | _alike(groups, stretch & np.uint64(255), ask)
            #: Every copy of the stretch that is not settled asks: the least document may hold it more than once.
            ask = ask[np.flatnonzero(same)][np.cumsum(same) - 1] & ~hit
            singly = ask & (reaching | (ways[groups] > TOGETHER) | (np.bincount(groups[ask], minlength=len(starts))[groups] > TOGETHER))
            for kind, rows in ((ASK_SINGLY, singly), (ASK, ask & ~singly)):
                yield from _settled(kind, numbers[row[rows]], place[rows], count[rows])

    first = _dealt(blocks.mapInArrow(lean(suffixes), SHIP), n_buckets).mapInArrow(lean(sorted_buckets), SHIP)
    kinds = {"hits": HIT, "asks": ASK, "asks_singly": ASK_SINGLY}
    by_block = checkpoint(first.groupBy("block").agg(*[F.collect_list(F.when(F.col("bucket") == kind, F.col("blob"))).alias(name) for name, kind in kinds.items()]))
    asked = blocks.join(by_block, "block", "left").select("block", "data", *kinds)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, hits, asks, singly in zip(*[batch.column(i) for i in range(5)]):
                number = number.as_py()
                for blob in hits.as_py() or ():
                    yield _rows([HIT], [number], [blob])
                together, apart = _places(asks.as_py()), _places(singly.as_py())
                if together is None and apart is None:
                    continue
                block = _Block(data.as_py())
                text = _Text(block.seen, length)
                if together is not None:
                    order = np.argsort(together[0])
                    place, count = together[0][order], together[1][order].astype(np.int64)
                    anchor = _anchor_of(text, place)
                    key = _mix(text.words[anchor] * _MIX1 ^ text.words[anchor + 8])
                    joined = np.frombuffer(b"".join(block.seen), np.uint8)
                    buckets = _spread(key, second)
                    for b in np.unique(buckets):
                        part = np.flatnonzero(buckets == b)
                        size = count[part] + length - 1
                        at = np.repeat(place[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        yield _rows([int(b)], [number], [_pack([*_named(BYTES, block.ids, block.seen_offsets, place[part]), count[part].astype(np.uint8), joined[at]])])
                if apart is not None:
                    order = np.argsort(apart[0])
                    at = _each(apart[0][order], apart[1][order].astype(np.int64))
                    key, check = _window_keys(text, at)
                    yield from _ship(number, block.ids, block.seen_offsets, _spread(key, second), at, [key, check], [key, check], np.ones(len(at), np.int64), WINDOWS)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs in _gather(batches):
            if bucket < 0:
                yield blobs
                continue
            parts = []
            numbers = np.array([number for number, _ in blobs], np.int64)
            for kind, columns in _opened(blobs):
                if kind == BYTES:
                    row, ids, place, count, joined = columns
                    count = count.astype(np.int64)
                    size = count + length - 1
                    start = np.cumsum(size) - size
                    text = _Text([joined.tobytes()], length)
                    key, check = _window_keys(text, _each(start, count))
                    columns = [np.repeat(row, count), np.repeat(ids, count), _each(place, count).astype(np.uint32), key, check]
                parts.append(columns)
            row, ids, place, key, check = _joined(parts)
            order = multikey_order([key, check, ids])
            hit = order[ids[order] > _leasts(ids[order], _changes(key[order], check[order]))]
            yield from _settled(HIT, numbers[row[hit]], place[hit], np.ones(len(hit), np.uint8))

    hits = _dealt(asked.mapInArrow(lean(windows), SHIP), second).mapInArrow(lean(compared), SHIP)
    found = checkpoint(hits.groupBy("block").agg(F.collect_list("blob").alias("hits")))
    return blocks.join(found, "block", "left").select("block", "data", "hits")


def _alike(groups: np.ndarray, side: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True for those of the rows whose side another of them in the group has too."""
    at = np.flatnonzero(rows)
    at = at[np.lexsort((side[at], groups[at]))]
    out = np.zeros(len(groups), bool)
    if len(at) > 1:
        equal = (groups[at[1:]] == groups[at[:-1]]) & (side[at[1:]] == side[at[:-1]])
        out[at[1:][equal]] = True
        out[at[:-1][equal]] = True
    return out


def _each(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _spread(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _window_keys(text: _Text, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that stand for the window at each place."""
    check = _mix(text.words[at] * _MIX3 ^ text.anchors[at + text.length - ANCHOR]) >> np.uint64(32)
    return text.hash(at, at + text.length), check.astype(np.uint32)


def _anchor_of(text: _Text, place: np.ndarray) -> np.ndarray:
    """The anchor of the window at each place: the first least hash within."""
    width = text.length - ANCHOR + 1
    return place + np.lib.stride_tricks.sliding_window_view(text.anchors, width)[place].argmin(axis=1)


def spans(places: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the windows cover."""
    order = np.argsort(places, kind="stable")
    starts, ends = places[order], np.maximum.accumulate(places[order] + counts[order] + length - 1)
    if not len(starts):
        return starts, ends
    new = np.ones(len(ends), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(ends)) - 1]


def _kept_parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple]]:
    """Per block a list of: id, text, starts and ends of the removed runs, kept bytes."""
    for batch in batches:
        for data, blobs in zip(batch.column(1), batch.column(2)):
            block, found = _Block(data.as_py()), _places(blobs.as_py())
            place, count = (found[0], found[1].astype(np.int64)) if found else (np.empty(0, np.int64),) * 2
            doc = np.searchsorted(block.seen_offsets, place, "right") - 1
            order = np.argsort(doc, kind="stable")
            edges = np.searchsorted(doc[order], np.arange(len(block.texts) + 1))
            out = []
            for i, text in enumerate(block.texts):
                mine = order[edges[i] : edges[i + 1]]
                starts, ends = spans(place[mine] - block.seen_offsets[i], count[mine], length)
                at = [0, *np.column_stack((starts, ends)).ravel().tolist(), len(text)]
                out.append((None if block.nulls[i] else int(block.ids[i]), text, starts.tolist(), ends.tolist(), b"".join(text[a:b] for a, b in zip(at[::2], at[1::2]))))
            yield out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, starts, ends (removed runs), kept (bytes).

    A null text is empty; a text shorter than a window loses nothing. A row with a null id loses nothing and takes
    nothing from others. Rows of equal id don't count as smaller than each other. Texts of any length are compared whole;
    other columns are ignored. An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _kept_parts(batches, length):
            out = [(doc_id, len(text), starts, ends, kept_) for doc_id, text, starts, ends, kept_ in rows]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "starts", "ends", "kept"])

    return covered_windows(docs, id_col, text_col, length).mapInArrow(lean(cut), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """docs with the covered bytes removed from the texts, and chars_col (if there) counted anew; other columns as they were.

    Bytes of a character that was cut go too. A null or empty text stays so, a row with a null id stays as it is, rows of
    equal id are told apart by their texts' hash, and rows that are equal in both lose the same bytes. An empty table
    stays empty. The rows' other columns travel no further than one join by doc_id and hash; their names may be any.
    """
    theirs, hashed, rewritten = (unused(c, docs) for c in ("cut_id", "cut_hash", "cut_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _kept_parts(batches, length):
            out = [(doc_id, hashlib.md5(text, usedforsecurity=False).digest(), kept_.decode("utf-8", "ignore")) for doc_id, text, starts, _, kept_ in rows if starts]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, (pa.int64(), pa.binary(), pa.string()))], [theirs, hashed, rewritten])

    changed = covered_windows(docs, id_col, text_col, length).mapInArrow(lean(cut), f"{theirs} long, {hashed} binary, {rewritten} string").dropDuplicates([theirs, hashed])
    on = (docs[id_col] == changed[theirs]) & (F.unhex(F.md5(docs[text_col].cast("binary"))) == changed[hashed])
    joined = docs.join(changed, on, "left")
    text = F.coalesce(changed[rewritten], docs[text_col])
    columns = [text.alias(c) if c == text_col else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == chars_col else docs[c] for c in docs.columns]
    return joined.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
