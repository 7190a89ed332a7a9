"""Token-ID output: binary shard files with a minimal perfect hash index over the document keys.

A shard file holds, in this order: the ids of its documents one after the other (16 or 32 bits, little-endian),
the index, and a footer. The index is a minimal perfect hash by displacement: a key's hash names a bucket, the
bucket's displacement names a slot, and the slot holds a 32-bit fingerprint of the key and the place of its ids,
so a document is found in constant time and an absent key is told by the fingerprint: the shard by the manifest, then
the footer, one displacement and one slot are read by their offsets. A directory lists the keys in the order of the
payload. Shards are ranges of ascending doc_id, and the manifest gives each shard's range.
"""

from __future__ import annotations

import atexit
import bisect
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, filesystem, kept, lean, partitions, range_of, shared_dir, splitters

MAGIC = b"GLTOKEN2"
FOOTER = struct.Struct("<8sQQQIIII")  # magic, ids, start of the index, its bytes, documents, buckets, bytes of an id, salt
#: What a slot holds: the key's fingerprint, the place of its first id and their number.
SLOT = np.dtype([("print", "<u4"), ("start", "<u8"), ("count", "<u8")])
END_ID = 2
#: Bytes of text for which a shard is meant.
SHARD = 64 << 20
#: Different chunks of text whose ids a worker remembers; beyond that it forgets all and starts anew.
REMEMBERED = 1_200_000
MARK = "\x01"
PER_BUCKET = 4
DIRECT = 1 << 31


def splits_at_space(tokenizer: dict) -> bool:
    """True if a tokenizer of this description gives a text the ids of its runs without white space, one after the other.

    That holds if it only composes, folds spaces and lower-cases, and then cuts out matches of a pattern that match no
    space; of the patterns, the one below is known to do so.
    """
    normalizer, cutter = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps)
    cuts = cutter.get("pretokenizers", [cutter] if cutter else [])
    spaceless = [x for x in cuts if x["type"] == "Split" and x["pattern"].get("Regex") == SPACELESS and x["behavior"] == "Removed" and x["invert"]]
    others = [x for x in cuts if x not in spaceless and not (x["type"] == "ByteLevel" and not x["add_prefix_space"])]
    no_space = all(not any(c.isspace() for c in x["content"]) for x in tokenizer.get("added_tokens", []))
    return bool(plain and spaceless and not others and no_space and cuts[0] in spaceless)


#: Fixed value: the pattern by which the public tokenizer cuts words out of a text.
SPACELESS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Encodes whole texts. Where the tokenizer joins nothing across white space, the ids of each run without are remembered."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known: dict[bytes, bytes] = {}
        described = json.loads(self.tokenizer.to_str())
        self.by_runs = splits_at_space(described)
        self.lowers = any(x["type"] == "Lowercase" for x in (described["normalizer"] or {}).get("normalizers", []))
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        #: The id of a sign that is a word of its own, put between runs that are encoded together.
        self.mark = mark[0] if len(mark) == 1 else None

    def _runs(self, text: str) -> list[bytes]:
        raw = text.encode()
        if self.lowers and text.isascii() and "<|" not in text:  # the tokenizer would lower-case it; other texts it first composes
            raw = raw.lower()
        return raw.split()

    def encode(self, texts: list[str | None], end_id: int | None = END_ID) -> list[bytes]:
        end = b"" if end_id is None else int(end_id).to_bytes(self.width, "little")
        if not self.by_runs:
            return [np.array(got.ids, self.kind).tobytes() + end for got in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        runs = [self._runs(t or "") for t in texts]
        found = [list(map(known.get, each)) for each in runs]
        holes: list[tuple[list, int, bytes]] = []
        for each, got in zip(runs, found):
            at = -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                holes.append((got, at, each[at]))
        if holes:
            self._learn(list({run for _, _, run in holes}))
            for got, at, run in holes:
                got[at] = known[run]
        return [b"".join([*x, end]) for x in found]

    def _learn(self, runs: list[bytes]) -> None:
        mark = MARK.encode()
        plain = [r for r in runs if mark not in r and b"<|" not in r] if self.mark is not None else []
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            ids = np.array(self.tokenizer.encode(f" {MARK} ".join([r.decode() for r in part] + [""]), add_special_tokens=False).ids, self.kind)
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part):
                raise ValueError("the tokenizer doesn't keep words apart")
            raw, width = ids.tobytes(), self.width
            self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *((ends[:-1] + 1) * width).tolist()], (ends * width).tolist())]))
        others = [r for r in runs if r not in self.known] if len(plain) < len(runs) else []
        for i in range(0, len(others), 4096):
            part = others[i : i + 4096]
            for run, got in zip(part, self.tokenizer.encode_batch([r.decode() for r in part], add_special_tokens=False)):
                self.known[run] = np.array(got.ids, self.kind).tobytes()


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, which outlives its tasks."""
    return kept(("encoder", path), lambda: Encoder(path))


def key_hash(doc_id: int | None, copy: int = 0, salt: int = 0) -> int:
    """Hash of a document's key: its id and, for repeated ids, its number among them."""
    return xxhash.xxh64_intdigest(struct.pack("<?qI", doc_id is None, doc_id or 0, copy), 9 + salt)


def key_hashes(keys: list[int | None], salt: int = 0) -> np.ndarray:
    """Of each key of a list, where a key that is repeated is told by its number."""
    copies: dict[int | None, int] = {}
    out = np.empty(len(keys), np.uint64)
    for i, k in enumerate(keys):
        copies[k] = copies.get(k, -1) + 1
        out[i] = key_hash(k, copies[k], salt)
    return out


@np.errstate(over="ignore")
def _slots(hashes: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    x = hashes ^ (np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return (x % np.uint64(n)).astype(np.int64)


def _buckets(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def build_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements of the buckets and the slot of each key; the hashes must be distinct and fill the slots 0 to n - 1."""
    n = len(hashes)
    if len(np.unique(hashes)) < n:
        raise ValueError("keys with equal hashes")
    n_buckets = max(1, -(-n // PER_BUCKET))
    bucket = _buckets(hashes, n_buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(sizes)
    taken, seeds, slot = np.zeros(n, bool), np.zeros(n_buckets, np.uint32), np.empty(n, np.int64)
    tries = np.arange(64)
    for b in np.argsort(-sizes, kind="stable"):
        size = sizes[b]
        if size < 2:
            break
        mine = order[ends[b] - size : ends[b]]
        first = 0
        while True:
            spots = _slots(hashes[mine][None, :], (first + tries)[:, None], n)
            good = ~taken[spots].any(axis=1)
            if size > 1:
                ordered = np.sort(spots, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                i = int(np.argmax(good))
                break
            first += len(tries)
        seeds[b], slot[mine] = first + i, spots[i]
        taken[spots[i]] = True
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)
    seeds[single] = DIRECT + free  # what is left goes to the free slots directly
    slot[order[ends[single] - 1]] = free
    return seeds, slot


class ShardWriter:
    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.ids, self.keys, self.counts = out, width, 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.keys.append(doc_id)
        self.counts.append(len(ids) // self.width)
        self.ids += self.counts[-1]

    def close(self) -> None:
        salt = 0
        while len(np.unique(hashes := key_hashes(self.keys, salt))) < len(self.keys):
            salt += 1  # two of the keys have one hash
        seeds, slot = build_index(hashes)
        counts = np.array(self.counts, "<u8")
        slots = np.empty(len(slot), SLOT)
        slots["print"][slot], slots["start"][slot], slots["count"][slot] = hashes & np.uint64(0xFFFFFFFF), np.cumsum(counts) - counts, counts
        nulls = np.array([k is None for k in self.keys], "u1")
        keys = np.array([k or 0 for k in self.keys], "<i8")
        index = b"".join(x.tobytes() for x in (seeds.astype("<u4"), slots, keys, nulls))
        self.out.write(index)
        self.out.write(FOOTER.pack(MAGIC, self.ids, self.ids * self.width, len(index), len(keys), len(seeds), self.width, salt))
        self.out.close()


class ShardReader:
    """Keyed access to a shard file; only the footer, one displacement, one slot and the ids asked for are read."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        magic, self.ids, self.start, self.length, self.n, self.n_buckets, self.width, self.salt = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(self.start + offset)
        return self.source.read(size)

    def place(self, doc_id: int | None, copy: int = 0) -> tuple[int, int] | None:
        """First id and number of ids of a document; None if the shard doesn't hold it."""
        if not self.n:
            return None
        h = np.array([key_hash(doc_id, copy, self.salt)], np.uint64)
        seed = int.from_bytes(self._at(4 * int(_buckets(h, self.n_buckets)[0]), 4), "little")
        at = seed - DIRECT if seed >= DIRECT else int(_slots(h, seed, self.n)[0])
        slot = np.frombuffer(self._at(4 * self.n_buckets + SLOT.itemsize * at, SLOT.itemsize), SLOT)[0]
        if int(slot["print"]) != int(h[0]) & 0xFFFFFFFF:
            return None
        return int(slot["start"]), int(slot["count"])

    def places(self) -> Iterator[tuple[int | None, int, int]]:
        """Key, first id and number of ids of all documents, in the order of the payload, each found by its key."""
        if not self.n:
            return
        data, at, parts = self._at(0, self.length), 0, []
        for kind, count in ((np.dtype("<u4"), self.n_buckets), (SLOT, self.n), (np.dtype("<i8"), self.n), (np.dtype("u1"), self.n)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        seeds, slots, keys, nulls = parts
        ids = [None if null else int(k) for k, null in zip(keys, nulls)]
        hashes = key_hashes(ids, self.salt)
        seed = seeds[_buckets(hashes, len(seeds))].astype(np.int64)
        slot = np.where(seed >= DIRECT, seed - DIRECT, _slots(hashes, seed & (DIRECT - 1), self.n))
        if (slots["print"][slot] != (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)).any():
            raise ValueError("the index doesn't match the directory")
        yield from zip(ids, slots["start"][slot].tolist(), slots["count"][slot].tolist())

    def read(self, start: int, count: int) -> np.ndarray:
        self.source.seek(start * self.width)
        return np.frombuffer(self.source.read(count * self.width), f"<u{self.width}")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """doc_id and ids (binary, little-endian) of each row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.encode(part.column(1).to_pylist(), end_id), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, ids binary")


def write(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> dict:
    """Write the shard files and the manifest into a folder that all executors share; return the manifest.

    Shards are ranges of ascending doc_id (null first); rows of equal id follow each other, ordered by their ids.
    Files get their final name when complete, and a task that runs again writes the same file. An empty table
    gives one empty shard.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("bytes")).first()["bytes"]
    cuts = splitters(docs.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id", max(partitions(spark), -(-total // SHARD)))
    fs, root = filesystem(folder)
    fs.create_dir(root)
    width = encoder(path).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        writer, shard, low, high = None, 0, None, None
        for batch in batches:
            for doc_id, ids, at in zip(*[c.to_pylist() for c in batch.columns]):
                if writer is None:
                    shard, low = at, doc_id
                    temporary = f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
                    writer = ShardWriter(fs.open_output_stream(temporary), width)
                writer.add(doc_id, ids)
                high = doc_id
        if writer is not None:
            writer.close()
            fs.move(temporary, f"{root}/shard-{shard:06d}.tok")
            rows = [[shard], [low], [high], [len(writer.keys)], [writer.ids]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["shard", "low", "high", "documents", "ids"])

    ids = encode(docs, path, id_col, text_col, end_id).withColumn("shard", range_of(F.col("doc_id"), cuts).cast("int"))
    dealt = ids.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    done = dealt.mapInArrow(lean(run), "shard long, low long, high long, documents long, ids long").collect()  # a row per shard
    shards, start = [], 0
    for r in sorted(done):
        shards.append(r.asDict() | {"file": f"shard-{r['shard']:06d}.tok", "start": start})
        start += r["ids"]
    manifest = {"width": width, "ids": start, "shards": shards}
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    Null and repeated ids come back as they were written, a row each; an empty folder's manifest gives no rows.
    """
    fs, root = filesystem(folder)
    manifest = json.loads(fs.open_input_file(f"{root}/manifest.json").read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = [(s["file"], s["start"]) for s in manifest["shards"]]
    files = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for file, base in zip(*[c.to_pylist() for c in batch.columns]):
                with fs.open_input_file(f"{root}/{file}") as source:
                    reader, out = ShardReader(source), [[] for _ in range(5)]
                    for doc_id, start, count in reader.places():
                        ids = reader.read(start, count)
                        for column, x in zip(out, (doc_id, base + start, count, zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None)):
                            column.append(x)
                        if len(out[0]) >= 1024:
                            yield _batch(out, with_ids)
                            out = [[] for _ in range(5)]
                    yield _batch(out, with_ids)

    return files.mapInArrow(lean(run), schema)


def _batch(out: list[list], with_ids: bool) -> pa.RecordBatch:
    arrays = [pa.array(x, pa.int64()) for x in out[:4]] + ([pa.array(out[4], pa.list_(pa.int32()))] if with_ids else [])
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def remove(folder: str) -> None:
    """Delete a folder of shard files, if it is there."""
    fs, root = filesystem(folder)
    try:
        fs.delete_dir(root)
    except FileNotFoundError:
        pass


class TokenFiles:
    """Keyed access to a folder of shard files; the manifest is read once, and each key costs a fixed number of small reads."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = filesystem(folder)
        shards = json.loads(self.fs.open_input_file(f"{self.root}/manifest.json").read())["shards"]
        self.shards = [s for s in shards if s["documents"]]
        least = -(1 << 63) - 1  # null ids come before all others
        self.lows = [least if s["low"] is None else s["low"] for s in self.shards]

    def lookup(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of one document, None if there is none; a null id is a key like any other.

        Rows of one id are told apart by copy, their number from 0 in the order of their ids.
        """
        at = bisect.bisect_right(self.lows, -(1 << 63) - 1 if doc_id is None else doc_id) - 1
        if at < 0:
            return None
        with self.fs.open_input_file(f"{self.root}/{self.shards[at]['file']}") as source:
            reader = ShardReader(source)
            found = reader.place(doc_id, copy)
            return reader.read(*found).copy() if found else None


def lookup(folder: str, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
    """The ids of one document of a folder; for more than one, open TokenFiles once."""
    return TokenFiles(folder).lookup(doc_id, copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    """Writes the files into a folder of their own beside the checkpoints, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    atexit.register(remove, folder)
    write(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, folder)
