"""Token ids in binary shards, with a minimal perfect hash index from document keys to places in a shard.

File format (little-endian throughout), one pair of files for each shard of ascending keys:

``*.ids``  the ids of the shard's documents one after the other, as unsigned 16-bit values if every id of the vocabulary
           fits, else as unsigned 32-bit values.  Nothing else is in it.
``*.idx``  "GMIX0001", then eight unsigned 64-bit values (documents, bytes of an id, levels, words of the bit array, and
           four reserved), the bits of each level (64-bit words each), the bit array, the ones before each word, and by
           slot: a 32-bit fingerprint of the key, the document's ordinal in the shard, the first id, the number of ids.
           Last the keys by ordinal with a byte that says whether the key is null.

``manifest.json``  the shards in order: least key, file names, documents, and ids before the shard.

A lookup finds the shard by its least key, the slot by the hash, compares the fingerprint and the key, and reads one span.
"""

from __future__ import annotations

import bisect
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import tokens, words
from glyphmill.llm.ranges import ranges
from glyphmill.llm.session import new_folder, tune

MAGIC = b"GMIX0001"
#: Documents and bytes of text of a shard, on average.
DOCUMENTS_PER_SHARD, BYTES_PER_SHARD = 8192, 16 << 20
#: Shards at most, each an entry of the manifest (some 100 bytes); beyond them shards grow.  And tasks that write at most.
MOST_SHARDS, MOST_TASKS = 1 << 16, 1 << 14
#: Bits of a level for each key that comes to it.
GAMMA = 2.0


def _level_hash(keys: np.ndarray, level: int, salt: int = 0) -> np.ndarray:
    return words.mix(keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1) + salt) % 2**64))


def key_hashes(keys: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """One 64-bit value for each (key, occurrence of that key), distinct for distinct pairs of one shard up to chance."""
    h = words.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    h = np.where(null, np.uint64(0x1F83D9ABFB41BD6B), h)
    return words.mix(h + occurrence.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


class PerfectHash:
    """A minimal perfect hash: keys that are alone at their place of a level's bit array stay there, the others go on."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        ones = np.bitwise_count(bits).astype(np.uint64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, levels = keys, [], []
        while len(left):
            if len(sizes) > 64:
                raise ValueError("keys are not distinct")
            n = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _level_hash(left, len(sizes)) % np.uint64(n)
            alone = np.bincount(at.astype(np.int64), minlength=n) == 1
            sizes.append(n // 64)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at.astype(np.int64)]]
        return cls(np.array(sizes, dtype=np.uint64), np.concatenate(levels) if levels else np.zeros(0, dtype=np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 if no level has it (which only foreign keys see)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = _level_hash(keys[open_], level) % np.uint64(size * 64)
            word, bit = base + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            low = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = (self.before[word[hit]] + np.bitwise_count(low)).astype(np.int64)
            open_, base = open_[~hit], base + size
        return out


def index_bytes(keys: np.ndarray, null: np.ndarray, sizes: np.ndarray, width: int) -> bytes:
    same = np.zeros(len(keys), dtype=np.int64)  # how often the key came before; keys are in order
    if len(keys):
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])))
        run = np.flatnonzero(new)
        same = np.arange(len(keys)) - run[np.cumsum(new) - 1]
    hashed = key_hashes(keys, null, same)
    table = PerfectHash.build(hashed)
    slot = table.slots(hashed)
    by_slot = np.empty(len(keys), dtype=np.int64)
    by_slot[slot] = np.arange(len(keys))
    first = np.cumsum(sizes) - sizes
    out = io.BytesIO()
    out.write(MAGIC)
    out.write(np.array([len(keys), width, len(table.sizes), len(table.bits), 0, 0, 0, 0], dtype="<u8").tobytes())
    for x, kind in ((table.sizes, "<u8"), (table.bits, "<u8"), (table.before, "<u8"), (_level_hash(hashed, 0, 77)[by_slot] >> np.uint64(32), "<u4"), (by_slot, "<u4"), (first[by_slot], "<u8"), (sizes[by_slot], "<u8"), (keys, "<i8"), (null, "u1")):
        out.write(x.astype(kind).tobytes())
    return out.getvalue()


class Index:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        n, self.width, levels, n_words = (int(x) for x in np.frombuffer(data, "<u8", 4, 8))
        at = 72

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.table = PerfectHash(take("<u8", levels), take("<u8", n_words))
        take("<u8", n_words)
        self.fingerprint, self.ordinal, self.first, self.size = take("<u4", n), take("<u4", n), take("<u8", n), take("<u8", n)
        self.keys, self.null = take("<i8", n), take("u1", n).astype(bool)

    def find(self, keys: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where fingerprint or key differ."""
        hashed = key_hashes(keys, null, occurrence)
        slot = self.table.slots(hashed)
        ok = slot >= 0
        ok[ok] = self.fingerprint[slot[ok]] == (_level_hash(hashed[ok], 0, 77) >> np.uint64(32)).astype(np.uint32)
        own = self.ordinal[slot[ok]].astype(np.int64)
        ok[ok] = (self.null[own] == null[ok]) & (self.null[own] | (self.keys[own] == keys[ok]))
        return np.where(ok, slot, -1)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _writer(folder: str, vocabulary: str, end_id: int):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tokens.encoder(vocabulary) as encoder:
            yield from written(rows, encoder)

    def written(rows: Iterable[pa.RecordBatch], encoder: tokens.Encoder) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        width = 2 if len(encoder.ends_word) <= 1 << 16 and end_id < 1 << 16 else 4
        shard, sink, name, keys, null, sizes = None, None, "", [], [], []

        def done() -> pa.RecordBatch:
            sink.close()
            k, m, s = (np.concatenate(x) for x in (keys, null, sizes))
            with store.open_output_stream(f"{base}/{name}.idx") as out:
                out.write(index_bytes(k, m, s, width))
            return pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "documents": [len(k)], "ids": [int(s.sum())]}, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

        for batch in rows:
            of = batch.column(2).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if of[a] != shard:
                    if sink:
                        yield done()
                    # another attempt of this task has a name of its own; the driver keeps the one that ended
                    shard, name, keys, null, sizes = int(of[a]), f"shard-{int(of[a]):06d}-{uuid.uuid4().hex[:12]}", [], [], []
                    sink = store.open_output_stream(f"{base}/{name}.ids")
                part = batch.slice(a, b - a)
                raw = words.text_bytes(part.column(1))
                for x, y in words.chunks(raw):
                    ids, offsets = encoder.encode_ended([t.decode("utf-8", "replace") for t in raw[x:y]], end_id)
                    sink.write(ids.astype(f"<u{width}").tobytes())
                    sizes.append(np.diff(offsets))
                keys.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                null.append(part.column(0).is_null().to_numpy(zero_copy_only=False))
        if sink:
            yield done()

    return run


def write(docs: DataFrame, folder: str | None = None, *, vocabulary: str = tokens.VOCABULARY, end_id: int = tokens.END_ID, documents_per_shard: int = DOCUMENTS_PER_SHARD, bytes_per_shard: int = BYTES_PER_SHARD) -> str:
    """Encode every text and write shards in ascending doc_id order (null first); returns the folder.

    Texts are shuffled once, by fixed ranges of doc_id, a shard to a task, and sorted there.  Null and empty texts have
    ``end_id`` alone.  Rows with one doc_id all are kept, in order of their text's hash; the key with its occurrence
    finds each.  An empty table has a manifest without shards.  Further columns are ignored.  The folder must be on a
    file system that pyarrow opens and that all executors share; the default is in ``spark.checkpoint.dir``.
    """
    spark = tune(docs.sparkSession)
    folder = folder or new_folder(spark, "ids")
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mean = rows.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    cuts = ranges(rows, "doc_id", max(1, min(documents_per_shard, bytes_per_shard / mean)), MOST_SHARDS)
    # a shard is one task's alone, unless there are more than MOST_TASKS
    dealt = cuts.numbered(rows, "doc_id", "shard").withColumn("shard", F.col("shard").cast("int")).repartitionById(min(MOST_TASKS, max(1, len(cuts))), "shard")
    ordered = dealt.withColumn("tie", F.xxhash64("text")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "tie").select("doc_id", "text", "shard")
    made = ordered.mapInArrow(_writer(folder, vocabulary, end_id), "shard int, name string, documents bigint, ids bigint").collect()
    shards, before, docs_before, starts = [], 0, 0, cuts.starts
    for r in sorted(made, key=lambda r: r["shard"]):  # one row a shard
        shards.append({"least": starts[r["shard"]] if starts else None, "name": r["name"], "documents": r["documents"], "ids": r["ids"], "start": before})
        before, docs_before = before + r["ids"], docs_before + r["documents"]
    with store.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"end_id": end_id, "documents": docs_before, "ids": before, "shards": shards}).encode())
    kept = {s["name"] for s in shards}
    for f in store.get_file_info(fs.FileSelector(base)):
        if f.base_name.startswith("shard-") and f.base_name.rsplit(".", 1)[0] not in kept:
            store.delete_file(f.path)
    return folder


class Reader:
    """Keyed access: one index in memory for each shard that is asked for, one read a document."""

    def __init__(self, folder: str):
        self.store, self.base = _open(folder)
        with self.store.open_input_file(f"{self.base}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.least = [s["least"] for s in self.manifest["shards"][1:]]
        self.index: dict[int, Index] = {}

    def get(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        if not self.manifest["shards"]:
            return None
        k = bisect.bisect_right(self.least, key) if key is not None else 0
        shard = self.manifest["shards"][k]
        if k not in self.index:
            with self.store.open_input_file(f"{self.base}/{shard['name']}.idx") as f:
                self.index[k] = Index(f.read())
        index = self.index[k]
        slot = int(index.find(np.array([key or 0], dtype=np.int64), np.array([key is None]), np.array([occurrence]))[0])
        if slot < 0:
            return None
        with self.store.open_input_file(f"{self.base}/{shard['name']}.ids") as f:
            f.seek(int(index.first[slot]) * index.width)
            return np.frombuffer(f.read(int(index.size[slot]) * index.width), dtype=f"<u{index.width}").astype(np.uint32)


def _read(folder: str):
    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in frames:
            for shard in batch.to_pylist():
                with store.open_input_file(f"{base}/{shard['name']}.idx") as f:
                    index = Index(f.read())
                n = len(index.keys)
                new = np.concatenate(([True], (index.keys[1:] != index.keys[:-1]) | (index.null[1:] != index.null[:-1])))
                same = np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1]
                slot = index.find(index.keys, index.null, same)
                if (slot < 0).any():
                    raise ValueError(f"{shard['name']}: the index misses a key")
                first, size = index.first[slot].astype(np.int64), index.size[slot].astype(np.int64)
                with store.open_input_file(f"{base}/{shard['name']}.ids") as f:
                    for a in range(0, n, 512):
                        b = min(n, a + 512)
                        f.seek(int(first[a]) * index.width)
                        ids = np.frombuffer(f.read(int(size[a:b].sum()) * index.width), dtype=f"<u{index.width}").astype("<u4")
                        data, at = memoryview(ids.tobytes()), (first[a:b] - first[a]).tolist()
                        crc = [zlib.crc32(data[4 * x : 4 * (x + m)]) for x, m in zip(at, size[a:b].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(index.keys[a:b], mask=index.null[a:b]), pa.array(first[a:b] + shard["start"]), pa.array(size[a:b]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; each place comes from a key lookup."""
    store, base = _open(folder)
    with store.open_input_file(f"{base}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    listed = spark.createDataFrame([(i, s["name"], s["start"]) for i, s in enumerate(shards)], "shard int, name string, start bigint")
    return listed.repartitionById(min(MOST_TASKS, max(1, len(shards))), "shard").mapInArrow(_read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
