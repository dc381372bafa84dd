"""Packing of tokenized documents into sequences: first-fit decreasing, in randomised groups of documents."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import tokens, words
from glyphmill.llm.session import tune

CAPACITY = 2048
#: Documents of a group, on average; a group's waste is about one sequence.
GROUP_DOCUMENTS = 2048

_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, piece bigint"


class FirstFit:
    """Bins in order, with a tournament tree over their free space: the first bin with room is found in log2(bins) steps."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, what it had free before) of the first bin with ``size`` free."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            node += free[node] < size
        before = free[node]
        free[node] -= size
        where = node - self.leaves
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
        return where, before


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, largest pieces first, ties in the given order.

    Pieces of the full capacity need no search: each is a bin of its own, numbered first.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    full = int((lengths >= capacity).sum())
    bins[order[:full]] = np.arange(full)
    fit = FirstFit(max(1, len(lengths) - full), capacity)
    for i in order[full:].tolist():
        where, before = fit.place(int(lengths[i]))
        bins[i], offsets[i] = full + where, capacity - before
    return bins, offsets


def _pieces(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40  # of the next piece: copies of a row are told apart by it alone
        with tokens.encoder(vocabulary) as encoder:
            for batch, raw in words.batches(rows):
                ids, offsets = encoder.encode_ended([x.decode("utf-8", "replace") for x in raw], end_id)
                sizes = np.diff(offsets)
                many = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(raw)), many)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                at = offsets[:-1][doc] + start
                data = memoryview(ids.astype("<u4").tobytes())
                spans = [data[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                out = [batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in spans], pa.int64()), pa.array(sizes[doc]), pa.array(np.arange(number, number + len(doc)))]
                number += len(doc)
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"]
                if with_ids:
                    out.append(pa.array([np.frombuffer(x, dtype="<i4") for x in spans], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _placed(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        group["sequence_id"] = (group["pack_group"].to_numpy().astype(np.int64) << 32) + bins
        group["offset"] = offsets
        return group.drop(columns=["pack_group", "piece"])

    return run


def pack(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = tokens.END_ID, vocabulary: str = tokens.VOCABULARY, group_documents: int = GROUP_DOCUMENTS, with_ids: bool = False) -> DataFrame:
    """Pieces of tokenized documents, placed in sequences of at most ``capacity`` ids.

    Each text becomes its ids and then ``end_id``, is cut at multiples of ``capacity``, and its pieces are placed by
    first-fit decreasing inside one of ``rows / group_documents`` random groups, by a hash of the piece and its number in
    its task, so that copies of one row go to different groups too.  A group is a bounded number of small rows and fits one
    task at any size of the input.  (The number is the same each time a task reads a table; ``docs`` should be one, and not
    the result of a shuffle whose rows come in any order.)

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if ``with_ids``), a row for each
    piece.  Null and empty texts are one piece of ``end_id`` alone.  A null doc_id is kept.  Repeated rows are packed as
    often as they come.  Ties of length go by doc_id, start and checksum.  An empty table gives an empty result; further
    columns are ignored.
    """
    tune(docs.sparkSession)
    groups = max(1, math.ceil(docs.count() / group_documents))
    schema = _PIECE + (", ids array<int>" if with_ids else "")
    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(vocabulary, capacity, end_id, with_ids), schema)
    grouped = made.withColumn("pack_group", F.pmod(F.xxhash64("piece", "ids_crc32"), F.lit(groups)))
    return grouped.groupBy("pack_group").applyInPandas(_placed(capacity), f"{schema}, sequence_id bigint, offset bigint".replace(", piece bigint", ""))
