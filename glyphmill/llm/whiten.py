"""Whitening of embeddings: an exact scatter of whole numbers, its eigenvectors, and the projected rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import vectors
from glyphmill.llm.session import tune

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Bits of a part of an entry; a product of parts over ROWS rows stays below 2^53, so doubles hold it exactly.
PART_BITS, ROWS = 20, 4096
#: Bits of a part of a sum on its way between tasks: 2^31 tasks may add theirs in 64 bits.
SUM_BITS = 32

_PARTS = "i int, j int, part int, value bigint"
_RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string"


def shifted(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), which is the whole number of the contract less its shift."""
    out = np.floor(x * scale)
    if out.size and not np.abs(out).max() < 2.0**62:
        raise ValueError("an entry does not fit a long")
    return out.astype(np.int64)


def cross(z: np.ndarray) -> np.ndarray:
    """The cross-products of the columns of whole numbers, as Python integers of any size.

    Entries are cut in parts of PART_BITS bits, whose matrix products over ROWS rows are exact in doubles.
    """
    total = np.zeros((z.shape[1],) * 2, dtype=object)
    for a in range(0, len(z), ROWS):
        rest, parts = z[a : a + ROWS], []
        while np.abs(rest).max(initial=0) > 1 << PART_BITS:
            parts.append((rest & ((1 << PART_BITS) - 1)).astype(np.float64))
            rest = rest >> PART_BITS
        parts.append(rest.astype(np.float64))
        for i, left in enumerate(parts):
            for j, right in enumerate(parts):
                total += (left.T @ right).astype(np.int64).astype(object) << (PART_BITS * (i + j))
    return total


def _scatter(scale: int):
    """A task's cross-products of (1, row), so that counts, sums and products come alike, in parts of SUM_BITS bits."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in rows:
            if batch.num_rows:
                y = shifted(vectors.matrix(batch), scale)
                own = cross(np.concatenate([np.ones((len(y), 1), dtype=np.int64), y], axis=1))
                total = own if total is None else total + own
        if total is None:
            return
        out = []
        for i, j in zip(*np.triu_indices(len(total)), strict=True):
            rest, part = int(total[i, j]), 0
            while rest not in (0, -1):
                out.append((i, j, part, rest & ((1 << SUM_BITS) - 1)))
                rest, part = rest >> SUM_BITS, part + 1
            if rest:
                out.append((i, j, part, -1))
        i, j, part, value = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(part, pa.int32()), pa.array(value, pa.int64())], names=["i", "j", "part", "value"])

    return run


def exact_scatter(known: DataFrame, dim: int, scale: int = SCALE) -> tuple[int, list[int], np.ndarray]:
    """(n, S, n·XᵀX - SSᵀ) of the shifted rows, exactly.  Tasks send (dim + 1)² / 2 sums each, which Spark adds by place;
    the driver gets one such set, whatever the number of rows."""
    summed = known.mapInArrow(_scatter(scale), _PARTS).groupBy("i", "j", "part").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((dim + 1,) * 2, dtype=object)
    for i, j, part, value in zip(*(summed[c].to_pylist() for c in ("i", "j", "part", "value")), strict=True):
        total[i, j] += value << (SUM_BITS * part)
        if i != j:
            total[j, i] = total[i, j]
    n, sums = int(total[0, 0]), [int(s) for s in total[0, 1:]]
    s = np.array(sums, dtype=object)
    return n, sums, n * total[1:, 1:] - np.outer(s, s)


def principal(n: int, scatter: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, shares of the trace) of the covariance, by falling eigenvalue.

    Each entry is divided once, from whole numbers, so it is the nearest double.  A vector's largest entry is positive.
    Eigenvalues that are nothing but rounding (at most dim * 2^-52 of the largest) are left out.
    """
    square = n * n
    covariance = np.array([[int(v) / square for v in row] for row in scatter], dtype=np.float64)
    value, vector = np.linalg.eigh(covariance)
    order = np.argsort(-value, kind="stable")[:most]
    order = order[value[order] > max(0.0, len(value) * 2.0**-52 * value.max(initial=0.0))]
    value, vector = value[order], vector[:, order]
    vector *= np.where(vector[np.abs(vector).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0) if len(order) else 1.0
    trace = sum(int(scatter[i, i]) for i in range(len(scatter)))
    return value, vector, np.array([v / (trace / square) for v in value])


def deviations(y: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """n·x - S of each entry, and the sums of their squares, in longs where they fit and in Python integers where not."""
    bound = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums), default=0)
    kind = np.int64 if y.shape[1] * bound * bound < 1 << 63 else object
    d = y.astype(kind) * n - np.array(sums, dtype=kind)
    return d, [int(v) for v in (d * d).sum(axis=1)]


def _projected(y: np.ndarray, n: int, sums: list[int], scale: np.ndarray) -> tuple[np.ndarray, list[int]]:
    d, squares = deviations(y, n, sums)
    return (d.astype(np.float64) / n) @ scale, squares


def whiten(rows: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits of ``vec_id, embedding``.

    An entry c becomes x = floor(1024 c) + 100000.  Tasks leave out the shift, which no covariance depends on, and add up
    sums and cross-products as integers of any size; n·XᵀX - SSᵀ is formed exactly, and only then turned into doubles and
    decomposed.  Rows are centred as whole numbers before they are projected.  ``identity_error`` is measured on the
    projected rows themselves, in a pass of its own.

    Rows whose vector is null, empty, not finite, or of another length than most take no part; a null vec_id is kept.
    Repeated rows count and come back as often as they come.  Components without variance cannot be whitened and are left
    out, so that one row, equal rows, and an empty table give an empty result, and vectors of fewer than eight independent
    directions fewer components.  ``deviation`` is null where it does not fit a long (from some millions of rows on);
    ``deviation_digits`` always has it.  Entries with 2^52 and more fail the query.  Further columns are ignored.
    """
    spark = tune(rows.sparkSession)
    known = vectors.usable(rows, "embedding", F.col("vec_id").cast("bigint").alias("vec_id"))
    _, dim = vectors.shape(known)
    if not dim:
        return spark.createDataFrame([], _RESULT)
    known = known.where(F.size("vector") == dim)
    n, sums, scatter = exact_scatter(known, dim, scale)
    value, vector, explained = principal(n, scatter, components)
    k = len(value)
    if not k:
        return spark.createDataFrame([], _RESULT)
    by = vector / np.sqrt(value)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                w, _ = _projected(shifted(vectors.matrix(batch), scale), n, sums, by)
                z = np.concatenate([np.ones((len(w), 1)), w], axis=1)
                total += z.T @ z
        i, j = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "value"])

    moments = np.zeros((k + 1, k + 1))
    for row in known.mapInArrow(measured, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        moments[row["i"], row["j"]] = row["value"]
    mean = moments[0, 1:] / n
    error = float(np.abs(moments[1:, 1:] / n - np.outer(mean, mean) - np.eye(k)).max())

    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w, squares = _projected(shifted(vectors.matrix(batch), scale), n, sums, by)
            m, row = len(w), np.repeat(np.arange(len(w)), k)
            long = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
            columns = [
                batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), long.take(pa.array(row)),
                pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), pa.array([str(s) for s in squares]).take(pa.array(row)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])

    return known.mapInArrow(out, _RESULT)
