"""Arrow columns to Python values and back, a few rows at a time, so that a batch never stands as Python objects."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch that is sent to a worker, where the session says nothing of it (Spark's own default is 64 MB).
BATCH, BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Rows that are Python values together, and characters (or ids) after which a part of a batch is given back.
ROWS, PART = 64, 1_000_000
INTS = pa.list_(pa.field("element", pa.int32()))


def tune(spark: SparkSession) -> None:
    """Batches by their bytes: 10,000 long texts, Spark's other limit, would stand in each worker once or twice.  A
    session's own limit stays."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BYTES_PER_BATCH)


def rows(values: pa.Array) -> Iterator[Any]:
    """The values one by one; ids come as lists of Python numbers."""
    for at in range(0, len(values), ROWS):
        some = values.slice(at, ROWS)
        if pa.types.is_list(some.type) and pa.types.is_integer(some.type.value_type) and not some.values.null_count:
            ends, flat = some.offsets.to_numpy(), some.values
            numbers = flat.slice(ends[0], ends[-1] - ends[0]).to_numpy().tolist()
            ends = (ends - ends[0]).tolist()
            there = some.is_valid().to_pylist()
            yield from (numbers[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], there))
        else:
            yield from some.to_pylist()


def parts(values: pa.Array) -> Iterator[Iterator[Any]]:
    """The values in parts of about ``PART`` characters, each of one row at least."""
    some: list[Any] = []
    size = 0
    for v in rows(values):
        some.append(v)
        size += len(v or "")
        if size > PART:
            yield iter(some)
            some, size = [], 0
    if some:
        yield iter(some)


def made(values: pa.Array, body: Callable[[Any], Any], kind: pa.DataType | None) -> Iterator[pa.Array]:
    """What ``body`` makes of the values (of null: null), in columns of about ``PART`` numbers or characters, each of one
    row at least.  Without a kind these are lists of numbers."""
    size, some = 0, Lists() if kind is None else []
    for v in rows(values):
        own = None if v is None else body(v)
        (some.add if kind is None else some.append)(own)
        size += 1 + len(own or "") + (sum(map(len, own)) if own and kind is not None and pa.types.is_list(kind) else 0)
        if size > PART:
            yield some.column() if kind is None else pa.array(some, kind)
            size, some = 0, Lists() if kind is None else []
    if size or not len(values):
        yield some.column() if kind is None else pa.array(some, kind)


class Lists:
    """A column of lists of numbers, made flat from the first: four bytes a number."""

    def __init__(self) -> None:
        self.flat, self.ends, self.missing = array("i"), array("i", [0]), []

    def add(self, numbers: Iterable[int] | None) -> None:
        self.missing.append(numbers is None)
        if numbers is not None:
            self.flat.extend(numbers)
        self.ends.append(len(self.flat))

    def column(self) -> pa.Array:
        return nested(self.ends, pa.array(np.frombuffer(self.flat, dtype=np.int32) if self.flat else [], pa.int32()), self.missing)


def nested(ends: array, of: pa.Array, missing: list[bool] | None = None) -> pa.Array:
    """Lists that end at these places of a column."""
    none = pa.array(missing) if missing and any(missing) else None
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, dtype=np.int32)), of, type=pa.list_(pa.field("element", of.type)), mask=none)
