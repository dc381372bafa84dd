"""Keyed streams that end by themselves: ids to text and text to ids, with timers of event time and limits.

A key's state is a few plain values.  It is given up when a row says so (``done``), or when the watermark passes the key's
last row by ``idle``: then what was held is given out, and nothing of the key stays behind.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from glyphmill.operators import batches
from glyphmill.operators.columns import Engine, _tokenizer
from glyphmill.operators.decoding import HELD_BYTES, Decoder
from glyphmill.operators.tokenizer import ALL, EncodeStream
from glyphmill.sources.definition import LimitError

TEXT, LIMIT, EXPIRED = "ok", "limit", "expired"
#: What state is kept in: the provider that has timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNITS = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def milliseconds(span: str) -> int:
    """``10 minutes`` and the like."""
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", span)
    if not found:
        raise ValueError(f"span {span!r}")
    return int(found[1]) * _UNITS[found[2]]


class _Late:
    """A broadcast value for a processor: Spark also unpickles processors in a process of its own that has no broadcast
    values and only asks for the kinds of state; there it is None."""

    def __init__(self, shared: Broadcast):
        self.shared = shared

    def __reduce__(self) -> tuple:
        return _loaded, self.shared.__reduce__()


def _loaded(load: Callable, given: tuple) -> Broadcast | None:
    try:
        return load(*given)
    except PySparkRuntimeError:
        return None


class _Keyed(StatefulProcessor):
    """The common course: restore, take the rows in order, keep or end, move the timer."""

    schema = ""

    def __init__(self, shared: Any, key: str, time: str, idle: int):
        self.shared, self.key, self.time, self.idle = _Late(shared), key, time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.schema)

    def _frame(self, key: tuple, seq: int, out: Any, status: str) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "seq": [seq], self.column: [out], "status": [status]})

    def _move(self, until: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is not None:
            self.handle.registerTimer(until)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values("seq", kind="stable")
        work, last = self._work(self.kept.get() if self.kept.exists() else None)
        seq, latest = int(given["seq"].max()), int(given[self.time].max().timestamp() * 1000)
        try:
            out, ended = self._taken(work, given)
        except LimitError:
            self._move(latest + self.idle)  # the rows are refused as a whole; what was held stays
            yield self._frame(key, seq, self.nothing, LIMIT)
            return
        if ended:
            self.kept.clear()
            self._move(None)
        else:
            self.kept.update((*self._state(work), max(seq, last)))
            self._move(latest + self.idle)
        yield self._frame(key, seq, out, TEXT)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            work, last = self._work(self.kept.get())
            out = work.flush()
            self.kept.clear()
            yield self._frame(key, last, out, EXPIRED)

    def close(self) -> None:
        pass


class _Decoding(_Keyed):
    schema, column, nothing = "held binary, strip int, first boolean, broken boolean, last bigint", "text", ""

    def __init__(self, *common: Any, skip: bool, hold: int | None):
        super().__init__(*common)
        self.skip, self.hold = skip, hold

    def _work(self, kept: tuple | None) -> tuple[Decoder, int]:
        d = Decoder(_tokenizer(self.shared).decoders())
        if kept is None:
            return d, -1
        held, strip, first, broken, last = kept
        return d.restore(bytes(held), strip, first, broken), last

    def _taken(self, work: Decoder, given: pd.DataFrame) -> tuple[str, bool]:
        t, out, ended = _tokenizer(self.shared), "", False
        for i, done in zip(given["id"].tolist(), given["done"].tolist(), strict=True):
            if i is not None and i == i:
                out += work.push_all(t.tokens_of([int(i)], self.skip), self.hold)
            if done:
                out += work.flush()
                ended = True
        return out, ended

    @staticmethod
    def _state(work: Decoder) -> tuple:
        return work.state()


class _Encoding(_Keyed):
    schema, column, nothing = "held string, started boolean, last bigint", "ids", []

    def __init__(self, *common: Any, mode: str, special: bool, most: int | None):
        super().__init__(*common)
        self.mode, self.special, self.most = mode, special, most

    def _work(self, kept: tuple | None) -> tuple[EncodeStream, int]:
        e = EncodeStream(_tokenizer(self.shared), self.mode, self.special)
        return (e, -1) if kept is None else (e.restore(kept[0], kept[1]), kept[2])

    def _taken(self, work: EncodeStream, given: pd.DataFrame) -> tuple[list[int], bool]:
        out, ended = [], False
        for text, done in zip(given["text"].tolist(), given["done"].tolist(), strict=True):
            if isinstance(text, str):
                out += work.push(text)
                if self.most is not None and len(work.kept) > self.most:
                    raise LimitError("too much text without a sure place")
            if done:
                out += work.flush()
                ended = True
        return out, ended

    @staticmethod
    def _state(work: EncodeStream) -> tuple:
        return work.state()


def _run(rows: DataFrame, key: str, time: str, processor: _Keyed, kind: str) -> DataFrame:
    of = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {of}, seq bigint, {processor.column} {kind}, status string", "append", "eventTime")


def decoded(ids: DataFrame, key: str, time: str, engine: Engine, *, idle: str = "10 minutes", hold: int | None = HELD_BYTES, skip_special_tokens: bool = False) -> DataFrame:
    """(key, seq, text, status) for a stream of (key, time, seq, id, done) with a watermark on ``time``.

    ``ok`` has the text that a micro-batch settles, and all that was held if a row has ``done``; ``expired`` what was held
    by a key that was idle; ``limit`` tells that a key's rows of this micro-batch would hold more than ``hold`` bytes of an
    undecided run: none of them is taken, and the state is as it was.  A null id is passed over.
    """
    return _run(ids, key, time, _Decoding(engine._shared, key, time, milliseconds(idle), skip=skip_special_tokens, hold=hold), "string")


def encoded(texts: DataFrame, key: str, time: str, engine: Engine, *, idle: str = "10 minutes", most: int | None = None, mode: str = ALL, add_special_tokens: bool = True) -> DataFrame:
    """(key, seq, ids, status) for a stream of (key, time, seq, text, done) with a watermark on ``time``: text that is
    appended to a key's text becomes the ids up to the last sure place; only what stands behind it is kept.

    A key's ids in order are those of its whole text.  ``most`` characters are kept at most, where given; more is told as
    ``limit``, and the micro-batch's rows of that key are not taken.  A null text is passed over.
    """
    return _run(texts, key, time, _Encoding(engine._shared, key, time, milliseconds(idle), mode=mode, special=add_special_tokens, most=most), "array<int>")


def encoded_batch(texts: DataFrame, key: str, engine: Engine, *, mode: str = ALL, add_special_tokens: bool = True) -> DataFrame:
    """(key, ids) of a table of (key, seq, text): what the stream gives for each key, all pushes and the end together."""
    shared = engine._shared

    def whole(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = EncodeStream(_tokenizer(shared), mode, add_special_tokens)
        started, last, ids, kind = False, None, array("i"), None

        def told(keys: list, lists: batches.Lists) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), lists.column()], [key, "ids"])

        for batch in given:
            kind = batch.schema.field(0).type
            keys, lists = [], batches.Lists()
            for own, text in zip(batches.rows(batch.column(0)), batches.rows(batch.column(1)), strict=True):
                if not started or not (own == last or (own != own and last != last)):
                    if started:
                        ids.extend(e.flush())
                        keys.append(last)
                        lists.add(ids)
                    started, last, ids = True, own, array("i")
                if text is not None:
                    ids.extend(e.push(text))
            if keys:
                yield told(keys, lists)
        if started:
            ids.extend(e.flush())
            lists = batches.Lists()
            lists.add(ids)
            yield told([last], lists)

    kind = texts.schema[key].dataType.simpleString()
    ordered = texts.select(key, "seq", "text").repartition(key).sortWithinPartitions(key, F.asc_nulls_last("seq")).select(key, "text")
    return ordered.mapInArrow(whole, f"{key} {kind}, ids array<int>")
