"""The tokenizer as Spark columns: Arrow-batched functions over a broadcast definition.

Each worker compiles a definition once and keeps the pieces it has seen, so repeated words cost one look.  Counting has a
function of its own, so that ids are neither sent back nor shuffled where only their number is wanted.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import cuts
from glyphmill.operators import batches, cutting
from glyphmill.operators.tokenizer import ALL, Tokenizer
from glyphmill.sources.definition import Definition, UnsupportedError

_ENCODING = "struct<ids:array<int>,type_ids:array<int>,tokens:array<string>,attention_mask:array<int>,special_tokens_mask:array<int>>"

_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.field("element", pa.string()))}


class Engine:
    """A tokenizer to use in Spark expressions."""

    def __init__(self, spark: SparkSession, tokenizer: Tokenizer | Definition):
        d = tokenizer.definition if isinstance(tokenizer, Tokenizer) else tokenizer
        self.tokenizer = tokenizer if isinstance(tokenizer, Tokenizer) else Tokenizer(d)
        self._shared = spark.sparkContext.broadcast(d)
        batches.tune(spark)

    def unload(self) -> None:
        """Takes the definition off the executors; a later use sends it again."""
        self._shared.unpersist()

    def _function(self, kind: str, body: Callable[[Tokenizer, Any], Any]) -> Callable[[Column | str], Column]:
        """Numbers come as one column for a batch, so that several functions share a worker; all else is given back in
        parts of a batch, so that what a worker holds does not grow with the batch."""
        shared = self._shared

        def number(values: pa.Array) -> pa.Array:
            t = _tokenizer(shared)
            return pa.array((None if v is None else body(t, v) for v in batches.rows(values)), _ARROW[kind], size=len(values))

        def run(given: Iterator[pa.Array]) -> Iterator[pa.Array]:
            t = _tokenizer(shared)
            for values in given:
                yield from batches.made(values, lambda v: body(t, v), _ARROW.get(kind))

        return F.arrow_udf(number if kind == "bigint" else run, kind)

    def encode(self, text: Column | str, *, add_special_tokens: bool = True, mode: str = ALL, continuation: bool = False, truncate: bool = True, pad: bool = True, empty: bool = True) -> Column:
        """``array<int>`` of ids; null stays null, and without ``empty`` no ids are null too.  The column may be STRING or
        BINARY (any bytes)."""

        def body(t: Tokenizer, v: str | bytes) -> list[int] | None:
            ids = t.encode(v, add_special_tokens=add_special_tokens, added_tokens=mode, continuation=continuation, truncate=truncate, pad=pad)
            return ids if ids or empty else None

        return self._function("array<int>", body)(text)

    def encode_ordinary(self, text: Column | str) -> Column:
        return self._function("array<int>", lambda t, v: t.encode_ordinary(v))(text)

    def encode_allowed(self, text: Column | str, allowed_special: set[str] | str = frozenset(), disallowed_special: set[str] | str = "all") -> Column:
        """Fails the query on a disallowed special token, as the library call raises."""
        return self._function("array<int>", lambda t, v: t.encode_allowed(v, allowed_special, disallowed_special))(text)

    def token_count(self, text: Column | str, *, add_special_tokens: bool = True, mode: str = ALL) -> Column:
        return self._function("bigint", lambda t, v: t.token_count(v, add_special_tokens=add_special_tokens, added_tokens=mode))(text)

    def encoding(self, text: Column | str, *, add_special_tokens: bool = True) -> Column:
        """ids, type_ids, tokens and both masks as one struct; null stays null, and tokens that ids do not tell are null."""

        def body(t: Tokenizer, v: str) -> dict[str, list | None]:
            e = t.encode_ex(v, add_special_tokens=add_special_tokens)
            return {"ids": e.ids, "type_ids": e.type_ids, "tokens": e.strings, "attention_mask": e.attention_mask, "special_tokens_mask": e.special_tokens_mask}

        shared = self._shared

        def run(given: Iterator[pa.Array]) -> Iterator[pa.Array]:
            t = _tokenizer(shared)
            for values in given:
                for part in batches.parts(values):
                    numbers = {n: batches.Lists() for n in ("ids", "type_ids", "attention_mask", "special_tokens_mask")}
                    tokens: list[list[str] | None] = []
                    for v in part:
                        made = body(t, v or "")
                        tokens.append(made["tokens"])
                        for n, lists in numbers.items():
                            lists.add(made[n])
                    columns = {n: lists.column() for n, lists in numbers.items()} | {"tokens": pa.array(tokens, pa.list_(pa.field("element", pa.string())))}
                    names = ["ids", "type_ids", "tokens", "attention_mask", "special_tokens_mask"]
                    yield pa.StructArray.from_arrays([columns[n] for n in names], names)

        column = F.col(text) if isinstance(text, str) else text
        return F.when(column.isNotNull(), F.arrow_udf(run, _ENCODING)(column))

    def normalized(self, text: Column | str) -> Column:
        return self._function("string", lambda t, v: t._normalize(v))(text)

    def pieces(self, text: Column | str, mode: str = ALL) -> Column:
        return self._function("array<string>", lambda t, v: t.pieces(v, mode))(text)

    def piece_ends(self, text: Column | str, mode: str = ALL) -> Column:
        return self._function("array<int>", lambda t, v: t.piece_ends(v, mode))(text)

    def segments(self, text: Column | str, mode: str = ALL) -> Column:
        """Added tokens and the gaps between them: ``array<struct<text, id>>``, a gap's id being null."""
        shared = self._shared

        def run(given: Iterator[pa.Array]) -> Iterator[pa.Array]:
            t = _tokenizer(shared)
            for values in given:
                for part in batches.parts(values):
                    texts, ids, ends, missing = [], [], array("i", [0]), []
                    for v in part:
                        missing.append(v is None)
                        for s, i, _ in t.segments(v, mode) if v is not None else ():
                            texts.append(s)
                            ids.append(i)
                        ends.append(len(ids))
                    yield batches.nested(ends, pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(ids, pa.int32())], ["text", "id"]), missing)

        return F.arrow_udf(run, "array<struct<text:string,id:int>>")(text)

    def decode(self, ids: Column | str, *, skip_special_tokens: bool = True) -> Column:
        """Text; an id beyond the table fails the query, a hole is passed over."""
        return self._function("string", lambda t, v: t.decode(v, skip_special_tokens))(ids)

    def decode_bytes(self, ids: Column | str) -> Column:
        return self._function("binary", lambda t, v: t.decode_bytes(v))(ids)

    def restored(self, text: Column | str, *, add_special_tokens: bool = True, skip_special_tokens: bool = True, empty: bool = True) -> Column:
        """``decode`` of ``encode``, text by text: the ids are no column.  Without ``empty`` a text without ids gives null."""

        def body(t: Tokenizer, v: str | bytes) -> str | None:
            ids = t.encode(v, add_special_tokens=add_special_tokens)
            return t.decode(ids, skip_special_tokens) if ids or empty else None

        return self._function("string", body)(text)

    def restored_bytes(self, text: Column | str) -> Column:
        """``decode_bytes`` of ``encode_ordinary`` likewise."""
        return self._function("binary", lambda t, v: t.decode_bytes(t.encode_ordinary(v)))(text)

    def split_points(self, text: Column | str, n_parts: int) -> Column:
        return self._function("array<int>", lambda t, v: t.split_points(v, n_parts))(text)

    def encode_bound(self, text: Column | str) -> Column:
        """The most ids that a text of this many bytes can have, by arithmetic alone."""
        t = self.tokenizer
        size = F.octet_length(F.col(text) if isinstance(text, str) else text).cast("bigint")
        if t.definition.padding:
            return self._function("bigint", lambda t, v: t.encode_bound(len(v.encode() if isinstance(v, str) else v)))(text)
        up = F.ceil(size * t.bound.rate.numerator / t.bound.rate.denominator)
        return (F.when(size == 0, F.lit(0)).otherwise(up + t.bound.before) + t.bound.template).cast("bigint")

    def encode_parts(self, df: DataFrame, key: str, text: str, part_chars: int) -> DataFrame:
        """(key, ids) of texts that are cut at certified places into parts of about ``part_chars``, encoded as rows of their
        own and put together in order: one giant text spreads over many tasks.  ``key`` must be unique."""
        n = F.greatest(F.lit(1), F.ceil(F.length(text) / part_chars).cast("int"))
        shared = self._shared

        def cut(texts: pd.Series, parts: pd.Series) -> pd.Series:
            t = _tokenizer(shared)
            out = []
            for v, k in zip(texts, parts, strict=True):
                at = [0, *t.split_points(v or "", int(k)), len(v or "")]
                out.append([(v or "")[a:b] for a, b in zip(at, at[1:], strict=False)])
            return pd.Series(out, dtype=object)

        def encoded(texts: pd.Series, places: pd.Series) -> pd.Series:
            t = _tokenizer(shared)
            return pd.Series([t.encode(v, add_special_tokens=False, continuation=bool(p), truncate=False, pad=False) for v, p in zip(texts, places, strict=True)], dtype=object)

        parts = df.select(F.col(key), F.posexplode(F.pandas_udf(cut, "array<string>")(F.coalesce(F.col(text), F.lit("")), n)).alias("place", "part"))
        made = parts.repartition(F.col(key), F.col("place")).select(key, "place", F.pandas_udf(encoded, "array<int>")("part", "place").alias("ids"))
        whole = made.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])).alias("ids"))
        d = self.tokenizer.definition
        return whole.select(key, F.concat(*[F.array(*[F.lit(i) for i in d.prefix]).cast("array<int>")] * bool(d.prefix), F.col("ids"), *[F.array(*[F.lit(i) for i in d.suffix]).cast("array<int>")] * bool(d.suffix)).alias("ids"))

    def encode_cut(self, df: DataFrame, key: str, text: str, part_chars: int) -> DataFrame:
        """``encode_parts`` with the cuts made by the JVM, without added tokens and template: for definitions with a split
        whose sure places are known and no normalizer.  A part has ``part_chars`` characters and those up to the next sure
        place; a text without any is one part.  ``key`` must be unique; a null text has no ids."""
        name = cutting.family(self.tokenizer.definition)
        if name is None or self.tokenizer.definition.normalizers:
            raise UnsupportedError("no sure places are known for this definition")
        parts = df.select(F.col(key), F.posexplode_outer(cuts.parts(text, name, part_chars)).alias("place", "part"))
        made = parts.repartition(F.col(key), F.col("place")).select(key, "place", self.encode_ordinary("part").alias("ids"))
        ordered = F.array_sort(F.collect_list(F.struct("place", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))))
        return made.groupBy(key).agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def _tokenizer(shared: Any) -> Tokenizer:
    """The compiled tokenizer of a broadcast definition: made once in each worker, kept with the definition."""
    d = shared.value
    if (found := d.__dict__.get("_compiled")) is None:
        found = d.__dict__["_compiled"] = Tokenizer(d)
    return found
