"""Streams: decoding ids as they come, by key, and token counts in windows of event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphmill.operators.columns import Engine, _tokenizer
from glyphmill.operators.decoding import Decoder


def decoded(ids: DataFrame, key: str, engine: Engine, *, skip_special_tokens: bool = False) -> DataFrame:
    """(key, seq, text) for a stream of (key, seq, id, done): the text that each micro-batch settles for each key.

    ``seq`` orders a key's ids; a row with ``done`` ends the key's text and gives what was held.  State is the held bytes,
    the characters still to strip, whether a token came yet and whether the open run is text; all pushes together give what decoding at once gives.
    """
    shared = engine._shared

    def step(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = _tokenizer(shared)
        d = Decoder(t.decoders())
        if state.exists:
            held, strip, first, broken = state.get
            d.restore(bytes(held), strip, first, broken)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        text, ended = "", False
        for i, done in zip(rows["id"].tolist(), rows["done"].tolist(), strict=True):
            if i is not None and i == i:
                text += "".join(map(d.push, t.tokens_of([int(i)], skip_special_tokens)))
            if done:
                text += d.flush()
                ended = True
        if ended:
            state.remove()
        else:
            state.update(d.state())
        yield pd.DataFrame({key: [group[0]], "seq": [int(rows["seq"].max())], "text": [text]})

    kind = ids.schema[key].dataType.simpleString()
    return ids.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq bigint, text string", "held binary, strip int, first boolean, broken boolean", "append", GroupStateTimeout.NoTimeout)


def windowed_usage(rows: DataFrame, time: str, count: Column, window: str = "10 minutes", lateness: str = "30 minutes", by: str | None = None) -> DataFrame:
    """Rows and tokens for each window of event time (and each value of ``by``); late rows count up to the watermark."""
    marked = rows.withColumn("_tokens", count).withWatermark(time, lateness)
    keys = [F.window(time, window).alias("window"), *([F.col(by)] if by else [])]
    out = marked.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum("_tokens").alias("n_tokens"))
    return out.select(F.col("window.start").alias("window_start"), *([by] if by else []), "n_rows", "n_tokens")
