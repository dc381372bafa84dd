"""A definition's pieces as a table function, for SQL text and DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from glyphmill.operators.columns import Engine, _tokenizer
from glyphmill.operators.tokenizer import ALL


def register(spark: SparkSession, name: str, engine: Engine, mode: str = ALL) -> None:
    """``name(text)`` gives (place, piece, end) for each piece of a text, ``end`` in bytes of the normalized text; a null
    text and an empty one give no rows.  Used as ``FROM t, LATERAL name(t.text) p``."""
    shared = engine._shared

    class Pieces:
        def eval(self, text: str) -> Iterator[tuple[int, str, int]]:
            end = 0
            for place, piece in enumerate(_tokenizer(shared).pieces(text, mode) if text is not None else ()):
                end += len(piece.encode("utf-8", "surrogateescape"))
                yield place, piece, end

    spark.udtf.register(name, udtf(Pieces, returnType="place int, piece string, end bigint"))
