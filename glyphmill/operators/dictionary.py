"""A dictionary of pieces: the model runs once for each piece that was ever seen, and texts are encoded by joins.

The dictionary is a table (word, ids), bucketed by word.  It grows by what a batch has and it has not; a batch is joined to
it without moving it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import batches
from glyphmill.operators.columns import Engine, _tokenizer
from glyphmill.operators.tokenizer import ALL

_WORDS = "array<struct<word: string, id: int, places: array<int>>>"


def words(engine: Engine, df: DataFrame, key: str, text: str, *, mode: str = ALL) -> DataFrame:
    """(key, word, id, places): the distinct words of each text with all their places in it; an added token has its id.

    Words are what the model sees (see ``Tokenizer.model_words``).  A null text, and an empty one, is one row without word
    and id.  What is shuffled later is a row for each distinct word of a text, not one for each piece.
    """
    shared = engine._shared

    def split(given: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizer(shared)
        for texts in given:
            for part in batches.parts(texts):
                strings, ids, places, ends = [], [], batches.Lists(), array("i", [0])
                for v in part:
                    found: dict[tuple[str, int | None], list[int]] = {}
                    for place, own in enumerate(t.model_words(v, mode) if v is not None else ()):
                        found.setdefault(own, []).append(place)
                    for (w, i), at in found.items():
                        strings.append(w if i is None else None)
                        ids.append(i)
                        places.add(at)
                    ends.append(len(ids))
                made = [pa.array(strings, pa.string()), pa.array(ids, pa.int32()), places.column()]
                yield batches.nested(ends, pa.StructArray.from_arrays(made, ["word", "id", "places"]))

    return df.select(F.col(key), F.explode_outer(F.arrow_udf(split, _WORDS)(text)).alias("w")).select(key, "w.word", "w.id", "w.places")


def modelled(engine: Engine, distinct: DataFrame) -> DataFrame:
    """(word, ids) of a column of distinct words."""
    return distinct.select("word", engine._function("array<int>", lambda t, v: t.word_ids(v))("word").alias("ids"))


def joined(engine: Engine, found: DataFrame, known: DataFrame, key: str, add_special_tokens: bool = True) -> DataFrame:
    """(key, ids) of the ``words`` of texts, by a dictionary that has all of them; ``key`` must be unique."""
    d = engine.tokenizer.definition
    every = found.join(known, "word", "left").withColumn("own", F.coalesce(F.when(F.col("id").isNotNull(), F.array("id")), "ids", F.array().cast("array<int>")))
    at = F.transform(F.coalesce("places", F.array().cast("array<int>")), lambda p: F.struct(p.alias("place"), F.col("own").alias("own")))
    placed = F.flatten(F.collect_list(at))
    ids = F.flatten(F.transform(F.array_sort(placed), lambda x: x["own"]))
    around = [F.array(*[F.lit(i) for i in own]).cast("array<int>") for own in ((d.prefix, d.suffix) if add_special_tokens else ((), ()))]
    return every.groupBy(key).agg(F.concat(around[0], ids, around[1]).alias("ids"))


def counted(engine: Engine, found: DataFrame, known: DataFrame, key: str, add_special_tokens: bool = True) -> DataFrame:
    """(key, n_tokens): sizes alone are joined and added, without places or ids."""
    d = engine.tokenizer.definition
    sizes = known.select("word", F.size("ids").alias("size"))
    each = found.select(key, "word", "id", F.coalesce(F.size("places"), F.lit(0)).alias("n")).join(sizes, "word", "left")
    own = F.col("n") * F.coalesce(F.when(F.col("id").isNotNull(), F.lit(1)), "size", F.lit(0))
    more = len(d.prefix) + len(d.suffix) if add_special_tokens else 0
    return each.groupBy(key).agg((F.sum(own) + F.lit(more)).cast("bigint").alias("n_tokens"))


class PieceDictionary:
    """A kept dictionary of one definition: ``name`` is its table, ``path`` the folder of its files.

    Two batches must not extend one table at the same time.  A batch that is repeated after a failure adds nothing that
    it has added before.
    """

    def __init__(self, engine: Engine, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.engine, self.spark, self.name, self.buckets = engine, spark, name, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (word STRING, ids ARRAY<INT>) USING parquet CLUSTERED BY (word) SORTED BY (word) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, found: DataFrame) -> DataFrame:
        """The distinct words that the dictionary lacks."""
        return found.select("word").where("word is not null").distinct().join(self.table().select("word"), "word", "left_anti")

    def extend(self, found: DataFrame) -> int:
        """Adds what is missing; tells how many words the model saw."""
        before = self.table().count()
        made = modelled(self.engine, self.missing(found)).repartition(self.buckets, "word").sortWithinPartitions("word")
        made.write.mode("append").format("parquet").bucketBy(self.buckets, "word").sortBy("word").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.table().count() - before

    def encode(self, df: DataFrame, key: str, text: str, **options: Any) -> DataFrame:
        """(key, ids) of texts whose words the dictionary has."""
        return joined(self.engine, words(self.engine, df, key, text), self.table(), key, **options)


def encode_by_words(engine: Engine, df: DataFrame, key: str, text: str, *, mode: str = ALL, add_special_tokens: bool = True) -> DataFrame:
    """(key, ids) by a dictionary of this table's own words; ``key`` must be unique, a null text gives the template alone."""
    found = words(engine, df, key, text, mode=mode)
    return joined(engine, found, modelled(engine, found.select("word").where("word is not null").distinct()), key, add_special_tokens)


def count_by_words(engine: Engine, df: DataFrame, key: str, text: str, *, mode: str = ALL, add_special_tokens: bool = True) -> DataFrame:
    """(key, n_tokens) likewise."""
    found = words(engine, df, key, text, mode=mode)
    return counted(engine, found, modelled(engine, found.select("word").where("word is not null").distinct()), key, add_special_tokens)
