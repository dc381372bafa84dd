"""Vocabularies as tables, lookups as joins, and decoding by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.tokenizer import Tokenizer

#: A vocabulary is broadcast only up to so many rows (some 40 bytes each); beyond it the join shuffles.
MOST_BROADCAST = 2_000_000


def vocabulary(spark: SparkSession, t: Tokenizer) -> DataFrame:
    """id, token, bytes, flags, skip of every id that has a string."""
    rows = [(i, s, t.token_bytes(i), t.id_flags(i), i in t._skipped) for i, s in sorted(t._strings.items())]
    return spark.createDataFrame(rows, "id int, token string, bytes binary, flags int, skip boolean")


def added_tokens(spark: SparkSession, t: Tokenizer) -> DataFrame:
    rows = [(a.id, a.content, a.special, a.normalized, a.lstrip, a.rstrip, a.single_word, a.flags) for a in t.added_tokens()]
    return spark.createDataFrame(rows, "id int, content string, special boolean, normalized boolean, lstrip boolean, rstrip boolean, single_word boolean, flags int")


def merges(spark: SparkSession, t: Tokenizer) -> DataFrame:
    """rank, left, right, out; of a pair given twice the last rank holds."""
    listed = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(t.definition.merges)], "rank int, left string, right string")
    return listed.groupBy("left", "right").agg(F.max("rank").alias("rank")).select("rank", "left", "right", F.concat("left", "right").alias("out"))


def info(spark: SparkSession, t: Tokenizer) -> DataFrame:
    found = t.info()
    return spark.createDataFrame([tuple(found.values())], "algorithm string, n_ids int, n_added int, sha256 string, name string, max_length int, pad_id int, pad_length int, pad_multiple int, pad_left boolean, n_prefix int, n_suffix int, control_isolation boolean")


def _hinted(vocab: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(vocab) if rows <= MOST_BROADCAST else vocab


def lookup_ids(df: DataFrame, column: str, vocab: DataFrame, rows: int) -> DataFrame:
    """Adds token and flags of an id column; null where the id has no token."""
    return df.join(_hinted(vocab.select(F.col("id").alias(column), "token", "flags"), rows), column, "left")


def lookup_tokens(df: DataFrame, column: str, vocab: DataFrame, rows: int) -> DataFrame:
    """Adds the id of a binary column of token bytes; null where no token has them, or they are empty.  Of several ids with
    the same bytes an added token's is taken, then one that is written so, then the latest."""
    rank = F.struct((F.col("flags").bitwiseAND(F.lit(1)) == 1).alias("added"), (F.encode("token", "UTF-8") == F.col("bytes")).alias("written"), "id")
    best = vocab.where("length(bytes) > 0").groupBy(F.col("bytes").alias(column)).agg(F.max(rank)["id"].alias("id"))
    return df.join(_hinted(best, rows), column, "left")


def unknown_ids(df: DataFrame, column: str, vocab: DataFrame, rows: int) -> DataFrame:
    return df.join(_hinted(vocab.select(F.col("id").alias(column)), rows), column, "left_anti")


def decode_join(df: DataFrame, key: str, ids: Column | str, vocab: DataFrame, rows: int, *, skip_special: bool = True, raw: bool = False) -> DataFrame:
    """(key, text) of byte-level ids with built-in functions alone: explode, join, ordered concatenation, repair.  A
    vocabulary that can be broadcast is joined as one row instead, and looked up inside each array: no id is shuffled.

    ``raw`` gives the bytes as they are.  An id without a token fails the query.
    """
    if rows <= MOST_BROADCAST:
        return _decode_by_row(df, key, ids, vocab, skip_special, raw)
    each = df.select(F.col(key), F.posexplode_outer(ids).alias("place", "id"))
    found = each.join(_hinted(vocab.select("id", "bytes", "skip"), rows), "id", "left")
    checked = F.when(F.col("id").isNotNull() & F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("id: no token "), F.col("id").cast("string")))).otherwise(F.coalesce("bytes", F.lit(b"")))
    kept = found.withColumn("own", F.when(F.col("skip") & F.lit(skip_special), F.lit(b"")).otherwise(checked.cast("binary")))
    whole = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.hex("own").alias("own")))), lambda x: x["own"]), "").alias("hex"))
    out = F.unhex("hex")
    return whole.select(key, out.alias("bytes") if raw else F.make_valid_utf8(out.cast("string")).alias("text"))


def _decode_by_row(df: DataFrame, key: str, ids: Column | str, vocab: DataFrame, skip_special: bool, raw: bool) -> DataFrame:
    """The vocabulary as one array with the bytes of id i at place i, broadcast."""
    own = F.when(F.col("skip") & F.lit(skip_special), F.lit("")).otherwise(F.hex("bytes"))
    every = vocab.agg(F.max("id").alias("last")).select(F.explode(F.sequence(F.lit(0), F.greatest("last", F.lit(0)))).alias("id"))
    listed = every.join(vocab.select("id", own.alias("own")), "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", "own"))).alias("listed"))
    table = listed.select(F.transform("listed", lambda x: x["own"]).alias("_table"))

    def found(i: Column) -> Column:
        return F.when(i.isNull(), F.lit("")).otherwise(F.coalesce(F.get("_table", i), F.raise_error(F.concat(F.lit("id: no token "), i.cast("string"))).cast("string")))

    out = F.unhex(F.array_join(F.transform(F.coalesce("_ids", F.array().cast("array<int>")), found), ""))
    made = df.select(F.col(key), (F.col(ids) if isinstance(ids, str) else ids).alias("_ids")).crossJoin(F.broadcast(table))  # one row
    return made.select(key, out.alias("bytes") if raw else F.make_valid_utf8(out.cast("string")).alias("text"))
