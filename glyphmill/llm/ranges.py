"""Ranges of a key with about equally many rows each, by fixed cuts: every evaluation deals rows out alike."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cuts that are written into the plan; beyond them each of so many ranges is cut again, by a small table.
MOST_COARSE = 1024
#: Cuts inside each of those.  A table of cuts has MOST_COARSE * MOST_FINE longs at most: 8 MB.
MOST_FINE = 1024


def _steps(cuts: list[int]) -> list[list[int]]:
    """The cuts in about as many groups as a group has cuts, so that a search looks at few of them."""
    size = max(1, math.ceil(math.sqrt(len(cuts))))
    return [cuts[i : i + size] for i in range(0, len(cuts), size)]


@dataclass(frozen=True)
class Ranges:
    """Ascending distinct starts of the ranges, in one or more coarse groups; and the rows that were counted.

    The first range also has the null keys and all keys below its start.
    """

    groups: list[list[int]]
    rows: int

    @property
    def starts(self) -> list[int]:
        return [c for g in self.groups for c in g]

    def __len__(self) -> int:
        return sum(len(g) for g in self.groups)

    def numbered(self, df: DataFrame, key: str, to: str, start: str | None = None) -> DataFrame:
        """``df`` with the number of each row's range in ``to`` (and the start of that range in ``start``)."""
        if not self.groups:
            return df.withColumn(to, F.lit(0).cast("bigint")).withColumn(start, F.lit(None).cast("bigint")) if start else df.withColumn(to, F.lit(0).cast("bigint"))
        coarse = [g[0] for g in self.groups] if len(self.groups) > 1 else self.groups[0]
        found, at = _search(F.array(*[F.array(*[F.lit(c) for c in s]) for s in _steps(coarse)]), key)
        if len(self.groups) == 1:
            out = df.withColumn(to, found)
            return out.withColumn(start, at) if start else out
        before = 0
        table = []
        for i, g in enumerate(self.groups):
            table.append((i, before, _steps(g)))
            before += len(g)
        fine = df.sparkSession.createDataFrame(table, "range_group bigint, range_before bigint, range_cuts array<array<bigint>>")
        joined = df.withColumn("range_group_of", found).join(F.broadcast(fine), F.col("range_group_of") == F.col("range_group"))
        inside, at = _search(F.col("range_cuts"), key)
        out = joined.withColumn(to, F.col("range_before") + inside)
        out = out.withColumn(start, at) if start else out
        return out.drop("range_group", "range_group_of", "range_before", "range_cuts")


def _search(steps: Column, key: str) -> tuple[Column, Column]:
    """The number of the last cut at or below the key (0 for none), and that cut, in two short steps."""
    at_most = lambda c: c <= F.col(key)
    step = F.greatest(F.size(F.filter(steps, lambda s: at_most(F.get(s, F.lit(0))))) - 1, F.lit(0))
    own = F.get(steps, step)
    place = F.greatest(F.size(F.filter(own, at_most)) - 1, F.lit(0))
    return (step * F.size(F.get(steps, F.lit(0))) + place).cast("bigint"), F.get(own, place)


def _cuts(rows: DataFrame, key: str, n: int, by: list[str]) -> DataFrame:
    shares = F.array(*[F.lit(i / n) for i in range(n)])
    return rows.groupBy(*by).agg(F.min(key).alias("least"), F.percentile_approx(key, shares, max(10_000, 4 * n)).alias("cuts"))


def ranges(df: DataFrame, key: str, rows_per_range: float, most: int = MOST_COARSE * MOST_FINE) -> Ranges:
    """Ranges of ``key`` with about ``rows_per_range`` rows; beyond ``most`` of them they grow.

    One pass over that column alone, or two if there are more than MOST_COARSE ranges.  Equal keys stay together.  An
    empty table, or one of null keys alone, has no cuts.
    """
    keys = df.select(F.col(key).cast("bigint").alias("key"))
    rows = keys.count()
    n = min(most, max(1, math.ceil(rows / rows_per_range)))
    coarse = min(n, MOST_COARSE) if n <= MOST_COARSE else math.ceil(math.sqrt(n))
    row = _cuts(keys, "key", coarse, []).first()
    if row is None or row["least"] is None:
        return Ranges([], rows)
    first = Ranges([sorted({row["least"], *row["cuts"]})], rows)
    if n <= MOST_COARSE:
        return first
    found = _cuts(first.numbered(keys.where("key is not null"), "key", "at"), "key", math.ceil(n / coarse), ["at"]).collect()
    return Ranges([sorted({r["least"], *r["cuts"]}) for r in sorted(found, key=lambda r: r["at"])], rows)


#: A key with more than this many times a range's rows is cut by its ties.
CROWDED = 2


def parts(df: DataFrame, key: str, tie: str, rows_per_range: float) -> tuple[DataFrame, int]:
    """``df`` with the number of each row's part in ``part`` and whether it can be the first there in ``starts``; and the parts.

    Parts follow each other in the order of (key, tie), null keys first.  They are ranges of the key; one key, or null, that
    many rows have is cut by ranges of its ties, which are taken to be hashes.  Rows of one key and one tie stay together.
    What is collected and broadcast is a row for each part of the ranges that hold such a key, or for each part where there
    are any.  In a part of several first keys alike all of them can be the first.
    """
    cuts = ranges(df, key, rows_per_range)
    k = F.col(key)
    numbered = cuts.numbered(df, key, "own", "starts_at")
    numbered = numbered.withColumn("level", F.when(k.isNull(), 0).when(k == F.col("starts_at"), 1).otherwise(2))
    held = numbered.groupBy("own", "level").count().where((F.col("level") < 2) & ((F.col("count") > CROWDED * rows_per_range) | (F.col("level") == 0))).collect()
    nulls = any(r["level"] == 0 for r in held)
    crowded = {(r["own"], r["level"]): math.ceil(r["count"] / rows_per_range) for r in held if r["count"] > CROWDED * rows_per_range}
    n = max(1, len(cuts))
    if not crowded:
        first = F.when(F.col("own") == 0, F.col("level") == (0 if nulls else 1)).otherwise(F.col("level") == 1)
        return numbered.withColumns({"part": F.col("own"), "starts": first}).drop("own", "starts_at", "level"), n
    spark = df.sparkSession
    owns = sorted({own for own, _ in crowded})
    cut = spark.createDataFrame([(own, level, crowded.get((own, level), 1)) for own in owns for level in range(3)], "own bigint, level int, into bigint")
    share = F.col(tie) / F.lit(2.0**64) + F.lit(0.5)
    split = numbered.join(F.broadcast(cut), ["own", "level"], "left")
    split = split.withColumn("bucket", F.when(F.col("into").isNull(), F.lit(0)).otherwise(F.least(F.floor(share * F.col("into")), F.col("into") - 1)).cast("bigint"))
    split = split.withColumn("level", F.when(F.col("into").isNull(), F.lit(-1)).otherwise(F.col("level"))).drop("into")
    least = split.where("level >= 0").groupBy("own", "level", "bucket").agg(F.min(F.struct(k.alias("key"), F.col(tie).alias("tie"))).alias("first")).collect()
    every = [(r["own"], r["level"], r["bucket"], r["first"]["key"], r["first"]["tie"]) for r in least] + [(i, -1, 0, None, None) for i in range(n) if i not in owns]
    every = [(*row[:3], part, *row[3:]) for part, row in enumerate(sorted(every, key=lambda r: r[:3]))]
    table = spark.createDataFrame(every, "own bigint, level int, bucket bigint, part bigint, first_key bigint, first_tie bigint")
    found = split.join(F.broadcast(table), ["own", "level", "bucket"])
    only = (F.col("level") < 0) & ((k.isNull() if nulls else k == F.col("starts_at")) if 0 not in owns else F.lit(False))
    first = F.when(F.col("level") >= 0, k.eqNullSafe(F.col("first_key")) & (F.col(tie) == F.col("first_tie"))).when(F.col("own") > 0, k == F.col("starts_at")).otherwise(only)
    return found.withColumn("starts", F.coalesce(first, F.lit(False))).drop("own", "level", "bucket", "starts_at", "first_key", "first_tie"), len(every)
