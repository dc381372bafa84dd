"""Post-processing of id arrays with built-in array functions: template, truncation, padding, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def template(ids: Column | str, prefix: list[int], suffix: list[int]) -> Column:
    return F.concat(_ints(prefix), _c(ids), _ints(suffix))


def truncate(ids: Column | str, max_length: int, template_ids: int = 0) -> Column:
    """The first ids that leave room for the template's."""
    return F.slice(_c(ids), F.lit(1), F.lit(max(0, max_length - template_ids)))


def padded_length(ids: Column | str, fixed: int = 0, multiple: int = 0, longest: Column | None = None) -> Column:
    target = F.greatest(F.size(_c(ids)), F.lit(fixed), *([longest] if longest is not None else []))
    return (F.ceil(target / multiple) * multiple).cast("int") if multiple else target


def pad(ids: Column | str, filler: int, *, fixed: int = 0, multiple: int = 0, longest: Column | None = None, left: bool = False) -> Column:
    """Never truncates; right unless ``left``."""
    more = F.array_repeat(F.lit(filler), padded_length(ids, fixed, multiple, longest) - F.size(_c(ids)))
    return F.concat(more, _c(ids)) if left else F.concat(_c(ids), more)


def pad_longest(df: DataFrame, ids: str, filler: int, *, batch: str | None = None, multiple: int = 0, left: bool = False) -> DataFrame:
    """Pads to the longest of each batch (a window over a column of batches of bounded size), or of the whole table (one
    aggregate as a scalar subquery, so no task sees the table)."""
    if batch is not None:
        return df.withColumn(ids, pad(ids, filler, multiple=multiple, left=left, longest=F.max(F.size(ids)).over(Window.partitionBy(batch))))
    return df.withColumn(ids, pad(ids, filler, multiple=multiple, left=left, longest=df.agg(F.coalesce(F.max(F.size(ids)), F.lit(0))).scalar()))


def attention_mask(ids: Column | str, padding: Column, left: bool = False) -> Column:
    ones, zeros = F.array_repeat(F.lit(1), F.size(_c(ids)) - padding), F.array_repeat(F.lit(0), padding)
    return F.concat(zeros, ones) if left else F.concat(ones, zeros)


def special_tokens_mask(ids: Column | str, n_prefix: int, n_suffix: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.lit(n_prefix)), F.array_repeat(F.lit(0), F.size(_c(ids)) - n_prefix - n_suffix), F.array_repeat(F.lit(1), F.lit(n_suffix)))
