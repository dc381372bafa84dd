"""Document fingerprints by winnowing, in DataFrame functions alone.

A rolling hash (shifted exclusive or) tells the k code points at every place; of each window of ``w`` hashes the least is
chosen, the rightmost of equal ones, with its place.  Any run of at least ``w + k - 1`` code points that two texts share
gives both a common hash.  A choice is one long: 32 bits of hash, then the place counted down from 2**31 - 1, so the least
value of a window is the least hash at the rightmost place.

Carried from place to place the hash is  h' = (h << s) ^ value(next code point), in which a code point is gone after
64 / s steps.  Array functions see neighbours only, so the hashes of two code points come from those of one, those of four
from those of two, and so on:  h(a b) = (h(a) << s * |b|) ^ h(b).  Each of these steps, and each step of the windows' least
values, is one pass over an array that never leaves its expression.

Functions over array elements are interpreted, which costs microseconds a code point.  ``edited_fingerprints`` cuts texts
into pieces of STEP windows, a row each, and takes the same steps over columns, one for each place of a piece: Spark compiles
those.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.ranges import parts

K, W = 12, 8
#: Documents and bytes of text that are sorted together, on average, to find each one's successor.
ROWS_PER_RANGE, BYTES_PER_RANGE = 512, 1 << 22
#: Such ranges that a task takes, and tasks at most; beyond those a task takes more.
PARTS_PER_TASK, MOST_TASKS = 4, 1 << 16
#: Windows of a piece.  A row has k + w - 2 more columns, and those beside them: beyond 100 Spark makes many small methods of a
#: step, but below that one for all steps, which would be too large for the JVM to compile.
STEP = 96

_HIGH = "-4294967296L"
_LAST = 2147483647
_ALL = 1 << 30


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _with_later(a: Column, later: Column, by: int, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of each element and the one ``by`` places later; null or the element's own where there is none."""
    return F.zip_with(a, F.slice(later, F.lit(by + 1), F.lit(_ALL)), f)


def _rolled(h: Column, k: int, then: Callable[[Column], Column], size: int = 1, kept: tuple[tuple[int, Column], ...] = ()) -> Column:
    """``then`` of the hashes of ``k`` code points from those of one, by doubling; the last k - 1 are null."""
    shift = max(1, 64 // k)
    joined = lambda more: lambda x, y: F.shiftleft(x, shift * more).bitwiseXOR(y)
    kept = (*kept, (size, h))
    if 2 * size <= k:
        return _let(_with_later(h, h, size, joined(size)), lambda x: _rolled(x, k, then, 2 * size, kept))
    have = size
    for more, own in reversed(kept[:-1]):
        if k & more:
            h, have = _with_later(h, own, have, joined(more)), have + more
    return then(h)


def grams(text: Column, k: int = K, shift: Column | int = 0) -> Column:
    """A long for each place of the text (see above), from its place plus ``shift``; a shorter text is one gram, an empty one none."""
    packed = lambda h, at: F.xxhash64(h).bitwiseAND(F.expr(_HIGH)).bitwiseOR((F.lit(_LAST) - shift - at).cast("long"))
    each = F.transform(F.split(text, ""), lambda c: F.xxhash64(c))
    every = _let(each, lambda h: _rolled(h, k, lambda x: F.transform(F.slice(x, F.lit(1), F.length(text) - (k - 1)), packed)))
    return F.when(F.length(text) >= k, every).when(F.length(text) > 0, F.array(packed(F.xxhash64(text), F.lit(0)))).otherwise(F.array().cast("array<long>"))


def least(made: Column, w: int = W) -> Column:
    """The least of each window of ``w`` grams, by doubling; fewer than ``w`` are one window."""
    if w & (w - 1):
        raise ValueError("w must be a power of two")

    def halved(a: Column, width: int, n: Column) -> Column:
        if width == w:
            return F.slice(a, F.lit(1), F.greatest(n - (w - 1), F.lit(1)))
        return _let(_with_later(a, a, width, lambda x, y: F.least(x, y)), lambda x: halved(x, 2 * width, n))

    return _let(made, lambda a: halved(a, 1, F.size(a)))


def _picked(pieces: DataFrame, k: int, w: int, step: int) -> DataFrame:
    """``pieces`` with ``picks`` instead of ``piece``: the choices of its first ``valid`` windows (at most ``step``), places from ``at``.

    The same values as those of ``grams`` and ``least``, with one column for each place.
    """
    if w & (w - 1):
        raise ValueError("w must be a power of two")
    beside = [F.col(c) for c in pieces.columns if c != "piece"]
    df = pieces

    def columns(made: list[Column]) -> list[Column]:
        nonlocal df
        df = df.select(*beside, *[c.alias(f"c{i}") for i, c in enumerate(made)])
        return [F.col(f"c{i}") for i in range(len(made))]

    def rolled(h: list[Column], have: int, to: int) -> list[Column]:
        by = max(1, 64 // k) * have
        return [functools.reduce(lambda x, y: F.shiftleft(x, by).bitwiseXOR(y), h[i : i + to : have]) for i in range(len(h) - to + have)]

    h = columns([F.xxhash64(F.get(F.split("piece", ""), F.lit(i))) for i in range(step + k + w - 2)])
    some = next(n for n in (4, 3, 2, 1) if k % n == 0)
    h = rolled(columns(rolled(h, 1, some)), some, k)
    m = columns([F.xxhash64(x).bitwiseAND(F.expr(_HIGH)).bitwiseOR((F.lit(_LAST - i) - F.col("at")).cast("long")) for i, x in enumerate(h)])
    m = columns([F.least(*m[i : i + w]) if w > 1 else m[i] for i in range(step)])
    # a choice stays that of windows in a row; no choice has the bit that marks those after the first
    again = F.lit(_LAST + 1)
    first = [m[0], *[F.when(x == y, again).otherwise(y) for x, y in zip(m, m[1:])]]
    return df.select(*beside, F.array_remove(F.slice(F.array(*first), F.lit(1), F.col("valid")), again).alias("picks"))


def _before(picks: str, to: str, step: int) -> Column:
    """The choices at places before ``to``, in order, from those of each piece."""
    whole = F.floor(F.col(to) / step).cast("int")
    rest = F.filter(F.coalesce(F.get(picks, whole), F.array().cast("array<long>")), lambda x: F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST).cast("long")) < F.col(to))
    return F.concat(F.flatten(F.slice(picks, F.lit(1), whole)), rest)


def with_fingerprint(df: DataFrame, text: str, to: str, *, k: int = K, w: int = W) -> DataFrame:
    """``df`` with the column ``to``: the chosen (hash, place) longs of ``text`` in order of place; empty for null."""
    return df.withColumn(to, F.coalesce(F.array_distinct(least(grams(F.col(text), k), w)), F.array().cast("array<long>")))


def hashes(chosen: str) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(F.col(chosen), lambda x: F.shiftright(x, 32)))


def places(chosen: str) -> Column:
    """The places (from 0) of a fingerprint's choices."""
    return F.transform(F.col(chosen), lambda x: (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST).cast("long"))).cast("int"))


def digest(chosen: str) -> Column:
    """A fingerprint as 32 hex digits: two 64-bit hashes of all its choices and places."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.col(chosen), F.lit(s))), 16, "0") for s in (1, 2)]))


def likeness(a: str, b: str, both: str) -> Column:
    """The Jaccard coefficient of two arrays of distinct hashes, of which ``both`` are shared; 1 if both arrays are empty."""
    every = F.size(a) + F.size(b) - F.col(both)
    return F.when(every == 0, F.lit(1.0)).otherwise(F.col(both) / every)


def fingerprints(docs: DataFrame, *, k: int = K, w: int = W) -> DataFrame:
    """Every text's choices: doc_id, n_chars and ``chosen``, an array of (hash, place); null counts as empty.

    A row alone, so repeated rows and null ids stay; equal texts have equal fingerprints; an empty table stays empty.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = with_fingerprint(rows, "text", "chosen", k=k, w=w).withColumn("at", places("chosen"))
    return made.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.arrays_zip(F.transform("chosen", lambda x: F.shiftright(x, 32)).alias("hash"), F.col("at").alias("place")).alias("chosen"))


def edited_fingerprints(docs: DataFrame, *, k: int = K, w: int = W, rows_per_range: int = ROWS_PER_RANGE, bytes_per_range: int = BYTES_PER_RANGE) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    The edited text ends in the start of the next document (ascending doc_id, null first, equal ids by their texts'
    hashes; after the last comes the first) in place of its own last floor(n/2) code points.  Rows are dealt out once,
    by fixed ranges of doc_id, and of the texts' hashes where many rows have one doc_id or none; each range also gets the first document of the one after it, so that none needs rows
    of another.  A single document is its own next.  Windows that lie inside the kept half, or inside what follows it,
    are those of the two documents; only the few between them are made anew.  Null texts count as empty; an empty text has
    no choices; texts may be of any length (a row must fit a task).  An empty table gives an empty result; further columns
    are ignored.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    mean = rows.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
    numbered, n = parts(rows.withColumn("tie", F.xxhash64("text")), "doc_id", "tie", max(1, min(rows_per_range, bytes_per_range / mean)))
    tasks = min(MOST_TASKS, max(math.ceil(n / PARTS_PER_TASK), min(n, docs.sparkSession.sparkContext.defaultParallelism)))
    # a row that can be the first of a part is also needed at the end of the part before it, and the first of all at the end of the last
    also = F.filter(F.array(F.struct(F.pmod(F.col("part") - 1, F.lit(n)).alias("part"), F.lit(1).alias("extra"))), lambda _: F.coalesce("starts", F.lit(False)))
    dealt = numbered.withColumn("to", F.explode(F.concat(F.array(F.struct("part", F.lit(0).alias("extra"))), also))).select("doc_id", "text", "tie", "to.part", "to.extra")
    dealt = dealt.withColumn("task", F.floor(F.col("part") * tasks / n).cast("int")).repartitionById(tasks, "task")
    order = Window.partitionBy("task", "part").orderBy("extra", F.asc_nulls_first("doc_id"), "tie")
    # the rows are sorted here, with nothing but their texts
    df = dealt.withColumns({"next_text": F.lead("text").over(order), "row": F.row_number().over(order)})
    df = df.withColumns({"n": F.length("text"), "keep": F.length("text") - F.floor(F.length("text") / 2).cast("int")})
    df = df.withColumn("used", F.least(F.col("n") - F.col("keep"), F.coalesce(F.length("next_text"), F.lit(0))))
    df = df.withColumn("edited", F.concat(F.expr("left(text, keep)"), F.expr("left(coalesce(next_text, ''), used)")))
    # a window spans k + w - 1 code points; shorter texts are one window, and have no pieces
    span = k + w - 1
    total = F.col("keep") + F.col("used")
    # Choices at places before ``own_to`` and ``next_to`` are those of windows inside the kept half and inside what follows it.
    # Choices beyond them are found anew, from the w - 1 windows that reach beyond those places, and from all windows between.
    df = df.withColumns({"own_to": F.greatest(F.col("keep") - (span - 1), F.lit(0)), "next_to": F.greatest(F.col("used") - (span - 1), F.lit(0))})
    df = df.withColumns({"across": F.greatest(F.col("own_to") - (w - 1), F.lit(0)), "end": F.col("keep") + F.greatest(F.col("next_to") - (w - 1), F.lit(0))})
    step = max(STEP, span + w)
    cut = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{span},{step + span - 1}}})).{{1,{step}}}"), F.lit(1))
    between = F.when(total >= span, F.substring(F.col("edited"), F.col("across") + 1, F.least(total, F.col("keep") + span - 1) - F.col("across"))).otherwise("")
    last = F.when(F.col("next_to") > 0, F.substring(F.col("edited"), F.col("end") + 1, total - F.col("end"))).otherwise("")
    df = df.withColumns({"cut": cut, "between": between, "last": last, "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256)})
    df = df.withColumns({"short": F.when(F.col("n") < span, F.col("text")), "edited_short": F.when(total < span, F.col("edited"))})
    at = lambda i: F.when(i < F.size("cut"), i * step).when(i == F.size("cut"), F.col("across")).otherwise(F.col("end"))
    pieces = F.transform(F.concat("cut", F.array("between", "last")), lambda x, i: F.struct((i - F.size("cut")).alias("of"), at(i).alias("at"), x.alias("piece")))
    df = df.withColumn("doc", F.struct("extra", "doc_id", "n", "keep", "own_to", "next_to", "edited_sha256", "short", "edited_short"))
    df = df.select("task", "part", "row", "doc", F.explode(pieces).alias("of"))
    df = df.select("task", "part", "row", F.when(F.col("of.of") == 0, F.col("doc")).alias("doc"), "of.of", "of.at", F.greatest(F.length("of.piece") - (span - 1), F.lit(0)).alias("valid"), "of.piece")
    df = _picked(df, k, w, step).groupBy("task", "part", "row").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.sort_array(F.collect_list(F.when(F.col("of") < 0, F.struct("of", "picks")))).getField("picks").alias("own"),
        *[F.max(F.when(F.col("of") == i, F.col("picks"))).alias(c) for i, c in enumerate(("between", "last"))],
    )
    df = df.select("task", "part", "row", "doc.*", "own", "between", "last")
    alone = lambda c: least(grams(F.col(c), k), w)
    df = df.withColumn("chosen", F.array_distinct(F.when(F.col("short").isNull(), F.flatten("own")).otherwise(alone("short"))))
    df = df.withColumn("hashes", hashes("chosen"))
    rows_of_part = Window.partitionBy("task", "part").orderBy("row")
    df = df.withColumns({f"next_{c}": F.lead(c).over(rows_of_part) for c in ("own", "hashes")}).where("extra = 0")
    moved = F.transform(_before("next_own", "next_to", step), lambda x: x - F.col("keep"))
    joint = F.concat(_before("own", "own_to", step), "between", moved, "last")
    df = df.withColumn("edited_chosen", F.array_distinct(F.when(F.col("edited_short").isNull(), joint).otherwise(alone("edited_short"))))
    df = df.withColumn("edited_hashes", hashes("edited_chosen"))
    # columns of their own, so that each is found once
    df = df.withColumns({f"both_{c}": F.size(F.array_intersect("hashes", f"{c}_hashes")) for c in ("edited", "next")})
    return df.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        digest("chosen").alias("fingerprint"),
        digest("edited_chosen").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes", "both_edited").alias("near_edited"),
        likeness("hashes", "next_hashes", "both_next").alias("near_next"),
    )
