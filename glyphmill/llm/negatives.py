"""Hard negatives: blocks of anchors, broadcast, times blocks of candidates as dense matrices of whole numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import vectors
from glyphmill.llm.session import new_folder, tune
from glyphmill.llm.vectors import Best

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score is between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Magnitudes up to which components are taken; scores of larger ones would hardly fit a long.
LARGEST = 1 << 40
#: Bits of a part of a component where whole products would not be exact in doubles.
PART_BITS = 20

_FOUND = "array<struct<score: bigint, id: bigint>>"
_WINDOW = "anchor int, slot int, anchor_id bigint, positive_id bigint, positive_score bigint, times bigint"
_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def components(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as whole numbers in doubles."""
    out = np.floor(x * scale)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError("a component is too large for scores in 64 bits")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of whole rows, exactly, as longs.

    One product of matrices in doubles is exact while no sum can reach 2^53; beyond that components are cut in two parts.
    """
    most = lambda m: float(np.abs(m).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most(a) * most(b) * a.shape[1] >= 2.0**63 and np.abs(a @ b.T).max() >= 2.0**62:
        raise ValueError("a score does not fit a long")
    low = lambda m: np.mod(m, 1 << PART_BITS)
    high = lambda m: np.floor(m / (1 << PART_BITS))
    whole = lambda x, y: (x @ y.T).astype(np.int64)
    cross = whole(high(a), low(b)) + whole(low(a), high(b))
    return (whole(high(a), high(b)) << 2 * PART_BITS) + (cross << PART_BITS) + whole(low(a), low(b))  # wraps to the sum, which fits


def _candidates(rows: Iterable[pa.RecordBatch], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components) in slices of rows with ascending ids."""
    for batch in rows:
        if batch.num_rows:
            ids, labels, x = vectors.longs(batch, "vec_id"), vectors.longs(batch, "label"), components(vectors.matrix(batch), scale)
            order = np.argsort(ids, kind="stable")
            for a in range(0, len(order), 4096):
                part = order[a : a + 4096]
                yield ids[part], labels[part], x[part]


def _tiles(n: int, columns: int) -> Iterator[slice]:
    size = max(1, vectors.TILE_VALUES // max(1, columns))
    return (slice(a, min(n, a + size)) for a in range(0, n, size))


def _positives(shared, scale: int, k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best rows with an anchor's label, itself among them."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, x, _ = shared.value
        best = Best(len(x), k)
        for ids, labels, y in _candidates(rows, scale):
            for at in _tiles(len(x), len(ids)):
                best.offer(at, products(x[at], y), ids, label[at, None] == labels[None, :])
        held, lists = best.lists()
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), lists], names=["anchor", "found"])

    return run


def _negatives(shared, scale: int, k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best rows with another label for each window of scores."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, x, windows = shared.value
        least, most = windows  # anchors x slots; an empty window has least over most
        best = [Best(len(x), k) for _ in range(least.shape[1])]
        for ids, labels, y in _candidates(rows, scale):
            for at in _tiles(len(x), len(ids)):
                scores = products(x[at], y)
                other = label[at, None] != labels[None, :]
                for slot, own in enumerate(best):
                    own.offer(at, scores, ids, other & (scores >= least[at, slot, None]) & (scores <= most[at, slot, None]))
        for slot, own in enumerate(best):
            held, lists = own.lists()
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(np.full(len(held), slot), pa.int32()), lists], names=["anchor", "slot", "found"])

    return run


def window(positive: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The scores s with least * positive <= 100 * s <= most * positive, from the least to the largest."""
    return -(-least * positive // 100), most * positive // 100


def mine(rows: DataFrame, anchors: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, least: int = LEAST, most: int = MOST, values: int = vectors.BLOCK_VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's best ``positives``
    the best ``negatives`` of another label whose scores are in the positive's window.

    ``rows`` have vec_id, label and embedding; ``anchors`` is a condition on vec_id and label.  Components become
    floor(scale * x), a score is the inner product of these, exactly.  Anchors are broadcast in blocks of at most
    ``values`` components, and each block meets every row twice: for its positives, then for the negatives in the windows
    that these set.  A task keeps only the best of each anchor, and those lists are merged; no pairs are written out.

    Rows with a null id, a null label, or a vector that is null, empty, not finite or of another length than most, take no
    part.  Rows with the same id, and repeated rows, are rows of their own: an anchor is left out of its own positives
    once, and a repeated anchor is answered as often as it comes.  Ties go by id.  An empty table, one without anchors,
    and one label alone give an empty result.  Further columns are ignored.  Components of 2^40 and more fail the query.
    """
    spark = tune(rows.sparkSession)
    known = vectors.usable(rows.where("vec_id is not null and label is not null"), "embedding", F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"))
    _, dim = vectors.shape(known)
    known = known.where(F.size("vector") == dim)
    chosen = known.where(anchors)
    folder = new_folder(spark, "negatives")
    paths = []
    for number, block in enumerate(vectors.blocks(chosen, chosen.count(), dim, "anchors", values)):
        paths.append(f"{folder}/{number}")
        _write_block(paths[-1], known, block, positives, negatives, scale, least, most)
    return spark.read.schema(_RESULT).parquet(*paths) if paths else spark.createDataFrame([], _RESULT)


def _write_block(path: str, known: DataFrame, block: pa.Table, positives: int, negatives: int, scale: int, least: int, most: int) -> None:
    context = known.sparkSession.sparkContext
    whole = block.combine_chunks().to_batches()[0]
    ids, label, times = (vectors.longs(whole, c) for c in ("vec_id", "label", "times"))
    x = components(vectors.matrix(whole), scale)
    first = context.broadcast((label, x, None))
    found = vectors.merged(known.mapInArrow(_positives(first, scale, positives + 1), f"anchor int, found {_FOUND}"), ["anchor"], positives + 1).toArrow()
    windows = np.ones((len(ids), positives), dtype=np.int64), np.zeros((len(ids), positives), dtype=np.int64)
    slots = []
    for anchor, best in zip(found["anchor"].to_pylist(), found["found"].to_pylist(), strict=True):
        own = int(products(x[anchor : anchor + 1], x[anchor : anchor + 1])[0, 0])
        kept = vectors.without_self([b["score"] for b in best], [b["id"] for b in best], own, int(ids[anchor]), positives)
        for slot, (score, positive) in enumerate(kept):
            windows[0][anchor, slot], windows[1][anchor, slot] = window(score, least, most)
            slots.append((anchor, slot, int(ids[anchor]), positive, score, int(times[anchor])))
    second = context.broadcast((label, x, windows))
    lists = vectors.merged(known.mapInArrow(_negatives(second, scale, negatives), f"anchor int, slot int, found {_FOUND}"), ["anchor", "slot"], negatives)
    told = known.sparkSession.createDataFrame(slots, _WINDOW)
    each = lists.join(told, ["anchor", "slot"]).select("anchor_id", "positive_id", "positive_score", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))), "found").drop("col")
    ranked = each.select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("place", "negative"))
    ranked.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("negative.id").alias("negative_id"), "positive_score", F.col("negative.score").alias("negative_score")).write.parquet(path)
    first.destroy()
    second.destroy()


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh row's label moved on by one, so that labels and vectors disagree somewhere."""
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
