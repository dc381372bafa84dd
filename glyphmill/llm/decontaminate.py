"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors whose document frequencies are counted over the whole corpus.  A distributed randomised SVD
of the benchmark's passages gives the latent space; overlapping windows of every document are projected into it and
compared with all benchmark passages by cosine.  A candidate is confirmed by the longest common subsequence of words,
weighed by inverse document frequency, and by whether the benchmark passage's answer is there too.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import words
from glyphmill.llm.session import tune

#: Buckets of the corpus's document frequencies: a fixed number, whatever the corpus.
BUCKETS = 1 << 18
_PARTS = 64
#: Words of a block; windows are whole blocks, so many and as far apart (both in blocks).
STEP = 4
WINDOWS = ((2, 1), (4, 2), (8, 4), (16, 8))
#: A passage is looked for in windows of half to twice its words (the longest windows: whatever is longer still).  In much
#: longer ones it is lost among other words, and much shorter ones hold too little of it to be confirmed.
FITTING = 2
#: Words of a benchmark passage; longer items are cut into passages that overlap by half.
PASSAGE = 64
#: Latent dimensions, and columns beyond them in the randomised range finder.
RANK, OVERSAMPLE, POWER_ROUNDS = 128, 16, 2
#: The least weight of a word, which one in every document has.
LEAST_WEIGHT = 0.1
#: A window is a candidate if its cosine in the latent space is so large, and if the share of its squared weight in words
#: of the benchmark, which is the square of a bound on its cosine with any passage, allows as much.
LEAST_COSINE = 0.5
LEAST_MASS = LEAST_COSINE**2
#: Windows of at least so many blocks and so large a share are joined to regions by themselves, and the weaker ones by
#: themselves: a weak window between two strong regions must not move the place where a long region is cut.
STRONG_BLOCKS, STRONG_MASS = 4, 0.4
#: Confirmed: so much of the passage's weight in the common subsequence; or less of it, but with the answer's words.
LEAST_SHARE, LEAST_SHARE_ANSWERED, LEAST_ANSWER = 0.6, 0.4, 0.8
#: Items with fewer words are found only where all their words stand in a row.
LEAST_WORDS = 6
#: Benchmark items, and characters of them, that make one block: what is on the driver and in a worker at a time.
MOST_ITEMS, MOST_CHARACTERS = 5_000, 4 << 20
#: Bytes of text that a worker holds while it searches block after block.
HELD_BYTES = 32 << 20


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _counted(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, documents = np.zeros(BUCKETS, dtype=np.int64), 0
    for _, texts in words.batches(rows):
        hashed, _, _, bounds = words.word_spans(texts, words.MARKS)
        of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        key = np.sort(of * BUCKETS + _bucket(hashed))
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        total += np.bincount(key[new] % BUCKETS, minlength=BUCKETS)
        documents += len(texts)
    parts = total.astype("<u4").reshape(_PARTS, -1)
    keep = [i for i in range(_PARTS) if parts[i].any()]
    yield pa.RecordBatch.from_arrays([pa.array([-1, *keep], pa.int32()), pa.array([np.array([documents], dtype="<u4").tobytes(), *(parts[i].tobytes() for i in keep)], pa.binary())], names=["part", "counts"])


def _sum_of(kind: str, out: str):
    def run(group: pa.Table) -> pa.Table:
        total = None
        for x in group.column(1).to_pylist():
            own = np.frombuffer(x, dtype=kind).astype(out)
            total = own if total is None else total + own
        return pa.table({"part": pa.array([group.column(0)[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    return run


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """By bucket of a word's hash, the documents with such a word; and the number of documents.  Over all rows."""
    made = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "part int, counts binary").groupBy("part").applyInArrow(_sum_of("<u4", "<u8"), "part int, counts binary")
    counts, documents = np.zeros((_PARTS, BUCKETS // _PARTS)), 0
    for r in made.collect():  # _PARTS + 1 rows of a fixed size
        values = np.frombuffer(r["counts"], dtype="<u8")
        if r["part"] < 0:
            documents = int(values[0])
        else:
            counts[r["part"]] = values
    return counts.ravel(), documents


def weights(counts: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequency by bucket: next to nothing for words that most documents have."""
    return np.maximum(np.log((documents + 1) / (counts + 1)), 0.0) + LEAST_WEIGHT


@dataclass(frozen=True)
class Passages:
    """Benchmark passages: their item, words (hashes), each word's weight, and which words are the answer."""

    item: list[int | None]
    hashed: list[np.ndarray]
    weight: list[np.ndarray]
    answer: list[np.ndarray]
    vocabulary: np.ndarray  # buckets of their weighty words, ascending
    short: list[tuple[int | None, np.ndarray]]  # items of fewer than LEAST_WORDS words


def passages(items: list[tuple[int | None, str | None, str | None]], idf: np.ndarray) -> Passages:
    """From (item_id, text, answer); without an answer, the text's last sentence or third of words stands for it."""
    out = Passages([], [], [], [], np.zeros(0, dtype=np.int64), [])
    seen: set[int] = set()
    for item, text, answer in items:
        raw = (text or "").encode()
        hashed, first, _, _ = words.word_spans([raw], words.MARKS)
        if len(hashed) < LEAST_WORDS:
            if len(hashed):
                out.short.append((item, hashed))
            continue
        if answer:
            wanted = set(words.word_spans([answer.encode()], words.MARKS)[0].tolist())
            is_answer = np.array([h in wanted for h in hashed.tolist()])
        else:
            body = raw.rstrip(b" .!?\n\t\r")
            stop = max(body.rfind(b". "), body.rfind(b"? "), body.rfind(b"! "), body.rfind(b".\n"), body.rfind(b"\n"))
            is_answer = first > stop
            if not 3 <= is_answer.sum() <= 2 * len(hashed) // 3:
                is_answer = np.arange(len(hashed)) >= 2 * len(hashed) // 3
        weight = idf[_bucket(hashed)]
        starts = range(0, max(1, len(hashed) - PASSAGE // 2), PASSAGE // 2) if len(hashed) > PASSAGE else [0]
        for a in starts:
            span = slice(a, a + PASSAGE)
            if weight[span].sum() > 0:
                out.item.append(item)
                out.hashed.append(hashed[span])
                out.weight.append(weight[span])
                out.answer.append(is_answer[span])
                seen.update(_bucket(hashed[span][weight[span] > 0]).tolist())
    return Passages(out.item, out.hashed, out.weight, out.answer, np.array(sorted(seen), dtype=np.int64), out.short)


def _gram_times(columns: int, matrix) -> object:
    """For sparse rows (columns, values): a task's part of A^T (A M), in parts of the result's rows."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.frombuffer(matrix.value, dtype="<f8").reshape(columns, -1)
        total = np.zeros_like(m)
        for batch in rows:
            for at, value in zip(batch.column(0), batch.column(1), strict=True):
                at, value = at.values.to_numpy(), value.values.to_numpy()
                np.add.at(total, at, np.outer(value, value @ m[at]))
        for i, part in enumerate(np.array_split(total, _PARTS)):
            if part.size:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.astype("<f8").tobytes()], pa.binary())], names=["part", "counts"])

    return run


def randomised_svd(rows: DataFrame, columns: int, rank: int, seed: int = 7) -> np.ndarray:
    """The first right singular vectors (columns x rank) of a distributed sparse matrix (at array<int>, value array<double>).

    Randomised range finder with power rounds: each round is one distributed product with A^T A, summed by parts of
    rows; only columns x (rank + OVERSAMPLE) values come to the driver.
    """
    spark = rows.sparkSession
    width = min(columns, rank + OVERSAMPLE)

    def product(m: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(m, dtype="<f8").tobytes())
        made = rows.mapInArrow(_gram_times(columns, shared), "part int, counts binary").groupBy("part").applyInArrow(_sum_of("<f8", "<f8"), "part int, counts binary")
        parts = {r["part"]: np.frombuffer(r["counts"], dtype="<f8") for r in made.collect()}
        shapes = np.array_split(np.zeros((columns, 0)), _PARTS)
        return np.vstack([parts.get(i, np.zeros(len(x) * m.shape[1])).reshape(-1, m.shape[1]) for i, x in enumerate(shapes) if len(x)])

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, width)))[0]
    for _ in range(POWER_ROUNDS):
        q = np.linalg.qr(product(q))[0]
    small = q.T @ product(q)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-value, kind="stable")[:rank]
    return q @ vector[:, best]


def subsequence(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which words of ``a`` are in a heaviest common subsequence with ``b`` (a mask)."""
    table = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        up = table[i]
        step = np.where(b == a[i], up[:-1] + weight[i], up[1:])
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(step, up[1:]))
    mask = np.zeros(len(a), dtype=bool)
    i, j = len(a), len(b)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            mask[i - 1] = True
            i, j = i - 1, j - 1
    return mask


class Searcher:
    """Looks for benchmark passages in texts."""

    def __init__(self, bench: Passages, idf: np.ndarray, basis: np.ndarray):
        self.bench, self.idf = bench, idf
        self.row = np.full(BUCKETS, -1, dtype=np.int32)
        self.row[bench.vocabulary] = np.arange(len(bench.vocabulary))
        self.words = (idf[bench.vocabulary][:, None] * basis).astype(np.float32)
        latent = np.array([self.words[self.row[b[b >= 0]]].sum(axis=0) for b in (_bucket(h[w > 0]) for h, w in zip(bench.hashed, bench.weight, strict=True))], dtype=np.float32).reshape(len(bench.hashed), basis.shape[1])
        self.latent = latent / np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))
        self.total = [w.sum() for w in bench.weight]
        length = np.array([len(h) for h in bench.hashed], dtype=np.int64)
        self.served = {}  # by blocks of a window: the passages that fit, and whether each row of the vocabulary is of one
        for size, _ in WINDOWS:
            fits = (length <= FITTING * STEP * size) & ((FITTING * length >= STEP * size) | (size == WINDOWS[0][0]))
            own = np.zeros(len(bench.vocabulary) + 1, dtype=bool)
            for p in np.flatnonzero(fits).tolist():
                own[self.row[_bucket(bench.hashed[p])]] = True
            own[-1] = False  # the place of words that are not in the vocabulary
            self.served[size] = np.flatnonzero(fits), own
        self.whole = [*bench.short, *zip(bench.item, bench.hashed, strict=True)]
        # each passage stands under its rarest word: the word, its place, the passage's length, first and last word
        rarest = [int(np.argmax(idf[_bucket(h)])) for _, h in self.whole]
        anchor = np.array([h[k] for k, (_, h) in zip(rarest, self.whole, strict=True)], dtype=np.uint64)
        order = np.argsort(anchor, kind="stable")
        self.anchor, self.of = anchor[order], order
        self.back, self.long = np.array(rarest, dtype=np.int64), np.array([len(h) for _, h in self.whole], dtype=np.int64)
        self.first, self.last = (np.array([h[k] for _, h in self.whole], dtype=np.uint64) for k in (0, -1))

    def verbatim(self, hashed: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, place in ``whole``, first word) wherever all words of a passage stand in a row."""
        lo = np.searchsorted(self.anchor, hashed)
        at = np.flatnonzero(self.anchor[np.minimum(lo, len(self.anchor) - 1)] == hashed) if len(self.anchor) else np.zeros(0, dtype=np.int64)
        for a in range(0, len(at), 4096):
            x = at[a : a + 4096]
            n = np.searchsorted(self.anchor, hashed[x], "right") - lo[x]
            p = self.of[np.repeat(lo[x] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            begin = np.repeat(x, n) - self.back[p]
            end = begin + self.long[p]
            t = np.repeat(np.searchsorted(bounds, x, "right") - 1, n)
            inside = np.flatnonzero((begin >= bounds[t]) & (end <= bounds[t + 1]))
            p, begin, end, t = p[inside], begin[inside], end[inside], t[inside]
            for i in np.flatnonzero((hashed[begin] == self.first[p]) & (hashed[end - 1] == self.last[p])).tolist():
                if np.array_equal(hashed[begin[i] : end[i]], self.whole[p[i]][1]):
                    yield int(t[i]), int(p[i]), int(begin[i])

    def candidates(self, hashed: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, bool, int, int, float]]:
        """(text, passage, strong, first word, end word, cosine) of windows that are near a benchmark passage."""
        bucket = _bucket(hashed)
        count = np.diff(bounds)
        blocks = -(-count // STEP)
        begin = np.concatenate(([0], np.cumsum(blocks)))
        text = np.repeat(np.arange(len(count)), count)
        block = begin[text] + (np.arange(len(hashed)) - bounds[text]) // STEP
        squared = self.idf[bucket] ** 2
        row = self.row[bucket]
        known = np.flatnonzero((row >= 0) & (squared > 0))
        every = np.concatenate(([0.0], np.cumsum(np.bincount(block, squared, begin[-1]))))
        of = np.repeat(np.arange(len(count)), blocks)
        place = np.arange(begin[-1]) - begin[of]
        at, row = block[known], row[known]
        for size, apart in WINDOWS:
            fitting, own = self.served[size]
            if not len(fitting):
                continue
            of_fitting = known[own[row]]
            mine = np.concatenate(([0.0], np.cumsum(np.bincount(block[of_fitting], squared[of_fitting], begin[-1]))))
            latent = self.latent[fitting]
            first = np.flatnonzero(place % apart == 0)
            end = np.minimum(first + size, begin[of[first] + 1])
            mass = mine[end] - mine[first]
            keep = (mass > 0) & (mass >= LEAST_MASS * (every[end] - every[first]))
            strong = (mass >= STRONG_MASS * (every[end] - every[first]))[keep] & (size >= STRONG_BLOCKS)
            first, end = first[keep], end[keep]
            for a in range(0, len(first), 2048):
                x, y = first[a : a + 2048], end[a : a + 2048]
                lo, hi = np.searchsorted(at, x), np.searchsorted(at, y)
                n = hi - lo
                flat = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                z = np.add.reduceat(self.words[row[flat]], np.cumsum(n) - n, axis=0)
                near = (z / np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))) @ latent.T
                for w, q in np.argwhere(near >= LEAST_COSINE).tolist():
                    t, p = int(of[x[w]]), int(fitting[q])
                    yield t, p, bool(strong[a + w]), int(bounds[t] + (x[w] - begin[t]) * STEP), int(min(bounds[t + 1], bounds[t] + (y[w] - begin[t]) * STEP)), float(near[w, q])

    def hits(self, texts: list[bytes]) -> list[tuple[int, int | None, int, int, float, float, float]]:
        """(text, item, first byte, end byte, cosine, share, answer share), the best for each text and item."""
        hashed, begin, end, bounds = words.word_spans(texts, words.MARKS)
        spans: dict[tuple[int, int, bool], list[tuple[int, int, float]]] = {}
        for t, p, strong, a, b, c in self.candidates(hashed, bounds):
            spans.setdefault((t, p, strong), []).append((a, b, c))
        offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        best: dict[tuple[int, int | None], tuple] = {}
        for (t, p, _), found in spans.items():
            own, weight = self.bench.hashed[p], self.bench.weight[p]
            found.sort()
            regions: list[list] = []
            for a, b, c in found:
                if regions and a <= regions[-1][1] and max(b, regions[-1][1]) - regions[-1][0] <= 2 * len(own) + 2 * WINDOWS[-1][0] * STEP:
                    regions[-1][1] = max(b, regions[-1][1])
                    regions[-1][2] = max(c, regions[-1][2])
                else:
                    regions.append([a, b, c])
            for a, b, c in regions:
                lo, hi = max(int(bounds[t]), a - len(own)), min(int(bounds[t + 1]), b + len(own))
                part = hashed[lo:hi]
                weighty = weight * np.isin(own, part)
                if weighty.sum() < LEAST_SHARE_ANSWERED * self.total[p]:
                    continue
                mask = subsequence(own, part, weight)
                share = float(weight[mask].sum() / self.total[p])
                full = weight[self.bench.answer[p]].sum()
                answered = float(weight[mask & self.bench.answer[p]].sum() / full) if full > 0 else share
                if share >= LEAST_SHARE or (share >= LEAST_SHARE_ANSWERED and answered >= LEAST_ANSWER):
                    here = np.flatnonzero(np.isin(part, own[mask]))
                    hit = (t, self.bench.item[p], int(begin[lo + here[0]] - offset[t]), int(end[lo + here[-1]] - offset[t]), c, share, answered)
                    if (t, hit[1]) not in best or best[t, hit[1]][5] < share:
                        best[t, hit[1]] = hit
        for t, p, a in self.verbatim(hashed, bounds):
            item, own = self.whole[p]
            if (t, item) not in best or best[t, item][5] < 1:
                best[t, item] = (t, item, int(begin[a] - offset[t]), int(end[a + len(own) - 1] - offset[t]), 1.0, 1.0, 1.0)
        return sorted(best.values(), key=lambda h: (h[0], h[1] is not None, h[1] or 0))


_HITS = "doc_id bigint, item_id bigint, start_byte bigint, end_byte bigint, cosine double, lcs_share double, answer_share double"


def _searched(models: list, rows: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches with the hits of their texts.  Every row is read once: where there are more blocks of the benchmark than
    one, a worker searches all of them in HELD_BYTES of text before it reads on, and holds one block's model at a time."""
    searcher = Searcher(*models[0].value) if len(models) == 1 else None

    def found(held: list[tuple[pa.RecordBatch, list[bytes]]]) -> Iterator[tuple[pa.RecordBatch, list]]:
        hits: list[dict] = [{} for _ in held]
        for model in models:
            own = searcher or Searcher(*model.value)
            for best, (_, texts) in zip(hits, held, strict=True):
                for h in own.hits(texts):
                    if h[:2] not in best or best[h[:2]][5] < h[5]:
                        best[h[:2]] = h
        for best, (batch, _) in zip(hits, held, strict=True):
            yield batch, sorted(best.values(), key=lambda h: (h[0], h[1] is not None, h[1] or 0))

    held, size = [], 0
    for batch, texts in words.batches(rows):
        held.append((batch, texts))
        size += sum(map(len, texts))
        if searcher or size >= HELD_BYTES:
            yield from found(held)
            held, size = [], 0
    if held:
        yield from found(held)


def _search(models: list):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _searched(models, rows):
            ids = batch.column(0).take(pa.array([h[0] for h in found], pa.int64()))
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([h[k + 1] for h in found], kind) for k, kind in enumerate(kinds))], names=["doc_id", "item_id", "start_byte", "end_byte", "cosine", "lcs_share", "answer_share"])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of bounded number and length (a longer item is a block alone), as they stream to the driver."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"), (F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")).alias("answer"))
    held, size = [], 0
    for item in items.orderBy("item_id", "text", "answer").toLocalIterator():
        if held and (len(held) >= MOST_ITEMS or size + len(item["text"] or "") > MOST_CHARACTERS):
            yield held
            held, size = [], 0
        held.append(tuple(item))
        size += len(item["text"] or "")
    if held:
        yield held


def _models(docs: DataFrame, benchmark: DataFrame) -> list:
    """A broadcast model (passages, weights, latent basis) for each block of the benchmark."""
    spark = tune(docs.sparkSession)
    idf = weights(*document_frequencies(docs))
    out = []
    for block in _blocks(benchmark):
        bench = passages(block, idf)
        if not bench.item:
            if bench.short:
                out.append(spark.sparkContext.broadcast((bench, idf, np.zeros((0, 0)))))
            continue
        place = {b: i for i, b in enumerate(bench.vocabulary.tolist())}
        rows = []
        for hashed, weight in zip(bench.hashed, bench.weight, strict=True):
            sums: dict[int, float] = {}
            for b, w in zip(_bucket(hashed).tolist(), weight.tolist(), strict=True):
                if w > 0:
                    sums[place[b]] = sums.get(place[b], 0.0) + w
            rows.append((list(sums), list(sums.values())))
        matrix = spark.createDataFrame(rows, "at array<int>, value array<double>").repartition(max(1, math.ceil(len(rows) / 500)))
        rank = min(RANK, len(rows), len(bench.vocabulary))
        out.append(spark.sparkContext.broadcast((bench, idf, randomised_svd(matrix, len(bench.vocabulary), rank))))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold a benchmark item, or most of it: doc_id, item_id, the span of bytes, and the scores.

    One row for each document and item, the best span.  A row of ``docs`` is searched by itself, so repeated rows and null
    ids stay; null and empty texts have no hits; an empty table or benchmark gives none.  Of a repeated item_id every text
    is searched.  Items of fewer than LEAST_WORDS words are found by all their words in a row (so an item of one common word
    is in many documents), and whatever stands word for word has the scores 1.  Further columns are ignored (an ``answer``
    column of the benchmark is used).
    """
    models = _models(docs, benchmark)
    if not models:
        return docs.sparkSession.createDataFrame([], _HITS)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_search(models), _HITS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns as they are."""
    models = _models(docs, benchmark)
    if not models:
        return docs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _searched(models, batches):
            bad = {h[0] for h in found}
            yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64())) if bad else batch

    return docs.mapInArrow(run, docs.schema)
