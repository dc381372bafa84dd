"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text alone are learned from.  The class prior is estimated from both (the least
ratio of the shares above a score, on rows apart from those that made the score), and a linear model minimises the
non-negative unbiased risk  prior * E_pos[l(+)] + max(0, E_unl[l(-)] - prior * E_pos[l(-)])  with the logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import words
from glyphmill.llm.session import tune

#: The model is fitted on so many trusted positives and unlabelled rows at most, taken by a hash of the row.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 8192, 16384
#: Score from which a document counts as good.
GOOD = 0.7
FOLDS, HELD_OUT = 4, 2
#: A text of so many words has half the say of a long one.
FEW_WORDS = 10

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of UTF-8 that begin a sign more often than a letter: Latin-1 signs, general marks and symbols, CJK marks and wide forms, emoji.
_SIGNS = (0xC2, 0xE2, 0xE3, 0xEF, 0xF0)
_CLASSES = 6 + len(_PUNCTUATION) + len(_SIGNS)
_CLASS = np.zeros(256, dtype=np.int64)  # 0: control
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[[9, 10, 13]] = 1, 2, 3, 4, 5
_CLASS[128:] = 1  # letters of other scripts count as letters
for _k, _b in enumerate((*_PUNCTUATION, *_SIGNS)):
    _CLASS[_b] = 6 + _k
#: Hashed shapes: runs of three classes, letters of any case being one.
GRAMS = 64
_COARSE = np.where(_CLASS == 2, 1, _CLASS)
N_FEATURES = _CLASSES + 8 + GRAMS


def features(texts: list[bytes]) -> np.ndarray:
    """One row for each text: shares of kinds of characters and of hashed runs of three kinds, word lengths, and how often
    words and shingles repeat.

    All are numbers of the text alone.  A text without words has zeros.
    """
    n = len(texts)
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    if not n:
        return out
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * _CLASSES + _CLASS[raw], minlength=n * _CLASSES).reshape(n, _CLASSES)
    out[:, :_CLASSES] = np.sqrt(kinds / np.maximum(1, sizes)[:, None])
    if len(raw) > 2:
        kind = _COARSE[raw]
        run = ((kind[:-2] * _CLASSES + kind[1:-1]) * _CLASSES + kind[2:]).astype(np.uint32) * np.uint32(2654435761)
        inside = owner[:-2] == owner[2:]
        told = np.bincount((owner[:-2] * GRAMS + (run >> np.uint32(26)).astype(np.int64))[inside], minlength=n * GRAMS).reshape(n, GRAMS)
        out[:, _CLASSES + 8 :] = np.sqrt(told / np.maximum(1, sizes - 2)[:, None])
    hashed, first, end, bounds = words.word_spans(texts)
    count = np.diff(bounds)
    some = np.maximum(1, count)
    of = np.repeat(np.arange(n), count)
    length = (end - first).astype(np.float64)
    grams, offsets = words.shingle_hashes(hashed, bounds)
    tri, tri_offsets = words.shingle_hashes(hashed, bounds, 2)
    same = (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1]) if len(of) else np.zeros(0, dtype=bool)
    rest = out[:, _CLASSES : _CLASSES + 8]
    rest[:, 0] = np.log1p(count)
    rest[:, 1] = np.bincount(of, length, n) / some
    rest[:, 2] = np.bincount(of, length > 12, n) / some
    rest[:, 3] = _distinct(of, hashed, n) / np.sqrt(some)
    rest[:, 4] = np.bincount(of[1:], same, n)[:n] / some if len(of) else 0
    rest[:, 5] = 1 - _distinct(np.repeat(np.arange(n), np.diff(offsets)), grams, n) / np.maximum(1, np.diff(offsets))
    rest[:, 6] = 1 - _distinct(np.repeat(np.arange(n), np.diff(tri_offsets)), tri, n) / np.maximum(1, np.diff(tri_offsets))
    rest[:, 7] = 1 - _distinct(of, hashed, n) / some
    out[count == 0, :] = 0
    return out


def _distinct(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The number of distinct values of each owner; a pair is told apart by one 64-bit hash."""
    if not len(values):
        return np.zeros(n)
    key = values ^ words.mix(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    return np.bincount(of[order[new]], minlength=n)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_standard(x, self.mean, self.scale) @ self.weight + self.bias)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Distances from the mean; of a text of few words they say little, so they count less."""
    seen = np.expm1(x[:, [_CLASSES]])
    return np.clip((x - mean) / scale, -6, 6) * (seen / (seen + FEW_WORDS))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.03, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk with Adam over all rows; where the negative part falls below 0, its own descent is undone."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (pos, unl))
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    for step in range(1, steps + 1):
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        g = (prior * (p.T @ (sp - 1)) / len(p) + down) if negative >= 0 else -down
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of both: the least ratio of the shares above a score,
    with a margin for chance, over scores that a good part of the positives reach; less two standard errors.

    Too high a prior calls the negatives positive, while one that is a little too low costs next to nothing.
    """
    if not len(pos) or not len(unl):
        return 0.5
    cuts = np.quantile(pos, np.linspace(0, 0.9, 181))
    share_p = np.array([(pos >= c).mean() for c in cuts])
    share_u = np.array([(unl >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(unl)) + 1 / np.sqrt(len(pos)))
    best = int(np.argmin((share_u + margin) / share_p))
    ratio = min(1.0, share_u[best] / share_p[best])
    return float(np.clip(ratio - 2 * np.sqrt(ratio * (1 - ratio) / len(unl)), 0.02, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray) -> Model:
    """From features of trusted positives and of unlabelled rows.  Without either, every score is the prior 0.5."""
    both = np.vstack([pos, unl]).astype(np.float64)
    if not len(pos) or not len(unl):
        d = pos.shape[1]
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 0.5)
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    p, u = (_standard(x, mean, scale) for x in (pos, unl))
    # for the prior, one half of the rows makes a score of positive against unlabelled, the other half is measured
    w, b = _fit(p[::2], u[::2], 0.5)
    prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b) if len(p) > 1 and len(u) > 1 else 0.5
    weight, bias = _fit(p, u, prior)
    return Model(mean, scale, weight, bias, prior)


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo FOLDS; a null key is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS)), F.lit(0))


def _features_of(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in words.batches(rows):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(texts)), pa.list_(pa.float32()))], names=["drawn", "features"])


def _sample(rows: DataFrame, n: int, most: int) -> np.ndarray:
    """Features of at most ``most`` of the ``n`` rows (doc_id, text): those with the least hashes of id and text.

    Copies of a row have one hash and count once.  Rows that cannot be among the least are left out before anything is
    shuffled, and features take their texts' place before the least are taken, so what comes to the driver is ``most``
    short arrays, however often an id comes (null included) and however long the texts are.
    """
    hashed = rows.withColumn("drawn", F.xxhash64("doc_id", "text"))
    least = -(2**63) + int(min(1.0, 1.25 * most / max(1, n)) * 2**63) * 2 - 1
    one = hashed.where(F.col("drawn") <= F.lit(least)).groupBy("drawn").agg(F.first("text").alias("text"))
    made = one.mapInArrow(_features_of, "drawn bigint, features array<float>").orderBy("drawn").limit(most).collect()
    return np.array([r["features"] for r in made], dtype=np.float64).reshape(len(made), N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, *, sample_positive: int = SAMPLE_POSITIVE, sample_unlabelled: int = SAMPLE_UNLABELLED) -> Model:
    """A model from documents outside the held-out fold.

    Positives are rows whose label is quality 1 (all their labels, if an id has several); labels of 0 are not read as
    negatives.  Unlabelled rows are drawn from all documents of the folds.  Both samples are bounded by the parameters
    (smaller by chance, or where rows repeat), and chosen by a hash of doc_id and text.
    """
    tune(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(fold(F.col("doc_id")) != HELD_OUT)
    trusted = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    n_docs, n_trusted = own.count(), trusted.count()
    # of many trusted ids, those with the least hashes: their documents alone are joined
    part = int(min(1.0, 1.25 * sample_positive / max(1, n_trusted)) * 1_000_000)
    few = lambda df: df.where(F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(1_000_000)) < part)
    positive = few(own).join(few(trusted), "doc_id", "left_semi")
    return fit(_sample(positive, min(n_trusted, sample_positive), sample_positive), _sample(own, n_docs, sample_unlabelled))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the model's score of each text (null counts as empty) in ``column``, from 0 to 1.

    Every row is scored by itself, from its whole text; all other columns are kept as they are (a column of that name is
    replaced).  An empty table stays empty.
    """
    tune(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != column.lower()]
    schema = docs.select(*kept).schema.add(column, "double")

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.batches(rows):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(features(texts)), pa.float64())], names=[*batch.schema.names, column])

    return docs.select(*kept).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, *, good: float = GOOD) -> DataFrame:
    """Score, fold and prediction of every document: ``docs`` plus score, held_out and predicted.

    Empty and null texts are scored too.  Repeated rows get the same score.  Without labels every score is 0.5.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= good).cast("int").alias("predicted"))
