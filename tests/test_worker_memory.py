"""What a worker is sent at once, and what it keeps."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from shapes import PARTS, SHAPES

from glyphmill.operators import batches, models
from glyphmill.operators.columns import Engine
from glyphmill.operators.tokenizer import MODES, Tokenizer
from glyphmill.plans import cases, registry, samples


def _largest_batch(session) -> int:
    def size(values: pa.Array) -> pa.Array:
        return pa.array([values.nbytes] * len(values), pa.int64())

    texts = session.range(0, 9_000, 1, 1).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("the other men "), 200)).alias("text"))
    return texts.select(F.arrow_udf(size, "bigint")("text").alias("n")).agg(F.max("n")).first()[0]


def test_batches_are_bounded_by_bytes(spark):
    """9,000 texts of 25 MB are fewer rows than Spark puts into one batch."""
    session = spark.newSession()
    Engine(session, samples.wordpiece())
    assert _largest_batch(session) < 6_000_000


def test_the_bound_of_a_session_stays(spark):
    session = spark.newSession()
    session.conf.set(batches.BATCH, "16m")
    Engine(session, samples.wordpiece())
    assert session.conf.get(batches.BATCH) == "16m"
    assert 12_000_000 < _largest_batch(session) < 20_000_000


MADE = {
    "byte_level": samples.byte_level, "composed": lambda: samples.byte_level(normalizer={"type": "NFC"}), "ranked": samples.ranked, "whole_texts": samples.whole_texts,
    "sentencepiece": samples.sentencepiece, "unigram_sample": samples.unigram, "wordpiece": samples.wordpiece,
    **{n: lambda d=d: Tokenizer.from_str(d) for n, d in cases.DEFINITIONS.items()}, **{n: lambda d=d: Tokenizer.from_str(json.dumps(d)) for n, d in SHAPES.items()},
}


@pytest.mark.parametrize("name", MADE)
def test_counts_are_those_of_the_ids(name):
    """With added tokens, templates, truncation and padding, for pieces that are too long to be kept, and a second time."""
    t = MADE[name]()
    texts = ["", " ", "".join(PARTS), " ".join(PARTS * 3), "sour tin" * 60, "ring" * 100 + " " * 300, "<s>the café</s> [UNK]<pad>", "<s>", *cases.TEXTS.get(name, ())]
    for text in [*texts, *texts]:
        for mode in MODES:
            for special in (True, False):
                want = len(t.encode(text, add_special_tokens=special, added_tokens=mode))
                assert t.token_count(text, add_special_tokens=special, added_tokens=mode) == want
        assert t.token_count(text.encode("utf-8", "surrogateescape")) == t.token_count(text) == len(t.encode(text))


def test_counting_keeps_numbers_alone(spark, tmp_path, monkeypatch):
    """Neither ids of pieces nor of texts are held where they are only counted."""
    texts = [" ".join(f"w{k * 7919 % 100_003}" for k in range(n, n + 500)) for n in range(0, 5_000, 500)]
    seen, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: seen.append(f) or real(f, kind))
    monkeypatch.setattr(Tokenizer, "encode", lambda *_, **__: pytest.fail("ids were made"))
    spark.createDataFrame([(k, v) for k, v in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    registry.queries()["encode_bounds"](spark, str(tmp_path))
    assert len(seen) == 5
    made, compiled = [], models.compiled
    monkeypatch.setattr(models, "compiled", lambda d: made.append(compiled(d)) or made[-1])
    for count in seen:
        assert min(count(pa.array(texts)).to_pylist()) >= 500
    assert len(made) == 5 and not any(made)
