"""What workers hold and how often they look: bounded parts of batches, bounded memories of pieces, each filter run once."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import pretok, versions
from glyphmill.operators import batches, cutting, decoding, dictionary, models, vocabulary
from glyphmill.operators.columns import Engine
from glyphmill.operators.tokenizer import Tokenizer
from glyphmill.plans import cases, registry, samples
from glyphmill.streaming import keyed

TEXTS = [f"the {k} other men {k * 7919 % 10007} in a station " * 40 for k in range(1500)]


def _run(monkeypatch, make, texts):
    """The batch function of a column, and the most MB that it holds at once over one batch."""
    seen, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: seen.append(f) or real(f, kind))
    make()
    tracemalloc.start()
    rows = parts = 0
    for made in seen[0](iter([pa.array(texts)])):
        rows, parts = rows + len(made), parts + 1
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return rows, parts, most


@pytest.mark.parametrize("kind", ["encoding", "segments", "words"])
def test_a_batch_is_given_back_in_parts(spark, monkeypatch, kind):
    engine = Engine(spark, samples.byte_level())
    engine._shared.value.__dict__.pop("_compiled", None)
    make = {"encoding": lambda: engine.encoding("text"), "segments": lambda: engine.segments("text"), "words": lambda: dictionary.words(engine, spark.createDataFrame([(1, "a")], "k int, text string"), "k", "text")}[kind]
    rows, parts, most = _run(monkeypatch, make, [*TEXTS, None, ""])
    assert rows == len(TEXTS) + 2 and parts > 1
    assert most < 200


def test_flat_lists_and_values():
    lists = batches.Lists()
    for own in ([1, 2], None, [], [3]):
        lists.add(own)
    made = lists.column()
    assert made.to_pylist() == [[1, 2], None, [], [3]]
    assert list(batches.rows(made)) == [[1, 2], None, [], [3]]
    assert list(batches.rows(made.slice(1))) == [None, [], [3]]
    assert list(batches.rows(pa.array(["a", None, ""]))) == ["a", None, ""]
    assert list(batches.rows(pa.array([[1, None]], pa.list_(pa.int32())))) == [[1, None]]


def test_short_pieces_are_not_cut(monkeypatch):
    monkeypatch.setattr(cutting.Joins, "words", lambda *_: pytest.fail("a short piece was cut"))
    t = Tokenizer.from_str(cases.DEFINITIONS["unknown_apart"])
    assert t.encode("milk mil k") == [7, 9, 7, 4, 1, 5]


def test_memory_of_pieces_is_bounded_by_characters():
    memo = models.Memo(lambda piece: [len(piece)])
    for k in range(20_000):
        assert memo.bounded()[f"{k:0>250}"] == [250]
    assert sum(map(len, memo)) <= models.KEPT_CHARACTERS + 250


@pytest.mark.parametrize("name", ["unknown_bytes", "prefixed", "best_path", "best_path_bytes", "words"])
def test_tokens_are_decoded_once(monkeypatch, name):
    t = Tokenizer.from_str(cases.DEFINITIONS[name])
    given = [t.encode(text) for text in cases.TEXTS[name]] + [list(ids) for ids in cases.IDS.get(name, ())]
    want = [decoding.text_of(t.tokens_of(ids, True), t.decoders()) for ids in given]
    pushed, push = [], decoding.Decoder.push
    monkeypatch.setattr(decoding.Decoder, "push", lambda self, token: pushed.append(token) or push(self, token))
    assert [t.decode(ids) for ids in given] == want
    pushed.clear()
    ids = t.encode("tea, milk " * 50)
    t.decode(ids)
    assert len(pushed) < 60 < len(ids)


def test_known_text_is_normalized_without_the_pattern(monkeypatch):
    class Refused:
        def split(self, text):
            pytest.fail("every character was compared with the pattern's ranges")

    monkeypatch.setattr(versions, "_UNKNOWN", Refused())
    assert versions.form("NFC", "café") == "café"


def test_texts_are_encoded_once(spark, tmp_path):
    """The filter for texts without ids does not run the Python function a second time."""
    spark.createDataFrame([(k, text) for k, text in enumerate(["tea", "", " ", "\x00"])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("encode_words", "decode_words"):
        made = registry.queries()[name](spark, str(tmp_path))
        assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        assert [r["doc_id"] for r in made.collect()] == [0]


def test_ids_are_looked_up_without_a_shuffle(spark):
    t = samples.byte_level()
    vocab = vocabulary.vocabulary(spark, t)
    ids = spark.createDataFrame([(1, t.encode("the café")), (2, []), (3, None), (4, [0, *t.encode("a")]), (5, [None])], "k int, ids array<int>")
    made = vocabulary.decode_join(ids, "k", "ids", vocab, t.n_vocab)
    assert sorted(map(tuple, made.collect())) == [(1, "the café"), (2, ""), (3, ""), (4, "a"), (5, "")]
    assert "hashpartitioning(k" not in made._jdf.queryExecution().executedPlan().toString()
    for bad in (t.n_vocab, -1):
        with pytest.raises(Exception, match="no token"):
            vocabulary.decode_join(ids.selectExpr("k", f"array({bad}) AS ids"), "k", "ids", vocab, t.n_vocab).collect()


def test_appended_texts_are_read_in_order_and_not_gathered(spark):
    engine = Engine(spark, samples.byte_level())
    rows = [(k, seq, part) for k in (None, 1, 2, 3) for seq, part in enumerate(["the oth", "er men", None, " in a stati", "on"])] + [(4, 0, None)]
    made = keyed.encoded_batch(spark.createDataFrame(rows[::-1], "k int, seq int, text string"), "k", engine)
    want = engine.tokenizer.encode("the other men in a station")
    assert {r["k"]: r["ids"] for r in made.collect()} == {None: want, 1: want, 2: want, 3: want, 4: []}
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["unknown_apart", "unknown_fused", "unknown_bytes", "prefixed"])
def test_characters_are_looked_up_once(monkeypatch, name):
    """New pieces of known characters ask for no character again, and decoding asks for no token's string again."""
    t = Tokenizer.from_str(cases.DEFINITIONS[name])
    texts = ["mi xk é茶", "\x00lk mil 茶é", *cases.TEXTS[name]]
    want = [(ids := t.encode(x), t.decode(ids)) for x in texts]
    assert [back for _, back in want] == [decoding.text_of(t.tokens_of(ids, True), t.decoders()) for ids, _ in want]
    t._model.clear()
    monkeypatch.setattr(models._Characters, "__missing__", lambda *_: pytest.fail("a character was made again"))
    monkeypatch.setattr(Tokenizer, "tokens_of", lambda *_: pytest.fail("token strings were made"))
    assert [(ids := t.encode(x), t.decode(ids)) for x in texts] == want


def test_pieces_at_marks():
    for scheme in ("always", "first", "never"):
        step = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": scheme, "split": True}
        whole = pretok._step(step)
        for text in ("", " ", "a", " a", "a b", "▁▁a  b▁", "ab ", "é▁茶"):
            for first in (True, False):
                assert pretok.compiled([step])(text, first) == [p for p, _ in (whole(text, first) if text else [])]


@pytest.mark.parametrize("kind", ["encode", "normalized", "pieces", "decode", "restored", "restored_bytes"])
def test_columns_are_given_back_in_parts(spark, monkeypatch, kind):
    """What a worker holds is bounded by a part, not by a batch; rows and values are those of the tokenizer."""
    engine = Engine(spark, Tokenizer.from_str(cases.DEFINITIONS["prefixed"]))
    t = engine.tokenizer
    values = [*TEXTS, None, ""]
    if kind == "decode":
        values = [None if v is None else t.encode(v) for v in values]
    seen, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, k: seen.append(f) or real(f, k))
    getattr(engine, kind)("v")
    given = pa.array(values, pa.list_(pa.int32()) if kind == "decode" else pa.string())
    made = list(seen[0](iter([given, given.slice(0, 0)])))
    want = {"encode": t.encode, "normalized": t._normalize, "pieces": t.pieces, "decode": t.decode, "restored": lambda v: t.decode(t.encode(v)), "restored_bytes": lambda v: t.decode_bytes(t.encode_ordinary(v))}[kind]
    assert len(made) > 2 and sum(map(len, made)) == len(values)
    assert max(part.nbytes for part in made) < 16 * batches.PART
    assert [v for part in made for v in part.to_pylist()] == [None if v is None else want(v) for v in values]
