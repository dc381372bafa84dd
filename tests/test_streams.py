"""Streams by key: text that comes in parts, limits, and keys that are ended by the watermark."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F
from shapes import PARTS, SHAPES

from glyphmill.functions import pretok
from glyphmill.operators.columns import Engine
from glyphmill.operators.decoding import Decoder, byte_of, run_text
from glyphmill.operators.tokenizer import NONSPECIAL, Tokenizer
from glyphmill.plans import samples
from glyphmill.sources.definition import LimitError
from glyphmill.streaming import keyed


def definitions():
    split = lambda p: {"type": "Split", "pattern": {"Regex": p}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    out = {name: Tokenizer.from_str(json.dumps(shape)) for name, shape in SHAPES.items()}
    out["cl100k"] = samples.byte_level(normalizer={"type": "NFC"}, pre_tokenizer={"type": "Sequence", "pretokenizers": [split(pretok.CL100K), level]})
    out["deepseek3"] = samples.byte_level(pre_tokenizer={"type": "Sequence", "pretokenizers": [*map(split, pretok.DEEPSEEK3), level]})
    out["template"] = samples.byte_level(post_processor={"type": "BertProcessing", "sep": ["</s>", 1], "cls": ["<s>", 0]})
    out["lstrip"] = samples.byte_level(added_tokens=samples._added(("in", " </s>", "the"), lstrip=True))
    return out


@pytest.mark.parametrize("name, t", definitions().items())
def test_appended_text_has_the_ids_of_the_whole(name, t):
    rng = random.Random(name)
    parts = [*PARTS, "the ", "of the thing ", "it's", " 12345", "!!", "é", "é", "\r\n", "/", "in", "ing"]
    early = 0
    for _ in range(250):
        given = ["".join(rng.choice(parts) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 8))]
        for mode in ("all", NONSPECIAL):
            stream, got = t.encode_stream(mode), []
            for x in given:
                got += stream.push(x)
            early += len(got)
            assert got + stream.flush() == t.encode("".join(given), added_tokens=mode), given
    assert early or t._cutter.rule is None


def test_only_the_end_of_a_text_is_kept():
    t = samples.byte_level()
    stream = t.encode_stream()
    for _ in range(300):
        stream.push("the rain in spain, ")
        assert len(stream.kept) < 40


def runs(ids_of_bytes):
    """Text of byte tokens and words, run by run."""
    out, run = "", b""
    for x in ids_of_bytes:
        if (b := byte_of(x)) is None:
            out, run = out + run_text(run) + x, b""
        else:
            run += bytes([b])
    return out + run_text(run)


def test_runs_that_are_no_text_are_told_at_once():
    rng = random.Random(5)
    steps = [{"type": "ByteFallback"}, {"type": "Fuse"}]
    for _ in range(3000):
        tokens = [rng.choice(["x", *(f"<0x{b:02X}>" for b in rng.choices([0x41, 0xC3, 0xA9, 0xE6, 0x97, 0xA5, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF], k=3))]) for _ in range(rng.randrange(9))]
        d = Decoder(steps)
        text = "".join(d.push(x) for x in tokens)
        assert text + d.flush() == runs(tokens)
    d = Decoder(steps)
    assert [d.push(x) for x in ("<0xF0>", "<0x9F>", "<0x41>", "<0x41>", "y")] == ["", "", "���", "�", "y"]


def test_a_push_beyond_the_hold_changes_nothing():
    t = samples.sentencepiece()
    ids = [t.token_to_id(f"<0x{b:02X}>") for b in "𓀀".encode() * 12]
    stream = t.decode_stream(hold=44)
    assert stream.push(ids[:44]) == "" and stream.decoder.state()[0] == "𓀀".encode() * 11
    for more in (ids[44:45], ids[44:], [*ids[44:], t.token_to_id("the")]):
        with pytest.raises(LimitError):
            stream.push(more)
        assert stream.decoder.state()[0] == "𓀀".encode() * 11
    stream.hold = 48
    assert stream.push(ids[44:]) + stream.flush() == "𓀀" * 12


@pytest.mark.parametrize("name, t", definitions().items())
def test_no_push_gives_more_than_its_bound(name, t):
    rng = random.Random(name)
    for _ in range(60):
        stream = t.decode_stream()
        for _ in range(rng.randrange(6)):
            ids = [rng.randrange(t.n_vocab) for _ in range(rng.randrange(5))]
            most = stream.bound(len(ids))
            assert len(stream.push(ids).encode()) <= most
        most = stream.bound(0)
        assert len(stream.flush().encode()) <= most


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def run(spark, tmp_path, schema, batches, make, name):
    """Each batch is one file, taken by one micro-batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table(name).collect()


def test_idle_keys_are_flushed_by_the_watermark(rocks, tmp_path):
    t = samples.sentencepiece()
    engine = Engine(rocks, t)
    number = lambda b: t.token_to_id(f"<0x{b:02X}>")
    long = [number(b) for b in "𓀀".encode() * 12]
    batches = [
        [(1, at(0), 0, t.token_to_id("the"), False), (1, at(0), 1, number(0xC3), False), (2, at(0), 0, t.token_to_id("t"), False), *((3, at(0), k, i, False) for k, i in enumerate(long[:40]))],
        [(2, at(2), 1, t.token_to_id("h"), True), *((3, at(2), 40 + k, i, False) for k, i in enumerate(long[40:]))],
        [(4, at(60), 0, t.token_to_id("o"), False)],
        [(4, at(61), 1, None, True)],
    ]
    rows = run(rocks, tmp_path, "k bigint, ts timestamp, seq bigint, id int, done boolean", batches, lambda s: keyed.decoded(s, "k", "ts", engine), "idle_keys")
    told = lambda k: sorted((r["seq"], r["status"], r["text"]) for r in rows if r["k"] == k)
    assert told(1) == [(1, "expired", "�"), (1, "ok", "the")]
    assert "".join(x[2] for x in told(2)) == "th" and {x[1] for x in told(2)} == {"ok"}
    assert told(3) == [(39, "expired", "𓀀" * 10), (39, "ok", ""), (47, "limit", "")]
    assert [x[1] for x in told(4)] == ["ok", "ok"]


def test_text_appended_in_a_stream(rocks, tmp_path):
    t = samples.byte_level(post_processor={"type": "BertProcessing", "sep": ["</s>", 1], "cls": ["<s>", 0]})
    engine = Engine(rocks, t)
    texts = {1: "the rain in spain stays mainly, <s> and so on. ", 2: "Слово и ещё слово", 3: "x" * 60}
    rows = [(k, at(n // 10), n, text[n : n + 7], n + 7 >= len(text)) for k, text in texts.items() for n in range(0, len(text), 7)]
    rows.sort(key=lambda r: (r[2], r[0]))
    batches = [rows[n : n + 6] for n in range(0, len(rows), 6)]
    got = run(rocks, tmp_path, "k bigint, ts timestamp, seq bigint, text string, done boolean", batches, lambda s: keyed.encoded(s, "k", "ts", engine), "appended")
    assert {k: [i for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["seq"]) for i in r["ids"]] for k in texts} == {k: t.encode(x) for k, x in texts.items()}
    assert len({r["seq"] for r in got if r["k"] == 1 and r["ids"]}) > 1
    table = rocks.createDataFrame(rows, "k bigint, ts timestamp, seq bigint, text string, done boolean")
    assert {r["k"]: r["ids"] for r in keyed.encoded_batch(table, "k", engine).collect()} == {k: t.encode(x) for k, x in texts.items()}
    limited = run(rocks, tmp_path / "again", "k bigint, ts timestamp, seq bigint, text string, done boolean", batches[:8], lambda s: keyed.encoded(s.where(F.col("k") == 3), "k", "ts", engine, most=20), "limited")
    assert "limit" in {r["status"] for r in limited}


def test_spans_of_time():
    assert keyed.milliseconds("10 minutes") == 600_000 and keyed.milliseconds("1 second") == 1000
    with pytest.raises(ValueError):
        keyed.milliseconds("soon")
