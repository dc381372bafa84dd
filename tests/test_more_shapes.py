"""Rank folders, hard cuts, charsmaps, chains of splits, and Java's older Unicode tables."""

import base64
import json
import random
import struct
import unicodedata

import pytest
import regex
import tokenizers
from shapes import META, SHAPES, file, unigram

from glyphmill.functions import pretok, supplement
from glyphmill.functions.normalize import Charsmap
from glyphmill.operators.tokenizer import NONE, Tokenizer
from glyphmill.plans import samples
from glyphmill.sources.definition import UnsupportedError


def rank_lines(extra=()):
    table = {bytes([b]): b for b in range(256)}
    for t in extra:
        table[t] = len(table)
    return table, b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in table.items())


def test_rank_folders(tmp_path):
    table, raw = rank_lines([b"th", b"the", "é".encode()])
    kimi, qwen = tmp_path / "kimi", tmp_path / "qwen"
    for folder, name in ((kimi, "tiktoken.model"), (qwen, "qwen.tiktoken")):
        folder.mkdir()
        (folder / name).write_bytes(raw)
    n = len(table)
    (kimi / "tokenizer_config.json").write_text(json.dumps({"added_tokens_decoder": {str(n): {"content": "[BOS]"}}}))
    t = Tokenizer.from_file(str(kimi))
    assert t.encode("[BOS]the") == [n, table[b"the"]] and len(t.added_tokens()) == 256 and t.id_to_token(n + 1) == f"<|reserved_token_{n + 1}|>"
    assert len(t.encode("[BOS]", added_tokens=NONE)) == 5
    t = Tokenizer.from_file(str(qwen))
    assert t.encode("e\u0301") == [table["é".encode()]] and t.encode("<|im_start|>") == [n + 1] and len(t.added_tokens()) == 208
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError, match="open"):
        Tokenizer.from_file(str(tmp_path / "other"))


def test_hard_cuts():
    assert [len(x) for x in pretok.run_cuts("a" * 60_000 + " " + "b" * 10)] == [25_000, 25_000, 10_011]
    assert [len(x) for x in pretok.run_cuts("ab " * 150_000)] == [400_000, 50_000]
    assert pretok.run_cuts("") == [] and "".join(pretok.run_cuts("x\x1cy " * 30)) == "x\x1cy " * 30


def charsmap(pairs):
    """A double array for the keys, by the plain way: each node gets the first base whose places are free."""
    strings, where = b"", {}
    for key, value in pairs.items():
        where[key.encode()] = len(strings)
        strings += value.encode() + b"\0"
    units = {}
    used = {0}

    def place(prefix):
        return sorted({k[len(prefix)] for k in where if k.startswith(prefix) and len(k) > len(prefix)})

    def fill(node, prefix):
        labels, leaf = place(prefix), prefix in where
        children = [0] * leaf + labels
        if not children:
            return
        base = 1
        while any((node ^ base ^ c) in used for c in children) or any((node ^ base ^ c) == node for c in children):
            base += 1
        for c in children:
            used.add(node ^ base ^ c)
        units[node] = units.get(node, 0) | (base << 10) | (0x100 if leaf else 0)
        if leaf:
            units[node ^ base] = 0x80000000 | where[prefix]
        for c in labels:
            units[node ^ base ^ c] = units.get(node ^ base ^ c, 0) | c
            fill(node ^ base ^ c, prefix + bytes([c]))

    fill(0, b"")
    flat = [units.get(i, 0) for i in range(max(units) + 1 + 256)]
    return base64.b64encode(struct.pack("<I", 4 * len(flat)) + struct.pack(f"<{len(flat)}I", *flat) + strings).decode()


def test_charsmap_is_the_librarys():
    blob = charsmap({"Ａ": "A", "\t": " ", "e\u0301": "é", "ﬁ": "fi", "\r": " ", "①": "1"})
    own, other = Charsmap(blob), tokenizers.normalizers.Precompiled(base64.b64decode(blob))
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["Ａ", "e", "\u0301", "\t", "\r\n", "ﬁ", "①", "x", " ", "日", "e\u0301", "\u0302"]) for _ in range(rng.randrange(9)))
        assert own(text) == other.normalize_str(text), repr(text)
    source = json.dumps(file(unigram(), {"type": "Precompiled", "precompiled_charsmap": blob}, META))
    t, h = Tokenizer.from_str(source), tokenizers.Tokenizer.from_str(source)
    assert t.encode("Ａb\tﬁ ab") == h.encode("Ａb\tﬁ ab").ids


@pytest.mark.parametrize("name, steps", [("bloom", [(pretok.BLOOM, "Isolated")]), ("minicpm", [(p, "Isolated") for p in pretok.MINICPM5]), ("laguna", [(pretok.LINE_ENDS, "MergedWithNext"), (pretok.QWEN2, "Isolated")]), ("deepseek", [(p, "Isolated") for p in pretok.DEEPSEEK3]), ("llada", [(pretok.LLADA, "Isolated")]), ("zeta", [(pretok.ZETA, "Isolated")])])
def test_chains_against_the_library_and_spark(spark, name, steps):
    own = pretok.compiled([{"type": "Split", "pattern": {"Regex": p}, "behavior": b} for p, b in steps])
    column = {"bloom": lambda: pretok.isolated("t", pretok.BLOOM), "minicpm": lambda: pretok.chained("t", pretok.MINICPM5), "laguna": lambda: pretok.laguna("t"), "deepseek": lambda: pretok.chained("t", pretok.DEEPSEEK3), "llada": lambda: pretok.split_matches("t", pretok.LLADA), "zeta": lambda: pretok.split_matches("t", pretok.ZETA)}[name]()
    kinds = {"Isolated": "isolated", "MergedWithNext": "merged_with_next"}
    other = tokenizers.pre_tokenizers.Sequence([tokenizers.pre_tokenizers.Split(tokenizers.Regex(p), kinds[b]) for p, b in steps])
    rng = random.Random(name)
    texts = ["".join(rng.choice(["a", "Bc", "é", " ", "  ", "\n", "\r\n", "\n\n", "1", "2345", "日本", "かな", ".", "!?", "'s", "'LL", "(", "|", "😀", "\t", "\u0301"]) for _ in range(rng.randrange(14))) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", column.alias("p"))
    for r in frame.collect():
        expected = [p for p, _ in other.pre_tokenize_str(r["t"])]
        assert own(r["t"], True) == expected, (name, r["t"])
        assert r["p"] == expected, (name, r["t"])


def test_cases_and_whole_texts_equal_the_library():
    """The fixed values of the cases, and what ``decode_wordpiece`` does, against the public library."""
    from tokenizers import Tokenizer as Library

    from glyphmill.plans import cases, samples

    for name, source in cases.DEFINITIONS.items():
        library = Library.from_str(source)
        made = [library.encode(t).ids for t in cases.TEXTS[name]]
        assert tuple(" ".join(map(str, ids)) for ids in made) == cases.ENCODED[name]
        assert tuple(library.decode(list(ids)) for ids in (*made, *cases.IDS.get(name, ()))) == cases.DECODED[name]
    own = samples.wordpiece()
    library = Library.from_str(samples.wordpiece_source())
    texts = ["The content, of it; is on.", "Été à la mer! (1999) naïve", "  spaces\tand\nlines ", "über-straße 日本 😀 don't", "x" * 40 + " ok", ""]
    for t in texts:
        ids = own.encode(t, add_special_tokens=False)
        assert ids == library.encode(t, add_special_tokens=False).ids and own.decode(ids) == library.decode(ids)


def test_null_encodings_stay_null_and_definitions_can_be_unloaded(spark):
    from glyphmill.operators.columns import Engine
    from glyphmill.plans import samples

    engine = Engine(spark, samples.byte_level())
    df = spark.createDataFrame([(1, "the"), (2, None)], "k int, t string")
    for _ in range(2):
        rows = {r["k"]: r["e"] for r in df.select("k", engine.encoding("t").alias("e")).collect()}
        assert rows[2] is None and rows[1]["ids"]
        engine.unload()


def test_token_to_id_of_bytes():
    t = Tokenizer.from_str(json.dumps(SHAPES["prepend"]))
    for i in range(t.n_vocab):
        raw = t.token_bytes(i)
        if raw:
            found = t.token_to_id(raw)
            assert t.token_bytes(found) == raw or t.id_to_token(found).encode() == raw
    assert t.token_to_id(b"") is None and t.token_to_id(b"no such token at all") is None


def test_kimi_pattern_splits_scripts():
    found = pretok.compiled_pattern(pretok.KIMI).findall
    assert found("日本語ABCdef 12345's") == ["日本語", "ABCdef", " ", "123", "45", "'s"]
    assert found("漢字kana")[0] == "漢字"


def test_spliced_patterns_know_newer_characters(spark):
    newest = [chr(p) for p in range(0x20, 0x110000) if not 0xD800 <= p <= 0xDFFF and regex.match(r"\p{L}", chr(p))]
    sample = [c for c in newest if unicodedata.category(c) == "Cn"][:50] + newest[::997]
    df = spark.createDataFrame([(c + "a" + c + " 1",) for c in sample], "t string")
    plain = pretok.split_matches("t", pretok.CL100K)
    whole = pretok.split_matches("t", supplement.spliced(spark, pretok.CL100K))
    rows = df.select("t", plain.alias("plain"), whole.alias("whole")).collect()
    assert all(r["whole"] == [r["t"][:-2], " ", "1"] for r in rows)
    assert any(r["plain"] != r["whole"] for r in rows)


def test_bytes_before_replacements_are_the_librarys():
    """Runs of bytes become text first; then marks are replaced in it too, and once more behind the fused text."""
    chain = [{"type": "ByteFallback"}, {"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, {"type": "Fuse"}, {"type": "Replace", "pattern": {"String": "o"}, "content": "00"}]
    source = SHAPES["unigram_bytes"] | {"decoder": {"type": "Sequence", "decoders": chain}}
    own, other = Tokenizer.from_str(json.dumps(source)), tokenizers.Tokenizer.from_str(json.dumps(source))
    rng = random.Random(12)
    number = lambda b: own.token_to_id(f"<0x{b:02X}>")
    mark = [number(b) for b in "▁o".encode()]
    for _ in range(400):
        ids = [i for _ in range(rng.randrange(9)) for i in (mark if rng.random() < 0.3 else [rng.randrange(own.n_vocab)] if rng.random() < 0.6 else [number(rng.choice(b"\xe2\x96\x81\xc3\xa9A"))])]
        assert own.decode(ids, False) == other.decode(ids, skip_special_tokens=False), ids
        stream = own.decode_stream()
        assert "".join(map(stream.push, ids)) + stream.flush() == own.decode(ids, False)
    for bad in (chain[:3], [*chain[:3], chain[3] | {"pattern": {"String": "oo"}}]):
        with pytest.raises(UnsupportedError):
            Tokenizer.from_str(json.dumps(source | {"decoder": {"type": "Sequence", "decoders": bad}}))


def test_strings_that_ids_do_not_tell():
    plain = Tokenizer.from_str(json.dumps(SHAPES["unigram_whitespace"]))
    assert plain.encode_ex("our ring").tokens and plain.encode_ex("our 水").ids
    for shape, text in (("unigram_whitespace", "our 水"), ("metaspace_first", "x </s>"), ("metaspace_split", "<s> x")):
        with pytest.raises(UnsupportedError):
            _ = Tokenizer.from_str(json.dumps(SHAPES[shape])).encode_ex(text).tokens
    assert Tokenizer.from_str(json.dumps(SHAPES["metaspace_first"])).encode_ex("x <s>").tokens[-1] == "<s>"


def test_strings_are_the_librarys_where_told():
    for name in SHAPES:
        own, other = Tokenizer.from_str(json.dumps(SHAPES[name])), tokenizers.Tokenizer.from_str(json.dumps(SHAPES[name]))
        told = 0
        for text in ("our ring", "", "sour tin ü x", "<s> tours", "水 ing", "  two  spaces", "[CLS] can not ?"):
            e = own.encode_ex(text)
            if e.strings is not None:
                told += 1
                assert e.tokens == other.encode(text).tokens, (name, text)
        assert told


def test_end_of_text_and_patterns_that_are_refused():
    with pytest.raises(KeyError):
        _ = samples.byte_level().eot_token
    ended = samples.byte_level(added_tokens=samples._added(("<|endoftext|>",)))
    assert ended.eot_token == ended.token_to_id("<|endoftext|>")
    for pattern, content in ((r"\s+", " "), (" {2,}", "x")):
        with pytest.raises(UnsupportedError):
            Tokenizer.from_str(json.dumps(SHAPES["unigram"] | {"normalizer": {"type": "Replace", "pattern": {"Regex": pattern}, "content": content}}))
    started = SHAPES["unigram_whitespace"] | {"normalizer": {"type": "Replace", "pattern": {"Regex": r"(?<!\n)^"}, "content": "▁"}}
    own, other = Tokenizer.from_str(json.dumps(started)), tokenizers.Tokenizer.from_str(json.dumps(started))
    for text in ("our", "\nour", " our\nring", "our\n\nring sour"):
        assert own.encode(text) == other.encode(text).ids, text
