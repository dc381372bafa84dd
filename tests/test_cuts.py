"""Sure places: parts split and encoded by themselves give what the whole gives; dictionaries of words."""

import json
import random
import time

import pytest
import regex
from pyspark.sql import functions as F
from shapes import PARTS, SHAPES, file, spm

from glyphmill.functions import cuts, pretok
from glyphmill.operators import cutting, dictionary, models, tables
from glyphmill.operators.columns import Engine
from glyphmill.operators.tokenizer import Tokenizer
from glyphmill.plans import samples
from glyphmill.sources.definition import UnsupportedError

LETTERS = [*"aBſÉ1٣ \t\n\r　!',/-", "́", "水", "ア", "・", "🌿", "𠀀", "𝐀", "𝟙", "​", "s", "l", "ll", "re", "'s", "ः", "ǅ", "ʰ"]


def isolated(pattern):
    return {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}


BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def pieces(name, text):
    if name == "deepseek3":
        out = [text]
        for p in pretok.DEEPSEEK3:
            found = regex.compile(p)
            out = [x for part in out for x in pretok.parted(part, (m.span() for m in found.finditer(part)), "Isolated", False)]
        return out
    return pretok.compiled_pattern({**pretok.COVERING, **pretok.COVERING_TOO}[name]).findall(text)


@pytest.mark.parametrize("name", cuts.FAMILIES)
def test_parts_have_the_pieces_of_the_whole(name):
    rule, rng = cuts.compiled(cuts.FAMILIES[name].pattern()), random.Random(name)
    sure = possible = 0
    for _ in range(6000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 9)))
        whole, found = pieces(name, text), {m.start() for m in rule.finditer(text)}
        for p in range(1, len(text)):
            same = pieces(name, text[:p]) + pieces(name, text[p:]) == whole
            assert same or p not in found, (text, p)
            sure, possible = sure + (p in found), possible + same
    assert sure > 0.7 * possible


@pytest.mark.parametrize("name", cuts.FAMILIES)
def test_the_jvm_finds_the_same_places(spark, name):
    rng = random.Random(name)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    rule = cuts.compiled(cuts.FAMILIES[name].pattern())
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    for r in df.select("text", cuts.places("text", name).alias("n"), cuts.parts("text", name, 3).alias("parts")).collect():
        if r["text"] is None:
            assert r["n"] is None and r["parts"] is None
            continue
        at, found = 0, {m.start() for m in rule.finditer(r["text"])}
        assert r["n"] == len(found) and "".join(r["parts"]) == r["text"]
        for part in r["parts"][:-1]:
            assert at + len(part) in found and not {p for p in found if at + 3 <= p < at + len(part)}
            at += len(part)


def shapes_to_cut():
    out = {name: Tokenizer.from_str(json.dumps(shape)) for name, shape in SHAPES.items()}
    for name, pattern in (("cl100k", pretok.CL100K), ("o200k", pretok.O200K)):
        for norm in (None, {"type": "NFC"}):
            out[f"{name} {norm}"] = samples.byte_level(normalizer=norm, pre_tokenizer={"type": "Sequence", "pretokenizers": [isolated(pattern), BYTES]})
    out["deepseek3"] = samples.byte_level(pre_tokenizer={"type": "Sequence", "pretokenizers": [*map(isolated, pretok.DEEPSEEK3), BYTES]})
    for flag in ("lstrip", "rstrip", "single_word"):
        out[flag] = samples.byte_level(added_tokens=samples._added(("in", " </s>", "the"), **{flag: True}))
    return out


@pytest.mark.parametrize("name, t", shapes_to_cut().items())
def test_parts_have_the_ids_of_the_whole(name, t):
    rng = random.Random(name)
    parts = [*PARTS, "the ", "of the thing ", "it's", " 12345", "!!", "é", "é", "\r\n", "/", "in", "ing"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(2, 20)))
        assert t.encode_parts(text, rng.randrange(2, 6)) == t.encode(text), text


@pytest.mark.parametrize("text", ["Слово, и ещё слово. " * 500, "한국어 문장입니다. " * 500, "if(x1==y){return\n\tz/2;}\n" * 500, "中文句子，没有空格。" * 500])
def test_texts_without_english_words_are_cut(text):
    for pattern in ([pretok.CL100K], [pretok.O200K], pretok.DEEPSEEK3):
        t = samples.byte_level(pre_tokenizer={"type": "Sequence", "pretokenizers": [*map(isolated, pattern), BYTES]})
        assert len(t.split_points(text, 8)) == 7 and t.encode_parts(text, 8) == t.encode(text)


def test_the_nearest_place_is_taken_and_of_two_the_earlier():
    t = samples.byte_level()
    assert t.split_points("aaaa bbbbbbbbbb", 2) == []  # the only place is further away than may be looked
    assert t.split_points("aaaaaaa bbbbb ccccc ddddddd", 2) == [13]
    assert t.split_points("aaaaaaaaaaaa b ccccccccccccc", 2) == [14]


# ---- words of pieces that no merge joins


def plain_words(d, piece):
    made = {a + b for a, b in d.merges}
    out = [piece[:1]]
    for a, b in zip(piece, piece[1:]):
        if a in d.vocab and (d.unk_token or b in d.vocab) and not any(a + b in m for m in made):
            out.append(b)
        else:
            out[-1] += b
    return out


@pytest.mark.parametrize("changes", [{}, {"fuse_unk": False}, {"byte_fallback": False}, {"byte_fallback": False, "fuse_unk": False}, {"unk_token": None, "byte_fallback": False}])
def test_words_have_the_ids_of_their_piece(changes):
    t = Tokenizer.from_str(json.dumps(file(spm(**changes))))
    whole, table, rng = models.spm_bpe(t.definition), cutting.joins(t.definition), random.Random(7)
    for _ in range(1500):
        piece = "".join(rng.choice("ginorstum▁xü水\udc80") for _ in range(rng.randrange(1, 25)))
        words = table.words(piece)
        assert words == plain_words(t.definition, piece)
        assert [i for w in words for i in whole(w)] == whole(piece), piece
    assert cutting.joins(Tokenizer.from_str(json.dumps(file(spm(ignore_merges=True)))).definition) is None


def test_long_lines_take_time_in_proportion():
    t = samples.whole_texts()
    line = "the rain in the other town, and then there is no end to it. "
    t.encode(line * 2000)
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        assert len(t.encode(line * n)) > 10 * n
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


# ---- dictionaries


def test_ids_by_dictionary(spark):
    rows = [(1, "the thing in the end"), (2, None), (3, ""), (4, "<s>the</s> the"), (5, "é水 the" * 50)]
    df = spark.createDataFrame(rows, "key int, text string")
    for t in (samples.byte_level(), samples.whole_texts(), samples.wordpiece(), samples.unigram(), samples.byte_level(post_processor={"type": "BertProcessing", "sep": ["</s>", 1], "cls": ["<s>", 0]})):
        engine = Engine(spark, t)
        want = {k: t.encode(v or "") for k, v in rows}
        assert {r["key"]: r["ids"] for r in dictionary.encode_by_words(engine, df, "key", "text").collect()} == want
        assert {r["key"]: r["n_tokens"] for r in dictionary.count_by_words(engine, df, "key", "text").collect()} == {k: len(v) for k, v in want.items()}


def test_a_kept_dictionary_asks_the_model_once_for_each_word(spark, tmp_path):
    engine = Engine(spark, samples.byte_level())
    kept = dictionary.PieceDictionary(engine, spark, "kept_words", f"file://{tmp_path}/words", buckets=4)
    batches = [[(1, "the cat sat"), (2, "a cat")], [(3, "the dog sat"), (4, None), (5, "")], [(6, "a dog")]]
    seen = set()
    for rows in batches:
        df = spark.createDataFrame(rows, "key int, text string")
        found = dictionary.words(engine, df, "key", "text")
        own = {w for _, v in rows for w, _ in engine.tokenizer.model_words(v or "")}
        assert {r["word"] for r in kept.missing(found).collect()} == own - seen
        assert kept.extend(found) == len(own - seen) and kept.extend(found) == 0
        seen |= own
        assert {r["key"]: r["ids"] for r in kept.encode(df, "key", "text").collect()} == {k: engine.tokenizer.encode(v or "") for k, v in rows}
    plan = kept.encode(df, "key", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    spark.sql("DROP TABLE kept_words")


def test_texts_cut_into_rows(spark):
    t = samples.byte_level()
    rows = [(1, "the thing, in the end; " * 200), (2, None), (3, ""), (4, "<s>x"), (5, "x" * 5000)]
    made = Engine(spark, t).encode_cut(spark.createDataFrame(rows, "key int, text string"), "key", "text", 40)
    assert {r["key"]: r["ids"] for r in made.collect()} == {k: t.encode_ordinary(v or "") for k, v in rows}
    with pytest.raises(UnsupportedError):
        Engine(spark, samples.unigram()).encode_cut(spark.createDataFrame(rows, "key int, text string"), "key", "text", 40)


def test_a_published_vocabulary(spark):
    if not samples.published():
        pytest.skip("no published vocabulary")
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(samples.published())
    rng = random.Random(8)
    for _ in range(150):
        text = "".join(rng.choice([*PARTS, "the ", "thing", " of", "\n\n", "12345", "don't"]) for _ in range(rng.randrange(15)))
        assert samples.real().encode(text) == other.encode(text).ids
        assert samples.real().encode_parts(text * 8, 4) == other.encode(text * 8).ids


def test_null_rows_have_no_places(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    assert [(r["n"], r["p"]) for r in df.select(cuts.places("text", "gpt2").alias("n"), F.size(cuts.parts("text", "gpt2", 5)).alias("p")).collect()] == [(None, None), (0, 0)]


def test_hard_cuts_as_columns(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choice([" ", "a"]) * rng.randrange(1, 40) for _ in range(30)) for _ in range(80)] + ["", "x" * 7, " " * 7, "\x1c \x1f " * 9, "é水🌿" * 30]
    monkeypatch.setattr(pretok, "CHUNK_CHARS", 100)
    monkeypatch.setattr(pretok, "RUN_CHARS", 7)
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    for r in df.select("text", pretok.hard_cuts("text", 100, 7).alias("parts")).collect():
        assert r["parts"] == (None if r["text"] is None else pretok.run_cuts(r["text"]) if r["text"] else [])


def test_long_runs_are_cut_before_the_split(spark):
    long = ["a" * 60_000, " " * 30_000 + "b", "水" * 26_000 + " x" * 200_000, "short text"]
    df = spark.createDataFrame(list(enumerate(long)), "k int, text string")
    found = regex.compile(pretok.KIMI, regex.V1)
    for r in df.select("k", pretok.kimi("text").alias("pieces")).collect():
        assert r["pieces"] == [p for part in pretok.run_cuts(long[r["k"]]) for p in found.findall(part)]


def test_pieces_by_a_table_function(spark):
    t = samples.byte_level()
    tables.register(spark, "own_pieces", Engine(spark, t))
    rows = [(1, "the <s> thing"), (2, ""), (3, None), (4, "é水")]
    spark.createDataFrame(rows, "k int, text string").createOrReplaceTempView("own_texts")
    got = [tuple(r) for r in spark.sql("SELECT k, p.* FROM own_texts, LATERAL own_pieces(text) p ORDER BY k, place").collect()]
    assert got == [(k, n, piece, end) for k, text in rows if text for n, (piece, end) in enumerate(zip(t.pieces(text), t.piece_ends(text), strict=True))]


@pytest.mark.parametrize("name", sorted(cuts.FAMILIES))
def test_places_are_counted_by_runs(spark, name):
    """As many as the pattern of the places finds, and without reading a long run again from each of its characters."""
    r = random.Random(name)
    letters = list("aAb é1२\n\r\t'/.,-%茶ア😀\u0301\u00a0\x00\U0001d7ce\U00020000☕_s")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(400)]
    pattern = cuts.compiled(cuts.FAMILIES[name].pattern())
    made = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", "text", cuts.places("text", name).alias("n")).collect()
    assert [r["n"] for r in sorted(made)] == [sum(0 < m.start() < len(x) for m in pattern.finditer(x)) for x in texts]
    assert "++" in cuts.FAMILIES[name].runs()
    long = spark.createDataFrame([(c * 200_000 + "a",) for c in "-1\n茶"] + [("a" * 200_000,)], "text string")
    began = time.monotonic()
    assert len(long.select(cuts.places("text", name)).collect()) == 5
    assert time.monotonic() - began < 20
