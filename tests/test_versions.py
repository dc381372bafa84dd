"""Characters by the versions that tokenizer files were made with, compared with the public library."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import normalizers, pre_tokenizers

from glyphmill.functions import normalize, pretok, versions
from glyphmill.functions.characters import is_punctuation

EVERY = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
BERT = {"clean_text": False, "handle_chinese_chars": False, "strip_accents": False, "lowercase": False}
STEPS = [{"type": k} for k in ("NFC", "NFD", "NFKC", "NFKD", "StripAccents", "Lowercase")] + [{"type": "BertNormalizer"} | BERT | {k: True} for k in BERT]


def theirs(step):
    return getattr(normalizers, step["type"])(**{k: v for k, v in step.items() if k != "type"})


def name(step):
    return "-".join([step["type"], *[k for k, v in step.items() if v is True]])


@pytest.mark.parametrize("step", STEPS, ids=name)
def test_every_character(step):
    ours, public = normalize.compiled([step]), theirs(step)
    assert [c for c in EVERY if ours(c) != public.normalize_str(c)] == []


@pytest.mark.parametrize("step", STEPS, ids=name)
def test_characters_side_by_side(step):
    odd = sorted(versions.held(versions.LATER_MARKS) | versions.held(versions.LATER_FORMS) | versions.held(versions.MARKS_OF_9))
    known = "aeou ń̴゙ְ̖ͅか각각ﬁ①éẛ̣㋾क़"
    rng = random.Random(7)
    ours, public = normalize.compiled([step]), theirs(step)
    for _ in range(20_000):
        text = "".join(rng.choice(odd if rng.random() < 0.3 else known) for _ in range(rng.randint(1, 9)))
        assert ours(text) == public.normalize_str(text), ascii(text)


def test_no_rows_of_characters_are_lost():
    assert versions.form("NFKC", "") == "" and versions.form("NFC", "㋿") == "㋿"
    assert versions.form("NFKC", "ﬁ㋿㋿ﬁ") == "fi㋿㋿fi"


def test_punctuation_and_marks_in_the_jvm(spark):
    public = pre_tokenizers.BertPreTokenizer()
    apart = {c for c in EVERY if len(public.pre_tokenize_str(f"a{c}a")) == 3}
    assert {c for c in EVERY if is_punctuation(c)} == apart
    points = spark.range(0, 0x110000, 1, 4).where("(id < 55296 or id > 57343) and id <> 65279").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    marked = {r["c"] for r in points.where(F.col("c").rlike(f"^(?U)(?:{pretok.PUNCTUATION_MARK})$")).collect()}
    stripped = {r["c"] for r in points.where(normalize.strip_accents("c") == "").collect()}
    assert marked == apart, sorted(map(ascii, marked ^ apart))
    assert stripped == {c for c in EVERY if versions.is_mark(c)}, sorted(map(ascii, stripped ^ {c for c in EVERY if versions.is_mark(c)}))
    words = spark.createDataFrame([("a؝b᙭c",)], "t string")
    assert words.select(pretok.bert("t")).first()[0] == [p for p, _ in public.pre_tokenize_str("a؝b᙭c")]
