"""The engine against the public tokenizer libraries, and its own laws."""

import json
import random

import pytest
import regex
import tokenizers
from shapes import PARTS, SHAPES, file, spm, token, unigram

from glyphmill.functions import pretok
from glyphmill.operators.decoding import byte_of
from glyphmill.operators.tokenizer import NONE, NONSPECIAL, Tokenizer
from glyphmill.plans import samples
from glyphmill.sources import definition, ranks
from glyphmill.sources.definition import ArgumentError, FormatError, IdError, OpenError, UnsupportedError


def texts(seed, n=250, parts=PARTS):
    rng = random.Random(seed)
    return ["", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n))]


@pytest.mark.parametrize("name", SHAPES)
def test_ids_masks_and_text_are_the_librarys(name):
    source = json.dumps(SHAPES[name])
    own, other = Tokenizer.from_str(source), tokenizers.Tokenizer.from_str(source)
    rng = random.Random(3)
    for text in texts(name):
        e = other.encode(text)
        assert own.encode(text) == e.ids, text
        assert own.encode(text, add_special_tokens=False) == other.encode(text, add_special_tokens=False).ids, text
        ex = own.encode_ex(text)
        assert (ex.ids, ex.type_ids, ex.attention_mask, ex.special_tokens_mask) == (e.ids, e.type_ids, e.attention_mask, e.special_tokens_mask)
        ids = [rng.randrange(own.n_vocab) for _ in range(6)]
        for skip in (True, False):
            for some in (ids, e.ids):
                assert own.decode(some, skip) == other.decode(some, skip_special_tokens=skip)
            stream = own.decode_stream(skip)
            assert "".join(stream.push(i) for i in ids) + stream.flush() == own.decode(ids, skip)


@pytest.mark.parametrize("name", ["metaspace_split", "prepend", "bert"])
def test_nonspecial_mode_matches_and_drops(name):
    source = json.dumps(SHAPES[name])
    own, other = Tokenizer.from_str(source), tokenizers.Tokenizer.from_str(source)
    other.encode_special_tokens = True
    for text in texts(name + "n"):
        assert own.encode(text, added_tokens=NONSPECIAL) == other.encode(text).ids


def test_mode_none_keeps_the_template():
    t = Tokenizer.from_str(json.dumps(SHAPES["prepend"]))
    assert t.encode("<s>s", added_tokens=NONE)[0] == 1
    assert 1 not in t.encode("<s>s", added_tokens=NONE)[1:]
    with pytest.raises(ArgumentError):
        t.encode("s", added_tokens="some")


@pytest.mark.parametrize("behaviour", definition.BEHAVIOURS)
@pytest.mark.parametrize("invert", [False, True])
def test_split_behaviours(behaviour, invert):
    other = tokenizers.pre_tokenizers.Split(tokenizers.Regex(r"\d+|-"), {"Removed": "removed", "Isolated": "isolated", "MergedWithPrevious": "merged_with_previous", "MergedWithNext": "merged_with_next", "Contiguous": "contiguous"}[behaviour], invert)
    own = pretok.compiled([{"type": "Split", "pattern": {"Regex": r"\d+|-"}, "behavior": behaviour, "invert": invert}])
    for text in texts(behaviour, 200, ["a", "bc", "1", "23", "-", "--", " "]):
        assert own(text, True) == [p for p, _ in other.pre_tokenize_str(text)], text


@pytest.mark.parametrize("name", pretok.COVERING)
def test_patterns_cover_every_text(name):
    for text in texts(name, 200, [*PARTS, "12345", "don't", "IT'S", "\r\n", "Éa", "ſ"]):
        assert "".join(regex.findall(pretok.COVERING[name], text)) == text


def test_byte_level_pieces_parts_and_bounds():
    t = samples.byte_level()
    for text in texts("bytes", 200, [*PARTS, "the ", "of the thing "]):
        ids = t.encode(text)
        assert t.decode(ids, skip_special_tokens=False) == text
        assert len(ids) <= t.encode_bound(len(text.encode()))
        assert "".join(t.pieces(text)) == text
        assert t.piece_ends(text)[-1:] == ([len(text.encode())] if text else [])
        assert t.encode_parts(text * 9, 4) == t.encode(text * 9)
    long = "the quick brown fox jumps over it's lazy " * 40
    assert len(t.split_points(long, 4)) == 3
    assert samples.sentencepiece(truncation={"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}).split_points(long, 4) == []
    for own in (samples.wordpiece(), samples.sentencepiece(), samples.unigram()):
        assert own.encode_parts(long, 5) == own.encode(long) and own.split_points(long, 5)


def test_any_bytes_round_trip():
    t = samples.byte_level()
    raw = bytes(range(256)) + "é".encode()
    assert t.decode_bytes(t.encode(raw)) == raw
    assert t.decode(t.encode(b"\xe2\x82a")) == b"\xe2\x82a".decode("utf-8", "replace")


def test_vocabulary_lookups():
    t = samples.byte_level()
    assert t.token_to_id("<s>") == 0 and t.id_to_token(0) == "<s>" and t.id_flags(0) == 3
    space = t.encode(" ")[0]
    assert t.token_bytes(space) == b" " and t.id_flags(space) == 4 and t.token_to_id(b" ") == space
    assert t.token_to_id(b"") is None and t.token_bytes(10**6) is None
    assert t.get_vocab_size() == t.n_vocab == len(t.get_vocab()) and t.max_token_value == t.n_vocab - 1
    assert t.token_byte_values() == sorted(t.token_byte_values()) and len(t.token_byte_values()) == t.n_vocab - 3
    assert [a.content for a in t.added_tokens()] == ["<s>", "</s>", "<pad>"] and t.special_tokens_set == {"<s>", "</s>", "<pad>"}
    with pytest.raises(IdError):
        t.decode([10**6])
    with pytest.raises(UnsupportedError):
        t.num_special_tokens_to_add(True)
    assert t.info()["algorithm"] == "byte_bpe" and t.control_isolation()


def test_byte_tokens():
    assert [byte_of(x) for x in ("<0x41>", "<0xfF>", "<0x+F>", "<0x4>", "<0xGG>", "x")] == [65, 255, 15, None, None, None]


def test_scores_are_read_from_their_digits():
    assert definition.score("-10.5") == -10.5 and definition.score("1e-3") == 1e-3 and definition.score("0.0") == 0.0
    assert definition.score("-7.123456789012345678901") == pytest.approx(-7.123456789012345)


@pytest.mark.parametrize(
    "changes, kind",
    [
        ({"version": "2.0"}, FormatError),
        ({"extra": 1}, FormatError),
        ({"model": spm(dropout=0.1)}, UnsupportedError),
        ({"model": spm(end_of_word_suffix="</w>")}, UnsupportedError),
        ({"model": spm(merges=["s z"])}, FormatError),
        ({"model": {"type": "WordLevel", "vocab": {}}}, UnsupportedError),
        ({"normalizer": {"type": "Nmt"}}, UnsupportedError),
        ({"pre_tokenizer": {"type": "Whitespace"}}, UnsupportedError),
        ({"decoder": {"type": "CTC"}}, UnsupportedError),
        ({"decoder": {"type": "Sequence", "decoders": [{"type": "Fuse"}, {"type": "ByteFallback"}]}}, UnsupportedError),
        ({"truncation": {"direction": "Left", "max_length": 5, "strategy": "LongestFirst", "stride": 0}}, UnsupportedError),
        ({"truncation": {"direction": "Right", "max_length": 5, "strategy": "OnlySecond", "stride": 0}}, UnsupportedError),
        ({"added_tokens": [token(300, "  ", lstrip=True), token(301, "x", rstrip=True)]}, UnsupportedError),
        ({"model": unigram(unk_id=99)}, FormatError),
    ],
)
def test_files_are_refused_by_name(changes, kind):
    with pytest.raises(kind) as e:
        definition.read(json.dumps(file(spm()) | changes))
    assert str(e.value).startswith((e.value.name, "'" + e.value.name)) and e.value.code < 0


def test_other_refusals(tmp_path):
    for raw in (b"{", b"[]", b'{"version": NaN}', b"\xff{"):
        with pytest.raises(FormatError):
            definition.read(raw)
    with pytest.raises(FormatError):
        definition.read('{"version":"1.0","version":"1.0","model":{}}')
    with pytest.raises(UnsupportedError):
        definition.read('{"config":{},"vocab":[]}')
    with pytest.raises(OpenError):
        Tokenizer.from_file(str(tmp_path / "none"))


def test_rank_files_against_the_library(tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    table = {bytes([b]): b for b in range(256)}
    for k, token in enumerate([b"th", b"he", b"the", b" t", b" the", b"in", b"ing"]):
        table[token] = 256 + k
    path = tmp_path / "own.ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in table.items()))
    specials = ranks.reserved_specials(300, 3, {"<end>": 301}, "<reserved_{}>")
    assert specials == {"<reserved_300>": 300, "<end>": 301, "<reserved_302>": 302}
    own = Tokenizer.from_file(str(path), pattern=pretok.GPT2, specials=specials)
    other = tiktoken.Encoding("own", pat_str=pretok.GPT2, mergeable_ranks=table, special_tokens=specials)
    for text in texts("ranks", 200, [*PARTS, "the thing", "<end>"]):
        assert own.encode_ordinary(text) == other.encode_ordinary(text)
        assert own.encode_allowed(text, "all") == other.encode(text, allowed_special="all")
        assert own.decode_bytes(own.encode_ordinary(text)) == text.encode()
    with pytest.raises(ValueError):
        own.encode_allowed("a<end>")
    with pytest.raises(FormatError):
        ranks.read(b"YQ== 0\nYQ== 1\n", pretok.GPT2)
    with pytest.raises(ArgumentError):
        Tokenizer.from_file(str(path))


def test_batches_pad_to_their_longest():
    source = json.dumps(SHAPES["bert_cased"])
    own, other = Tokenizer.from_str(source), tokenizers.Tokenizer.from_str(source)
    some = ["s", "sour ring", "", "no tours ?"]
    assert own.encode_batch(some) == [e.ids for e in other.encode_batch(some)]
