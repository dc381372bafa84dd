"""Bounds of ids by bytes, and the certificate that added tokens are out of a text's reach."""

import itertools
import json
import random
from fractions import Fraction

import pytest
from shapes import PARTS, SHAPES, file, token

from glyphmill.functions.characters import byte_alphabet
from glyphmill.operators import bounds, models
from glyphmill.operators.tokenizer import NONE, Tokenizer
from glyphmill.plans import samples
from glyphmill.sources import definition

WIDE = [*PARTS, "ΐ", "ﷺ", "ﬃ", "İ", "각", "🌿", "é", "¨", "‾", "\x00", "½", "𝟙", "הּ", "   "]


@pytest.mark.parametrize("name, shape", SHAPES.items())
def test_no_text_has_more_ids(name, shape):
    t, rng = Tokenizer.from_str(json.dumps(shape)), random.Random(name)
    for _ in range(600):
        text = "".join(rng.choice(WIDE) for _ in range(rng.randrange(8)))
        assert len(t.encode(text)) <= t.encode_bound(len(text.encode())), text
    for c in WIDE:
        assert len(t.encode(c * 50)) <= t.encode_bound(len(c.encode()) * 50), c


def test_rates():
    assert bounds.Bound(samples.byte_level().definition).rate == 1
    assert bounds.Bound(samples.whole_texts().definition).rate == 1  # and not three, for the mark's bytes
    assert bounds.Bound(samples.byte_level(normalizer={"type": "NFC"}).definition).rate == 3
    assert bounds.Bound(samples.unigram(normalizer={"type": "NFKC"}).definition).rate == 6  # one of three bytes becomes 18
    short = samples.sentencepiece(added_tokens=samples._added(("<s>", "</s>", "x"))).definition
    assert bounds.Bound(short).rate == Fraction(2, 1) and bounds.Bound(short).before == 1


@pytest.mark.parametrize("name", ["prepend", "metaspace_split", "unigram", "unigram_bytes", "bert"])
def test_bounds_are_never_above_a_byte_each_by_three(name):
    t = Tokenizer.from_str(json.dumps(SHAPES[name]))
    assert t.encode_bound(1000) <= 33 * 1000 + 100


def arising(d, letters, longest):
    run, seen = models.byte_bpe(d), set()
    for n in range(1, longest + 1):
        for p in itertools.product(letters, repeat=n):
            seen |= set(run("".join(p)))
    return seen


def test_ids_that_can_arise_against_all_short_texts():
    rng = random.Random(6)
    missed = 0
    for _ in range(60):
        letters, made = "abc", []
        known = list(letters)
        for _ in range(rng.randrange(1, 6)):
            a, b = rng.choice(known), rng.choice(known)
            if len(a + b) <= 4 and (a, b) not in made:
                made.append((a, b))
                known.append(a + b)
        extra = [x for x in ("abca", "cc", "bab") if x not in known]  # strings that no merge makes
        merges = [list(m) for m in made if rng.random() < 0.8]
        parts = {p for m in merges for p in m} | {a + b for a, b in merges}
        vocab = list(dict.fromkeys([*byte_alphabet().values(), *known, *extra, *parts]))
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {s: i for i, s in enumerate(vocab)}, "merges": merges}
        d = definition.read(json.dumps(file(model)))
        ours, seen = bounds.reachable(d), arising(d, letters, 6)
        assert seen <= ours
        missed += len({i for i in ours if vocab[i] in known + extra} - seen - {d.vocab[c] for c in letters})
        for x in extra:
            assert (d.vocab[x] in ours) == any(a + b == x and d.vocab[a] in ours and d.vocab[b] in ours for a, b in d.merges)
    assert missed < 40  # a merge that an earlier one always forestalls is taken for one that can happen


def test_a_merge_of_parts_that_cannot_arise_proves_nothing():
    alphabet = list(byte_alphabet().values())
    vocab = {s: i for i, s in enumerate([*alphabet, "xy", "xyz", "yz"])}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [["xy", "z"]]}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    shut = Tokenizer.from_str(json.dumps(file(model, None, level, level, tokens=[token(vocab["xyz"], "xyz")])))
    assert shut.control_isolation()  # nothing makes xy
    model["merges"] = [["xy", "z"], ["x", "y"]]
    open_ = Tokenizer.from_str(json.dumps(file(model, None, level, level, tokens=[token(vocab["xyz"], "xyz")])))
    assert not open_.control_isolation() and vocab["xyz"] in open_.encode("xyz", added_tokens=NONE)
    assert not Tokenizer.from_str(json.dumps(SHAPES["prepend"])).control_isolation()  # not looked at
