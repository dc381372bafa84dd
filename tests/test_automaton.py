"""Leftmost-longest matches of many strings."""

import random

import time

import pytest

from glyphmill.functions.automaton import Automaton
from glyphmill.operators import tokenizer
from glyphmill.plans import samples


def plain(words, text):
    out, at = [], 0
    while at < len(text):
        own = [w for w in words if text.startswith(w, at)]
        if own:
            out.append((at, at + max(map(len, own))))
            at = out[-1][1]
        else:
            at += 1
    return out


def test_spans_are_those_of_a_search_place_by_place():
    rng = random.Random(1)
    for _ in range(3000):
        words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 9))}
        text = "".join(rng.choice("abé𐀀") for _ in range(rng.randrange(40)))
        assert list(Automaton(words).spans(text)) == plain(words, text), (words, text)


def test_time_does_not_follow_the_number_of_strings():
    rng = random.Random(2)
    text = "".join(rng.choice("<abcdef >") for _ in range(300_000))
    took = []
    for n in (20, 20_000):
        found = Automaton({"<" + "".join(rng.choice("abcdef") for _ in range(8)) + ">" for _ in range(n)})
        began = time.process_time()
        list(found.spans(text))
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0]


@pytest.mark.parametrize("flags", [{}, {"single_word": True}, {"lstrip": True}, {"rstrip": True}, {"special": False}])
def test_segments_do_not_depend_on_the_way_of_searching(monkeypatch, flags):
    rng = random.Random(3)
    contents = tuple(dict.fromkeys("".join(rng.choice("abc<> ") for _ in range(rng.randrange(1, 6))).strip() or "<" for _ in range(200)))
    added = samples._added(contents, **flags)
    many = samples.byte_level(added_tokens=added)
    monkeypatch.setattr(tokenizer, "FEW_TOKENS", 1 << 30)
    few = samples.byte_level(added_tokens=added)
    assert many._raw[0].__qualname__.startswith("Automaton") and not few._raw[0].__qualname__.startswith("Automaton")
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "<", ">", " ", "ab", "é"]) for _ in range(30))
        for mode in tokenizer.MODES:
            assert many.segments(text, mode) == few.segments(text, mode)
