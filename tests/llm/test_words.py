import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def listed(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), t))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \n\té日\x0b\x1c.", max_size=40), max_size=8))
def test_words_and_shingles_of_any_texts(texts):
    raw = [t.encode() for t in texts]
    hashed, first, end, bounds = words.word_spans(raw)
    grams, offsets = words.shingle_hashes(hashed, bounds)
    joined = b" ".join(raw) + b" "
    by_word, by_gram = {}, {}
    for i, t in enumerate(raw):
        own = listed(t)
        assert len(own) == bounds[i + 1] - bounds[i]
        for w, h, a, b in zip(own, hashed[bounds[i] :], first[bounds[i] :], end[bounds[i] :]):
            assert by_word.setdefault(w, h) == h and listed(joined[a:b]) == [w]
        shingles = [tuple(own[k : k + 5]) for k in range(len(own) - 4)] or ([tuple(own)] if own else [])
        assert len(shingles) == offsets[i + 1] - offsets[i]
        for s, h in zip(shingles, grams[offsets[i] :]):
            assert by_gram.setdefault(s, h) == h
    assert len(set(map(int, by_word.values()))) == len(by_word) and len(set(map(int, by_gram.values()))) == len(by_gram)


def test_chunks_hold_every_text_once():
    sizes = [10, 500, 3, 0, 900, 1]
    spans = list(words.chunks([b"x" * n for n in sizes], 510))
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(sizes)))
    assert list(words.chunks([])) == []


def test_mix_is_one_to_one():
    x = np.arange(200_000, dtype=np.uint64)
    assert len(np.unique(words.mix(x))) == len(x)
