"""How many ids a text of so many bytes can have at most, and which ids the model can give at all."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from fractions import Fraction
from itertools import chain

from glyphmill.functions import normalize
from glyphmill.functions.characters import byte_alphabet
from glyphmill.sources.definition import BPE, UNIGRAM, WORDPIECE, Definition

#: Steps that take one character after the other, or compose neighbours.
_BY_CHARACTER = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer"}
#: What other steps multiply a text's length by, at most.
_OTHER = {"Precompiled": 11}
#: Code points that a step may make longer: beyond these are only unassigned and private ones.
_ASSIGNED = (range(0xD800), range(0xE000, 0x33480), range(0xE0000, 0xE0200))


def _weights(d: Definition) -> Callable[[str], int]:
    """The most ids that one character of normalized text can give."""
    size = lambda c: len(c.encode("utf-8", "surrogateescape"))
    if d.algorithm == BPE:
        return size
    if d.algorithm == WORDPIECE:
        return lambda c: 1
    whole = d.byte_fallback and all(f"<0x{b:02X}>" in d.vocab for b in range(256))
    if d.algorithm == UNIGRAM and d.byte_fallback or whole:
        return lambda c: 1 if c in d.vocab and c != d.unk_token else size(c)
    return lambda c: max(1, size(c)) if d.byte_fallback else 1


def _prefix(d: Definition) -> str:
    """What may be set before every stretch between added tokens."""
    out = "".join(s["prepend"] for s in d.normalizers if s["type"] == "Prepend")
    return out + "".join(s.get("replacement", "▁") for s in d.pre_tokenizers if s["type"] == "Metaspace" and s.get("prepend_scheme", "always") != "never")


def _growth(d: Definition, weight: Callable[[str], int]) -> Fraction:
    """The most that a byte of text becomes, summed by ``weight`` over the normalized text: exactly, by asking the steps
    about every character, where they take characters one by one; as a product of their growths otherwise."""
    steps = [s for s in d.normalizers if s["type"] not in ("Prepend", "Strip")]
    simple = all(s["type"] in _BY_CHARACTER or (s["type"] == "Replace" and len(s["pattern"].get("String", "  ")) == 1) for s in steps)
    if not simple:
        total = Fraction(max(map(weight, "a▁水🌿")))
        for s in steps:
            content = s.get("content", "")
            total *= {"NFKC": 11, "NFKD": 11, "NFC": 3, "NFD": 3, "BertNormalizer": 3, "Lowercase": 2, **_OTHER}.get(s["type"], 1) if s["type"] != "Replace" else max(1, len(content.encode()))
        return total
    run, most = normalize.compiled(steps), Fraction(1)
    composed = any(s["type"] in ("NFC", "NFKC") for s in steps)
    for c in chain(*_ASSIGNED) if steps else ():  # a character that no step changes gives no more ids than it has bytes
        ch = chr(c)
        made = run(ch)
        if made == ch:
            continue
        out = sum(map(weight, made))
        size = 1 if c < 0x80 else 2 if c < 0x800 else 3 if c < 0x10000 else 4
        if out * most.denominator > most.numerator * size:
            most = Fraction(out, size)
        if composed and (apart := unicodedata.normalize("NFD", ch)) != ch:
            own, parts = weight(ch), len(apart.encode())
            if own * most.denominator > most.numerator * parts:
                most = Fraction(own, parts)
    return most


class Bound:
    """ids <= ceil(rate * bytes) + fixed for every text; ``fixed`` is the template's, and what is set before a text."""

    def __init__(self, d: Definition):
        weight = _weights(d)
        before = sum(map(weight, _prefix(d)))
        self.rate = _growth(d, weight)
        for t in d.added:  # a token, and what is set before the stretch that follows it
            form = t.content.encode() if not t.normalized or not d.normalizers else b"x" * max(1, len(t.content.encode()) // 11)
            self.rate = max(self.rate, Fraction(1 + before, max(1, len(form))))
        self.before, self.template = before, len(d.prefix) + len(d.suffix)

    def of(self, n_bytes: int) -> int:
        return (-(-n_bytes * self.rate.numerator // self.rate.denominator) + self.before if n_bytes else 0) + self.template


def reachable(d: Definition) -> set[int]:
    """The ids that a byte-level model can give for some text: initial symbols, and what merges make of parts that can both
    arise.  A merge's product is longer than its parts, so one pass by length settles all of them."""
    if d.ranks:
        return set(d.ranks.values())
    if d.ignore_merges:
        return set(d.vocab.values())
    alphabet = set(byte_alphabet().values())
    arise = {c for c in alphabet if c in d.vocab}
    if d.unk_token is not None and d.unk_token in d.vocab and len(arise) < 256:
        arise.add(d.unk_token)
    for a, b in sorted(d.merges, key=lambda m: len(m[0]) + len(m[1])):
        if a in arise and b in arise:
            arise.add(a + b)
    return {d.vocab[s] for s in arise}


def isolated(d: Definition) -> bool:
    """Whether it is proved that no text gives an added token's id where added tokens are not matched.  Byte-level models
    alone are looked at; for the others, whose models give unknown or byte tokens, nothing is proved."""
    return d.algorithm == BPE and not {t.id for t in d.added} & reachable(d)


