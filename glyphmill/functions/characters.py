"""Classes of characters that tokenizer files rely on."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import regex

from glyphmill.functions import versions

# The 25 code points of White_Space, and the ASCII punctuation.
WHITE_SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")
ASCII_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: The ranges that count as Chinese where a normalizer sets such characters apart.
CHINESE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))

_WORD = regex.compile(r"\w", regex.V1)


class Table(dict):
    """What ``str.translate`` makes of each character, asked for once."""

    def __init__(self, one: Callable[[str], str]):
        super().__init__()
        self.one = one

    def __missing__(self, point: int) -> str:
        made = self[point] = self.one(chr(point))
        return made


@cache
def is_word(ch: str) -> bool:
    return bool(_WORD.match(ch))


@cache
def is_chinese(ch: str) -> bool:
    return any(a <= ord(ch) <= b for a, b in CHINESE)


@cache
def is_punctuation(ch: str) -> bool:
    return ch in ASCII_PUNCTUATION or versions.is_general_punctuation(ch)


@cache
def lowered(ch: str) -> str:
    """The lower case of one character, without regard to what stands around it."""
    return versions.lower(ch)


@cache
def byte_alphabet() -> dict[int, str]:
    """The 256 printable characters that stand for bytes: those that print stand for themselves, the others come from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out
