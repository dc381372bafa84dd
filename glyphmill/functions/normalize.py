"""Normalizer steps: on Python text for the exact engine, and as built-in columns where those give the same."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable
from typing import Any

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import versions
from glyphmill.functions.characters import WHITE_SPACE, Table, is_chinese, lowered
from glyphmill.sources.definition import FormatError, UnsupportedError

Step = Callable[[str], str]


def compiled(steps: list[dict[str, Any]]) -> Step:
    """One function for all steps, each over the whole string."""
    made = [_step(s) for s in steps]

    def run(text: str) -> str:
        for f in made:
            text = f(text)
        return text

    return run


def _step(s: dict[str, Any]) -> Step:
    kind = s["type"]
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return lambda t: versions.form(kind, t)
    if kind == "StripAccents":
        kept = Table(lambda c: "" if versions.is_mark(c) else c)
        return lambda t: t if t.isascii() else t.translate(kept)
    if kind == "Lowercase":
        low = Table(lowered)
        return lambda t: t.lower() if t.isascii() else t.translate(low)
    if kind == "Strip":
        return _strip(s.get("strip_left", True), s.get("strip_right", True))
    if kind == "Prepend":
        return lambda t: s["prepend"] + t if t else t
    if kind == "Replace":
        return _replace(s)
    if kind == "Precompiled":
        return Charsmap(s["precompiled_charsmap"])
    if kind == "BertNormalizer":
        return _bert(s)
    raise UnsupportedError(f"normalizer {kind}")


def _strip(left: bool, right: bool) -> Step:
    def run(t: str) -> str:
        a, b = 0, len(t)
        while left and a < b and t[a] in WHITE_SPACE:
            a += 1
        while right and b > a and t[b - 1] in WHITE_SPACE:
            b -= 1
        return t[a:b]

    return run


def _replace(s: dict[str, Any]) -> Step:
    (kind, pattern), content = next(iter(s["pattern"].items())), s["content"]
    if kind == "String":
        return lambda t: t.replace(pattern, content)
    found = regex.compile(pattern, regex.V1)
    return lambda t: found.sub(lambda _: content, t)


def _bert(s: dict[str, Any]) -> Step:
    clean, chinese, lower = s.get("clean_text", True), s.get("handle_chinese_chars", True), s.get("lowercase", True)
    accents = s.get("strip_accents") if s.get("strip_accents") is not None else lower

    def one(c: str) -> str:
        if clean:
            if c in "\t\n\r":
                return " "
            if c in "\x00�" or versions.is_control(c):
                return ""
            if c in WHITE_SPACE:
                return " "
        return f" {c} " if chinese and is_chinese(c) else c

    first, bare, low = Table(one), Table(lambda c: "" if versions.is_non_spacing_mark(c) else c), Table(lowered)

    def run(t: str) -> str:
        t = t.translate(first)
        if accents and not t.isascii():
            t = versions.form("NFD", t).translate(bare)
        if not lower:
            return t
        return t.lower() if t.isascii() else t.translate(low)

    return run


#: Keys that a worker keeps the replacements of.
MOST_KNOWN = 100_000


class Charsmap:
    """A precompiled map of strings: a double array of keys and their replacements, walked by grapheme clusters."""

    def __init__(self, blob: str):
        try:
            raw = base64.b64decode(blob, validate=True)
            size = struct.unpack_from("<I", raw)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", raw, 4)
            self.strings = raw[4 + 4 * (size // 4) :]
            self.strings.decode("utf-8")
        except (ValueError, struct.error) as e:
            raise FormatError("precompiled_charsmap") from e
        self.known: dict[str, str | None] = {}

    def find(self, key: str) -> str | None:
        """The replacement for the shortest key that starts ``key``."""
        if key not in self.known:
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            self.known[key] = self._walk(key.encode())
        return self.known[key]

    def _walk(self, key: bytes) -> str | None:
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(self.units[0])
        for c in key:
            node ^= c
            if not c or node >= len(self.units) or self.units[node] & 0x800000FF != c:
                return None
            unit = self.units[node]
            node ^= offset(unit)
            if unit & 0x100:
                start = self.units[node] & 0x7FFFFFFF
                return self.strings[start : self.strings.index(b"\0", start)].decode()
        return None

    def __call__(self, text: str) -> str:
        out = []
        for cluster in regex.findall(r"\X", text):
            if len(cluster.encode()) < 6 and (whole := self.find(cluster)) is not None:
                out.append(whole)
            else:
                out += [c if (r := self.find(c)) is None else r for c in cluster]
        return "".join(out)


# ---- the same as columns, for texts on which built-in functions agree


def strip(text: Column | str, left: bool = True, right: bool = True) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    out = F.regexp_replace(out, r"(?U)^\s+", "") if left else out
    return F.regexp_replace(out, r"(?U)\s+$(?![\s\S])", "") if right else out


def collapse_spaces(text: Column | str) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def replace(text: Column | str, pattern: str, content: str) -> Column:
    return F.replace(F.col(text) if isinstance(text, str) else text, F.lit(pattern), F.lit(content))


def prepend(text: Column | str, what: str) -> Column:
    of = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(of) > 0, F.concat(F.lit(what), of)).otherwise(of)


def strip_accents(text: Column | str) -> Column:
    """Marks of the version that ``StripAccents`` knows go; nothing is taken apart before."""
    return F.regexp_replace(text, f"[{versions.JAVA_MARK}]", "")


def is_ascii(text: Column | str) -> Column:
    return (F.col(text) if isinstance(text, str) else text).rlike(r"^[\x00-\x7F]*$")


def bert_ascii(text: Column | str) -> Column:
    """The BERT normalizer with all steps on, for ASCII text: control characters go, white space is a space, A-Z lower."""
    spaced = F.translate(text, "\t\n\r", "   ")
    gone = F.regexp_replace(spaced, r"[\x00-\x1F\x7F]", "")
    return F.translate(gone, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


