"""Where a text, or a piece of it, may be cut so that the ids of the parts are the ids of the whole."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import regex

from glyphmill.functions import cuts, pretok
from glyphmill.functions.characters import WHITE_SPACE
from glyphmill.sources.definition import BPE, SPM, UNIGRAM, WORDPIECE, Definition

#: Normalizer steps that take characters one by one, or compose them, but never with an ASCII character before them.
_LOCAL = {"Lowercase", "StripAccents", "NFC", "NFD", "NFKC", "NFKD", "BertNormalizer"}


class Joins:
    """Neighbouring characters that some merge of a vocabulary brings into one string.

    Between two others no merge ever reaches over, so a piece may be cut there, however long it is: the merges on either
    side are the same.  The first of the two must be a character of the vocabulary, since a character that is not waits for
    what follows it; and so must be the second where characters may vanish (``both``), since then what stands beyond it
    comes next.
    """

    def __init__(self, pairs: set[tuple[str, str]], known: set[str], both: bool = False):
        self.both = both
        self._keys = np.array(sorted((ord(a) << 21) | ord(b) for a, b in pairs), dtype=np.int64)
        self._known = np.array(sorted(map(ord, known)), dtype=np.int64)
        self.pairs, self.known = pairs, known

    @staticmethod
    def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
        if not len(found):
            return np.zeros(len(values), dtype=bool)
        return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values

    def words(self, piece: str) -> list[str]:
        """The piece in the smallest parts that no merge joins."""
        if len(piece) < 2:
            return [piece]
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        free = self._among(points[:-1], self._known) & ~self._among((points[:-1] << 21) | points[1:], self._keys)
        if self.both:
            free &= self._among(points[1:], self._known)
        ends = [*(np.flatnonzero(free) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip([0, *ends], ends)]


def joins(d: Definition) -> Joins | None:
    """The relation of a SentencePiece-style vocabulary; none where whole pieces are looked up before any merge, or where
    merges join bytes of characters that the vocabulary lacks."""
    if d.algorithm != SPM or d.ignore_merges:
        return None
    bytewise = {f"<0x{b:02X}>" for b in range(256)}
    if any(a in bytewise or b in bytewise for a, b in d.merges):
        return None
    vanish = d.unk_token is None and not (d.byte_fallback and bytewise <= set(d.vocab))
    return Joins({p for a, b in d.merges for p in zip(a + b, (a + b)[1:])}, {c for c in d.vocab if len(c) == 1}, vanish)


@cache
def _seconds() -> frozenset[str]:
    """Characters that compose with one before them."""
    out = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def _composed(around: str) -> bool:
    """Whether no normal form changes these characters or joins one to its neighbours."""
    return around.isascii() or (unicodedata.normalize("NFC", around) == around and not any(unicodedata.combining(c) or c in _seconds() for c in around))


def family(d: Definition) -> str | None:
    """The split pattern's name, where it is one whose cuts are known."""
    steps = [s for s in d.pre_tokenizers if not (s["type"] == "ByteLevel" and not s.get("use_regex", True))]
    if [s["type"] for s in steps] == ["ByteLevel"]:
        return "gpt2"
    if not steps or any(s["type"] != "Split" or next(iter(s["pattern"])) != "Regex" for s in steps):
        return None
    patterns = tuple(next(iter(s["pattern"].values())) for s in steps)
    plain = all(s["behavior"] == "Isolated" and not s.get("invert") for s in steps)
    if patterns == pretok.DEEPSEEK3:
        return "deepseek3" if plain else None
    whole = len(steps) == 1 and (plain or (steps[0]["behavior"] == "Removed" and steps[0].get("invert")))
    return next((n for n, p in {**pretok.COVERING, **pretok.COVERING_TOO}.items() if whole and p == patterns[0] and n in cuts.FAMILIES), None)


class Cutter:
    """The sure places of a definition's texts: a pattern, and no added token that touches the place."""

    def __init__(self, d: Definition, table: Joins | None):
        self.rule, self._composes = self._find(d, table)
        self._added: dict[str, list[int]] = {}  # lengths of added tokens by their first character
        for content in {t.content for t in d.added if t.content}:
            self._added.setdefault(content[0], []).append(len(content))
        self._contents = {t.content for t in d.added}
        self._longest = max(map(len, self._contents), default=0)

    @staticmethod
    def _find(d: Definition, table: Joins | None) -> tuple[regex.Pattern | None, bool]:
        """No cuts where the whole text counts (truncation, padding), where added tokens are matched in normalized text, or
        where a step looks further than these rules know."""
        kinds = {s["type"] for s in d.normalizers}
        if d.truncation or d.padding or (d.normalizers and any(t.normalized for t in d.added)):
            return None, False
        split = [s["type"] for s in d.pre_tokenizers]
        if d.algorithm == BPE and (name := family(d)):
            if kinds <= {"NFC"}:
                return cuts.compiled(cuts.FAMILIES[name].pattern()), bool(kinds)
            return (cuts.compiled(cuts.ONE_SPACE), False) if kinds <= _LOCAL else (None, False)
        if d.algorithm == WORDPIECE and kinds <= _LOCAL and set(split) and set(split) <= {"BertPreTokenizer", "WhitespaceSplit"}:
            return cuts.compiled(cuts.AFTER_SPACE), False
        if d.algorithm in (SPM, UNIGRAM) and kinds <= _LOCAL and split == ["Metaspace"] and d.pre_tokenizers[0].get("split", True):
            return cuts.compiled(cuts.PRINTING), False
        if table is not None and [s["type"] for s in d.normalizers] == ["Replace"] and split in ([], ["Split"]):
            # spaces become marks, and nothing is set before a text; a split at spaces finds none
            change = d.normalizers[0]
            whole = not d.pre_tokenizers or d.pre_tokenizers[0]["pattern"] == {"String": " "}
            if change["pattern"] == {"String": " "} and len(change["content"]) == 1 and whole and (not table.both or change["content"] in table.known):
                before = "".join(regex.escape(c, special_only=False) for c in sorted(table.known) if (c, change["content"]) not in table.pairs and c not in WHITE_SPACE)
                return (cuts.compiled(f"(?<=[{before}])(?= )") if before else None), False
        return None, False

    def _clear(self, text: str, p: int) -> bool:
        """Whether no added token ends at the place, starts there, or reaches over it."""
        starts = range(max(0, p - self._longest), min(len(text), p + 1))
        return not any(s + n >= p and text[s : s + n] in self._contents for s in starts for n in self._added.get(text[s], ()))

    def nearest(self, text: str, want: int, reach: int, after: int) -> int | None:
        """The sure place nearest to ``want``, within ``reach`` of it and beyond ``after``; of two as near, the earlier."""
        low, high = max(after + 1, want - reach, 1), min(want + reach, len(text) - 1)
        found = (m.start() for m in self.rule.finditer(text, low, min(len(text), high + 2)))
        for p in sorted((p for p in found if low <= p <= high), key=lambda p: (abs(p - want), p)):
            if (not self._composes or _composed(text[max(0, p - 2) : p + 1])) and self._clear(text, p):
                return p
        return None

    def last(self, text: str) -> int | None:
        """The last sure place that stays one whatever text is appended: whatever may stand over it is there already."""
        end = len(text) - max(2, self._longest + 1)
        reach = 32  # the last place is most often near
        while self.rule is not None and end > 0:
            low, reach = max(0, end - reach), min(4096, 8 * reach)
            for p in sorted((m.start() for m in self.rule.finditer(text, low, min(len(text), end + 2)) if 0 < m.start() <= end), reverse=True):
                if (not self._composes or _composed(text[max(0, p - 2) : p + 1])) and self._clear(text, p):
                    return p
            end = low
        return None

    def points(self, text: str, n_parts: int) -> list[int]:
        if n_parts < 2 or self.rule is None:
            return []
        out: list[int] = []
        reach = max(1, min(4096, len(text) // (4 * n_parts)))
        for k in range(1, n_parts):
            hit = self.nearest(text, len(text) * k // n_parts, reach, out[-1] if out else 0)
            if hit is not None:
                out.append(hit)
        return out
