"""The four models: from one piece of text to ids.  Results are kept by piece, so a repeated piece costs one look."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import chain

from glyphmill.functions.characters import byte_alphabet
from glyphmill.sources.definition import BPE, SPM, UNIGRAM, Definition, UnsupportedError

#: Pieces that a worker keeps, the characters of all of them, and the longest it keeps.
KEPT_PIECES, KEPT_CHARACTERS, KEPT_LENGTH = 150_000, 3_000_000, 256

Model = Callable[[str], list[int]]


def merged(symbols: list, rank_of: Callable[[object, object], tuple[int, object] | None]) -> list:
    """Merge the adjacent pair of least rank, the leftmost of equal ones, until no pair merges.

    A heap of (rank, place): n symbols take n log n steps, however long the piece.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    live = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and (found := rank_of(symbols[i], symbols[j])) is not None:
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = right[i] if live[i] else -1
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], live[j] = made, False
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [s for s, ok in zip(symbols, live, strict=True) if ok]


#: Symbols up to which looking at every pair again is cheaper than a heap.
SHORT = 24


def merged_pairs(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``merged`` for ids with a table of pairs."""
    if len(symbols) > SHORT:
        joined = any(map(pairs.__contains__, zip(symbols, symbols[1:])))
        return merged(symbols, lambda a, b: pairs.get((a, b))) if joined else symbols
    found = list(map(pairs.get, zip(symbols, symbols[1:])))
    while any(found):
        best = None
        for i, f in enumerate(found):
            if f is not None and (best is None or f < best):
                best, at = f, i
        symbols[at : at + 2] = [best[1]]
        del found[at]
        if at < len(found):
            found[at] = pairs.get((symbols[at], symbols[at + 1]))
        if at:
            found[at - 1] = pairs.get((symbols[at - 1], symbols[at]))
    return symbols


def _pair_ranks(d: Definition) -> dict[tuple[int, int], tuple[int, int]]:
    """(rank, merged id) of each pair of ids; of a pair given twice the last rank holds."""
    return {(d.vocab[a], d.vocab[b]): (k, d.vocab[a + b]) for k, (a, b) in enumerate(d.merges)}


def byte_bpe(d: Definition) -> Model:
    """Pieces are in the byte alphabet."""
    if d.ranks:
        raw = {c: bytes([b]) for b, c in byte_alphabet().items()}
        ranks = d.ranks

        def by_rank(a: bytes, b: bytes) -> tuple[int, bytes] | None:
            whole = a + b
            return None if whole not in ranks else (ranks[whole], whole)

        def run_ranks(piece: str) -> list[int]:
            parts = [raw[c] for c in piece]
            whole = b"".join(parts)
            return [ranks[whole]] if whole in ranks else [ranks[s] for s in merged(parts, by_rank)]

        return run_ranks
    pairs, vocab, unk, fuse = _pair_ranks(d), d.vocab, d.unk_id, d.fuse_unk

    def run(piece: str) -> list[int]:
        if d.ignore_merges and piece in vocab:
            return [vocab[piece]]
        symbols: list[int] = []
        unknown = False
        for c in piece:
            at = vocab.get(c)
            if at is not None:
                symbols.append(at)
            elif unk is not None and not (unknown and fuse):
                symbols.append(unk)
            unknown = at is None
        return merged_pairs(symbols, pairs)

    return run


class _Characters(dict):
    """Ids of characters, made when first asked for and kept up to a number: those of the vocabulary, of all bytes where it
    has them, and -1 for others where they are unknown.  KeyError where an unknown character is none of these."""

    def __init__(self, d: Definition, fallback: dict[int, int | None]):
        super().__init__()
        self.vocab, self.fallback = d.vocab, fallback if None not in fallback.values() else {}
        self.unknown = (-1,) if not fallback and d.unk_id is not None and d.unk_token is not None else None

    def __missing__(self, c: str) -> tuple[int, ...]:
        if (at := self.vocab.get(c)) is not None:
            own = (at,)
        elif self.fallback:
            own = tuple([self.fallback[b] for b in c.encode("utf-8", "surrogateescape")])
        elif self.unknown:
            own = self.unknown
        else:
            raise KeyError(c)
        if len(self) < KEPT_PIECES:
            self[c] = own
        return own


def spm_bpe(d: Definition) -> Model:
    pairs, vocab = _pair_ranks(d), d.vocab
    fallback = {b: vocab.get(f"<0x{b:02X}>") for b in range(256)} if d.byte_fallback else {}
    known = _Characters(d, fallback).__getitem__

    def run(piece: str) -> list[int]:
        if d.ignore_merges and piece in vocab:
            return [vocab[piece]]
        try:
            symbols = list(chain.from_iterable(map(known, piece)))
        except KeyError:
            symbols = waited(piece)
        else:
            if -1 in symbols:
                kept = symbols if not d.fuse_unk else [b for a, b in zip([0, *symbols], symbols) if a != -1 or b != -1]
                symbols = [d.unk_id if s == -1 else s for s in kept]
        return merged_pairs(symbols, pairs)

    def waited(piece: str) -> list[int]:
        """Where some bytes are missing, or what is unknown vanishes."""
        symbols: list[int] = []
        pending = False
        for c in piece:
            if (at := vocab.get(c)) is not None:
                if pending:
                    symbols.append(d.unk_id)
                    pending = False
                symbols.append(at)
            elif fallback and None not in (own := [fallback[b] for b in c.encode("utf-8", "surrogateescape")]):
                symbols += own  # a waiting unknown stays behind these
            elif d.unk_token is not None:
                if d.unk_id is None:
                    raise UnsupportedError("unk_token is not in the vocabulary")
                if pending and not d.fuse_unk:
                    symbols.append(d.unk_id)
                pending = True
        if pending:
            symbols.append(d.unk_id)
        return symbols

    return run


def unigram(d: Definition) -> Model:
    """The best path through a lattice: strictly better sums win, so of equal ones the first seen does.

    The unknown piece itself, found in the text, counts as unknown too and joins its unknown neighbours.
    """
    scores = {piece: s for piece, s in d.scores}
    longest = max((len(p) for p in scores), default=0)
    unk_score = min((s for _, s in d.scores), default=0.0) - 10.0
    starts = {p[:k] for p in scores for k in range(1, len(p) + 1)}
    fallback = {b: d.vocab.get(f"<0x{b:02X}>") for b in range(256)} if d.byte_fallback else {}

    def path(piece: str) -> list[tuple[str, bool]]:
        n = len(piece)
        best: list[tuple[float, int, bool] | None] = [None] * (n + 1)
        best[0] = (0.0, 0, False)
        for s in range(n):
            base = best[s][0]
            alone = False
            for e in range(s + 1, min(n, s + longest) + 1):
                part = piece[s:e]
                if part not in starts:
                    break
                if part in scores:
                    alone = alone or e == s + 1
                    value = scores[part] + base
                    if best[e] is None or value > best[e][0]:
                        best[e] = (value, s, d.vocab[part] == d.unk_id)
            if not alone:
                value = unk_score + base
                if best[s + 1] is None or value > best[s + 1][0]:
                    best[s + 1] = (value, s, True)
        out: list[tuple[str, bool]] = []
        e = n
        while e:
            _, s, unknown = best[e]
            out.append((piece[s:e], unknown))
            e = s
        return out[::-1]

    def run(piece: str) -> list[int]:
        parts: list[tuple[str, bool]] = []
        for text, unknown in path(piece):
            if unknown and parts and parts[-1][1]:
                parts[-1] = (parts[-1][0] + text, True)
            else:
                parts.append((text, unknown))
        ids: list[int] = []
        for text, _ in parts:
            if text in d.vocab:
                ids.append(d.vocab[text])
            elif fallback and None not in (own := [fallback[b] for b in text.encode("utf-8", "surrogateescape")]):
                ids += own
            elif d.unk_id is None:
                raise UnsupportedError("unk_id is missing")
            else:
                ids.append(d.unk_id)
        return ids

    return run


def wordpiece(d: Definition) -> Model:
    """The longest match first; a piece with any part that is not found is unknown as a whole."""
    vocab, prefix = d.vocab, d.subword_prefix
    longest = max(map(len, vocab), default=0)

    def unknown() -> list[int]:
        if d.unk_id is None:
            raise UnsupportedError("unk_token is not in the vocabulary")
        return [d.unk_id]

    def run(piece: str) -> list[int]:
        if len(piece) > d.max_chars:
            return unknown()
        ids, start = [], 0
        while start < len(piece):
            for end in range(min(len(piece), start + longest), start, -1):
                key = (prefix if start else "") + piece[start:end]
                if key in vocab:
                    ids.append(vocab[key])
                    start = end
                    break
            else:
                return unknown()
        return ids

    return run


class Memo(dict):
    """Ids by piece: looked up in one step, made by the model when missing."""

    def __init__(self, run: Model):
        super().__init__()
        self.run, self.characters = run, 0

    def __missing__(self, piece: str) -> list[int]:
        ids = self.run(piece)
        if len(piece) <= KEPT_LENGTH:
            self[piece] = ids
            self.characters += len(piece)
        return ids

    def sizes(self) -> Memo:
        """The numbers of ids instead, for those who count: kept apart, without the ids."""
        run = self.run
        return Memo(lambda piece: len(run(piece)))

    def bounded(self) -> Memo:
        """Starts anew when it holds too much; results do not depend on it."""
        if len(self) > KEPT_PIECES or self.characters > KEPT_CHARACTERS:
            self.clear()
            self.characters = 0
        return self


def compiled(d: Definition) -> Memo:
    return Memo({BPE: byte_bpe, SPM: spm_bpe, UNIGRAM: unigram}.get(d.algorithm, wordpiece)(d))
