"""Token ids of whole texts by the ``tokenizers`` library, with one library call for each new word.

The library is asked once for each distinct word of a worker.  A text is cut at space, tab, LF and CR only, and only
when the tokenizer's own file shows that no step of it looks across white space (``cuts_at_white_space``); otherwise
each text goes to the library whole.  ``tests/llm`` compares both ways.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Words that a worker keeps in a task, and between tasks (the first ones, which are the most frequent), so that memory is
#: bounded; results do not depend on it.
TABLE_WORDS, KEPT_WORDS = 500_000, 250_000

#: Words of letters that are encoded together.
ROW_WORDS = 256

#: Texts of these characters alone are in NFC already and have the same lower case in Python and in the library.
_PLAIN = re.compile("[^\x00-įı-ɏ]")
#: Marks that follow words and are no part of a contraction.
_TAIL = ".,!?;:*$%&#|)"
#: The split pattern and normalizer steps for which a cut at white space changes nothing.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def cuts_at_white_space(definition: dict) -> bool:
    """Whether ids of a text are those of its white-space separated parts, one after the other."""
    steps = (definition.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = bool(steps) and steps[0].get("pattern") == {"Regex": _SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in definition["added_tokens"])
    return bool(split and byte_level and added and (definition.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and not definition.get("truncation"))


class Codes(dict):
    """Numbers of words in the order in which they come; ``new`` lists those that have no ids yet."""

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class Encoder:
    """Encodes lists of texts to one flat array of ids and each text's number of ids."""

    def __init__(self, path: str, table_words: int = TABLE_WORDS):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = cuts_at_white_space(definition := json.load(f))
        suffix = definition["model"].get("end_of_word_suffix")
        self.by_word = self.by_word and bool(suffix)
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.table_words = table_words
        self._clear()

    def _clear(self) -> None:
        self.code = Codes([""])
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.first = np.zeros(1 << 14, dtype=np.int64)
        self.count = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def shrink(self, words: int = KEPT_WORDS) -> None:
        """Keeps the first ``words`` words of the table."""
        if len(self.code) <= words:
            return
        self.code = Codes(list(islice(self.code, words)))
        self.ids, ends = self._gather(np.arange(words))
        self.count = self.count[:words].copy()
        self.first = ends - self.count
        self.used = len(self.ids)

    def _library_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype=np.int32), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _letters_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone: each is one piece, whose last id alone has the end-of-word suffix, so many share a call."""
        rows = [" ".join(words[i : i + ROW_WORDS]) for i in range(0, len(words), ROW_WORDS)]
        ids, _ = self._library_ids(rows)
        last = np.flatnonzero(self.ends_word[ids])
        if len(last) != len(words):
            raise ValueError("the vocabulary has no end-of-word suffix on every piece")
        return ids, np.diff(last, prepend=-1)

    def _put(self, codes: list[int], flat: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of words by code."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(1 << 16, len(self.ids)), dtype=np.int32)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[codes] = self.used + np.cumsum(sizes) - sizes
        self.count[codes] = sizes
        self.used += len(flat)

    def _add(self, plain: bool) -> None:
        """Ids of new words: letters alone, letters with a tail of marks (the ids of both, one after the other), or any other.

        ``plain``: all of them are known to hold plain characters alone.
        """
        code, new = self.code, self.code.new
        letters, letters_at, other, other_at, joint, joint_at = [], [], [], [], [], []
        for at, word in enumerate(new, len(code) - len(new)):  # letters and tails that are new themselves join the list
            core = word.rstrip(_TAIL)
            if not core.isalpha() or not (plain or core.isascii() or not _PLAIN.search(core)):
                other.append(word)
                other_at.append(at)
            elif len(core) == len(word):
                letters.append(word)
                letters_at.append(at)
            else:
                joint.append((code[core], code[word[len(core) :]]))
                joint_at.append(at)
        code.new = []
        if (more := len(code) - len(self.first)) > 0:
            more = np.zeros(max(more, len(self.first)), dtype=np.int64)
            self.first, self.count = np.concatenate((self.first, more)), np.concatenate((self.count, more))
        if letters:
            self._put(letters_at, *self._letters_ids(letters))
        if other:
            self._put(other_at, *self._library_ids(other))
        if joint:
            parts = np.array(joint, dtype=np.int64)
            self._put(joint_at, self._gather(parts.ravel())[0], self.count[parts].sum(axis=1))

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by code, and how many ids there are up to the end of each."""
        counts = self.count[codes]
        ends = np.cumsum(counts)
        at = np.repeat(self.first[codes] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[at], ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return self._library_ids(texts)
        words: list[str] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        plain = True
        for i, text in enumerate(texts):
            if text.isascii() or not _PLAIN.search(text):
                text = text.lower()
            else:
                plain = False
            own = re.split("[ \t\n\r]", text) if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")
            words += own
            sizes[i] = len(own)
        if len(self.code) > self.table_words:
            self.shrink(min(KEPT_WORDS, self.table_words // 2))
        try:
            codes = np.fromiter(map(self.code.__getitem__, words), dtype=np.int64, count=len(words))
            if self.code.new:
                self._add(plain)
        except BaseException:
            self._clear()  # else words would stay without ids
            raise
        found, ends = self._gather(codes)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        upto = np.concatenate(([0], ends))
        return found, upto[bounds[1:]] - upto[bounds[:-1]]

    def encode_ended(self, texts: list[str], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The same, with ``end_id`` after each text: all ids, and n+1 offsets."""
        ids, counts = self.encode(texts)
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(counts + 1, out=offsets[1:])
        out = np.full(int(offsets[-1]), end_id, dtype=np.uint32)
        keep = np.ones(len(out), dtype=bool)
        keep[offsets[1:] - 1] = False
        out[keep] = ids
        return out, offsets


@lru_cache(maxsize=2)
def _kept(path: str) -> Encoder:
    return Encoder(path)


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """The worker's encoder for a task; its table shrinks when the task ends, so that an idle worker holds little."""
    found = _kept(path)
    try:
        yield found
    finally:
        found.shrink()
