"""A compiled tokenizer: the exact engine that Spark workers run, one text at a time."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from typing import Any

from glyphmill.functions import normalize, pretok
from glyphmill.functions.automaton import Automaton
from glyphmill.functions.characters import WHITE_SPACE, byte_alphabet, is_word
from glyphmill.operators import bounds, cutting, decoding, models
from glyphmill.sources import definition, ranks
from glyphmill.sources.definition import BPE, UNIGRAM, AddedToken, ArgumentError, Definition, FormatError, IdError, LimitError, OpenError, UnsupportedError

ALL, NONSPECIAL, NONE = "all", "nonspecial", "none"
MODES = (ALL, NONSPECIAL, NONE)
#: Bytes of a text at most.
MAX_TEXT = 1 << 29
#: Added tokens up to which an alternation is tried at each place; its cost grows with their number.
FEW_TOKENS = 64


@dataclass
class Encoding:
    ids: list[int]
    type_ids: list[int]
    attention_mask: list[int]
    special_tokens_mask: list[int]
    strings: list[str] | None
    overflowing: tuple = ()

    @property
    def tokens(self) -> list[str]:
        """The written form of each id; an error where ids do not tell it, and never a guess."""
        if self.strings is None:
            raise UnsupportedError("tokens that their ids do not tell")
        return self.strings


class Tokenizer:
    def __init__(self, d: Definition):
        self.definition = d
        self.name, self.sha256 = d.name, d.sha256
        self.encode_special_tokens = False
        self._normalize = normalize.compiled(d.normalizers)
        self._split = pretok.compiled(self._alphabet_steps(d))
        self._model = models.compiled(d)
        self._whole, self._direct = self._direct_split(d)
        self._sizes = self._model.sizes() if self._whole is None else self._whole.sizes()
        self._joins = cutting.joins(d)
        self._cutter = cutting.Cutter(d, self._joins)
        self._by_content = {t.content: t for t in d.added}
        #: Ids whose string depends on the text: an unknown piece is written as its text, an id that a model string and
        #: another added token share as either of them, and a token that takes in white space with what it took.
        self._untold = {t.id for t in d.added if t.lstrip or t.rstrip}
        if d.algorithm == UNIGRAM and d.unk_id is not None:
            self._untold.add(d.unk_id)
        written = {i: s for s, i in d.vocab.items()}
        self._untold |= {t.id for t in d.added if written.get(t.id, t.content) != t.content}
        self._added_by_id = {t.id: t for t in reversed(d.added)}
        self._raw = self._pattern([t for t in d.added if not t.normalized], lambda t: t.content)
        self._normal = self._pattern([t for t in d.added if t.normalized], lambda t: self._normalize(t.content))
        if d.algorithm == BPE and any(t.normalized and self._normalize(t.content) != t.content for t in d.added):
            raise UnsupportedError("an added token that the normalizer changes")
        self._strings = self._token_strings(d)
        specials = {t.content for t in d.added if t.special}
        self._skipped = frozenset(i for i, s in self._strings.items() if s in specials)
        self._ids = self._string_ids(d)
        self._by_bytes: dict[bytes, int] | None = None
        self._last = max(self._strings, default=-1)
        self._byte_level = any(s["type"] == "ByteLevel" for s in self.decoders() or [])
        self._pieces_of_ids: dict[int, bytes] = {}
        self._texts = decoding.Texts(self.decoders(), self._strings)

    # ---- loading

    @classmethod
    def from_file(cls, path: str, *, pattern: str | None = None, specials: dict[str, int] | None = None, tier: Any = None, cache_mib: Any = None) -> Tokenizer:
        """A JSON definition or a rank file (which needs its split ``pattern``).  ``tier`` and ``cache_mib`` say nothing here."""
        if os.path.isdir(path):
            return cls(ranks.read_folder(path))
        try:
            with open(path, "rb") as f:
                raw = f.read()
        except OSError as e:
            raise OpenError(str(e)) from e
        if ranks.is_rank_file(raw):
            if pattern is None:
                raise ArgumentError("a rank file needs its split pattern")
            return cls(ranks.read(raw, pattern, specials, name=path))
        return cls(definition.read(raw, path))

    @classmethod
    def from_str(cls, source: str, **_: Any) -> Tokenizer:
        return cls.from_buffer(source.encode())

    @classmethod
    def from_buffer(cls, source: bytes, **_: Any) -> Tokenizer:
        if ranks.is_rank_file(source):
            raise FormatError("rank files are read from a path")
        return cls(definition.read(source))

    def __reduce__(self):
        return Tokenizer, (self.definition,)

    @staticmethod
    def _alphabet_steps(d: Definition) -> list[dict[str, Any]]:
        """Byte-level models take pieces of the byte alphabet: without a ByteLevel step one is added that does not split."""
        if d.algorithm == BPE and not any(s["type"] == "ByteLevel" for s in d.pre_tokenizers):
            return [*d.pre_tokenizers, {"type": "ByteLevel", "use_regex": False}]
        return d.pre_tokenizers

    def _direct_split(self, d: Definition) -> tuple[models.Memo | None, Any]:
        """Where one covering pattern makes all pieces, ids are kept by the plain piece: the byte alphabet is then only
        written out for pieces that are new."""
        steps = [s for s in d.pre_tokenizers if not (s["type"] == "ByteLevel" and not s.get("use_regex", True))]
        if d.algorithm != BPE or len(steps) != 1:
            return None, None
        pattern = pretok.GPT2 if steps[0]["type"] == "ByteLevel" else next(iter(steps[0].get("pattern", {"": None}).items()))[1]
        covers = pattern in {**pretok.COVERING, **pretok.COVERING_TOO}.values() and steps[0].get("behavior", "Isolated") in ("Isolated", "Removed") and bool(steps[0].get("invert")) == (steps[0].get("behavior") == "Removed")
        if not covers:
            return None, None
        alphabet = byte_alphabet()
        return models.Memo(lambda p: self._model.run("".join(alphabet[b] for b in p.encode("utf-8", "surrogateescape")))), pretok.compiled_pattern(pattern).findall

    @staticmethod
    def _pattern(tokens: list[AddedToken], form) -> tuple[Callable[[str], Iterable[tuple[int, int]]], dict[str, AddedToken]] | None:
        """Spans of the leftmost-longest matches: by an alternation for some strings, by an automaton for many."""
        by = {form(t): t for t in tokens if form(t)}
        if not by:
            return None
        if len(by) > FEW_TOKENS:
            return Automaton(by).spans, by
        found = re.compile("|".join(re.escape(c) for c in sorted(by, key=lambda c: (-len(c), c))))
        return lambda text: (m.span() for m in found.finditer(text)), by

    def _token_strings(self, d: Definition) -> dict[int, str]:
        out = {i: s for s, i in d.vocab.items()}
        if d.ranks:
            alphabet = byte_alphabet()
            out = {i: "".join(alphabet[b] for b in t) for t, i in d.ranks.items()}
        for t in d.added:
            form = self._normalize(t.content) if t.normalized and d.normalizers else t.content
            out[t.id] = form
        return out

    def _string_ids(self, d: Definition) -> dict[str, int]:
        out = dict(d.vocab) if not d.ranks else {self._strings[i]: i for i in d.ranks.values()}
        return out | {t.content: t.id for t in d.added}

    # ---- encoding

    def segments(self, text: str, mode: str = ALL) -> list[tuple[str, int | None, bool]]:
        """(text, id of an added token or None, whether it starts the input), gaps normalized and cut again."""
        if mode not in MODES:
            raise ArgumentError(f"mode {mode!r}")
        out: list[tuple[str, int | None, bool]] = []
        for part, token, at in self._scan(text, self._raw, mode):
            if token is not None:
                out.append((part, token.id, at == 0))
                continue
            for inner, own, place in self._scan(self._normalize(part), self._normal, mode):
                out.append((inner, None if own is None else own.id, at == 0 and place == 0))
        return out

    @staticmethod
    def _scan(text: str, known: tuple[Callable[[str], Iterable[tuple[int, int]]], dict[str, AddedToken]] | None, mode: str) -> list[tuple[str, AddedToken | None, int]]:
        """Leftmost-longest matches that do not overlap.  A match that is dropped (special in NONSPECIAL, single_word inside
        a word) still moves the search on; rstrip moves the token's end, but not the place where the search goes on."""
        if known is None or mode == NONE:
            return [(text, None, 0)] if text else []
        out: list[tuple[str, AddedToken | None, int]] = []
        done = 0
        for start, end in known[0](text):
            token = known[1][text[start:end]]
            if mode == NONSPECIAL and token.special:
                continue
            if token.single_word and ((start and is_word(text[start - 1])) or (end < len(text) and is_word(text[end]))):
                continue
            if token.lstrip:
                while start > done and text[start - 1] in WHITE_SPACE:
                    start -= 1
            if token.rstrip:
                while end < len(text) and text[end] in WHITE_SPACE:
                    end += 1
            start = max(start, done)
            if start >= end:
                continue
            if start > done:
                out.append((text[done:start], None, done))
            out.append((text[start:end], token, start))
            done = end
        if done < len(text):
            out.append((text[done:], None, done))
        return out

    @staticmethod
    def _text(text: str | bytes) -> str:
        if isinstance(text, bytes):
            text = text.decode("utf-8", "surrogateescape")
        if len(text) > MAX_TEXT // 4 and len(text.encode("utf-8", "surrogateescape")) > MAX_TEXT:
            raise LimitError("the text is too long")
        return text

    def _model_ids(self, text: str, mode: str, continuation: bool, limit: int | None = None) -> list[int]:
        ids: list[int] = []
        split_any = bool(self.definition.pre_tokenizers) or self.definition.algorithm == BPE
        known, plain = self._model.bounded(), self._whole.bounded() if self._whole is not None else None
        for part, token, first in self.segments(text, mode):
            if token is not None:
                ids.append(token)
            elif plain is not None:
                ids += chain.from_iterable(map(plain.__getitem__, self._direct(part)))
            else:
                pieces = self._split(part, first and not continuation) if split_any else [part]
                if limit is None:
                    ids += chain.from_iterable(map(known.__getitem__, self._short(pieces)))
                    continue
                for piece in pieces:
                    # a short piece costs the model less than to be cut
                    for word in [piece] if len(piece) <= models.KEPT_LENGTH else self._words(piece):
                        ids += known[word]
                        if limit is not None and len(ids) >= limit:
                            return ids
        return ids

    def _short(self, pieces: list[str]) -> Iterable[str]:
        """The pieces, long ones in parts that the model may take one by one."""
        if max(map(len, pieces), default=0) <= models.KEPT_LENGTH:
            return pieces
        return chain.from_iterable([p] if len(p) <= models.KEPT_LENGTH else self._words(p) for p in pieces)

    def _words(self, piece: str) -> list[str]:
        """A piece in parts that the model may take one by one."""
        return [piece] if self._joins is None else self._joins.words(piece)

    def model_words(self, text: str | bytes, mode: str = ALL, continuation: bool = False) -> list[tuple[str, int | None]]:
        """What the model would see, word by word, and added tokens with their ids: a text's ids are those of its words."""
        out: list[tuple[str, int | None]] = []
        alphabet = byte_alphabet() if self._whole is not None else {}
        split_any = bool(self.definition.pre_tokenizers) or self.definition.algorithm == BPE
        for part, token, first in self.segments(self._text(text), mode):
            if token is not None:
                out.append((part, token))
            elif self._whole is not None:
                found = self._direct(part)
                written = {p: ("".join(alphabet[b] for b in p.encode("utf-8", "surrogateescape")), None) for p in set(found)}
                out += map(written.__getitem__, found)
            else:
                out += [(w, None) for p in (self._split(part, first and not continuation) if split_any else [part]) for w in self._words(p)]
        return out

    def word_ids(self, word: str) -> list[int]:
        """The model's ids of one word of ``model_words``."""
        return self._model.bounded()[word]

    def encode(self, text: str | bytes, *, add_special_tokens: bool = True, added_tokens: str | None = None, continuation: bool = False, truncate: bool = True, pad: bool = True) -> list[int]:
        """Ids of a text.  ``added_tokens`` is all, nonspecial or none; a continuation is neither cut nor padded."""
        d, mode = self.definition, added_tokens or (NONSPECIAL if self.encode_special_tokens else ALL)
        template = len(d.prefix) + len(d.suffix) if add_special_tokens else 0
        limit = max(0, d.truncation["max_length"] - template) if d.truncation and truncate and not continuation else None
        ids = self._model_ids(self._text(text), mode, continuation, limit)
        if limit is not None:
            ids = ids[:limit]
        if add_special_tokens:
            ids = [*d.prefix, *ids, *d.suffix]
        return self._padded(ids, d.padding["id"]) if d.padding and pad and not continuation else ids

    def token_count(self, text: str | bytes, *, add_special_tokens: bool = True, added_tokens: str | None = None) -> int:
        """How many ids ``encode`` gives: of each piece their number alone is kept, and no ids are made into a list."""
        d, mode = self.definition, added_tokens or (NONSPECIAL if self.encode_special_tokens else ALL)
        if d.truncation or d.padding:
            return len(self.encode(text, add_special_tokens=add_special_tokens, added_tokens=mode))
        split_any = bool(d.pre_tokenizers) or d.algorithm == BPE
        sizes, n = self._sizes.bounded(), len(d.prefix) + len(d.suffix) if add_special_tokens else 0
        for part, token, first in self.segments(self._text(text), mode):
            if token is not None:
                n += 1
            elif self._whole is not None:
                n += sum(map(sizes.__getitem__, self._direct(part)))
            else:
                n += sum(map(sizes.__getitem__, self._short(self._split(part, first) if split_any else [part])))
        return n

    def _padded(self, values: list, filler: Any, longest: int = 0) -> list:
        p = self.definition.padding
        target = max(len(values), p["length"] or 0, longest)
        if p["multiple"]:
            target = -(-target // p["multiple"]) * p["multiple"]
        more = [filler] * (target - len(values))
        return more + values if p["left"] else values + more

    def encode_ordinary(self, text: str | bytes) -> list[int]:
        return self.encode(text, add_special_tokens=False, added_tokens=NONE, truncate=False, pad=False)

    def encode_allowed(self, text: str, allowed_special: set[str] | str = frozenset(), disallowed_special: set[str] | str = "all") -> list[int]:
        """Only the allowed special tokens are matched; a text with a disallowed one raises ValueError."""
        specials = self.special_tokens_set
        allowed = specials if allowed_special == "all" else set(allowed_special)
        refused = specials - allowed if disallowed_special == "all" else set(disallowed_special)
        if hit := next((s for s in sorted(refused) if s in text), None):
            raise ValueError(f"disallowed special token {hit!r}")
        if not allowed:
            return self.encode_ordinary(text)
        found = re.compile("|".join(re.escape(s) for s in sorted(allowed, key=lambda s: (-len(s), s))))
        ids, at = [], 0
        for m in found.finditer(text):
            ids += [*self.encode_ordinary(text[at : m.start()]), self._by_content[m[0]].id]
            at = m.end()
        return ids + self.encode_ordinary(text[at:])

    def encode_ex(self, text: str | bytes, *, add_special_tokens: bool = True, longest: int = 0) -> Encoding:
        d = self.definition
        inner = self.encode(text, add_special_tokens=add_special_tokens, pad=False)
        before, after = (len(d.prefix), len(d.suffix)) if add_special_tokens else (0, 0)
        middle = len(inner) - before - after
        special = [1] * before + [0] * middle + [1] * after
        types = [*(d.prefix_types if before else []), *[d.sequence_type] * middle, *(d.suffix_types if after else [])]
        mask, tokens = [1] * len(inner), [self._strings.get(i, "") for i in inner]
        for k in (*range(before), *range(len(inner) - after, len(inner))):  # the template writes contents as they are
            if inner[k] in self._added_by_id:
                tokens[k] = self._added_by_id[inner[k]].content
        untold = not self._untold.isdisjoint(inner[before : len(inner) - after])
        if d.padding:
            p = d.padding
            inner, types, tokens, mask, special = (self._padded(v, f, longest) for v, f in ((inner, p["id"]), (types, p["type_id"]), (tokens, p["token"]), (mask, 0), (special, 1)))
        return Encoding(inner, types, mask, special, None if untold else tokens)

    def encode_batch(self, texts: list[str], **kw: Any) -> list[list[int]]:
        """Each text by itself; with padding to the longest, all to the longest of the batch."""
        made = [self.encode(t, **kw) for t in texts]
        p = self.definition.padding
        if p and p["length"] is None and kw.get("pad", True) and made:
            made = [self._padded(x, p["id"], max(map(len, made))) for x in made]
        return made

    def pieces(self, text: str | bytes, mode: str = ALL) -> list[str]:
        """The pieces that the model sees, in the normalized text; an added token is one piece."""
        alphabet = {c: b for b, c in byte_alphabet().items()}
        out = []
        for part, token, first in self.segments(self._text(text), mode):
            if token is not None:
                out.append(part)
            else:
                own = self._split(part, first) if self.definition.pre_tokenizers or self.definition.algorithm == BPE else [part]
                out += [bytes(alphabet[c] for c in p).decode("utf-8", "surrogateescape") for p in own] if self.definition.algorithm == BPE else own
        return out

    def piece_ends(self, text: str | bytes, mode: str = ALL) -> list[int]:
        ends, at = [], 0
        for p in self.pieces(text, mode):
            at += len(p.encode("utf-8", "surrogateescape"))
            ends.append(at)
        return ends

    def template(self) -> tuple[list[int], list[int], int]:
        """Ids and type ids of the post-processor's own tokens, and how many stand before the text."""
        d = self.definition
        return [*d.prefix, *d.suffix], [*d.prefix_types, *d.suffix_types], len(d.prefix)

    def encode_bound(self, n_bytes: int) -> int:
        """No text of so many bytes has more ids: ``operators.bounds`` says why."""
        bound = self.bound.of(n_bytes)
        return len(self._padded([0] * bound, 0)) if self.definition.padding else bound

    @cached_property
    def bound(self) -> bounds.Bound:
        return bounds.Bound(self.definition)

    # ---- decoding

    def _known(self, ids: list[int]) -> None:
        if ids and not (0 <= min(ids) and max(ids) <= self._last):
            raise IdError(f"id {next(i for i in ids if not 0 <= i <= self._last)}")

    def tokens_of(self, ids: list[int], skip_special_tokens: bool = False) -> list[str]:
        self._known(ids)
        return [self._strings[i] for i in ids if i in self._strings and not (skip_special_tokens and i in self._skipped)]

    def decoders(self) -> list[dict[str, Any]] | None:
        d = self.definition
        return [{"type": "ByteLevel"}] if d.ranks or (d.algorithm == BPE and not d.decoders) else d.decoders

    def decode(self, ids: list[int], skip_special_tokens: bool = True) -> str:
        if self._byte_level:
            self._known(ids)
            return b"".join(map(self._bytes_of_id, (i for i in ids if i not in self._skipped) if skip_special_tokens else ids)).decode("utf-8", "replace")
        self._known(ids)
        return self._texts.of(ids, self._skipped if skip_special_tokens else frozenset())

    def _bytes_of_id(self, i: int) -> bytes:
        """What an id of a byte-level vocabulary adds to a text; a hole adds nothing."""
        if (found := self._pieces_of_ids.get(i)) is None:
            found = self._pieces_of_ids[i] = decoding.raw_bytes(self._strings[i]) if i in self._strings else b""
        return found

    def decode_batch(self, batch: list[list[int]], skip_special_tokens: bool = True) -> list[str]:
        return [self.decode(ids, skip_special_tokens) for ids in batch]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return decoding.bytes_of(self.tokens_of(ids), self.decoders())

    def decode_bytes_batch(self, batch: list[list[int]]) -> list[bytes]:
        return [self.decode_bytes(ids) for ids in batch]

    def decode_stream(self, skip_special_tokens: bool = False, hold: int | None = None) -> DecodeStream:
        return DecodeStream(self, skip_special_tokens, hold)

    def encode_stream(self, mode: str = ALL, add_special_tokens: bool = True) -> EncodeStream:
        return EncodeStream(self, mode, add_special_tokens)

    # ---- vocabulary

    def token_bytes(self, i: int) -> bytes | None:
        """The bytes that an id stands for, or None for a hole."""
        if i not in self._strings:
            return None
        token = self._strings[i]
        if i in {t.id for t in self.definition.added}:
            return token.encode()
        if self.definition.algorithm == BPE:
            return decoding.raw_bytes(token)
        b = decoding.byte_of(token) if self.definition.byte_fallback else None
        return token.encode() if b is None else bytes([b])

    def id_to_token(self, i: int) -> str | None:
        return self._strings.get(i)

    def token_to_id(self, token: str | bytes) -> int | None:
        """A str is the written form.  Bytes are the decoded form: an added content first, then the latest id with these bytes."""
        if isinstance(token, str):
            return self._ids.get(token)
        if not token:
            return None
        if self._by_bytes is None:  # made on the first call
            decoded = {self.token_bytes(i): i for i in sorted(self._strings)}
            written = {s.encode(): i for i, s in reversed(self._strings.items())}
            self._by_bytes = decoded | written | {t.content.encode(): t.id for t in reversed(self.definition.added)}
        return self._by_bytes.get(token)

    def id_flags(self, i: int) -> int:
        """Bits: 1 added, 2 special, 4 a byte token."""
        t = self._added_by_id.get(i)
        byte = t is None and i in self._strings and (decoding.byte_of(self._strings[i]) is not None if self.definition.byte_fallback else self.definition.algorithm == BPE and len(decoding.raw_bytes(self._strings[i])) == 1)
        return (1 if t else 0) | (2 if t and t.special else 0) | (4 if byte else 0)

    def token_byte_values(self) -> list[bytes]:
        added = {t.id for t in self.definition.added}
        return sorted(self.token_bytes(i) for i in self._strings if i not in added)

    def added_tokens(self) -> list[AddedToken]:
        return sorted(self.definition.added, key=lambda t: t.id)

    def get_added_tokens_decoder(self) -> dict[int, AddedToken]:
        return {t.id: t for t in self.added_tokens()}

    def get_vocab(self, with_added: bool = True) -> dict[str, int]:
        base = {self._strings[i]: i for i in self.definition.ranks.values()} if self.definition.ranks else dict(self.definition.vocab)
        return base | ({t.content: t.id for t in self.definition.added} if with_added else {})

    def get_vocab_size(self, with_added: bool = True) -> int:
        return len(self.get_vocab(with_added))

    def num_special_tokens_to_add(self, is_pair: bool = False) -> int:
        if is_pair:
            raise UnsupportedError("pairs")
        return len(self.definition.prefix) + len(self.definition.suffix)

    @cached_property
    def longest_text(self) -> int:
        """The most bytes that one id adds to a text: its string with a space before, and after all replacements; a byte
        that is no text becomes three."""
        most = 3
        for token in self._strings.values():
            for s in self.decoders() or []:
                if s["type"] == "Replace":
                    pattern = next(iter(s["pattern"].values()))
                    if len(s["content"].encode()) > len(pattern.encode()):
                        token = token.replace(pattern, s["content"])
            most = max(most, 1 + (len(token.encode("utf-8", "surrogateescape")) if not self._byte_level else 3 * len(decoding.raw_bytes(token))))
        return most

    @property
    def n_vocab(self) -> int:
        return self.max_token_value + 1

    @property
    def max_token_value(self) -> int:
        return self._last

    @property
    def eot_token(self) -> int:
        """The id of the special token <|endoftext|>; KeyError where there is none."""
        return {t.content: t.id for t in self.definition.added if t.special}["<|endoftext|>"]

    @property
    def special_tokens_set(self) -> set[str]:
        return {t.content for t in self.definition.added if t.special}

    def info(self) -> dict[str, Any]:
        d = self.definition
        return {
            "algorithm": d.algorithm, "n_ids": self.n_vocab, "n_added": len(d.added), "sha256": d.sha256, "name": d.name,
            "max_length": d.truncation["max_length"] if d.truncation else None, "pad_id": d.padding["id"] if d.padding else None,
            "pad_length": d.padding["length"] if d.padding else None, "pad_multiple": d.padding["multiple"] if d.padding else None, "pad_left": d.padding["left"] if d.padding else None,
            "n_prefix": len(d.prefix), "n_suffix": len(d.suffix), "control_isolation": self.control_isolation(),
        }

    def control_isolation(self) -> bool:
        """Whether it is proved that no text gives an added token's id when added tokens are not matched."""
        return bounds.isolated(self.definition)

    def to_summary(self) -> str:
        return json.dumps(self.info(), sort_keys=True)

    # ---- cutting

    def split_points(self, text: str, n_parts: int) -> list[int]:
        """Places (in characters) where a text may be cut, near equal parts: the ids of the parts, each after the first
        encoded as a continuation, are those of the whole.  What places are sure says ``operators.cutting``."""
        return self._cutter.points(text, n_parts)

    def encode_parts(self, text: str, n_parts: int) -> list[int]:
        """The same ids as ``encode``, from parts that can be encoded apart."""
        cuts = [0, *self.split_points(text, n_parts), len(text)]
        d = self.definition
        inner = [i for a, b in zip(cuts, cuts[1:], strict=False) for i in self.encode(text[a:b], add_special_tokens=False, continuation=a > 0, truncate=False, pad=False)]
        return [*d.prefix, *inner, *d.suffix] if len(cuts) > 2 else self.encode(text)


class DecodeStream:
    """Incremental decoding: all pushes and the flush together are what ``decode`` gives.

    ``hold`` is the most bytes of an undecided run of byte tokens; a push that would need more raises LimitError and
    changes nothing, so the same ids may be pushed again after ``hold`` was raised.  None holds any run.
    """

    def __init__(self, tokenizer: Tokenizer, skip_special_tokens: bool, hold: int | None = None):
        self.tokenizer, self.skip, self.hold = tokenizer, skip_special_tokens, hold
        self.decoder = decoding.Decoder(tokenizer.decoders())

    def bound(self, n: int) -> int:
        """No push of ``n`` ids gives more bytes of text now, and no flush more than a push of none."""
        return n * self.tokenizer.longest_text + 3 * len(self.decoder.held)

    def push(self, ids: int | list[int]) -> str:
        tokens = self.tokenizer.tokens_of([ids] if isinstance(ids, int) else ids, self.skip)  # a bad id leaves the state as it was
        return self.decoder.push_all(tokens, self.hold)

    def flush(self) -> str:
        return self.decoder.flush()


class EncodeStream:
    """Incremental encoding: all pushes and the flush together are the ids of the whole text.

    A push gives the ids up to the last sure place that no later text can change, and keeps the text behind it (and as much
    as the longest added token has).  State is the kept text and whether ids were given.  Definitions without sure places
    keep everything.
    """

    def __init__(self, tokenizer: Tokenizer, mode: str = ALL, add_special_tokens: bool = True):
        self.tokenizer, self.mode, self.special = tokenizer, mode, add_special_tokens
        self.restore("", False)

    def restore(self, kept: str, started: bool) -> EncodeStream:
        self.kept, self.started = kept, started
        return self

    def state(self) -> tuple[str, bool]:
        return self.kept, self.started

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False, added_tokens=self.mode, continuation=self.started, truncate=not self.started, pad=False)

    def push(self, text: str) -> list[int]:
        self.kept += text
        at = self.tokenizer._cutter.last(self.kept)
        if at is None:
            return []
        before = self.tokenizer.definition.prefix if self.special and not self.started else []
        ids = [*before, *self._ids(self.kept[:at])]
        self.kept, self.started = self.kept[at:], True
        return ids

    def flush(self) -> list[int]:
        d = self.tokenizer.definition
        if not self.started:
            ids = self.tokenizer.encode(self.kept, add_special_tokens=self.special, added_tokens=self.mode)
        else:
            ids = [*self._ids(self.kept), *(d.suffix if self.special else [])]
        self.restore("", False)
        return ids
