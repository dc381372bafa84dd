"""Tokenizer definitions: strict reading of a JSON file, refusing by name what is not reproduced exactly."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

BPE, SPM, UNIGRAM, WORDPIECE = "byte_bpe", "spm_bpe", "unigram", "wordpiece"

#: Limits of a definition: bytes of the source, of a token and of an added token; ids; added tokens; template parts.
MAX_SOURCE, MAX_TOKEN, MAX_ADDED, MAX_ID, MAX_ADDED_COUNT, MAX_TEMPLATE = 256 << 20, 65_535, 255, (1 << 21) - 1, 65_535, 64


class TokenizerError(ValueError):
    """An error with the stable code and name of its kind."""

    code, name = 0, ""

    def __init__(self, message: str):
        super().__init__(f"{self.name}: {message}")


class OpenError(TokenizerError):
    code, name = -1, "open"


class FormatError(TokenizerError):
    code, name = -2, "format"


class UnsupportedError(TokenizerError):
    code, name = -3, "unsupported"


class IdError(TokenizerError, KeyError):
    code, name = -7, "id"


class LimitError(TokenizerError):
    code, name = -9, "limit"


class ArgumentError(TokenizerError):
    code, name = -10, "arg"


@dataclass(frozen=True)
class AddedToken:
    content: str
    id: int
    special: bool = False
    normalized: bool = True
    lstrip: bool = False
    rstrip: bool = False
    single_word: bool = False

    @property
    def flags(self) -> int:
        """Bits: 1 added, 2 special, 8 lstrip, 16 rstrip, 32 single_word, 64 normalized."""
        return 1 | 2 * self.special | 8 * self.lstrip | 16 * self.rstrip | 32 * self.single_word | 64 * self.normalized


@dataclass
class Definition:
    """What a file says, checked: the logical plan of a tokenizer."""

    algorithm: str
    vocab: dict[str, int]
    merges: list[tuple[str, str]] = field(default_factory=list)
    scores: list[tuple[str, float]] = field(default_factory=list)
    ranks: dict[bytes, int] = field(default_factory=dict)  # of a rank file: bytes to id, the id being the rank
    added: list[AddedToken] = field(default_factory=list)
    normalizers: list[dict[str, Any]] = field(default_factory=list)
    pre_tokenizers: list[dict[str, Any]] = field(default_factory=list)
    decoders: list[dict[str, Any]] | None = None
    prefix: list[int] = field(default_factory=list)
    suffix: list[int] = field(default_factory=list)
    prefix_types: list[int] = field(default_factory=list)
    suffix_types: list[int] = field(default_factory=list)
    sequence_type: int = 0
    truncation: dict[str, Any] | None = None
    padding: dict[str, Any] | None = None
    unk_token: str | None = None
    unk_id: int | None = None
    fuse_unk: bool = False
    byte_fallback: bool = False
    ignore_merges: bool = False
    subword_prefix: str = "##"
    max_chars: int = 100
    sha256: str = ""
    name: str = ""


class _Number(float):
    """A JSON number that keeps how it was written."""

    lexeme: str

    def __new__(cls, lexeme: str) -> _Number:
        out = super().__new__(cls, lexeme)
        out.lexeme = lexeme
        return out


def score(lexeme: str) -> float:
    """A score as the reading library takes it: the digits as an integer (64 bits), then one product or quotient by a
    power of ten; not correctly rounded on purpose, since ties are decided by the last bit."""
    sign = -1.0 if lexeme.startswith("-") else 1.0
    body, _, power = lexeme.lstrip("-").lower().partition("e")
    whole, _, part = body.partition(".")
    exponent, digits = int(power or 0), 0
    for k, ch in enumerate(whole + part):
        if digits > (2**64 - 1 - int(ch)) // 10:
            # no room: the other digits only count as places
            exponent += max(0, len(whole) - k)
            break
        digits = digits * 10 + int(ch)
        exponent -= k >= len(whole)
    value = float(digits)
    while True:
        if abs(exponent) <= 308:
            value = value / 10.0**-exponent if exponent < 0 else value * 10.0**exponent
            break
        if value == 0.0:
            break
        if exponent > 0:
            raise FormatError(f"number out of range: {lexeme}")
        value /= 1e308
        exponent += 308
    return sign * value


def _pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in items:
        if k in out:
            out.setdefault("\0twice", set()).add(k)
        out[k] = v
    return out


def _once(found: dict[str, Any], where: str, known: tuple[str, ...]) -> None:
    if twice := found.get("\0twice", set()) & set(known):
        raise FormatError(f"{where}: field given twice: {', '.join(sorted(twice))}")


def _need(found: Any, where: str, key: str, kind: type | tuple[type, ...]) -> Any:
    if not isinstance(found, dict) or key not in found:
        raise FormatError(f"{where}: {key} is missing")
    if not isinstance(found[key], kind) or (kind is int and isinstance(found[key], bool)):
        raise FormatError(f"{where}: {key} has a wrong type")
    return found[key]


TOP = ("version", "truncation", "padding", "added_tokens", "normalizer", "pre_tokenizer", "post_processor", "decoder", "model")


def read(source: str | bytes, name: str = "") -> Definition:
    """A definition from the JSON text of a tokenizer file."""
    raw = source.encode() if isinstance(source, str) else source
    if len(raw) > MAX_SOURCE:
        raise LimitError("the file is too large")
    try:
        tree = json.loads(raw.decode("utf-8"), object_pairs_hook=_pairs, parse_float=_Number, parse_constant=_refused_constant)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise FormatError(str(e)) from e
    if not isinstance(tree, dict):
        raise FormatError("not an object")
    if "config" in tree and "vocab" in tree and "model" not in tree:
        raise UnsupportedError("tekken files")
    if unknown := set(tree) - set(TOP) - {"\0twice"}:
        raise FormatError(f"unknown field: {sorted(unknown)[0]}")
    _once(tree, "file", TOP)
    if tree.get("version") != "1.0":
        raise FormatError("version is not 1.0")
    model = _need(tree, "file", "model", dict)
    algorithm = _algorithm(tree, model)
    out = Definition(algorithm, {}, sha256=hashlib.sha256(raw).hexdigest(), name=name)
    {BPE: _bpe, SPM: _bpe, UNIGRAM: _unigram, WORDPIECE: _wordpiece}[algorithm](out, model)
    out.added = _added(tree.get("added_tokens") or [], out.vocab)
    out.normalizers = _steps(tree.get("normalizer"), "normalizers", "normalizer")
    out.pre_tokenizers = _steps(tree.get("pre_tokenizer"), "pretokenizers", "pre_tokenizer")
    out.decoders = _steps(tree["decoder"], "decoders", "decoder") if tree.get("decoder") else None
    _check_steps(out)
    _post(out, tree.get("post_processor"))
    _truncation(out, tree.get("truncation"))
    _padding(out, tree.get("padding"))
    return out


def _refused_constant(x: str) -> None:
    raise FormatError(f"not a JSON number: {x}")


def _algorithm(tree: dict, model: dict) -> str:
    kind = model.get("type")
    if kind is None:
        kind = "WordPiece" if "max_input_chars_per_word" in model else "Unigram" if isinstance(model.get("vocab"), list) else "BPE" if "merges" in model else None
    if kind == "WordPiece":
        return WORDPIECE
    if kind == "Unigram":
        return UNIGRAM
    if kind != "BPE":
        raise UnsupportedError(f"model {kind}")
    steps = [*_steps(tree.get("pre_tokenizer"), "pretokenizers", "pre_tokenizer"), *(_steps(tree.get("decoder"), "decoders", "decoder") if tree.get("decoder") else [])]
    return BPE if any(s.get("type") == "ByteLevel" for s in steps) else SPM


def _vocab(model: dict) -> dict[str, int]:
    found = _need(model, "model", "vocab", dict)
    out: dict[str, int] = {}
    for token, at in found.items():
        if token == "\0twice":
            continue
        if not isinstance(at, int) or isinstance(at, bool) or at < 0:
            raise FormatError(f"vocab: id of {token!r}")
        if at >= MAX_ID:
            raise LimitError(f"id {at}")
        if len(token.encode("utf-8", "surrogatepass")) > MAX_TOKEN:
            raise LimitError(f"token {at} is too long")
        out[token] = at
    return out


def _merges(model: dict, vocab: dict[str, int]) -> list[tuple[str, str]]:
    out = []
    for m in _need(model, "model", "merges", list):
        if isinstance(m, str):
            if m.startswith("#version"):
                continue
            parts = m.split(" ")
        else:
            parts = m
        if not isinstance(parts, list) or len(parts) != 2 or not all(isinstance(p, str) for p in parts):
            raise FormatError(f"merge {m!r}")
        if any(p not in vocab for p in (*parts, parts[0] + parts[1])):
            raise FormatError(f"merge {m!r} is not in the vocabulary")
        out.append((parts[0], parts[1]))
    return out


def _bpe(out: Definition, model: dict) -> None:
    if model.get("dropout") not in (None, 0):
        raise UnsupportedError("dropout")
    for key in ("continuing_subword_prefix", "end_of_word_suffix"):
        if model.get(key):
            raise UnsupportedError(key)
    out.vocab = _vocab(model)
    if out.algorithm == SPM and len(set(out.vocab.values())) < len(out.vocab):
        raise UnsupportedError("two strings with one id")
    out.merges = _merges(model, out.vocab)
    out.unk_token = model.get("unk_token")
    out.unk_id = out.vocab.get(out.unk_token) if out.unk_token is not None else None
    out.fuse_unk, out.byte_fallback, out.ignore_merges = (bool(model.get(k)) for k in ("fuse_unk", "byte_fallback", "ignore_merges"))


def _unigram(out: Definition, model: dict) -> None:
    for entry in _need(model, "model", "vocab", list):
        if not isinstance(entry, list) or len(entry) != 2 or not isinstance(entry[0], str) or isinstance(entry[1], (str, bool)):
            raise FormatError(f"vocab entry {entry!r}")
        out.scores.append((entry[0], score(entry[1].lexeme if isinstance(entry[1], _Number) else str(entry[1]))))
    out.vocab = {piece: i for i, (piece, _) in enumerate(out.scores)}
    out.unk_id = model.get("unk_id")
    if out.unk_id is not None and not 0 <= out.unk_id < len(out.scores):
        raise FormatError("unk_id is outside the vocabulary")
    out.byte_fallback = bool(model.get("byte_fallback"))


def _wordpiece(out: Definition, model: dict) -> None:
    out.vocab = _vocab(model)
    out.unk_token = model.get("unk_token", "[UNK]")
    out.unk_id = out.vocab.get(out.unk_token)
    out.subword_prefix = model.get("continuing_subword_prefix", "##")
    out.max_chars = model.get("max_input_chars_per_word", 100)


def _added(listed: list, vocab: dict[str, int]) -> list[AddedToken]:
    """Ids in the file are not read: a token's id is the vocabulary's, else the next one from its size, in file order.  Of
    equal contents the last flags hold, and special once is special always; an empty content is passed over."""
    by: dict[str, AddedToken] = {}
    following = len(vocab)
    if len(listed) > MAX_ADDED_COUNT:
        raise LimitError("too many added tokens")
    for t in listed:
        content = _need(t, "added_tokens", "content", str)
        if not content:
            continue
        if len(content.encode()) > MAX_ADDED:
            raise LimitError(f"added token {content[:20]!r}")
        if content in by:
            at = by[content].id
        elif content in vocab:
            at = vocab[content]
        else:
            at, following = following, following + 1
        special = bool(t.get("special", False)) or (content in by and by[content].special)
        by[content] = AddedToken(content, at, special, bool(t.get("normalized", not special)), bool(t.get("lstrip")), bool(t.get("rstrip")), bool(t.get("single_word")))
    found = list(by.values())
    if any(t.lstrip and not t.content.strip() for t in found) and any(t.rstrip for t in found):
        raise UnsupportedError("a white-space lstrip token beside rstrip tokens")
    return found


def _steps(found: Any, inner: str, where: str) -> list[dict[str, Any]]:
    if not found:
        return []
    if not isinstance(found, dict) or "type" not in found:
        raise FormatError(f"{where}: no type")
    if found["type"] == "Sequence":
        return [s for x in _need(found, where, inner, list) for s in _steps(x, inner, where)]
    return [found]


# The step types that each algorithm takes; all others are refused by name.
NORMALIZERS = {
    BPE: ("NFC", "NFKC"),
    SPM: ("Prepend", "Replace"),
    UNIGRAM: ("NFC", "NFD", "NFKC", "NFKD", "StripAccents", "Lowercase", "Strip", "Replace", "Precompiled", "Prepend"),
    WORDPIECE: ("BertNormalizer", "NFD", "Lowercase", "StripAccents"),
}
PRE_TOKENIZERS = {
    BPE: ("ByteLevel", "Split", "Digits", "Punctuation", "WhitespaceSplit"),
    SPM: ("Metaspace", "Split"),
    UNIGRAM: ("Metaspace", "WhitespaceSplit", "Split", "Digits", "Punctuation"),
    WORDPIECE: ("BertPreTokenizer", "WhitespaceSplit"),
}
DECODERS = ("ByteLevel", "Replace", "Metaspace", "ByteFallback", "Fuse", "Strip", "WordPiece")
# The patterns that a normalizer may replace, with what stands for them.
REPLACED = ((" {2,}", " "), (" {2,}", "▁"), (r"(?<!\n)^", "▁"), (" ", "▁"))
BEHAVIOURS = ("Removed", "Isolated", "MergedWithPrevious", "MergedWithNext", "Contiguous")


def _check_steps(out: Definition) -> None:
    for steps, known, where in ((out.normalizers, NORMALIZERS[out.algorithm], "normalizer"), (out.pre_tokenizers, PRE_TOKENIZERS[out.algorithm], "pre_tokenizer"), (out.decoders or [], DECODERS, "decoder")):
        for s in steps:
            if s["type"] not in known:
                raise UnsupportedError(f"{where} {s['type']}")
            if s["type"] == "ByteLevel" and s.get("add_prefix_space") and where == "pre_tokenizer":
                raise UnsupportedError("ByteLevel add_prefix_space")
            if s["type"] == "Split" and s.get("behavior") not in BEHAVIOURS:
                raise FormatError(f"Split behavior {s.get('behavior')!r}")
            if s["type"] in ("Split", "Replace") and not (isinstance(s.get("pattern"), dict) and list(s["pattern"]) in (["Regex"], ["String"]) and next(iter(s["pattern"].values()))):
                raise FormatError(f"{s['type']} pattern")
            if where == "normalizer" and s["type"] == "Replace" and "Regex" in s["pattern"] and (s["pattern"]["Regex"], s["content"]) not in REPLACED:
                raise UnsupportedError(f"Replace of the pattern {s['pattern']['Regex']!r}")
            if s["type"] == "Strip" and where == "decoder" and s.get("stop"):
                raise UnsupportedError("decoder Strip from the end")
    kinds = [s["type"] for s in out.normalizers]
    for k, kind in enumerate(kinds):
        if kind in ("NFC", "NFKC") and {"StripAccents", "Lowercase"} & set(kinds[k + 1 :]):
            raise UnsupportedError(f"{kind} before StripAccents or Lowercase")
    if out.algorithm == BPE and not any(s["type"] == "ByteLevel" for s in out.decoders or [{"type": "ByteLevel"}]):
        raise UnsupportedError("a byte-level vocabulary without its decoder")
    if out.algorithm == SPM and any(s["type"] == "Metaspace" and s.get("prepend_scheme") == "first" for s in out.pre_tokenizers) and out.normalizers:
        raise UnsupportedError("Metaspace first after a normalizer")
    chain = [s["type"] for s in out.decoders or []]
    if out.algorithm == UNIGRAM and chain[:1] == ["ByteFallback"]:
        if chain != ["ByteFallback", "Replace", "Fuse", "Replace"]:
            raise UnsupportedError(f"decoders {' '.join(chain)}")
        if len(out.decoders[3]["pattern"].get("String", "  ")) != 1:
            raise UnsupportedError("a Replace of more than one character behind Fuse")
    order = [("Replace", "Metaspace"), ("ByteFallback",), ("Fuse",), ("Strip",)]
    if out.algorithm == SPM and out.decoders:
        at = 0
        for s in out.decoders:
            while at < len(order) and s["type"] not in order[at]:
                at += 1
            if at == len(order):
                raise UnsupportedError(f"decoder {s['type']} out of order")
            at += 1


def _post(out: Definition, found: Any) -> None:
    steps = _steps(found, "processors", "post_processor")
    adding = 0
    for s in steps:
        if s["type"] == "ByteLevel":
            continue
        adding += 1
        if adding > 1:
            raise UnsupportedError("two post-processors that add ids")
        if s["type"] in ("BertProcessing", "RobertaProcessing"):
            out.prefix, out.suffix = [s["cls"][1]], [s["sep"][1]]
            out.prefix_types, out.suffix_types = [0], [0]
        elif s["type"] == "TemplateProcessing":
            seen = False
            parts = _need(s, "post_processor", "single", list)
            if len(parts) > MAX_TEMPLATE:
                raise LimitError("template parts")
            for part in parts:
                kind, value = next(iter((k, v) for k, v in part.items() if k != "\0twice"))
                if kind == "Sequence":
                    if seen or value.get("id") != "A":
                        raise UnsupportedError("a template without exactly one $A")
                    seen, out.sequence_type = True, value.get("type_id", 0)
                else:
                    ids = s["special_tokens"][value["id"]]["ids"]
                    into, types = (out.suffix, out.suffix_types) if seen else (out.prefix, out.prefix_types)
                    into += ids
                    types += [value.get("type_id", 0)] * len(ids)
            if not seen:
                raise UnsupportedError("a template without exactly one $A")
        else:
            raise UnsupportedError(f"post_processor {s['type']}")


def _truncation(out: Definition, found: Any) -> None:
    if not found:
        return
    limit = _need(found, "truncation", "max_length", int)
    if found.get("direction", "Right") != "Right":
        raise UnsupportedError("truncation direction Left")
    if found.get("strategy", "LongestFirst") not in ("LongestFirst", "OnlyFirst"):
        raise UnsupportedError(f"truncation {found.get('strategy')}")
    added = len(out.prefix) + len(out.suffix)
    if limit < added:
        raise UnsupportedError("max_length below the template's ids")
    if found.get("stride", 0) and found["stride"] >= limit - added:
        raise UnsupportedError("truncation stride")
    out.truncation = {"max_length": limit}


def _padding(out: Definition, found: Any) -> None:
    if not found:
        return
    strategy = found.get("strategy", "BatchLongest")
    out.padding = {
        "length": strategy["Fixed"] if isinstance(strategy, dict) else None,
        "left": found.get("direction", "Right") == "Left",
        "multiple": found.get("pad_to_multiple_of") or 0,
        "id": found.get("pad_id", 0), "type_id": found.get("pad_type_id", 0), "token": found.get("pad_token", "[PAD]"),
    }
