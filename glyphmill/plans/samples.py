"""Small tokenizer definitions for the queries, each written out by a rule, so that SQL can state the same."""

from __future__ import annotations

import base64
import importlib.util
import json
from functools import cache
from typing import Any

from glyphmill.functions.characters import byte_alphabet
from glyphmill.functions.pretok import GPT2
from glyphmill.operators.tokenizer import Tokenizer
from glyphmill.sources import ranks

#: Merges of the byte-level sample in rank order.
MERGES = [
    ("t", "h"), ("h", "e"), ("i", "n"), ("e", "r"), ("o", "n"), ("a", "n"), ("r", "e"), ("th", "e"), (" ", "t"), (" ", "a"),
    (" ", "th"), (" ", "o"), ("e", "n"), ("s", "t"), (" ", "the"), ("in", "g"), ("e", "s"), ("a", "t"), (" ", "w"), ("n", "d"),
    ("o", "u"), (" ", "i"), ("er", "e"), ("i", "on"), ("t", "ion"), ("d", "e"), (" ", "de"), ("u", "e"), ("q", "ue"), ("c", "h"),
    ("e", "i"), ("l", "e"),
]
#: Whole words and parts of the WordPiece sample.
WORDS = "the of and in to is that it for was on are as with be this have from or had by not de la le les un en et que des der die das und in el los se no"
PARTS = "th he in er on an re ed nd ha at en es st ti ou or nt hi ing ea ve co me de ra ro li ri io le ne se te ar as al it et is ma la el ic ch ng ion tion able ly sh wh"
SPECIALS = ("<s>", "</s>", "<pad>")


def byte_merges() -> list[tuple[str, str]]:
    """Pairs in the byte alphabet (the space is a character of its own there), each part made by an earlier merge or one byte."""
    space = byte_alphabet()[32]
    out, known = [], set(byte_alphabet().values())
    for pair in MERGES:
        a, b = (part.replace(" ", space) for part in pair)
        if a in known and b in known and (a, b) not in out:
            out.append((a, b))
            known.add(a + b)
    return out


def _file(model: dict[str, Any], **parts: Any) -> Tokenizer:
    return Tokenizer.from_str(_source(model, **parts))


def _source(model: dict[str, Any], **parts: Any) -> str:
    top = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model}
    return json.dumps(top | parts)


#: Words of a language that make a definition.
MOST_WORDS = 200


def word_file(words: list[tuple[str, int]]) -> str:
    """A definition whose vocabulary is the given words with their numbers."""
    return _source({"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 100, "vocab": dict(words)}, pre_tokenizer={"type": "BertPreTokenizer"})


def _added(contents: tuple[str, ...], **flags: Any) -> list[dict[str, Any]]:
    return [{"id": i, "content": c, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} | flags for i, c in enumerate(contents)]


def byte_vocab() -> dict[str, int]:
    out: dict[str, int] = {}
    for s in (*SPECIALS, *byte_alphabet().values(), *(a + b for a, b in byte_merges())):
        out.setdefault(s, len(out))
    return out


def byte_level(**parts: Any) -> Tokenizer:
    """Three special tokens, the 256 bytes, and the merges."""
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": byte_vocab(), "merges": [list(m) for m in byte_merges()]}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    return _file(model, **{"pre_tokenizer": level, "decoder": level, "added_tokens": _added(SPECIALS)} | parts)


def rank_lines() -> list[str]:
    """The byte-level sample as a rank file: the 256 bytes, then what the merges make."""
    back = {c: bytes([b]) for b, c in byte_alphabet().items()}
    made = [*back.values(), *dict.fromkeys(b"".join(back[c] for c in a + b) for a, b in byte_merges())]
    return [f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(made)]


def ranked() -> Tokenizer:
    return Tokenizer(ranks.read("\n".join(rank_lines()).encode(), GPT2, {}))


def word_vocab() -> list[str]:
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *(f"##{c}" for c in letters), *WORDS.split(), *(f"##{p}" for p in PARTS.split()), *".,!?"]
    return list(dict.fromkeys(out))


def wordpiece(**parts: Any) -> Tokenizer:
    return Tokenizer.from_str(wordpiece_source(**parts))


def wordpiece_source(**parts: Any) -> str:
    model = {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 12, "vocab": {w: i for i, w in enumerate(word_vocab())}}
    normal = {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": False, "lowercase": True}
    return _source(model, **{"normalizer": normal, "pre_tokenizer": {"type": "BertPreTokenizer"}, "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True}, "added_tokens": _added(("[PAD]", "[UNK]", "[CLS]", "[SEP]"))} | parts)


def published(name: str = "byte_bpe_50k.json") -> str | None:
    """The path of a published vocabulary, where the package that has them is installed."""
    if importlib.util.find_spec("public_tokenizers") is None:
        return None
    import public_tokenizers

    return str(public_tokenizers.path(name))


@cache
def real() -> Tokenizer:
    """A published byte-level vocabulary of some 50,000 tokens."""
    return Tokenizer.from_file(published())


SPM_MERGES = [("t", "h"), ("h", "e"), ("i", "n"), ("e", "r"), ("o", "n"), ("a", "n"), ("r", "e"), ("th", "e"), ("▁", "t"), ("▁", "a"), ("▁t", "he"), ("▁", "o"), ("e", "n"), ("s", "t")]


def sentencepiece(**parts: Any) -> Tokenizer:
    """Characters of the merges and some more, byte fallback, a mark before every word."""
    pairs = SPM_MERGES
    vocab: dict[str, int] = {}
    for s in ("<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", *"abcdefghijklmnopqrstuvwxyz.,", *(a + b for a, b in pairs)):
        vocab.setdefault(s, len(vocab))
    pairs = [p for p in pairs if p[0] in vocab and p[1] in vocab]
    model = {"type": "BPE", "dropout": None, "unk_token": "<unk>", "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": True, "byte_fallback": True, "ignore_merges": False, "vocab": vocab, "merges": [list(p) for p in pairs]}
    meta = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True}
    chain = [{"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, {"type": "ByteFallback"}, {"type": "Fuse"}, {"type": "Strip", "content": " ", "start": 1, "stop": 0}]
    return _file(model, **{"pre_tokenizer": meta, "decoder": {"type": "Sequence", "decoders": chain}} | parts)


#: Spaces become marks and every text starts with one; no split, so a whole text is one piece to the model.
MARKED = {"type": "Sequence", "normalizers": [{"type": "Prepend", "prepend": "▁"}, {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}]}


def whole_texts() -> Tokenizer:
    """The SentencePiece-style sample in the form that normalizes instead of splitting."""
    return sentencepiece(normalizer=MARKED, pre_tokenizer=None)


def unigram(**parts: Any) -> Tokenizer:
    """Scores by a rule: longer pieces cost less for each character."""
    pieces = ["<unk>", "▁", *"abcdefghijklmnopqrstuvwxyz.,", *(f"▁{w}" for w in dict.fromkeys(WORDS.split())), *dict.fromkeys(PARTS.split())]
    pieces = list(dict.fromkeys(pieces))
    vocab = [[p, 0.0 if p == "<unk>" else -(2.0 + 1.25 * len(p) + (k % 7) / 8)] for k, p in enumerate(pieces)]
    return _file({"type": "Unigram", "unk_id": 0, "vocab": vocab, "byte_fallback": False}, **{"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True}, "decoder": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True}} | parts)
