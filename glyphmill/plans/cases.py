"""Small definitions for what documents do not hold, with texts and the ids or texts that they must give."""

from __future__ import annotations

from typing import Any

from glyphmill.functions.characters import byte_alphabet
from glyphmill.plans import samples

_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_MARK = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True}
_BACK = [{"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, {"type": "ByteFallback"}, {"type": "Fuse"}, {"type": "Strip", "content": " ", "start": 1, "stop": 0}]


def _token(i: int, content: str, **flags: Any) -> dict[str, Any]:
    return {"id": i, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} | flags


def _pairs(vocab: dict[str, int], merges: list[list[str]], **changes: Any) -> dict[str, Any]:
    return {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges} | changes


def _byte_level(merges: list[list[str]], words: tuple[str, ...] = (), **changes: Any) -> dict[str, Any]:
    tokens = [*byte_alphabet().values(), *("".join(m) for m in merges), *words]
    return _pairs({t: i for i, t in enumerate(dict.fromkeys(tokens))}, merges, **changes)


def _characters(letters: str, **changes: Any) -> dict[str, Any]:
    tokens = ["<unk>", *(f"<0x{b:02X}>" for b in range(256) if changes.get("byte_fallback")), "▁", *letters, "mi", "▁mi", "mil", "lk"]
    return _pairs({t: i for i, t in enumerate(dict.fromkeys(tokens))}, [["m", "i"], ["▁", "mi"], ["mi", "l"], ["l", "k"]], unk_token="<unk>", **changes)


def _scores(byte_fallback: bool) -> dict[str, Any]:
    pieces = ["<unk>", "▁", *"tea", "te", "▁te", "▁tea", "at", *(f"<0x{b:02X}>" for b in range(256) if byte_fallback)]
    return {"type": "Unigram", "unk_id": 0, "byte_fallback": byte_fallback, "vocab": [[p, 0.0 if p == "<unk>" else -1.5 * len(p) - (k % 5) / 4 if len(p) < 6 else -9.0] for k, p in enumerate(pieces)]}


_NEXT = 256 + 2
_WORDS = ["[UNK]", "tea", "##s", "##pot", "a", "cup", ",", ".", "!", "'", "s", "n", "t", "is", "##n"]

#: Definitions by name.
DEFINITIONS: dict[str, str] = {
    "added_options": samples._source(
        _byte_level([["t", "e"], ["te", "a"]]), pre_tokenizer=_BYTES, decoder=_BYTES,
        added_tokens=[_token(_NEXT, "<one>", single_word=True), _token(_NEXT + 1, "<left>", lstrip=True), _token(_NEXT + 2, "<right>", rstrip=True), _token(_NEXT + 3, "<both>", lstrip=True, rstrip=True, special=False), _token(_NEXT + 4, "<left>er")],
    ),
    "added_normalized": samples._source(
        _byte_level([["t", "e"]]), normalizer={"type": "NFC"}, pre_tokenizer=_BYTES, decoder=_BYTES, added_tokens=[_token(_NEXT - 1, "<raw>"), _token(_NEXT, "<caf\u00e9>", normalized=True, special=False)],
    ),
    "ignore_merges": samples._source(_byte_level([["t", "e"], ["a", "s"]], ("teas", "Ġtea"), ignore_merges=True), pre_tokenizer=_BYTES, decoder=_BYTES),
    "unknown_apart": samples._source(_characters("milk"), pre_tokenizer=_MARK, decoder={"type": "Sequence", "decoders": _BACK}),
    "unknown_fused": samples._source(_characters("milk", fuse_unk=True), pre_tokenizer=_MARK, decoder={"type": "Sequence", "decoders": _BACK}),
    "unknown_bytes": samples._source(_characters("milk", byte_fallback=True, fuse_unk=True), pre_tokenizer=_MARK, decoder={"type": "Sequence", "decoders": _BACK}),
    "prefixed": samples._source(_characters("milk", byte_fallback=True), normalizer={"type": "Sequence", "normalizers": [{"type": "Prepend", "prepend": "▁"}, {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}]}, decoder={"type": "Sequence", "decoders": _BACK}, added_tokens=[_token(0, "<unk>")]),
    "best_path": samples._source(_scores(False), pre_tokenizer=_MARK, decoder=_MARK),
    "best_path_bytes": samples._source(_scores(True), normalizer={"type": "NFKC"}, pre_tokenizer=_MARK, decoder={"type": "Sequence", "decoders": _BACK}),
    "words": samples._source({"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 8, "vocab": {w: i for i, w in enumerate(_WORDS)}}, normalizer={"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None, "lowercase": True}, pre_tokenizer={"type": "BertPreTokenizer"}, decoder={"type": "WordPiece", "prefix": "##", "cleanup": True}),
}

_COMMON = ("", " ", "tea", "  two  teas ", "milk mil k", "é日😀", "a\nb\tc")
#: Texts to encode, by definition; their ids are decoded too.
TEXTS: dict[str, tuple[str, ...]] = {
    "added_options": (*_COMMON, "a<one>b", "a <one> b", "<one>,<one>x", "x  <left>  y", "x  <right>  y", "x \n<both>\t y", "a<left>er", "a <left>er<left>", "<both><both>"),
    "added_normalized": (*_COMMON, "<RAW> <raw>", "<caf\u00e9><cafe\u0301><cafe>", "te<raw>te\u0301"),
    "ignore_merges": (*_COMMON, "teas", " tea", "teas teas", "tease"),
    "unknown_apart": (*_COMMON, "xx mi yyk", "milk!? milk", "▁mi"),
    "unknown_fused": (*_COMMON, "xx mi yyk", "milk!? milk", "▁mi"),
    "unknown_bytes": (*_COMMON, "xx mi yyk", "milk!? milk", "▁mi"),
    "prefixed": (*_COMMON, "mi<unk>mi", "<unk>", "▁ mi"),
    "best_path": (*_COMMON, "teat eat tate", "tea xx tea", "xyx"),
    "best_path_bytes": (*_COMMON, "teat ﬁ eat", "Ⅳ tea ½"),
    "words": (*_COMMON, "Teapots, a cup.", "It isn't a teacup!", "TÉAS 茶tea", "teapotteapot teás"),
}
#: Ids to decode by themselves: pieces of characters, holes of byte runs, marks alone.
IDS: dict[str, tuple[tuple[int, ...], ...]] = {
    "unknown_bytes": ((1 + 0xC3, 1 + 0xA9), (1 + 0xC3,), (1 + 0xE6, 1 + 0x97, 258, 1 + 0xA5), (257, 1 + 0x41, 257, 1 + 0xF0), (257, 257), ()),
    "best_path": ((1, 1, 2), (2, 1), (7,), (6, 7)),
    "words": ((1, 2, 6, 4), (2, 1), (9, 10), (11, 9, 12, 8), (13, 14, 9, 12, 7)),
    "added_options": ((188, 105), (69,), (156, 245, 102),),
}

#: What the public ``tokenizers`` library gives, ids by definition in the order of the texts.
ENCODED: dict[str, tuple[str, ...]] = {
    "added_options": ("", "220", "257", "220 220 83 86 78 220 220 257 82 220", "76 72 75 74 220 76 72 75 220 74", "127 102 162 245 98 172 253 246 222", "64 198 65 197 66", "64 27 78 77 68 29 65", "64 220 258 220 65", "258 11 27 78 77 68 29 87", "87 259 220 220 88", "87 220 220 260 88", "87 261 88", "64 262", "64 220 262 259", "261 261"),
    "added_normalized": ("", "220", "256 64", "220 220 83 86 78 220 220 256 64 82 220", "76 72 75 74 220 76 72 75 220 74", "127 102 162 245 98 172 253 246 222", "64 198 65 197 66", "27 49 32 54 29 220 257", "258 258 27 66 64 69 68 29", "256 257 83 127 102"),
    "ignore_merges": ("", "220", "256 64", "220 220 83 86 78 220 220 256 257 220", "76 72 75 74 220 76 72 75 220 74", "127 102 162 245 98 172 253 246 222", "64 198 65 197 66", "258", "259", "258 220 256 257", "256 257 68"),
    "unknown_apart": ("", "1", "1 0 0 0", "1 1 0 0 0 1 1 0 0 0 0 1", "7 9 7 4 1 5", "1 0 0 0", "1 0 0 0 0 0", "1 0 0 7 1 0 0 5", "7 9 0 0 7 9", "7"),
    "unknown_fused": ("", "1", "1 0", "1 1 0 1 1 0 1", "7 9 7 4 1 5", "1 0", "1 0", "1 0 7 1 0 5", "7 9 0 7 9", "7"),
    "unknown_bytes": ("", "257", "257 117 102 98", "257 257 117 120 112 257 257 117 102 98 116 257", "263 265 263 260 257 261", "257 196 170 231 152 166 241 160 153 129", "257 98 11 99 10 100", "257 121 121 263 257 122 122 261", "263 265 34 64 263 265", "263"),
    "prefixed": ("", "257 257", "257 117 102 98", "257 257 257 117 120 112 257 257 117 102 98 116 257", "263 265 263 260 257 261", "257 196 170 231 152 166 241 160 153 129", "257 98 11 99 10 100", "263 0 263", "0", "257 257 263"),
    "best_path": ("", "1", "7", "1 1 2 0 1 7 0 1", "1 0 1 0 1 0", "1 0", "1 4 0", "6 8 1 3 8 1 2 4 5", "7 1 0 7", "1 0"),
    "best_path_bytes": ("", "1", "7", "1 1 2 128 120 1 7 124 1", "1 118 114 117 116 1 118 114 117 1 116", "1 204 178 239 160 174 249 168 161 137", "1 4 19 107 18 108", "6 8 1 111 114 1 3 8", "1 82 95 7 1 58 235 138 141 59"),
    "words": ("", "", "1", "0 1 2", "0 0 0", "0 0 0", "4 0 0", "1 3 2 6 4 5 7", "0 13 14 9 12 4 0 8", "1 2 0 1", "0 1 2"),
}
#: And texts, first of those ids and then of IDS.
DECODED: dict[str, tuple[str, ...]] = {
    "added_options": ('', ' ', 'tea', '  two  teas ', 'milk mil k', 'é日😀', 'a\nb\tc', 'a<one>b', 'a  b', ',<one>x', 'x  y', 'x  y', 'x<both>y', 'a', 'a ', '<both><both>', '\x00�', 'f', '���'),
    "added_normalized": ('', ' ', 'tea', '  two  teas ', 'milk mil k', 'é日😀', 'a\nb\tc', '<RAW> ', '<caf�><caf�><cafe>', 'teté'),
    "ignore_merges": ('', ' ', 'tea', '  two  teas ', 'milk mil k', 'é日😀', 'a\nb\tc', 'teas', ' tea', 'teas teas', 'tease'),
    "unknown_apart": ('', '', '<unk><unk><unk>', ' <unk><unk><unk>  <unk><unk><unk><unk> ', 'milk mil k', '<unk><unk><unk>', '<unk><unk><unk><unk><unk>', '<unk><unk> mi <unk><unk>k', 'milk<unk><unk> milk', 'mi'),
    "unknown_fused": ('', '', '<unk>', ' <unk>  <unk> ', 'milk mil k', '<unk>', '<unk>', '<unk> mi <unk>k', 'milk<unk> milk', 'mi'),
    "unknown_bytes": ('', '', 'tea', ' two  teas ', 'milk mil k', 'é日😀', 'a\nb\tc', 'xx mi yyk', 'milk!? milk', 'mi', 'é', '�', '��m�', 'A �', ' ', ''),
    "prefixed": ('', ' ', 'tea', '  two  teas ', 'milk mil k', 'é日😀', 'a\nb\tc', 'mi mi', '', '  mi'),
    "best_path": ('', '', 'tea', ' t<unk>  tea<unk> ', '<unk> <unk> <unk>', '<unk>', 'a<unk>', 'teat eat tate', 'tea <unk> tea', '<unk>', ' t', 't ', 'tea', 'te tea'),
    "best_path_bytes": ('', '', 'tea', ' two  teas ', 'milk mil k', 'é日😀', 'a\nb\tc', 'teat fi eat', 'IV tea 1⁄2'),
    "words": ('', '', 'tea', '[UNK] teas', '[UNK] [UNK] [UNK]', '[UNK] [UNK] [UNK]', 'a [UNK] [UNK]', 'teapots, a cup.', "[UNK] isn ' t a [UNK]!", 'teas [UNK] tea', '[UNK] teas', 'teas, a', '##s tea', "' s", "n ' t!", "isn ' t."),
}
