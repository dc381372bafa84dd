"""From ids back to text: token strings, decoder chains, and decoding by steps."""

from __future__ import annotations

import codecs
from typing import Any

from glyphmill.functions.characters import byte_alphabet
from glyphmill.sources.definition import LimitError

# What the WordPiece clean-up replaces in each string, in this order.
CLEAN_UP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))

_BYTES = {c: b for b, c in byte_alphabet().items()}
_HEX = "0123456789abcdefABCDEF"


def byte_of(token: str) -> int | None:
    """The byte of a token like <0x41>; a plus sign and one digit count too."""
    if len(token.encode()) != 6 or not token.startswith("<0x") or not token.endswith(">"):
        return None
    a, b = token[3], token[4]
    return int(token[3:5], 16) if a in _HEX and b in _HEX else int(b, 16) if a == "+" and b in _HEX else None


def raw_bytes(token: str) -> bytes:
    """The bytes that a token of the byte alphabet stands for; one with any other character is its own UTF-8."""
    return bytes(_BYTES[c] for c in token) if all(c in _BYTES for c in token) else token.encode("utf-8", "surrogateescape")


def run_text(run: bytes) -> str:
    """A run of byte tokens: text if it is valid as a whole, else one replacement character for each byte."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        return "�" * len(run)


#: Bytes of an undecided run that a stream holds where it is given a limit and no other number.
HELD_BYTES = 44


def _may_be_text(run: bytes) -> bool:
    """Whether some bytes after it make it valid, if that is so without its last byte: the character before decides."""
    at = max(0, len(run) - 2)
    while at > 0 and len(run) - at < 5 and run[at] & 0xC0 == 0x80:
        at -= 1
    try:
        codecs.getincrementaldecoder("utf-8")().decode(run[at:])
    except UnicodeDecodeError:
        return False
    return True


class Decoder:
    """Decodes token strings one by one; ``push`` gives all text that no later token can change, ``flush`` the rest.

    A run of byte tokens is held while its bytes may still be text; once they cannot, each is one replacement character at
    once.  State is four plain values (held bytes, characters still to strip, whether no token came yet, whether the run
    is no text), so a stream can keep it between batches.
    """

    def __init__(self, decoders: list[dict[str, Any]] | None, raw: bool = False):
        self.steps = decoders
        kinds = [s["type"] for s in decoders or []]
        self.byte_level = "ByteLevel" in kinds
        self.fallback = "ByteFallback" in kinds
        self.wordpiece = next((s for s in decoders or [] if s["type"] == "WordPiece"), None)
        self.per_token = [s for s in decoders or [] if s["type"] in ("Replace", "Metaspace")]
        #: Where runs of bytes are made text first, what follows is done to that text too.
        self.bytes_first = kinds[:1] == ["ByteFallback"] and "Replace" in kinds
        self.strip = next((s for s in decoders or [] if s["type"] == "Strip"), None)
        self.raw = raw
        self.restore(b"", self.strip["start"] if self.strip else 0, True, False)

    def restore(self, held: bytes, to_strip: int, first: bool, broken: bool) -> Decoder:
        self.held, self.to_strip, self.first, self.broken = held, to_strip, first, broken
        return self

    def state(self) -> tuple[bytes, int, bool, bool]:
        return self.held, self.to_strip, self.first, self.broken

    def push_all(self, tokens: list[str], hold: int | None = None) -> str:
        """All pushes or none: where one would hold more than ``hold`` bytes, LimitError, and the state is as it was."""
        before, out = self.state(), []
        for token in tokens:
            out.append(self.push(token))
            if hold is not None and len(self.held) > hold:
                held = len(self.held)
                self.restore(*before)
                raise LimitError(f"a run of {held} bytes is longer than the hold of {hold}")
        return "".join(out)

    def push(self, token: str) -> str:
        if self.byte_level:
            self.held += raw_bytes(token)
            return self._utf8(False)
        if not self.steps:
            out = token if self.first else " " + token
            self.first = False
            return out
        if self.wordpiece:
            return self._piece(token)
        return self._stripped(self._chained(token))

    def flush(self) -> str:
        if self.byte_level:
            return self._utf8(True)
        return self._stripped(self._ended())

    def _ended(self) -> str:
        """What an ending run of byte tokens leaves to give."""
        out, self.held, self.broken = run_text(self.held), b"", False
        return self._replaced(out) if self.bytes_first else out

    def _replaced(self, text: str) -> str:
        for s in self.per_token:
            text = text.replace(next(iter(s["pattern"].values())), s["content"])
        return text

    def _utf8(self, final: bool) -> str:
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        out = reader.decode(self.held, final)
        self.held = b"" if final else reader.getstate()[0]
        return out

    def _piece(self, token: str) -> str:
        prefix = self.wordpiece.get("prefix", "##")
        if not self.first:
            token = token[len(prefix) :] if token.startswith(prefix) else " " + token
        self.first = False
        if self.wordpiece.get("cleanup", True):
            for a, b in CLEAN_UP:
                token = token.replace(a, b)
        return token

    def _chained(self, token: str) -> str:
        b = byte_of(token) if self.fallback else None
        if b is not None:
            self.first = False
            if not self.broken:
                self.held += bytes([b])
                if _may_be_text(self.held):
                    return ""
                self.broken, run, self.held = True, len(self.held), b""
                return "�" * run
            return "�"
        for s in self.per_token:
            if s["type"] == "Replace":
                token = token.replace(next(iter(s["pattern"].values())), s["content"])
            else:
                scheme = s.get("prepend_scheme", "always" if s.get("add_prefix_space", True) else "never")
                token = token.replace(s.get("replacement", "▁"), "" if self.first and scheme != "never" else " ")
        self.first = False
        return self._ended() + token

    def _stripped(self, text: str) -> str:
        content = self.strip["content"] if self.strip else ""
        while self.to_strip and text:
            if not text.startswith(content):
                self.to_strip = 0
                break
            text = text[len(content) :]
            self.to_strip -= 1
        return text


def text_of(tokens: list[str], decoders: list[dict[str, Any]] | None) -> str:
    d = Decoder(decoders)
    return "".join([*map(d.push, tokens), d.flush()])


class Texts:
    """``text_of`` for one chain of decoders, by what each id's string adds behind others, asked for once.

    Bytes of byte tokens and the UTF-8 of all other tokens are read as one text.  Strings are whole characters, so that
    text is right where each run of bytes is right by itself; where one is not, ``text_of`` takes the tokens one by one.
    """

    def __init__(self, decoders: list[dict[str, Any]] | None, strings: dict[int, str]):
        self.decoders, self.strings = decoders, strings
        d = Decoder(decoders)
        self.strip = d.strip if decoders and not d.wordpiece else None
        self.simple = not d.byte_level and not d.bytes_first and (self.strip is None or len(self.strip["content"]) == 1)
        self.added: dict[frozenset[int], dict[int, bytes]] = {}

    def _adds(self, token: str, first: bool) -> bytes:
        d = Decoder(self.decoders)
        if d.steps and d.fallback and not d.wordpiece and (b := byte_of(token)) is not None:
            return bytes([b])
        d.first, d.to_strip = first, 0
        return (d.push(token) + d.flush()).encode()

    def of(self, ids: list[int], skipped: frozenset[int]) -> str:
        """The text of ids of the table: those that are skipped, and holes, add nothing."""
        if self.simple:
            added = self.added.setdefault(skipped, {})
            try:
                for i in set(ids).difference(added):
                    added[i] = self._adds(self.strings[i], False) if i in self.strings and i not in skipped else b""
                parts = list(map(added.__getitem__, ids))
                at = next((k for k, i in enumerate(ids) if i in self.strings and i not in skipped), None)
                if at is None:
                    return ""
                parts[at] = self._adds(self.strings[ids[at]], True)
                text = b"".join(parts).decode()
            except UnicodeError:
                pass
            else:
                for _ in range(self.strip["start"] if self.strip else 0):
                    text = text.removeprefix(self.strip["content"])
                return text
        return text_of([self.strings[i] for i in ids if i in self.strings and i not in skipped], self.decoders)


def bytes_of(tokens: list[str], decoders: list[dict[str, Any]] | None) -> bytes:
    """Never repaired: the bytes of byte tokens as they are, all else as UTF-8."""
    d = Decoder(decoders)
    if d.byte_level:
        return b"".join(map(raw_bytes, tokens))
    out = b""
    for token in tokens:
        b = byte_of(token) if d.fallback else None
        if b is None:
            out += d.push(token).encode("utf-8", "surrogateescape")
        else:
            out += bytes([b])
            d.first = False
    return out
