"""Rank files: lines of base64 bytes, a space, and the rank, which is the id."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources import definition
from glyphmill.sources.definition import BPE, MAX_ID, AddedToken, Definition, FormatError, LimitError, OpenError


def is_rank_file(raw: bytes) -> bool:
    """A rank file does not start as JSON does."""
    return raw.lstrip()[:1] not in (b"{", b"")


def read(raw: bytes, pattern: str, specials: dict[str, int] | None = None, *, nfc: bool = False, name: str = "") -> Definition:
    ranks: dict[bytes, int] = {}
    for n, line in enumerate(raw.splitlines(), 1):
        if not line.strip():
            continue
        parts = line.split(b" ")
        try:
            token, rank = base64.b64decode(parts[0], validate=True), int(parts[1])
        except (binascii.Error, ValueError, IndexError) as e:
            raise FormatError(f"line {n}") from e
        if len(parts) != 2 or not token or token in ranks or rank < 0:
            raise FormatError(f"line {n}")
        if rank >= MAX_ID:
            raise LimitError(f"line {n}: id {rank}")
        ranks[token] = rank
    if len(set(ranks.values())) < len(ranks):
        raise FormatError("two tokens with one rank")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise FormatError(f"byte {missing[0]} has no rank")
    added = [AddedToken(t, i, True, False) for t, i in sorted((specials or {}).items(), key=lambda x: x[1])]
    return Definition(
        BPE, {}, ranks=ranks, added=added, normalizers=[{"type": "NFC"}] if nfc else [],
        pre_tokenizers=[{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}],
        sha256=hashlib.sha256(raw).hexdigest(), name=name,
    )


def reserved_specials(first_id: int, count: int, named: dict[str, int], form: str) -> dict[str, int]:
    """Special tokens for a range of ids: the named ones, and ``form`` with the id's number for the rest."""
    by_id = {i: t for t, i in named.items()}
    return {by_id.get(i, form.format(i)): i for i in range(first_id, first_id + count)}


def read_folder(path: str) -> Definition:
    """A folder with tokenizer.json, or with a rank file and what its wrapper adds.

    ``tiktoken.model``: 256 reserved ids after the ranks, named in tokenizer_config.json, hard cuts of long runs.
    ``qwen.tiktoken``: 208 specials after the ranks, found in the NFC text.
    """
    from glyphmill.functions import pretok

    def raw(name: str) -> bytes | None:
        try:
            with open(os.path.join(path, name), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    if (found := raw("tokenizer.json")) is not None:
        return definition.read(found, path)
    if (found := raw("tiktoken.model")) is not None:
        config = json.loads(raw("tokenizer_config.json") or b"{}")
        named = {t["content"]: int(i) for i, t in config.get("added_tokens_decoder", {}).items()}
        first = sum(1 for line in found.splitlines() if line.strip())
        out = read(found, pretok.KIMI, reserved_specials(first, 256, named, "<|reserved_token_{}|>"), name=path)
        out.pre_tokenizers.insert(0, {"type": "RunCuts"})
        return out
    if (found := raw("qwen.tiktoken")) is not None:
        first = sum(1 for line in found.splitlines() if line.strip())
        names = ["<|endoftext|>", "<|im_start|>", "<|im_end|>", *(f"<|extra_{k}|>" for k in range(205))]
        out = read(found, pretok.QWEN2, {n: first + k for k, n in enumerate(names)}, nfc=True, name=path)
        out.added = [AddedToken(t.content, t.id, True, True) for t in out.added]
        return out
    raise OpenError(f"no tokenizer in {path}")


def frame(spark: SparkSession, path: str) -> DataFrame:
    """(rank, token binary) of a rank file, by built-in functions alone."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split("value", " ")
    return lines.select(parts[1].cast("int").alias("rank"), F.unbase64(parts[0]).alias("token"))
