"""Characters by the Unicode versions that tokenizer files were made with: 9.0 for the normal forms and for marks, 8.0 for
the categories of the BERT steps, 17.0 for lower case.  The tables of this interpreter are of yet another version.

A version knows a character that it lacks neither as a mark nor as something to take apart, move or join.  So text between
such characters is normalized by itself, and they stand as they are: ``form`` cuts there and asks the tables of today.
Characters that today's tables lack too behave alike in both.
"""

from __future__ import annotations

import re
import unicodedata


def points(ranges: str) -> str:
    """Ranges of code points, as in "07FD 0898-089F", written for the inside of a class of Java's regular expressions."""
    ends = [r.split("-") for r in ranges.split()]
    return "".join("-".join(rf"\x{{{e}}}" for e in pair) for pair in ends)


def held(ranges: str) -> frozenset[str]:
    ends = [[int(e, 16) for e in r.split("-")] for r in ranges.split()]
    return frozenset(chr(c) for pair in ends for c in range(pair[0], pair[-1] + 1))


# What Unicode's versions brought, as far as a step asks for it.
#: Marks that are none in 9.0.
LATER_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0AFA-0AFF 0B55 0C04 0C3C 0CF3 0D00 0D3B-0D3C 0D81 0EBA 0ECE 1715 180F 1ABF-1ACE 1CF7 1DF6-1DFA A82C A8FF "
    "10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 11073-11074 110C2 11145-11146 111C9 111CE-111CF 11241 1133B 1145E "
    "1182C-1183A 11930-11935 11937-11938 1193B-1193E 11940 11942-11943 119D1-119D7 119DA-119E0 119E4 11A01-11A0A 11A33-11A39 11A3B-11A3E "
    "11A47 11A51-11A5B 11A8A-11A99 11D31-11D36 11D3A 11D3C-11D3D 11D3F-11D45 11D47 11D8A-11D8E 11D90-11D91 11D93-11D97 11EF3-11EF6 "
    "11F00-11F01 11F03 11F34-11F3A 11F3E-11F42 13440 13447-13455 16F4F 16F7F-16F87 16FE4 16FF0-16FF1 1CF00-1CF2D 1CF30-1CF46 1E08F "
    "1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: Marks in 9.0 that are none today.
FORMER_MARKS = "1CF2-1CF3"
#: Characters with a compatible form that 9.0 lacks.
LATER_FORMS = "32FF A7F2-A7F4 AB69 10781-10785 10787-107B0 107B2-107BA 1E030-1E06D 1F16C 1FBF0-1FBF9"
#: Non-spacing marks in 9.0, or today, that are none in 8.0.
MARKS_OF_9 = (
    "08D4-08E1 1885-1886 1DFB A8C5 A9BD 1123E 11438-1143F 11442-11444 11446 11C30-11C36 11C38-11C3D 11C3F 11C92-11CA7 11CAA-11CB0 "
    "11CB2-11CB3 11CB5-11CB6 1E000-1E006 1E008-1E018 1E01B-1E021 1E023-1E024 1E026-1E02A 1E944-1E94A"
)
#: A non-spacing mark in 8.0 that is a spacing one today.
FORMER_NON_SPACING = "1734"
#: Controls that have no category in 8.0.
LATER_CONTROLS = "0890-0891 08E2 110CD 13430-1343F"
#: Punctuation that is none in 8.0.
LATER_PUNCTUATION = (
    "061D 09FD 0A76 0C77 0C84 1B7D-1B7E 2E43-2E4F 2E52-2E5D 10EAD 10F55-10F59 10F86-10F89 1144B-1144F 1145A-1145B 1145D 11660-1166C 116B9 "
    "1183B 11944-11946 119E2 11A3F-11A46 11A9A-11A9C 11A9E-11AA2 11B00-11B09 11C41-11C45 11C70-11C71 11EF7-11EF8 11F43-11F4F 11FFF "
    "12FF1-12FF2 16E97-16E9A 16FE2 1E95E-1E95F"
)
#: Punctuation in 8.0 that is none today.
FORMER_PUNCTUATION = "166D 111C9"
#: Lower case of 16.0 and 17.0: capitals in a row, and the first of what they become.
LATER_LOWER = (
    ("1C89", 0x1C8A), ("A7CB", 0x264), ("A7CC", 0xA7CD), ("A7CE", 0xA7CF), ("A7D2", 0xA7D3), ("A7D4", 0xA7D5), ("A7DA", 0xA7DB), ("A7DC", 0x19B),
    ("10D50-10D65", 0x10D70), ("16EA0-16EB8", 0x16EBB),
)

_MARKS_ADDED, _MARKS_GONE = held(LATER_MARKS), held(FORMER_MARKS)
_NON_SPACING_ADDED, _NON_SPACING_GONE = held(LATER_MARKS) | held(MARKS_OF_9), held(FORMER_NON_SPACING)
_CONTROLS_ADDED = held(LATER_CONTROLS)
_PUNCTUATION_ADDED, _PUNCTUATION_GONE = held(LATER_PUNCTUATION), held(FORMER_PUNCTUATION)
_LOWER = {c: chr(to + n) for capitals, to in LATER_LOWER for n, c in enumerate(sorted(held(capitals)))}
_UNKNOWN_CHARACTERS = _MARKS_ADDED | held(LATER_FORMS)
_UNKNOWN = re.compile(f"([{''.join(sorted(_UNKNOWN_CHARACTERS))}]+)")


def form(kind: str, text: str) -> str:
    """NFC, NFD, NFKC or NFKD by the tables of 9.0."""
    if text.isascii():
        return text
    if _UNKNOWN_CHARACTERS.isdisjoint(text):  # far cheaper than the pattern's many ranges
        return unicodedata.normalize(kind, text)
    stretches = _UNKNOWN.split(text)
    stretches[::2] = [unicodedata.normalize(kind, s) for s in stretches[::2]]
    return "".join(stretches)


def is_mark(ch: str) -> bool:
    """By the tables of 9.0."""
    return (unicodedata.category(ch)[0] == "M" and ch not in _MARKS_ADDED) or ch in _MARKS_GONE


def is_non_spacing_mark(ch: str) -> bool:
    """By the tables of 8.0."""
    return (unicodedata.category(ch) == "Mn" and ch not in _NON_SPACING_ADDED) or ch in _NON_SPACING_GONE


def is_control(ch: str) -> bool:
    """Control, format or private, by the tables of 8.0."""
    return unicodedata.category(ch) in ("Cc", "Cf", "Co") and ch not in _CONTROLS_ADDED


def is_general_punctuation(ch: str) -> bool:
    """By the tables of 8.0."""
    return (unicodedata.category(ch)[0] == "P" and ch not in _PUNCTUATION_ADDED) or ch in _PUNCTUATION_GONE


def lower(ch: str) -> str:
    """By the tables of 17.0, without regard to what stands around the character."""
    return _LOWER.get(ch) or ch.lower()


#: ``is_mark`` and ``is_general_punctuation`` for the inside of one of Java's classes, whose own tables lie between these
#: versions and today's.
JAVA_MARK = rf"\p{{M}}{points(FORMER_MARKS)}&&[^{points(LATER_MARKS)}]"
JAVA_PUNCTUATION = rf"\p{{P}}{points(FORMER_PUNCTUATION)}&&[^{points(LATER_PUNCTUATION)}]"
