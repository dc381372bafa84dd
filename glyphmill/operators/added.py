"""Added tokens as built-in columns, for tokens without policy flags (those go through the engine)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.pretok import isolated


def pattern(contents: list[str]) -> str:
    """Leftmost-longest: an alternation, the longest first."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", c) for c in sorted(contents, key=lambda c: (-len(c), c)))


def segments(text: Column | str, contents: list[str]) -> Column:
    """Added tokens and gaps, in order."""
    return isolated(text, pattern(contents)) if contents else F.array(F.col(text) if isinstance(text, str) else text)


def occurrences(text: Column | str, contents: list[str]) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(pattern(contents)), F.lit(0))
