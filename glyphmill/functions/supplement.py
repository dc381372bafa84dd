"""Characters that Java's tables do not know yet: found once a session and spliced into patterns.

The JVM's Unicode tables are older than those that tokenizer files were made with.  One small Spark job asks Java's
regular expressions about every code point; what the newer tables class otherwise becomes ranges inside the patterns.
"""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

CLASSES = ("L", "N", "M", "P", "S", "Lu", "Ll", "Lt", "Lm", "Lo")


@lru_cache(maxsize=2)
def missing(spark: SparkSession) -> dict[str, str]:
    """For each class the ranges of code points that Java leaves out, written for a character class."""
    points = spark.range(0x20, 0x110000).where("id < 55296 or id > 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    bits = sum((F.when(F.col("c").rlike(rf"^\p{{{k}}}$"), 1 << n).otherwise(0) for n, k in enumerate(CLASSES)), F.lit(0))
    known = {r["id"]: r["bits"] for r in points.select("id", bits.alias("bits")).where("bits > 0").toArrow().to_pylist()}
    out = {}
    for n, k in enumerate(CLASSES):
        newer = regex.compile(rf"\p{{{k}}}")
        more = [p for p in range(0x20, 0x110000) if not 0xD800 <= p <= 0xDFFF and not known.get(p, 0) >> n & 1 and newer.match(chr(p))]
        out[k] = _ranges(more)
    return out


def _ranges(points: list[int]) -> str:
    spans: list[list[int]] = []
    for p in points:
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


def spliced(spark: SparkSession, pattern: str) -> str:
    """The pattern with every class made whole: inside a set its ranges are added, elsewhere the class becomes a set."""
    more, out, depth, i = missing(spark), [], 0, 0
    while i < len(pattern):
        m = regex.compile(r"\\p\{(\w+)\}").match(pattern, i)
        if m:
            extra = more.get(m[1], "")
            out.append(m[0] + extra if depth else f"[{m[0]}{extra}]" if extra else m[0])
            i = m.end()
            continue
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        depth += (pattern[i] == "[") - (pattern[i] == "]" and depth > 0)
        out.append(pattern[i])
        i += 1
    return "".join(out)
