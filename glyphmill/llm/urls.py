"""URL filtering: given host and path rules first, then association rules that FP-growth mines from labelled pages.

Whole URLs are read: every host suffix, path part and query name is a token.  Tokens that too few bad pages have can be in
no frequent combination and are left out before FP-growth; of tokens that the same labelled pages have, one stands for all;
and a token that bad pages alone have is a rule that none with it can better, so it is left out too.  What is left is mined
to any length.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import html, quality
from glyphmill.llm.session import stored, tune

#: Of the pages labelled bad, the share that a token combination must hold, and how many there must be.
MIN_SUPPORT, MIN_COUNT = 0.01, 3
#: Of the pages with a combination, the share that must be bad: not only of the labelled ones, but as far as their number
#: tells (Wilson's lower bound, one in twenty beyond it).
MIN_CONFIDENCE, SPREAD = 0.6, 1.645

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RULE = "verdict string, host string, path string"


def parts(url: str | None) -> tuple[str, str]:
    """Host and path: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``.  Else both empty."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    host = re.match(r"[^/?#]*", rest[2])[0]
    return host.translate(_UPPER), re.match(r"[^?#]*", rest[2][len(host) :])[0]


def url_tokens(url: str | None) -> list[str]:
    """Distinct tokens of a whole URL, digits as one sign: scheme, host suffixes, words of the host, path parts with their
    place, the path's last ending, query names and whether there is a fragment."""
    host, path = parts(url)
    if not url:
        return []
    out = [f"scheme={url.partition('://')[0].translate(_UPPER)}"] if "://" in url else []
    labels = re.sub(r"\d+", "0", host).split(".") if host else []
    suffix = ""
    for label in reversed(labels):
        suffix = f"{label}.{suffix}" if suffix else label
        out.append(f"host={suffix}")
    out += [f"word={w}" for label in labels[:-2] for w in label.split("-") if w]
    ways = re.sub(r"\d+", "0", path).strip("/").split("/")
    out += [f"path{k}={p}" for k, p in enumerate(ways) if p]
    if "." in ways[-1]:
        out.append(f"ending={ways[-1].rpartition('.')[2]}")
    query = url.partition("?")[2].partition("#")[0]
    out += [f"query={q.partition('=')[0]}" for q in query.split("&") if q]
    if "#" in url:
        out.append("fragment")
    return list(dict.fromkeys(out))


class GivenRules:
    """Rules of (verdict, host, path): each fits its host and all subdomains where the path starts with the rule's."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for verdict, host, path in rules:
            self.by_host[host.translate(_UPPER)].append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule, as (rule, verdict); by the host's suffixes, so its cost is that of the host's labels."""
        found: tuple[int, str, str] | None = None
        labels = host.split(".")
        for k in range(len(labels)):
            suffix = ".".join(labels[k:])
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (found is None or len(suffix) + len(start) > found[0]):
                    found = (len(suffix) + len(start), suffix + start, verdict)
        return found and found[1:]


class MinedRules:
    """An inverted index: each rule stands under its rarest token, and fits a page that has all its tokens."""

    def __init__(self, rules: list[tuple[tuple[str, ...], float, int]]):
        often: dict[str, int] = defaultdict(int)
        for tokens, _, _ in rules:
            for t in tokens:
                often[t] += 1
        self.index: dict[str, list[tuple[float, int, tuple[str, ...]]]] = defaultdict(list)
        for tokens, confidence, support in rules:
            self.index[min(tokens, key=lambda t: (often[t], t))].append((confidence, support, tuple(sorted(tokens))))

    def find(self, tokens: list[str]) -> tuple[float, int, tuple[str, ...]] | None:
        """The fitting rule of greatest confidence, then support, then tokens."""
        have = set(tokens)
        return max((r for t in tokens for r in self.index.get(t, ()) if have.issuperset(r[2])), default=None)


def _tokens(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        yield pa.RecordBatch.from_arrays([pa.array(map(url_tokens, batch.column(0).to_pylist()), pa.list_(pa.string())), batch.column(1)], names=["items", "bad"])


def lower_bound(bad: int, pages: int, z: float = SPREAD) -> float:
    """The share of bad pages that ``bad`` of ``pages`` speak for, at least."""
    p = bad / pages
    return (p + z * z / (2 * pages) - z * math.sqrt(p * (1 - p) / pages + z * z / (4 * pages * pages))) / (1 + z * z / pages)


def _lower_bound(z: float = SPREAD) -> Column:
    p, n = F.col("bad") / F.col("pages"), F.col("pages")
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> list[tuple[tuple[str, ...], float, int]]:
    """Rules (tokens, confidence, bad pages) from rows of (url, bad 0/1).

    FP-growth finds the token combinations, of any length, that are frequent among bad pages; a join with all labelled
    pages, by each combination's rarest token, counts the pages that have it, and those whose lower bound of confidence is
    too low are dropped before anything comes to the driver.  A rule is dropped if a shorter one inside it is as sure.
    Pages of equal tokens are counted together first, so repeated pages cost nothing more.

    The number of combinations, and so the time, can double with each token that a third of the same bad pages have beside
    good ones; no combination is left out for that.  No labelled or no bad pages: no rules.
    """
    tune(labelled.sparkSession)
    items = labelled.select(F.col("url").cast("string").alias("url"), F.col("bad").cast("int").alias("bad")).where("bad is not null").mapInArrow(_tokens, "items array<string>, bad int")
    items = stored(items.groupBy("items").agg(F.count("*").alias("pages"), F.sum("bad").alias("bad")), "tokens")
    n_bad = items.agg(F.sum("bad").alias("n")).first()["n"] or 0
    least = max(min_count, math.ceil(min_support * n_bad))
    # which pages have a token is told by their number and the sum of their transactions' hashes
    told = items.select("bad", "pages", F.explode("items").alias("token"), (F.xxhash64("items").cast("decimal(20,0)") * F.col("pages")).alias("page"))
    tokens = told.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("pages").alias("pages"), F.sum("page").alias("page")).where(F.col("bad") >= least)
    kept = tokens.groupBy("bad", "pages", "page").agg(F.max(F.struct(F.length("token"), "token"))["token"].alias("token"))
    kept = stored(kept.select("token", "bad", "pages"), "kept")
    sure = kept.where((F.col("bad") == F.col("pages")) & (_lower_bound() >= min_confidence))
    good = {(r["token"],): (r["sure"], r["bad"]) for r in sure.withColumn("sure", _lower_bound()).collect()}
    open_ = kept.where("bad < pages")
    names = [r["token"] for r in open_.select("token").collect()]
    if names:
        fewer = items.select(F.array_intersect("items", F.lit(sorted(names))).alias("items"), "pages", "bad").where(F.size("items") > 0)
        fewer = stored(fewer.groupBy("items").agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad")), "fewer")
        each = fewer.where("bad > 0").select("items", F.explode(F.array_repeat(F.lit(0), F.col("bad").cast("int")))).select("items")
        frequent = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / each.count())).fit(each).freqItemsets
        # a combination whose pages were all bad would still not be sure enough: it is not counted
        frequent = frequent.withColumns({"bad": F.col("freq"), "pages": F.col("freq")}).where((_lower_bound() >= min_confidence) & (F.col("bad") >= least)).select(F.array_sort("items").alias("wanted"), "freq")
        often = open_.select(F.col("token").alias("t"), F.col("pages").alias("often"))
        rarest = frequent.select("wanted", "freq", F.explode("wanted").alias("t")).join(F.broadcast(often), "t").groupBy("wanted").agg(F.min(F.struct("often", "t"))["t"].alias("token"), F.first("freq").alias("bad"))
        found = rarest.join(fewer.select(F.explode("items").alias("token"), "items", F.col("pages").alias("own")), "token").where(F.size(F.array_except("wanted", "items")) == 0)
        counted = found.groupBy("wanted").agg(F.first("bad").alias("bad"), F.sum("own").alias("pages")).withColumn("sure", _lower_bound()).where(F.col("sure") >= min_confidence)
        good |= {tuple(r["wanted"]): (r["sure"], r["bad"]) for r in counted.collect()}
    best: list[tuple[tuple[str, ...], float, int]] = []
    index: dict[str, list[tuple[frozenset[str], float]]] = defaultdict(list)
    for c in sorted(good, key=lambda c: (len(c), c)):  # shorter rules first; each stands under its first token
        have = set(c)
        if any(sure >= good[c][0] and have > inside for t in c for inside, sure in index.get(t, ())):
            continue
        index[c[0]].append((frozenset(c), good[c][0]))
        best.append((c, *good[c]))
    return sorted(best)


def _judge(given: list[tuple[str, str, str]], mined: list[tuple[tuple[str, ...], float, int]]):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, learned = GivenRules(given), MinedRules(mined)
        for batch in rows:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                if found := fixed.find(host, path):
                    out.append((host, path, found[0], found[1], None, None))
                elif hit := learned.find(url_tokens(url)):
                    out.append((host, path, None, "block", " & ".join(hit[2]), hit[0]))
                else:
                    out.append((host, path, None, "allow", None, None))
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate([pa.string()] * 5 + [pa.float64()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence"])

    return run


def judge(pages: DataFrame, given: Iterable[tuple[str, str, str]], mined: list[tuple[tuple[str, ...], float, int]]) -> DataFrame:
    """A verdict for every page (page_id, url): page_id, host, path, rule, verdict, mined_rule, confidence.

    The longest given rule decides; else a mined rule blocks; else the page is allowed.  A null URL or one without
    ``://`` has an empty host and path, fits no given rule, and is allowed unless a mined rule fits.  Rows are judged one
    by one: repeated rows and null ids stay, an empty table gives an empty result, further columns are ignored.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(_judge(list(given), mined), "page_id bigint, host string, path string, rule string, verdict string, mined_rule string, confidence double")


def labelled_pages(pages: DataFrame, model: quality.Model, *, good: float = quality.GOOD) -> DataFrame:
    """(page_id, url, bad) of every page: bad if the main text of its own html is none that the quality model calls good.

    A page with a null or empty html, or without main text, is scored as an empty text.  Repeated rows and null ids stay.
    """
    texts = html.extract(pages).select("page_id", "url", "text")
    return quality.score(texts, model, "quality").select("page_id", "url", (F.col("quality") < good).cast("int").alias("bad"))
