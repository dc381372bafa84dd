"""Main text of web pages by tag-path ratios.

Text nodes are grouped by the path of block tags from the root.  A path's ratio is its text per node, weighed by its
share of punctuation and lessened by its share of link text; ratios are smoothed along the page, fused over neighbouring
paths of one container, and thresholded.  A container (the path without its last tag) whose paths hold most of the
selected text is content as a whole, so short paragraphs, headings and lists in it are kept.  Elements that are no content by
their name, role or class are left out before; an article or main element only weighs in a path's score.

Where no article or main element has chosen text, menus, remarks and notices can share the paths of the content, and class
names can mislead.  There each block's own ratio is summed up over the elements around it: the content is the innermost element that
holds most of it (MOST), and a part that has a layout's class name counts as left out only while it does not outweigh all
other text (OUTWEIGHS).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.session import tune

#: Share of the standard deviation of smoothed ratios that a path must reach.
THRESHOLD = 1.0
#: What the score of a path is multiplied by inside an article or main element.
MAIN_WEIGHT = 2.0
#: Share of an element's sum of ratios by which the content is looked for inside one of its parts.
MOST = 0.6
#: How many times the ratios of all other text a part with a layout's class name must have to be content after all.
OUTWEIGHS = 2.0
#: Weights of the smoothing over neighbouring nodes.
_KERNEL = np.array([0.06, 0.24, 0.4, 0.24, 0.06])

# HTML's element names by what they do to text.
_KEEPS_P = ("td", "th", "button", "caption", "table", "object")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SKIP = frozenset("script style head title template noscript iframe object svg math canvas audio video nav header footer aside form button input select option textarea datalist dialog menu noembed noframes xmp search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset("article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark a part as no content.
_BOILER = frozenset(
    "ad ads adv advert advertisement adverts adsense advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus footer footnote-nav gdpr header menu menubar modal nav navbar navigation newsletter notice notices notification notifications "
    "pagination pager popup promo promoted promotion recommended recommendations related remark reply replies respond share sharing sidebar sidebars "
    "signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets masthead reader-comments discussion".split()
)
#: Of these, what also names wrappers of a whole page or story.
_LAYOUT = frozenset("banner header modal notice notices popup share sharing sidebar sidebars social tags topbar widget widgets".split())
#: Elements that hold parts of a page.
_HOLDS = frozenset("html body div section center table tbody tr td".split())
#: Starts of names that speak of another part, such as no-sidebar.
_NOT_ITSELF = ("no-", "has-", "with-", "without-", "is-", "js-")
#: Of these, what an article element itself can be: a reader's remark, an advert, or a pointer to another page.
_NOT_ARTICLE = frozenset("ad advert advertisement comment comments promo promoted recommended related remark reply replies sponsored teaser".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
_SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select", "datalist"), "optgroup": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？।؟،]")


#: How sure it is that an element is no content: not at all, by a layout's class name alone, or by anything else.
_CONTENT, _DOUBTFUL, _NONE = range(3)


def _no_content(tag: str, attributes: str, in_main: bool = False) -> int:
    """Whether an element is no content by its name, role or class.  A header inside the main part holds its title."""
    if tag in _SKIP and not (in_main and tag == "header"):
        return _NONE
    if not attributes.strip() or tag in ("html", "body", "main"):
        return _CONTENT
    boiler = _NOT_ARTICLE if tag == "article" else _BOILER
    doubt = _CONTENT
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            names = [x for x in value.split() if not x.startswith(_NOT_ITSELF)]
            words = {w for x in names for w in re.split(r"[^a-z0-9]+", x)} | set(names)
            if words & boiler and not (in_main and words & boiler <= {"header"}):
                if not words & boiler <= _LAYOUT:
                    return _NONE
                doubt = _DOUBTFUL
        elif (name == "role" and value in _ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return _NONE
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _NONE
    return doubt


class Open:
    """The open block elements.  A path is a number that stands for (path above, tag), so it costs the same at any depth;
    where a tag is open last is known without a look at the others."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.skipped: list[int] = []
        self.elements: list[int] = []
        self.around: list[tuple[int, str, int]] = [(-1, "", _CONTENT)]  # by element: the one around it, its tag, whether it is no content
        self.paths: list[int] = []
        self.last: dict[str, list[int]] = {}
        self.known: dict[tuple[int, str], int] = {}
        self.above: list[tuple[int, str]] = [(-1, "")]  # by path: the path above it and its tag; 0 is the root

    def path(self) -> int:
        return self.paths[-1] if self.paths else 0

    def element(self) -> int:
        return self.elements[-1] if self.elements else 0

    def push(self, tag: str, skipped: int) -> None:
        key = (self.path(), tag)
        if key not in self.known:
            self.known[key] = len(self.above)
            self.above.append(key)
        self.last.setdefault(tag, []).append(len(self.tags))
        self.paths.append(self.known[key])
        self.tags.append(tag)
        self.skipped.append(skipped)
        self.around.append((self.element(), tag, skipped))
        self.elements.append(len(self.around) - 1)

    def place(self, tags: Iterable[str]) -> int:
        """Where the innermost of these tags is open; -1 if none is."""
        return max((self.last[t][-1] for t in tags if self.last.get(t)), default=-1)

    def cut(self, k: int) -> None:
        for tag in self.tags[k:]:
            self.last[tag].pop()
        del self.tags[k:], self.skipped[k:], self.paths[k:], self.elements[k:]


def blocks(page: str) -> tuple[list[tuple[int, str, int, int]], list[tuple[int, str]], list[tuple[int, str, int]]]:
    """(path of block tags, text, characters inside links, element) of each block of text, in page order; by path the
    path above it with its tag; and by element the one around it, its tag and whether it is no content.

    White space inside a block is one space; character references are decoded.  Tags that HTML leaves out are closed.
    """
    out: list[tuple[int, str, int, int]] = []
    stack = Open()
    inline: list[tuple[str, bool]] = []  # open elements inside a block that hide their text
    hidden = 0
    text: list[str] = []
    link = links = 0

    def flush() -> None:
        nonlocal links
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole:
                out.append((stack.path(), whole, links, stack.element()))
            text.clear()
        links = 0

    def pop(k: int) -> None:
        flush()
        stack.cut(k)

    def add(raw: str) -> None:
        nonlocal links
        if raw and not hidden:
            piece = html.unescape(raw) if "&" in raw else raw
            text.append(piece)
            if link:
                links += len(piece)

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in _RAW and not closing:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in _INLINE:
            if tag == "br" or tag == "wbr" or tag == "img":
                if tag == "br":
                    add(" ")
                continue
            if closing:
                if tag == "a":
                    link = max(0, link - 1)
                if any(t == tag for t, _ in inline):
                    while True:
                        t, h = inline.pop()
                        hidden -= h
                        if t == tag:
                            break
            else:
                if tag == "a":
                    link += 1
                if attributes.strip() and _no_content(tag, attributes):
                    inline.append((tag, True))
                    hidden += 1
                elif inline:
                    inline.append((tag, False))
            continue
        inline.clear()
        hidden = 0
        if tag in _VOID:
            flush()
            continue
        if closing:
            if (k := stack.place((tag,))) >= 0:
                pop(k)
            else:
                flush()
            link = 0
            continue
        flush()
        link = 0
        if tag in _P_ENDS:
            if (k := stack.place(("p",))) > stack.place(_KEEPS_P):
                pop(k)
            if tag in _HEADINGS and stack.tags and stack.tags[-1] in _HEADINGS:
                pop(len(stack.tags) - 1)
        elif tag in _CLOSES:
            scope = stack.place(_SCOPES[tag])
            outermost = -1
            for t in _CLOSES[tag]:
                for k in reversed(stack.last.get(t, ())):
                    if k <= scope:
                        break
                    outermost = k if outermost < 0 else min(outermost, k)
            if outermost >= 0:
                pop(outermost)
        if tag == "body" and stack.tags and stack.tags[-1] == "head":
            pop(len(stack.tags) - 1)
        above = stack.skipped[-1] if stack.tags else _CONTENT
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "path", "math"):
            stack.push(tag, above if above == _NONE else max(above, _no_content(tag, attributes, stack.place(_MAIN) >= 0)))
    flush()
    return out, stack.above, stack.around


def _smoothed(x: np.ndarray) -> np.ndarray:
    if len(x) < 3:
        return x
    return np.convolve(np.pad(x, 2, mode="edge"), _KERNEL, mode="valid")


def main_text(page: str, threshold: float = THRESHOLD) -> str:
    """Text of the chosen blocks, one to a line (see the head of this module)."""
    found, above, around = blocks(page)
    found = _content(found, above, around)
    if not found:
        return ""
    sums: dict[int, list[float]] = {}
    for path, text, links, _ in found:
        own = sums.setdefault(path, [0, 0, 0, 0])
        own[0] += 1
        own[1] += len(text)
        own[2] += len(_PUNCTUATION.findall(text))
        own[3] += min(links, len(text))
    ratio = {p: (s[1] / s[0]) * (0.2 + min(1.0, 12 * s[2] / max(1, s[1]))) * (1 - s[3] / max(1, s[1])) for p, s in sums.items()}
    smooth = _smoothed(np.array([ratio[p] for p, _, _, _ in found]))
    fused: dict[int, list[float]] = {}  # what a path's own nodes have after smoothing, with the path's own ratio
    for (path, _, _, _), v in zip(found, smooth, strict=True):
        f = fused.setdefault(path, [0.0, 0])
        f[0] += v
        f[1] += 1
    score = {p: 0.5 * ratio[p] + 0.5 * f[0] / f[1] for p, f in fused.items()}
    named = _within(above, {p for p, (_, tag) in enumerate(above) if tag in _MAIN})
    for p in score:
        if p in named:
            score[p] *= MAIN_WEIGHT
    least = threshold * float(np.std(smooth)) if len(sums) > 1 else 0.0
    chosen = {p for p, v in score.items() if v >= least and v > 0} or {max(score, key=lambda p: (score[p], p))}
    weight: dict[int, float] = {}
    for p in chosen:
        weight[above[p][0]] = weight.get(above[p][0], 0) + sums[p][1] * (MAIN_WEIGHT if p in named else 1)
    best = max(weight.values())
    containers = {c for c, w in weight.items() if 4 * w >= best}
    body = {p for p in containers if p <= 0 or above[p][1] in ("html", "body")}
    inside = _within(above, containers - body)
    # right below the body stand the page's other parts too: of lists that are links almost alone none is kept there
    loose = _within(above, body) if body else set()
    keep = {p for p in sums if (p in chosen and above[p][0] in containers) or p in inside or (p in loose and not _menu(sums[p]))}
    keep.add(0)
    kept = [b for b in found if b[0] in keep] if any(p in named for p in keep) else _innermost(found, keep, above, around)
    return "\n".join(text for _, text, _, _ in kept)


def _ratio(text: str, links: int) -> float:
    """A block's own length, by its share of punctuation and of text outside links."""
    return len(text) * (0.2 + min(1.0, 12 * len(_PUNCTUATION.findall(text)) / len(text))) * (1 - min(links, len(text)) / len(text))


def _content(found: list[tuple[int, str, int, int]], above: list[tuple[int, str]], around: list[tuple[int, str, int]]) -> list[tuple[int, str, int, int]]:
    """Without the blocks of elements that are no content.  Of those that only a layout's class name speaks against, the
    heaviest stays where it outweighs all text that nothing speaks against, unless that has an article or main element."""
    clear = [b for b in found if around[b[3]][2] == _CONTENT]
    doubtful = [b for b in found if around[b[3]][2] == _DOUBTFUL]
    main = {p for p, (_, tag) in enumerate(above) if tag in _MAIN} if doubtful else set()
    if not doubtful or (main and any(b[0] in _within(above, main) for b in clear)):
        return clear
    outer = [0] * len(around)  # the outermost doubtful element around each
    for e, (up, _, doubt) in enumerate(around):
        outer[e] = outer[up] or (e if doubt == _DOUBTFUL else 0)
    weight: dict[int, float] = {}
    for _, text, links, e in doubtful:
        weight[outer[e]] = weight.get(outer[e], 0.0) + _ratio(text, links)
    heaviest = max(weight, key=lambda e: (weight[e], -e))
    if weight[heaviest] <= OUTWEIGHS * sum(_ratio(text, links) for _, text, links, _ in clear):
        return clear
    return [b for b in found if around[b[3]][2] == _CONTENT or outer[b[3]] == heaviest]


def _innermost(found: list[tuple[int, str, int, int]], keep: set[int], above: list[tuple[int, str]], around: list[tuple[int, str, int]]) -> list[tuple[int, str, int, int]]:
    """The blocks of the paths in ``keep`` inside the innermost element that holds most of their ratios, and the headings
    right before that element."""
    weight = [0.0] * len(around)
    kept, every = [0] * len(around), [0] * len(around)
    for path, text, links, e in found:
        every[e] += 1
        if path in keep:
            weight[e] += _ratio(text, links)
            kept[e] += 1
    for e in range(len(around) - 1, 0, -1):  # an element's number is greater than that of the one around it
        up = around[e][0]
        weight[up], kept[up], every[up] = weight[up] + weight[e], kept[up] + kept[e], every[up] + every[e]
    largest = [0] * len(around)  # by element, the heaviest part that holds several blocks
    for e in range(1, len(around)):
        up = around[e][0]
        if around[e][1] in _HOLDS and kept[e] > 1 and (not largest[up] or weight[e] > weight[largest[up]]):
            largest[up] = e
    at = before = 0
    while largest[at] and weight[largest[at]] >= MOST * weight[at]:
        before = at if every[largest[at]] < every[at] else before
        at = largest[at]
    inside = [False] * len(around)
    inside[at] = True
    for e in range(at + 1, len(around)):
        inside[e] = inside[around[e][0]]
    out, begun = [], False
    for b in found:
        begun = begun or inside[b[3]]
        if (inside[b[3]] and b[0] in keep) or (not begun and above[b[0]][1] in _HEADINGS and around[b[3]][0] == before):
            out.append(b)
    return out


def _within(above: list[tuple[int, str]], roots: set[int]) -> set[int]:
    """The paths at or below some paths; a path's number is greater than that of the path above it."""
    out = set(roots)
    for p, (up, _) in enumerate(above):
        if up in out:
            out.add(p)
    return out


def _menu(sums: list[float]) -> bool:
    """A path of more than one node that is links almost alone."""
    return sums[0] > 2 and sums[3] > 0.8 * sums[1]


def _extract(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html).

    Pages are read one by one, so repeated rows, ties and null ids stay as they are.  A null or empty page, and one
    without text, has an empty text.  Time and memory grow with a page's length, whatever the depth of its elements; nothing
    is cut from a long one.  Markup that is cut off or not closed is read to its end.  An empty table gives an
    empty result; further columns are ignored.
    """
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
