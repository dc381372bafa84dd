"""Exact n-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document is its set of distinct word shingles, as 64-bit hashes.  All sets are put in one global order, rare shingles
first (by a count sketch over the whole corpus, then by hash).  If two sets of sizes n and m have a Jaccard coefficient
of at least t, they share at least T = ceil(t * max(n, m)) shingles, so for every l up to T the first n - ceil(t n) + l
shingles of one and the first m - ceil(t m) + l of the other have l in common.

The index.  A document whose prefix ends in crowded shingles lengthens it, if its own share of the candidates that these
would bring costs more than the longer prefix's postings; partners must then share two of its shingles.  Let s be the
first shingle that two linked documents have in common.  If s is not crowded, both stand in the list of s.  If it is, and
both are lengthened, they have a second one, t, behind it, and both stand in the list of the pair (s, t); in the list of s
itself a lengthened document is a guest, which meets those that are not lengthened and no other guest.  So a passage that
many documents share brings them together only where a second shingle does, and this is decided by lists of keys, before
any text moves.

Linked documents meet at their first common shingle.  If it stands at place i of a set of n, at most n - i shingles can
be shared, so the partner has at most (n - i) (1 + t) / t - n shingles; places with no partner of a size that suits both
are passed over.  The others meet in the group of the list's hub (the document with the most popular prefix among
them), so that a family of copies has few groups, not one for each shingle.  There each is compared with the hub, which is
linear in the group; those that do not link to it are compared with all others, in blocks of which a task sees two.
A pair is verified only if it shares as many shingles of its prefixes as both ask for (up to MOST_MATCHES), and if a parity
bitmap allows the overlap.  Pairs are not emitted: a task returns a spanning forest of the links it has verified, and
components are made from the forests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import words
from glyphmill.llm.components import components
from glyphmill.llm.session import stored, tune

#: Links need 100 * shared >= PERCENT * union.
PERCENT = 75
#: Counters of the sketch (4 bytes each are broadcast) and bits of the filter that passes over texts before a join: as many
#: as the corpus has use for, between the two numbers, so that what is broadcast is bounded by 32 MB each.  Results do not
#: depend on either: what the filter lets through wrongly the join drops.
COUNTERS = (1 << 20, 1 << 23)
FILTER_BITS = (1 << 26, 1 << 28)
_BLOCKS = 128
#: A shingle in so many documents, beyond what the sketch's noise explains, is crowded.
CROWDED = 32
#: The most matches that a document asks for in a task.
MOST_MATCHES = 8
#: What verifying a candidate costs, in postings.
VERIFY_COST = 4.0
#: Documents of a block; a task holds two blocks.  And those that are compared with their hub together.
BLOCK, RAYS = 384, 256
#: Shingles of those, all together (8 bytes each): groups of long documents are cut in as many more blocks.
BLOCK_SHINGLES = RAY_SHINGLES = 1 << 22
_BITS = 1024
#: Postings of a shingle that are compared one by one with those after them, by size; and how many a task holds.
_NEAR, _TOGETHER = 16, 1 << 18
#: Stands for a null doc_id where ids are compared.
_NO_ID = -(2**63) + 1


def _sized(rows: int, bounds: tuple[int, int]) -> int:
    """The power of two next above the number of rows times 4, inside the bounds."""
    return min(bounds[1], max(bounds[0], 1 << (4 * rows).bit_length()))


def _shift(n: int) -> np.uint64:
    """How far a 64-bit hash is shifted to be a place of ``n``, a power of two."""
    return np.uint64(64 - n.bit_length() + 1)


def _sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts (by text, ascending) and their n+1 offsets."""
    hashed, _, _, bounds = words.word_spans(texts)
    grams, offsets = words.shingle_hashes(hashed, bounds)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    out = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.bincount(text[new], minlength=len(texts)), out=out[1:])
    return grams[new], out


def _keys(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values for each set; equal sets have equal ones, others differ up to chance."""
    sums = lambda x: np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))[offsets])
    size = np.diff(offsets).astype(np.uint64)
    return words.mix(sums(words.mix(grams)) + size).view(np.int64), words.mix(sums(words.mix(grams ^ np.uint64(0x5851F42D4C957F2D))) ^ size).view(np.int64)


def _packed(raw: bytes) -> bytes:
    """Compressed before it is shuffled: small counts and texts take less than half of what the shuffle's own codec leaves."""
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


_PROFILE = "doc_id bigint, n_shingles bigint, key bigint, key2 bigint, block int, counts binary"


def _profile(counters: int):
    """A row for each document with its set's size and keys; then the task's part of the sketch, in blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, dtype=np.uint32)
        shift = _shift(counters)
        waiting, held = [], 0

        def count() -> None:
            """Counts end at the largest value of 32 bits."""
            at, n = np.unique(np.concatenate(waiting), return_counts=True)
            counts[at] = np.minimum(counts[at].astype(np.int64) + n, 2**32 - 1)

        for batch, texts in words.batches(rows):
            grams, offsets = _sets(texts)
            a, b = _keys(grams, offsets)
            waiting.append((grams >> shift).astype(np.int64))
            held += len(grams)
            if held > 1 << 21:
                count()
                waiting, held = [], 0
            n = len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(a), pa.array(b), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        if waiting:
            count()
        parts = counts.astype("<u4", copy=False).reshape(_BLOCKS, -1)
        keep = [i for i in range(_BLOCKS) if parts[i].any()]
        none = pa.nulls(len(keep), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(keep, pa.int32()), pa.array([_packed(parts[i].tobytes()) for i in keep], pa.binary())], schema=schema)

    return run


def _summed(group: pa.Table) -> pa.Table:
    total = None
    for x in group.column("counts").to_pylist():
        own = np.frombuffer(_unpacked(x), dtype="<u4").astype(np.uint64)
        total = own if total is None else total + own
    return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})


class Order:
    """The global order of shingles, and each set's own prefix in it."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.shift = _shift(len(counts))
        mean = float(counts.mean())
        self.noise = mean + 4 * np.sqrt(mean)

    def ranked(self, grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each set's shingles in the global order, and how popular they are beyond the noise."""
        often = self.counts[(grams >> self.shift).astype(np.int64)]
        size = np.diff(offsets)
        order = np.lexsort((grams, often, np.repeat(np.arange(len(size)), size)))
        return grams[order], np.maximum(0.0, often[order] - self.noise)

    def prefixes(self, grams: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For each set: its prefix, the matches it asks for, and how popular the prefix is."""
        ranked, popular = self.ranked(grams, offsets)
        size = np.diff(offsets)
        summed = np.concatenate(([0.0], np.cumsum(popular)))
        out, matches, strength = [], np.ones(len(size), dtype=np.int64), np.zeros(len(size))
        for i in np.flatnonzero(size):
            n, a = int(size[i]), int(offsets[i])
            least = -(-PERCENT * n // 100)
            first = n - least + 1
            last = min(MOST_MATCHES, least)
            extended = first + np.arange(last)
            steps = np.arange(1, last + 1)
            cost = extended + VERIFY_COST * (summed[a + extended] - summed[a]) / steps
            pick = int(np.argmin(cost))
            out.append(ranked[a : a + first + pick])
            matches[i] = pick + 1
            strength[i] = (summed[a + first + pick] - summed[a]) / (first + pick)
        if len(out) < len(size):
            full = iter(out)
            out = [next(full) if s else ranked[:0] for s in size]
        return out, matches, strength


def postings(ranks: Order, grams: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, ``placed``, set) of the sets numbered ``of``, none of them empty: see the head of this module."""
    ranked, popular = ranks.ranked(grams, offsets)
    size, start = np.diff(offsets)[of], offsets[:-1][of]
    least = -(-PERCENT * size // 100)
    first = size - least + 1  # where the first common shingle of a link can stand
    own = np.repeat(np.arange(len(of)), first)
    place = np.arange(len(own)) - np.repeat(np.cumsum(first) - first, first)
    at = start[own] + place
    crowded = popular[at] > CROWDED
    n_crowded = np.bincount(own[crowded], minlength=len(of))
    candidates = VERIFY_COST * np.bincount(own[crowded], popular[at[crowded]], len(of))
    pairs = n_crowded * (n_crowded + 1) // 2  # postings of the longer prefix; no more than those of the plain one
    longer = (n_crowded > 0) & (least >= 2) & (pairs <= first) & (pairs < candidates)
    strength = np.bincount(own, popular[at], len(of)) / first
    weak = (_GUEST - 1 - np.minimum(_GUEST - 1, 1500 * np.log1p(strength))).astype(np.int64)
    guest = crowded & longer[own]
    lists, told, whose = [ranked[at]], [placed(size[own], place, np.where(guest, _GUEST, weak[own]))], [own]
    for i in np.flatnonzero(longer).tolist():  # the crowded shingles are the last of the prefix
        m = int(n_crowded[i])
        a, b = np.triu_indices(m + 1, 1)
        begin = int(first[i]) - m
        shingles = ranked[start[i] + begin : start[i] + begin + m + 1]
        lists.append(words.mix(shingles[a] + words.mix(shingles[b])))
        told.append(placed(np.full(len(a), size[i]), begin + a, np.full(len(a), weak[i])))
        whose.append(np.full(len(a), i))
    return np.concatenate(lists), np.concatenate(told), np.concatenate(whose)


def _postings(order):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Order(np.frombuffer(order.value, dtype="<u4"))
        for _, texts in words.batches(rows):
            grams, offsets = _sets(texts)
            key, _ = _keys(grams, offsets)
            seen = np.unique(key, return_index=True)[1]  # copies of one batch have one set of postings
            seen = seen[np.diff(offsets)[seen] > 0]
            if not len(seen):
                continue
            shingle, place, own = postings(ranks, grams, offsets, seen)
            yield pa.RecordBatch.from_arrays([pa.array((shingle & _SHORTENED).view(np.int64)), pa.array(place), pa.array(key[seen][own])], names=["shingle", "place", "key"])

    return run


#: Postings carry 48 bits of a shingle: zeros take no room in the shuffle, and two shingles that look alike only make
#: documents meet that need not.
_SHORTENED = np.uint64(2**64 - 2**16)
#: Bits of a set's size, of a place in it, and of how weak a document is as a hub: together one long.
_SIZE_BITS, _WEAK_BITS = 24, 15
_MOST_SIZE, _MOST_WEAK = (1 << _SIZE_BITS) - 1, (1 << _WEAK_BITS) - 1
#: The weakest: a document that meets no other of this kind in the list.
_GUEST = _MOST_WEAK


def placed(size: np.ndarray, place: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """One long that sorts by size, then place.  Sets of more shingles than the bits hold count as equally large, at place 0:
    they suit one another, so none is passed over."""
    huge = size > _MOST_SIZE
    return (np.where(huge, _MOST_SIZE, size) << (_SIZE_BITS + _WEAK_BITS)) | (np.where(huge, 0, place) << _WEAK_BITS) | weak


def meetings(shingle: np.ndarray, place: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Distinct (hub, key) of postings sorted by shingle, ``placed`` and key."""
    new = np.ones(len(shingle), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (place[1:] != place[:-1]) | (key[1:] != key[:-1])
    shingle, place, key = (x[new] for x in (shingle, place, key))
    size, weak = place >> (_SIZE_BITS + _WEAK_BITS), place & _MOST_WEAK
    guest = weak == _GUEST
    most = (size - ((place >> _WEAK_BITS) & _MOST_SIZE)) * (100 + PERCENT) // PERCENT - size  # the largest partner
    start = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
    length = np.diff(np.append(start, len(shingle)))
    suits = np.zeros(len(shingle), dtype=bool)
    for apart in range(1, _NEAR + 1):
        both = np.flatnonzero(shingle[apart:] == shingle[:-apart])
        if not len(both):
            break
        both = both[(size[both + apart] <= most[both]) & (size[both] <= most[both + apart]) & ~(guest[both] & guest[both + apart])]
        suits[both] = suits[both + apart] = True
    if (length > _NEAR + 1).any():  # in long lists: those that suit the least size, and that some other can suit
        far = np.repeat(length > _NEAR + 1, length)
        over = lambda x: np.repeat(x, length)
        suits |= far & ~guest & (most >= over(size[start])) & (size <= over(np.maximum.reduceat(most, start)))
        suits |= far & guest & (most >= over(np.minimum.reduceat(np.where(guest, _MOST_SIZE + 1, size), start))) & (size <= over(np.maximum.reduceat(np.where(guest, -1, most), start)))
    at = np.flatnonzero(suits)
    if not len(at):
        return np.zeros((0, 2), dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], shingle[at][1:] != shingle[at][:-1])))
    best = np.minimum.reduceat((weak[at].astype(np.int64) << 36) + np.arange(len(at)), first) & ((1 << 36) - 1)
    hub = np.repeat(key[at][best], np.diff(np.append(first, len(at))))
    return np.unique(np.stack([hub, key[at]], axis=1), axis=0)


def _meetings(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``meetings`` of a sorted stream.  A shingle's postings are seen together, up to _TOGETHER of them; if there are
    more, all its keys meet at the strongest of the first ones, so that a task's memory is bounded and nothing is lost."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    long: tuple[int, int] | None = None  # a shingle with too many postings, and its hub

    def told(columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        rest = int(np.searchsorted(columns[0], long[0], "right")) if long and len(columns[0]) and columns[0][0] == long[0] else 0
        if rest:
            keys = np.unique(columns[2][:rest])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), long[1])), pa.array(keys)], names=["hub", "key"])
        pairs = meetings(*(x[rest:] for x in columns)) if rest < len(columns[0]) else []
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["hub", "key"])

    for batch in rows:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        n += batch.num_rows
        if n < _TOGETHER:
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
        if not cut:
            cut = len(whole[0])
            long = long if long and long[0] == whole[0][0] else (int(whole[0][0]), int(whole[2][np.argmin(whole[1] & _MOST_WEAK)]))
        yield from told(tuple(x[:cut] for x in whole))
        held, n = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
    if n:
        yield from told(tuple(np.concatenate(x) for x in zip(*held, strict=True)))


def _filter_places(key: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """The filter's bit, of ``n``, for each (set key, doc_id)."""
    return (words.mix(key.view(np.uint64) ^ words.mix(own.view(np.uint64))) >> _shift(n)).astype(np.int64)


def _filter_bits(n: int):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(n // 8, dtype=np.uint8)
        for batch in rows:
            at = _filter_places(*(np.ascontiguousarray(c.to_numpy()) for c in batch.columns), n)
            np.bitwise_or.at(packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        packed = packed.reshape(_BLOCKS, -1)
        keep = [i for i in range(_BLOCKS) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([_packed(packed[i].tobytes()) for i in keep], pa.binary())], names=["block", "counts"])

    return run


def _united(group: pa.Table) -> pa.Table:
    bits = None
    for x in group.column("counts").to_pylist():
        own = np.frombuffer(_unpacked(x), dtype=np.uint8)
        bits = own if bits is None else bits | own
    return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "counts": pa.array([bits.tobytes()], pa.binary())})


def _key_filter(pairs: DataFrame, n: int):
    """A broadcast filter of (key, doc_id) pairs: ``n`` / 8 bytes, however many there are."""
    bits = np.zeros((_BLOCKS, n // 8 // _BLOCKS), dtype=np.uint8)
    for r in pairs.mapInArrow(_filter_bits(n), "block int, counts binary").groupBy("block").applyInArrow(_united, "block int, counts binary").collect():
        bits[r["block"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return pairs.sparkSession.sparkContext.broadcast(bits.tobytes())


def _passes(kept: np.ndarray, key: np.ndarray, own: pa.Array) -> np.ndarray:
    at = _filter_places(key, own.cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False), 8 * len(kept))
    return (kept[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _picked(kept):
    """Texts whose (key, doc_id) the filter lets through."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(kept.value, dtype=np.uint8)
        for batch, texts in words.batches(rows):
            grams, offsets = _sets(texts)
            key, _ = _keys(grams, offsets)
            at = np.flatnonzero((np.diff(offsets) > 0) & _passes(bits, key, batch.column(0)))
            packed = pa.array([_packed(texts[i]) for i in at.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), batch.column(0).take(pa.array(at)).fill_null(_NO_ID), packed], names=["key", "rep", "packed"])

    return run


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _links(a: tuple, b: tuple) -> bool:
    """Whether two (set, sorted prefix, matches asked for) share enough of their prefixes, and then of their sets."""
    if len(np.intersect1d(a[1], b[1], assume_unique=True)) < min(a[2], b[2]):
        return False
    shared = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return 100 * shared >= PERCENT * (len(a[0]) + len(b[0]) - shared)


def linked(docs: list[tuple], side: np.ndarray, tight: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between documents of both sides (of all, if ``same``), the ``tight`` ones being
    connected already.

    Candidates in order of the overlap that their bitmaps allow; documents that are connected are not compared.
    """
    sets = [d[0] for d in docs]
    m = len(sets)
    size = np.array([len(s) for s in sets])
    whole = np.concatenate(sets)
    parity = (np.bincount(np.repeat(np.arange(m) * _BITS, size) + (whole & np.uint64(_BITS - 1)).astype(np.int64), minlength=m * _BITS) & 1).astype(bool)
    bits = np.packbits(parity.reshape(m, _BITS), axis=1).view(np.uint64)
    label = np.arange(m)
    label[tight] = m
    forest = []
    for a in range(m - 1):
        rest = np.arange(a + 1, m)
        if not same:
            rest = rest[side[rest] != side[a]]
        rest = rest[label[rest] != label[a]]
        if not len(rest):
            continue
        total = size[a] + size[rest]
        most = np.minimum((total - _popcount(bits[rest] ^ bits[a])) // 2, np.minimum(size[a], size[rest]))
        able = 100 * most >= PERCENT * (total - most)
        rest, most = rest[able], most[able]
        for b in rest[np.argsort(-most, kind="stable")].tolist():
            if label[a] != label[b] and _links(docs[a], docs[b]):
                forest.append((a, b))
                label[label == label[b]] = label[a]
    return forest


def _read(texts: list[bytes], ranks: Order) -> Iterator[tuple]:
    """(set, sorted prefix, matches asked for) of each text."""
    for x, y in words.chunks(texts):
        grams, offsets = _sets(texts[x:y])
        prefixes, matches, _ = ranks.prefixes(grams, offsets)
        for i in range(y - x):
            yield grams[offsets[i] : offsets[i + 1]].copy(), np.sort(prefixes[i]), int(matches[i])


_STAR = "hub bigint, key bigint, linked boolean, packed binary, size bigint"


def _starred(order):
    """From (hub, part, other, alone, key, packed) sorted so that a part's hub comes first: whether each other key links to it.

    Where the part is the whole group (``alone``), what is left between loose documents and the others is settled here, and
    edges alone come out.  Of a group with more parts each key comes out with its text, for the cells.
    """

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Order(np.frombuffer(order.value, dtype="<u4"))
        at, hub, alone, have = None, None, False, {}

        def rest() -> list[tuple]:
            if not alone or len(have) < 2 or all(t for _, t in have.values()):
                return []
            keys, docs, tight = list(have), [d for d, _ in have.values()], np.array([t for _, t in have.values()])
            return [(keys[x], keys[y], True, None, None) for x, y in linked(docs, np.zeros(len(keys)), tight, True)]

        def told(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()))], names=["hub", "key", "linked", "packed", "size"])

        for batch in rows:
            hubs, parts, other, single, keys, packed = (c.to_pylist() for c in batch.columns)
            out = []
            for i, d in enumerate(_read([_unpacked(x) for x in packed], ranks)):
                if (hubs[i], parts[i]) != at:
                    out += rest()
                    at, hub, alone, have = (hubs[i], parts[i]), None, single[i], {}
                if not other[i]:
                    hub = d
                    continue
                ties = hub is not None and _links(hub, d)
                if alone:
                    have.setdefault(keys[i], (d, ties))
                    if ties:
                        out.append((hubs[i], keys[i], True, None, None))
                else:
                    out.append((hubs[i], keys[i], ties, packed[i], len(d[0])))
            yield told(out)
        yield told(rest())

    return run


def _verified(order):
    """From (hub, i, j, side, tight, key, packed) sorted by cell (hub, i, j): a forest of each cell's links."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Order(np.frombuffer(order.value, dtype="<u4"))
        cell, have = None, {}

        def done() -> list[tuple[int, int]]:
            if len(have) < 2:
                return []
            keys, docs = list(have), [d for d, _, _ in have.values()]
            sides, tight = (np.array([v[k] for v in have.values()]) for k in (1, 2))
            return [(keys[x], keys[y]) for x, y in linked(docs, sides, tight.astype(bool), cell[1] == cell[2])]

        def told(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in rows:
            edges = []
            hubs, first, second, sides, tight, keys, packed = (c.to_pylist() for c in batch.columns)
            for i, d in enumerate(_read([_unpacked(x) for x in packed], ranks)):
                if (hubs[i], first[i], second[i]) != cell:
                    edges += done()
                    cell, have = (hubs[i], first[i], second[i]), {}
                have.setdefault(keys[i], (d, sides[i], tight[i]))
            if edges:
                yield told(edges)
        if edges := done():
            yield told(edges)

    return run


def _all_edges(members: DataFrame, texts: DataFrame, order, parts: int) -> DataFrame:
    """Edges that connect all documents of a group (hub, key, rep) that links connect.

    First every document is compared with its hub, which is linear in the group.  Only pairs with a document that is not
    linked to its hub (a loose one) are left: loose blocks meet each other and the blocks of the others, cell by cell.
    Blocks have about equally many documents, so few that neither these nor their shingles are more than a task may hold.
    """
    blocks = lambda n, shingles, most, together: F.ceil(F.greatest(n / most, shingles / together)).cast("int")
    counted = members.join(members.groupBy("hub").agg(blocks(F.count("*"), F.sum("n_shingles"), RAYS, RAY_SHINGLES).alias("n")), "hub")
    block = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    part = F.when(F.col("key") == F.col("hub"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(block(F.col("n"))))
    rays = counted.select("hub", F.explode(part).alias("part"), (F.col("key") != F.col("hub")).alias("other"), (F.col("n") == 1).alias("alone"), "key", "rep").join(texts, ["key", "rep"])
    rays = rays.select("hub", "part", "other", "alone", "key", "packed").repartition(parts, "hub", "part").sortWithinPartitions("hub", "part", "other")
    stars = stored(rays.mapInArrow(_starred(order), _STAR), "stars")

    large = stars.where("packed is not null")
    sizes = large.groupBy("hub").agg(F.count_if(~F.col("linked")).alias("loose"), F.count("*").alias("all"), F.sum("size").alias("size"), F.coalesce(F.sum(F.when(~F.col("linked"), F.col("size"))), F.lit(0)).alias("loose_size")).where("loose > 0 and all > 1")
    side = lambda n, shingles: blocks(n, shingles, BLOCK, BLOCK_SHINGLES)
    few = sizes.select("hub", side(F.col("loose"), F.col("loose_size")).alias("n_loose"), side(F.col("all") - F.col("loose"), F.col("size") - F.col("loose_size")).alias("n_tight"))
    open_ = large.join(few, "hub").withColumn("side", F.when(F.col("linked"), F.col("n_loose") + block(F.greatest("n_tight", F.lit(1)))).otherwise(block(F.col("n_loose"))))
    loose_cells, last = F.sequence(F.lit(0), F.col("n_loose") - 1), F.col("n_loose") + F.col("n_tight") - 1
    met = open_.withColumn("met", F.explode(F.when(F.col("linked"), loose_cells).otherwise(F.sequence(F.lit(0), last))))
    cells = met.select("hub", F.least("side", "met").alias("i"), F.greatest("side", "met").alias("j"), "side", F.col("linked").alias("tight"), "key", "packed")
    cells = cells.repartition(parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return stars.where("linked").select(F.col("hub").alias("a"), F.col("key").alias("b")).unionByName(cells.mapInArrow(_verified(order), "a bigint, b bigint"))


def _marked(kept, name: str, inside: bool):
    """Rows whose (key, doc_id) is (``inside``) or is not in the filter, with the set's key in the column ``name`` (0: no words)."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(kept.value, dtype=np.uint8)
        for batch, texts in words.batches(rows):
            grams, offsets = _sets(texts)
            some = np.diff(offsets) > 0
            key = np.where(some, _keys(grams, offsets)[0], 0)
            own = some & _passes(bits, key, batch.column(batch.schema.get_field_index("doc_id")))
            at = pa.array(np.flatnonzero(own == inside))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(key).take(at)], names=[*batch.schema.names, name])

    return run


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the least doc_id; all columns as they are.

    Of several rows with that id and text one stays.  Rows without words all stay.  A row with a null doc_id stays only if
    nothing that it reaches has an id.  Rows that a fixed-size filter knows to stay are not shuffled; joins settle the rest.
    """
    found = stored(classes(docs, with_key=True), "classes")
    listed = found.where("n_shingles > 0").select("key", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "component_id")
    counted = listed.groupBy("key", "id", "component_id").count()
    touched = stored(counted.where("component_id <> id or count > 1").select("key", "id", F.coalesce(F.col("component_id") != F.col("id"), F.lit(False)).alias("leaves")), "touched")
    name = "set_key"
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    schema = docs.withColumn(name, F.lit(None).cast("bigint")).schema
    kept = _key_filter(touched.select("key", "id"), _sized(64 * found.count(), FILTER_BITS))
    sure = docs.mapInArrow(_marked(kept, name, False), schema)
    asked = docs.mapInArrow(_marked(kept, name, True), schema)
    known = touched.select(F.col("key").alias(f"{name}key"), F.col("id").alias(f"{name}id"), F.col("leaves").alias(f"{name}leaves"))
    joined = asked.join(known, (asked[name] == known[f"{name}key"]) & (F.coalesce(asked["doc_id"], F.lit(_NO_ID)) == known[f"{name}id"]), "left")
    staying = joined.where(~F.coalesce(F.col(f"{name}leaves"), F.lit(False)))
    # rows that come more than once: the first of each id and text
    first = F.row_number().over(Window.partitionBy("doc_id", name).orderBy(F.xxhash64("text")))
    single = staying.withColumn(f"{name}n", first).where(F.col(f"{name}n") == 1)
    return sure.select(*docs.columns).unionByName(single.select(*docs.columns))


def classes(docs: DataFrame, *, with_key: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: the least doc_id that links reach, its own included.

    Links are between sets of five-word shingles with 100 * shared >= 75 * union; equal sets are linked.  A text of
    fewer words is one shingle; a null text or one without words has none and is linked with nothing.  Repeated rows are
    equal sets.  A null doc_id takes part; its component is the least other id reached, else null.  An empty table gives
    an empty result; further columns are ignored.  ``with_key`` adds the set's hash.  Nothing is
    capped: every pair that can link meets in a task.  Only the sketch and the filter, both of a bounded size, are collected.
    """
    spark = tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_rows = docs.count()
    counters = _sized(n_rows, COUNTERS)
    profile = stored(rows.mapInArrow(_profile(counters), _PROFILE), "profile")
    own = profile.where("block is null").drop("block", "counts")
    counts = np.zeros((_BLOCKS, counters // _BLOCKS), dtype="<u4")
    for r in profile.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(_summed, "block int, counts binary").collect():
        counts[r["block"]] = np.frombuffer(r["counts"], dtype="<u4")
    order = spark.sparkContext.broadcast(counts.tobytes())

    posted = rows.select("text").mapInArrow(_postings(order), "shingle bigint, place bigint, key bigint")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = posted.repartition(parts, "shingle").sortWithinPartitions("shingle", "place", "key").mapInArrow(_meetings, "hub bigint, key bigint")
    least = own.where("n_shingles > 0").groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"))
    members = stored(met.distinct().join(least.select("key", F.coalesce("rep", F.lit(_NO_ID)).alias("rep"), "n_shingles"), "key"), "members")

    # one text of each set: that of its least id, and of copies with one id (or with none) any one, as they are equal
    picked = rows.mapInArrow(_picked(_key_filter(members.select("key", "rep").distinct(), _sized(64 * n_rows, FILTER_BITS))), "key bigint, rep bigint, packed binary")
    texts = picked.groupBy("key", "rep").agg(F.first("packed").alias("packed"))
    edges = _all_edges(members, texts, order, parts)
    roots = components(edges)

    smallest = least.groupBy("key").agg(F.min("rep").alias("rep")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    of_root = smallest.where("root is not null").groupBy("root").agg(F.min("rep").alias("component"))
    of_key = smallest.join(of_root, "root", "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = own.join(of_key, "key", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", *(["key"] if with_key else []))
