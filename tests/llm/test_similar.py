"""The Jaccard join and components against brute force."""

import random
import re
from collections import defaultdict

import pytest

from glyphmill.llm import catalog, similar
from glyphmill.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in where[g]:
                shared[j] += 1
            where[g].append(i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def family(seed, n, size, edits):
    """Copies of one text with some words replaced, other texts that share a passage with it, and short ones around it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7)))
    base, line = [word() for _ in range(size)], [word() for _ in range(20)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(size)] = word()
        out.append(own)
        out.append(line + [word() for _ in range(rng.randrange(12))])
        out.append([word() for _ in range(30)] + line)
    return [(i + 1, " ".join(w)) for i, w in enumerate(out)]


def compare(spark, rows, **changes):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((tuple(r) for r in similar.classes(df).collect()), key=repr)
    assert got == brute(rows)


def test_whole_table(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in catalog.op3_jaccard_join(spark, data).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_near_the_threshold(spark, seed):
    compare(spark, family(seed, 60, 80, 14))


def test_small_blocks_and_long_lists(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 7)
    monkeypatch.setattr(similar, "RAYS", 28)
    compare(spark, family(3, 50, 40, 6))


def test_blocks_of_few_shingles(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(similar, "RAY_SHINGLES", 900)
    compare(spark, family(4, 50, 40, 6))


def test_families_of_long_texts_are_cut_by_their_shingles(spark, monkeypatch):
    """Near copies of 1 MB each: a task holds a few of them, though they are far fewer than a block has documents."""
    import random

    monkeypatch.setattr(similar, "BLOCK_SHINGLES", 400_000)
    monkeypatch.setattr(similar, "RAY_SHINGLES", 400_000)
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(130_000)]
    rows = []
    for k in range(7):
        own = list(base)
        for i in rng.sample(range(len(own)), 1500 if k < 5 else 9000):
            own[i] = f"x{k}"
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {(r["doc_id"], r["component_id"]) for r in similar.classes(df).collect()} == set(components_of(rows))


def components_of(rows):
    sets = {}
    for k, text in rows:
        w = text.split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    up = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(up, a), find(up, b)))
                up[y] = x
    return [(k, find(up, k)) for k in sets]


def find(up, k):
    while up[k] != k:
        k = up[k]
    return k


def test_postings_that_outgrow_a_task():
    import numpy as np
    import pyarrow as pa

    key = np.arange(1, 101)
    shingle = np.where(key <= 60, 5, key)
    order = pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(similar.placed(np.full(100, 10), np.zeros(100, dtype=np.int64), key % 7)), pa.array(key)], names=["shingle", "place", "key"])
    together, similar._TOGETHER = similar._TOGETHER, 16
    try:
        found = [tuple(r.values()) for b in similar._meetings(order.slice(a, 5) for a in range(0, 100, 5)) for r in b.to_pylist()]
    finally:
        similar._TOGETHER = together
    assert len({h for h, _ in found}) == 1 and {k for _, k in found} == set(range(1, 61))


def index(texts):
    """(hub, key) pairs of some texts by the index alone, and how many postings it has."""
    import numpy as np

    raw = [t.encode() for t in texts]
    grams, offsets = similar._sets(raw)
    counts = np.bincount((grams >> similar._shift(1 << 20)).astype(np.int64), minlength=1 << 20)
    shingle, place, own = similar.postings(similar.Order(counts.astype("<u4")), grams, offsets, np.arange(len(texts)))
    shingle = (shingle & similar._SHORTENED).view(np.int64)
    order = np.lexsort((own, place, shingle))
    return similar.meetings(shingle[order], place[order], own[order]), len(shingle)


def test_one_crowded_shingle_brings_nobody_together(spark, monkeypatch):
    """Texts of two shingles, each of which 36 texts have: those that share one of them meet nobody, copies do."""
    texts = [f"y{i} are the same four x{j}" for i in range(36) for j in range(36)] + ["Y3 are the same  four x4"]
    met, n = index(texts)
    monkeypatch.setattr(similar, "CROWDED", 10**9)
    plain, n_plain = index(texts)
    assert len(plain) >= 1296 and set(met[:, 1].tolist()) == {3 * 36 + 4, 1296} and n <= 2 * n_plain
    monkeypatch.undo()
    compare(spark, list(enumerate(texts)))


@pytest.mark.parametrize("crowded", [0, 3])
def test_any_threshold_of_crowds_gives_the_same(spark, monkeypatch, crowded):
    """Lengthened documents, guests and plain ones in all mixtures."""
    rows = family(5, 40, 30, 9)
    monkeypatch.setattr(similar, "CROWDED", crowded)
    met, _ = index([t for _, t in rows])
    groups = defaultdict(set)
    for hub, key in met.tolist():
        groups[hub].add(key)
    sets = [shingles(t) for _, t in rows]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert linked and all(any(i in g and j in g for g in groups.values()) for i, j in linked)


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((tuple(r) for r in similar.classes(odd).collect()), key=repr)
    assert got == brute(rows)
    assert similar.classes(nothing).count() == 0


def test_keep_one(spark, odd, nothing):
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is not None, x or 0))
    assert ids == [1, 3, 3, 4, 5, 6, 7, 8, 9]
    assert similar.keep_one(nothing).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    around = defaultdict(set)
    for a, b in edges:
        if a != b:
            around[a].add(b)
            around[b].add(a)
    for node in around:
        seen, todo = {node}, [node]
        while todo:
            for x in around[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(around)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
