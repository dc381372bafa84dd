"""Hard negatives, whitening and nearest neighbours, against plain versions."""

import itertools
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import catalog, negatives, neighbours, vectors, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, code int, vector double"


def rows_of(rng, n, dim=6, labels=3, scale=0.4):
    return [(int(i), [float(np.float32(c)) for c in rng.normal(0, scale, dim)], int(rng.integers(labels))) for i in range(n)]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """A third of the rows are copies of one; ids and rows repeat; and whatever a row may lack."""
    rng = np.random.default_rng(5)
    rows = rows_of(rng, 300)
    rows += [(i, rows[100][1], 1) for i in range(300, 460)]
    rows += [rows[100], rows[100], (100, rows[7][1], 2), (200, None, 1), (None, rows[3][1], 1), (207, rows[3][1], None)]
    rows += [(300, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (400, [float("nan")] * 6, 1), (500, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], 1), (600, [], 1), (700, [1.0, 2.0], 1), (800, [0.0] * 6, 0)]
    return rows, spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], SCHEMA).repartition(5)


def usable(rows, label=True, dim=6):
    return [r for r in rows if r[0] is not None and r[1] and (not label or r[2] is not None) and len(r[1]) == dim and all(c is not None and math.isfinite(c) for c in r[1])]


# ---- lists of best rows


def test_best_lists_merge_in_any_order():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 12, (7, 500)), rng.permutation(500)
    for kind in (np.int64, np.float64):
        best = vectors.Best(7, 4, kind)
        for part in np.array_split(rng.permutation(500), 9):
            best.offer(slice(0, 5), scores[:5, part].astype(kind), ids[part], scores[:5, part] != 3)
            best.offer(slice(5, 7), scores[5:, part].astype(kind), ids[part], scores[5:, part] != 3)
        for line in range(7):
            plain = sorted((-s, i) for s, i in zip(scores[line].tolist(), ids.tolist(), strict=True) if s != 3)[:4]
            assert list(zip((-best.scores[line]).tolist(), best.ids[line].tolist(), strict=True)) == plain


# ---- hard negatives


def plain_negatives(rows, dim=6):
    """Row by row, in whole numbers of any size."""
    known = [(i, label, [math.floor(256 * c) for c in x]) for i, x, label in usable(rows, dim=dim)]
    out = []
    for k, (anchor, own, x) in enumerate(known):
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i, label) for j, (i, label, y) in enumerate(known) if j != k)
        for s, i, _ in [t for t in scored if t[2] == own][:5]:
            fit = [(-t[0], t[1]) for t in scored if t[2] != own and 30 * -s <= 100 * -t[0] <= 90 * -s]
            out += [(anchor, i, rank, n, -s, score) for rank, (score, n) in enumerate(fit[:10], 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_of_odd_rows(odd_vectors):
    rows, df = odd_vectors
    want = plain_negatives(rows)
    assert len(want) > 100
    assert told(negatives.mine(df, F.col("vec_id") % 100 == 0)) == want
    assert told(negatives.mine(df, F.col("vec_id") % 100 == 0, values=30)) == want  # a block for every few anchors


def test_hard_negatives_of_the_table(spark, data):
    rows = [(r["vec_id"], list(r["embedding"]), (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = plain_negatives(rows, dim=64)
    assert told(catalog.op11_hard_negatives(spark, data)) == want and len(want) > 50
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    got = sql.sql(catalog.oracle_sql()["op11_hard_negatives"]).fetchall()
    assert sorted(got) == want


def test_hard_negatives_without_rows_anchors_or_other_labels(spark, odd_vectors):
    _, df = odd_vectors
    for part in (df.where("false"), df.where("vec_id % 100 = 1"), df.where("label = 1")):
        assert told(negatives.mine(part, F.col("vec_id") % 100 == 0)) == []


def test_products_are_exact_beyond_doubles():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(-(1 << 29), 1 << 29, (5, 8)).astype(float) for _ in range(2))
    assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    with pytest.raises(ValueError):
        negatives.products(np.full((1, 4), 2.0**39), np.full((1, 4), 2.0**39))
    with pytest.raises(ValueError):
        negatives.components(np.array([[1e30]]))


def test_windows_are_exact_at_their_ends():
    for p in (*range(-30, 120), 10**15 + 7):
        least, most = negatives.window(p)
        assert [s for s in range(least - 2, min(most, least + 400) + 3) if 30 * p <= 100 * s <= 90 * p][:3] == [*range(least, min(most, least + 400) + 1)][:3]
        assert 100 * most <= 90 * p < 100 * (most + 1) and 100 * (least - 1) < 30 * p <= 100 * least


# ---- whitening


def test_cross_products_of_any_size():
    rng = np.random.default_rng(3)
    for top in (600, 1 << 21, 1 << 44, 1 << 61):
        z = rng.integers(-top, top, (300, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert whiten.cross(z).tolist() == want


def test_scatter_is_exact_over_tasks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 3)) * [1, 1e6, 1e12]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id bigint, embedding array<double>").repartition(7)
    n, sums, scatter = whiten.exact_scatter(vectors.usable(df, "embedding", F.col("vec_id")), 3)
    y = [[math.floor(Fraction(1024) * Fraction(c)) for c in r] for r in x.tolist()]
    assert n == 200 and sums == [sum(c) for c in zip(*y, strict=True)]
    assert scatter.tolist() == [[n * sum(r[i] * r[j] for r in y) - sums[i] * sums[j] for j in range(3)] for i in range(3)]


def check_whitened(rows, got):
    known = [(i, [math.floor(1024 * c) + 100000 for c in x]) for i, x in rows]
    n, dim = len(known), len(known[0][1])
    total = [sum(x[d] for _, x in known) for d in range(dim)]
    digits = {}
    for i, x in known:
        digits.setdefault(i, []).append(sum((n * x[d] - total[d]) ** 2 for d in range(dim)))
    xs = np.array([x for _, x in known], float)
    value, vector = np.linalg.eigh(np.cov((xs - xs.mean(axis=0)).T, bias=True))
    value, vector = value[::-1], vector[:, ::-1]
    k = min(8, dim)
    assert len(got) == n * k and all(r["n"] == n and r["identity_error"] < 1e-9 for r in got) and len({r["identity_error"] for r in got}) == 1
    signs = {}
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert int(r["deviation_digits"]) in digits[r["vec_id"]] and r["deviation"] == int(r["deviation_digits"])
        assert abs(r["explained"] - value[r["component"] - 1] / value.sum()) < 1e-9
    for c in range(1, k + 1):
        plain = {}
        for (i, _), x in zip(known, xs, strict=True):
            plain.setdefault(i, []).append(float((x - xs.mean(axis=0)) @ vector[:, c - 1] / math.sqrt(value[c - 1])))
        first = max(plain, key=lambda i: abs(plain[i][0]))
        signs[c] = math.copysign(1, plain[first][0] * by_row[first, c][0]["whitened"])
        for i, w in plain.items():
            assert np.allclose(sorted(signs[c] * v for v in w), sorted(r["whitened"] for r in by_row[i, c]), atol=1e-7)


def test_whitening_of_odd_rows(odd_vectors):
    rows, df = odd_vectors
    known = [(i, x) for i, x, _ in rows if x and len(x) == 6 and all(c is not None and math.isfinite(c) for c in x)]
    check_whitened(known, whiten.whiten(df).collect())


def test_whitening_of_the_table(spark, data):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check_whitened(rows, catalog.op12_whitening(spark, data).collect())


def test_whitening_without_variance(spark, odd_vectors):
    _, df = odd_vectors
    for part in (df.where("false"), df.where("vec_id = 5"), df.where("vec_id between 300 and 350 and embedding[1] is not null")):
        assert whiten.whiten(part).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(20)], "vec_id bigint, embedding array<double>")
    got = whiten.whiten(flat).collect()
    assert len(got) == 20 and {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_deviations_beyond_a_long(spark):
    y = np.array([[1 << 40, 3], [-(1 << 40), 5]])
    d, squares = whiten.deviations(y, 1 << 30, [12, 7])
    want = [[(1 << 30) * int(c) - s for c, s in zip(r, (12, 7), strict=True)] for r in y]
    assert d.tolist() == want and squares == [sum(v * v for v in r) for r in want]
    big = spark.createDataFrame([(i, [3e9 * i, 1.0]) for i in range(3)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r for r in whiten.whiten(big).collect()}
    assert got[0]["deviation"] is None and int(got[0]["deviation_digits"]) == (3 * 1024 * 3_000_000_000) ** 2 and got[1]["deviation"] == 0


# ---- nearest neighbours


def plain_nearest(rows, k=5, every=50):
    known = [(i, np.array(x, float)) for i, x in rows]
    known = [(i, x / 1.0, math.sqrt(float((x * x).sum()))) for i, x in known]
    out = []
    for a, (q, x, n) in enumerate(known):
        if q % every == 0:
            scored = sorted((-round(float((x * y).sum()) / (n * m), 10), i) for b, (i, y, m) in enumerate(known) if a != b)
            out.append((q, [(i, -s) for s, i in scored[:k]]))
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 10)))
    return out


def test_nearest_of_odd_rows(odd_vectors):
    rows, df = odd_vectors
    known = [(i, x) for i, x, _ in usable(rows, label=False) if any(x)]
    want = {}
    for q, found in plain_nearest(known):
        want.setdefault(q, []).append(found)
    index = neighbours.build(df, fit_rows=64)
    assert index.rows.count() == index.n == len(known)
    for values, shard in ((10**6, 10**6), (60, 200)):
        got = neighbours.search(index, F.col("vec_id") % 50 == 0, values=values, shard_values=shard).collect()
        assert len(got) == sum(len(f) for each in want.values() for f in each)
        hit = total = 0
        for q, each in want.items():
            mine = [(r["rank"], r["vec_id"], round(r["score"], 10)) for r in got if r["query_id"] == q]
            assert sorted(r for r, _, _ in mine) == sorted([*range(1, 6)] * len(each))
            plain = [x for f in each for x in f]
            hit += sum(min(plain.count(x), [m[1:] for m in mine].count(x)) for x in set(plain))
            total += len(plain)
        assert hit >= 0.97 * total


def test_recall_on_the_tables(spark, data):
    for folder in (data, data.replace("0.001", "0.1")):
        rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
        want, got = dict(plain_nearest(rows)), answers(catalog.op13_nearest(spark, folder))
        assert set(got) == set(want) and all(len(f) == 5 for f in got.values())
        assert sum(len(set(f) & set(got[q])) for q, f in want.items()) >= 0.95 * 5 * len(want)


def test_nearest_without_rows_queries_or_partners(spark, odd_vectors):
    _, df = odd_vectors
    for part in (df.where("false"), df.where("vec_id % 50 = 1"), df.where("vec_id = 150"), df.where("vec_id = 800")):
        assert neighbours.search(neighbours.build(part), F.col("vec_id") % 50 == 0).count() == 0
    few = neighbours.search(neighbours.build(df.where("vec_id in (50, 51, 52)")), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [51, 52]


@pytest.mark.parametrize("bits", [64, 256])
def test_probing_finds_every_code_within_the_radius(bits):
    rng = np.random.default_rng(bits)
    code = rng.integers(0, 256, (400, bits // 8)).astype(np.uint8)
    for i in range(1, 400, 2):  # near copies, at all distances
        flip = rng.permutation(bits)[: i % 50]
        code[i] = code[i - 1] ^ np.packbits(np.isin(np.arange(bits), flip))
    index = neighbours.MultiIndex(code)
    apart = np.bitwise_count(code[:, None, :] ^ code[None]).sum(axis=2)
    for q, r in itertools.product(range(0, 60, 7), (0, 1, 2, 7, 8, 15, 16, 31, 40, bits // 3, bits)):
        want = np.flatnonzero(apart[q] <= r)
        for lengths in ((8,), (16,)) if r < bits // 2 else ((8,),):
            assert np.array_equal(neighbours.MultiIndex(code, lengths).within(code[q], r), want)
        assert np.array_equal(index.within(code[q], r), want)


def test_rotations_are_learned():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (500, 20)) * np.linspace(3, 0.1, 20)
    x /= np.linalg.norm(x, axis=1)[:, None]
    gap = lambda r: sum(float((np.abs(x @ r[:, i : i + 20]) - 1 / math.sqrt(20)).__pow__(2).sum()) for i in (0, 20, 40))
    assert gap(neighbours.learned(x, 64)) < 0.9 * gap(neighbours.learned(x, 64, rounds=0))
    assert np.allclose(neighbours.learned(x, 64)[:, :20].T @ neighbours.learned(x, 64)[:, :20], np.eye(20))
    assert neighbours.learned(rng.normal(0, 1, (300, 100)), 64).shape == (100, 64)
