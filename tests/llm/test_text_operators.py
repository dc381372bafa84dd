"""Quality, decontamination, licenses, fingerprints and pages."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import catalog, decontaminate, html, licenses, quality, winnow

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


# ---- quality


def test_held_out_accuracy(spark, data):
    big = data.replace("0.001", "0.01")
    got = catalog.op2_quality(spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    every = got.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in every)
    assert len(every) == spark.read.parquet(f"{big}/documents.parquet").count()


def test_labels_of_the_held_out_fold_and_zeros_do_not_matter(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_quality_of_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (None, 1, 0), (4, None, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(nothing, labels).count() == 0
    assert {r["score"] for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}
    scored = quality.score(odd, quality.fit(np.zeros((0, quality.N_FEATURES)), np.zeros((0, quality.N_FEATURES))))
    assert scored.columns == ["doc_id", "text", "key", "score"] and scored.schema["score"].dataType.simpleString() == "double"


def plain_features(text):
    """What ``features`` says of one text, step by step."""
    kind = lambda b: int(quality._CLASS[b])
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
    out = np.zeros(quality.N_FEATURES)
    if not w:
        return out
    c = quality._CLASSES
    for b in text:
        out[kind(b)] += 1 / len(text)
    for k in range(len(text) - 2):
        x, y, z = (1 if kind(b) == 2 else kind(b) for b in text[k : k + 3])
        out[c + 8 + ((((x * c + y) * c + z) * 2654435761) % 2**32 >> 26)] += 1 / (len(text) - 2)
    out[:c], out[c + 8 :] = np.sqrt(out[:c]), np.sqrt(out[c + 8 :])
    five = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]
    two = [tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))]
    n = len(w)
    out[c : c + 8] = np.log1p(n), sum(map(len, w)) / n, sum(len(x) > 12 for x in w) / n, len(set(w)) / np.sqrt(n), sum(x == y for x, y in zip(w, w[1:], strict=False)) / n, 1 - len(set(five)) / len(five), 1 - len(set(two)) / len(two), 1 - len(set(w)) / n
    return out


def test_features_against_a_plain_version():
    rng = random.Random(17)
    texts = [t.encode() for t in ("", " \n", "one", "Ab ab AB", "é日本 😀☆☆ £5!", "x" * 40, *(prose(rng, rng.randrange(1, 90)) + " again again" for _ in range(30)))]
    assert np.allclose(quality.features(texts), [plain_features(t) for t in texts], atol=1e-5)


def test_the_fit_lessens_the_non_negative_risk():
    rng = np.random.default_rng(4)
    pos, unl = rng.normal(1, 1, (300, 3)), np.vstack([rng.normal(1, 1, (280, 3)), rng.normal(-1, 1, (120, 3))])

    def risk(w, b, prior):
        """Sums over single rows, as the formula stands."""
        loss = lambda x, y: np.log1p(np.exp(-y * (float(x @ w) + b)))
        plus = prior * sum(loss(x, 1) for x in pos) / len(pos)
        return plus + max(0.0, sum(loss(x, -1) for x in unl) / len(unl) - prior * sum(loss(x, -1) for x in pos) / len(pos))

    weight, bias = quality._fit(pos, unl, 0.7, decay=0.0)
    here = risk(weight, bias, 0.7)
    assert here < risk(np.zeros(3), 0.0, 0.7)
    assert all(here <= risk(weight + d, bias + e, 0.7) + 2e-3 for d, e in ((rng.normal(0, 0.2, 3), rng.normal(0, 0.2)) for _ in range(25)))


def test_the_sample_is_bounded_when_one_id_has_most_rows(spark):
    rows = spark.range(100_000).select(F.when(F.col("id") % 3 > 0, F.lit(77)).otherwise(F.when(F.col("id") % 9 > 0, F.col("id"))).alias("doc_id"), F.concat(F.lit("some words of row "), F.when(F.col("id") % 2 == 0, F.lit("one")).otherwise(F.col("id").cast("string"))).alias("text"))
    got = quality._sample(rows, 100_000, 500)
    assert 300 < len(got) <= 500 and got.shape[1] == quality.N_FEATURES
    labels = spark.createDataFrame([(77, 1)], "doc_id bigint, quality int")
    model = quality.train(rows, labels, sample_positive=200, sample_unlabelled=300)
    assert 0 < model.prior < 1


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    pos = rng.normal(2, 1, 4000)
    unl = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert quality.estimate_prior(pos, unl) == pytest.approx(0.7, abs=0.06)


# ---- decontamination


@pytest.fixture(scope="module")
def bench_case(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randrange(15, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "too short")]
    docs, expected = [(k, prose(rng, rng.randrange(40, 300))) for k in range(150)], set()
    for k in range(0, 150, 5):
        item = items[rng.randrange(30)]
        own = item[1].split()
        for _ in range(len(own) // 8 * (k % 2)):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        docs[k] = (k, docs[k][1] + " " + " ".join(own).upper() + " " + prose(rng, 30))
        expected.add((k, item[0]))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), expected


def test_planted_passages_are_found_and_others_left_alone(bench_case):
    docs, items, expected = bench_case
    rows = decontaminate.leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == expected
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    passages = {r["item_id"]: r["text"].upper().split() for r in items.where("item_id < 90").collect()}
    for r in rows:
        found = texts[r["doc_id"]][r["start_byte"] : r["end_byte"]].decode().upper().split()
        assert len(set(found) & {w.strip(".") for w in passages[r["item_id"]]}) >= 0.5 * len(set(passages[r["item_id"]]))
    kept = {r["doc_id"] for r in decontaminate.clean(docs, items).collect()}
    assert kept == set(texts) - {d for d, _ in expected}


def test_items_in_turns_give_the_same(bench_case, monkeypatch):
    docs, items, expected = bench_case
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 11)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == expected


def test_given_answers_are_used(spark):
    rng = random.Random(9)
    text = prose(rng, 40)
    half = " ".join(text.split()[20:])
    docs = spark.createDataFrame([(k, prose(rng, 120)) for k in range(40)] + [(99, prose(rng, 50) + " " + half + " " + prose(rng, 50))], "doc_id bigint, text string")
    item = lambda a: spark.createDataFrame([(1, text, a)], "item_id bigint, text string, answer string")
    assert [r["doc_id"] for r in decontaminate.leaks(docs, item(" ".join(text.split()[30:]))).collect()] == [99]
    assert decontaminate.leaks(docs, item(" ".join(text.split()[:10]))).count() == 0


def test_short_items_among_rare_words_and_short_benchmarks(spark):
    rng = random.Random(21)
    common = [f"c{i}" for i in range(40)]
    docs = [(k, " ".join(rng.choice(common) for _ in range(60))) for k in range(60)]
    items = [(n, " ".join(f"q{n}x{i}" for i in range(n))) for n in (1, 3, 5, 6, 7, 9, 12)]
    often = " ".join(t for _, t in items)
    docs += [(100 + k, " ".join(rng.sample(often.split(), 30))) for k in range(30)]  # their words are not rare
    rare = lambda k, n: " ".join(f"r{k}y{i}" for i in range(n))
    placed = [(1000 + 10 * n + s, n, f"{rare(1000 + 10 * n + s, 30 + s)} {t} {rare(2000 + 10 * n + s, 33)}") for n, t in items for s in range(4)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs + [(d, t) for d, _, t in placed], "doc_id bigint, text string")
    found = decontaminate.leaks(df, bench).where("doc_id >= 1000").collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, n) for d, n, _ in placed}
    texts, wanted = {d: t.encode() for d, _, t in placed}, dict(items)
    assert all(texts[r["doc_id"]][r["start_byte"] : r["end_byte"]].decode() == wanted[r["item_id"]] for r in found)
    few = decontaminate.leaks(df, bench.where("item_id in (3, 5)")).where("doc_id >= 1000").collect()
    assert {(r["doc_id"], r["item_id"]) for r in few} == {(d, n) for d, n, _ in placed if n in (3, 5)}


@pytest.mark.parametrize("changed", [0.0, 0.2, 0.35])
def test_recall_of_paraphrases(spark, changed):
    """Words replaced at random in passages of 8 to 90 words."""
    rng = random.Random(int(100 * changed))
    items = [(i, prose(rng, rng.randrange(8, 90))) for i in range(60)]
    docs = [(1000 + k, prose(rng, rng.randrange(40, 300))) for k in range(100)]
    for i, text in items:
        own = text.split()
        for k in rng.sample(range(len(own)), int(changed * len(own))):
            own[k] = rng.choice(WORDS)
        docs.append((i, prose(rng, rng.randrange(5, 80)) + " " + " ".join(own) + " " + prose(rng, rng.randrange(5, 80))))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert sum((i, i) in pairs for i, _ in items) >= (60 if changed < 0.3 else 48) and not any(d >= 1000 for d, _ in pairs)


def test_windows_of_which_a_third_is_the_benchmark_s():
    own = [f"k{i}" for i in range(13)] + [f"v{i}" for i in range(7)]
    idf = np.full(decontaminate.BUCKETS, 3.0)
    text = " ".join(own)
    changed = [f"z{i}" for i in range(7)]
    hashed = decontaminate.words.word_spans([" ".join(changed).encode()], decontaminate.words.MARKS)[0]
    idf[decontaminate._bucket(hashed)] = 6.0  # what stands in place of seven words is rarer
    bench = decontaminate.passages([(1, text, None), (2, " ".join(f"o{i}" for i in range(20)), None)], idf)
    rows = np.zeros((2, len(bench.vocabulary)))
    for k, h in enumerate(bench.hashed):
        rows[k, np.searchsorted(bench.vocabulary, decontaminate._bucket(h))] = 3.0
    basis = np.linalg.svd(rows, full_matrices=False)[2].T
    mixed = []
    for k in range(13):
        mixed += [own[k], *changed[k // 2 : k // 2 + (k % 2)]]
    found = decontaminate.Searcher(bench, idf, basis).hits([(" ".join([*mixed, changed[6]])).encode()])
    assert [h[1] for h in found] == [1] and found[0][5] == pytest.approx(0.65)


def test_randomised_svd_is_the_svd(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 25))
    rows = spark.createDataFrame([(list(range(25)), r.tolist()) for r in a], "at array<int>, value array<double>").repartition(3)
    v = decontaminate.randomised_svd(rows, 25, 6)
    exact = np.linalg.svd(a)[2][:6].T
    assert np.allclose(v @ v.T, exact @ exact.T, atol=1e-6)


def test_subsequence_is_the_heaviest():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b, w = rng.integers(0, 4, 7), rng.integers(0, 4, 8), rng.random(7)
        mask = decontaminate.subsequence(a, b, w)

        def fits(at):
            it = iter(b.tolist())
            return all(a[i] in it for i in at)

        best = max(w[list(c)].sum() for n in range(8) for c in combinations(range(7), n) if fits(c))
        assert fits(np.flatnonzero(mask)) and w[mask].sum() == pytest.approx(best)


def test_decontamination_of_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id bigint, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in decontaminate.leaks(odd, bench).collect())
    assert got == [(False, 0), (True, 1), (True, 1), (True, 2), (True, 7)]
    assert decontaminate.leaks(nothing, bench).count() == 0 and decontaminate.leaks(odd, bench.where("false")).count() == 0
    assert decontaminate.clean(odd, bench.where("false")).count() == odd.count() and decontaminate.clean(odd, bench).columns == odd.columns


# ---- licenses


def bag(text):
    w = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_license_lines_of_the_table(spark, data):
    docs = [(r["doc_id"], bag(r["text"])) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    expected = {(d, n) for d, s in docs for n, t in licenses.TEMPLATES.items() if len(s & bag(t)) >= 0.75 * len(bag(t))}
    assert {(r["doc_id"], r["template"]) for r in catalog.op4_license_scan(spark, data).collect()} == expected and expected


def test_templates_inside_other_texts():
    rng = random.Random(6)
    s = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for _ in range(6):
            own = text.split()
            if len(own) > 40:
                own[rng.randrange(len(own))] = "changed"
            doc = prose(rng, rng.randrange(60)) + "\n" + " ".join(own) + "\n" + prose(rng, rng.randrange(60))
            hits = [m for m in s.matches([b"", doc.encode(), b"x"]) if m[1] == name]
            assert len(hits) == 1 and hits[0][0] == 1 and hits[0][4] >= 0.75
            assert " ".join(own[2:-2])[60:-60] in doc.encode()[hits[0][2] : hits[0][3]].decode()
    assert s.matches([prose(rng, 300).encode()]) == [] and licenses.Scanner({}).matches([b"a b c"]) == []


def test_license_scan_of_odd_rows(odd, nothing):
    own = {"numbers": "four five six seven eight nine"}
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in licenses.scan(odd, own).collect())
    assert got == [(False, 0), (True, 1), (True, 1), (True, 2), (True, 7)]
    assert licenses.scan(nothing).count() == 0


# ---- fingerprints


def windows(text, hashed, k=winnow.K, w=winnow.W):
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] if len(text) >= k else [text] if text else []
    marks = [(hashed[g], -i) for i, g in enumerate(grams)]
    return list(dict.fromkeys(min(marks[i : i + w]) for i in range(max(1, len(marks) - w + 1)))) if marks else []


def gram_hashes(spark, texts, k=winnow.K):
    """The hash of each gram, rolled code point by code point in Python; the values of code points are Spark's."""
    mixed = lambda values: {r["x"]: r["h"] for r in spark.createDataFrame([(v,) for v in values], "x bigint").select("x", F.shiftright(F.xxhash64("x"), 32).alias("h")).collect()}
    told = lambda strings: {r["x"]: r["h"] for r in spark.createDataFrame([(v,) for v in strings], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    value, raw = told(sorted({c for t in texts for c in t})), {}
    short = told(sorted({t for t in texts if 0 < len(t) < k}))
    for t in texts:
        h = 0
        for i, c in enumerate(t):
            h = ((h << (64 // k)) ^ (value[c] & (1 << 64) - 1)) & (1 << 64) - 1
            if i >= k:
                h ^= ((value[t[i - k]] & (1 << 64) - 1) << (64 // k * k)) & (1 << 64) - 1
            if i >= k - 1:
                raw[t[i - k + 1 : i + 1]] = h - (1 << 64) if h >> 63 else h
    raw |= short
    final = mixed(sorted(set(raw.values())))
    return {g: final[h] for g, h in raw.items()}


def test_fingerprints_against_brute_force(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(70)
    odd_rows = [(900, "abc"), (901, None), (902, ""), (903, "x" * 30), (904, "x" * 30), (None, "no id one two three four five"), (50000, "é日本" * 9), (903, "an id of two rows, with enough text for windows"), (905, "so many code points"), (906, "s" * 18), (907, "😀 and more 𝔘 than that" * 4), (908, "long " * 40_000)]
    d = d.unionByName(spark.createDataFrame(odd_rows, d.schema)).withColumn("next", F.lit(1)).withColumn("part", F.lit("x"))
    rows = sorted(((r[0], r[1] or "", r[2]) for r in d.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    n = len(rows)
    edited = [t[: len(t) - len(t) // 2] + rows[(i + 1) % n][1][: len(t) // 2] for i, (_, t, _) in enumerate(rows)]
    every = [t for _, t, _ in rows] + edited
    hashed = gram_hashes(spark, every)
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    expected = []
    for i, (key, t, _) in enumerate(rows):
        own, other, following = ({h for h, _ in windows(x, hashed)} for x in (t, edited[i], rows[(i + 1) % n][1]))
        expected.append((key, len(t), hashlib.sha256(edited[i].encode()).hexdigest(), round(near(own, other), 9), round(near(own, following), 9)))
    for size in (9, 5000):
        found = winnow.edited_fingerprints(d, rows_per_range=size).collect()
        assert sorted(map(repr, expected)) == sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9))) for r in found)
    again = {(r["t"]): r["f"] for r in winnow.with_fingerprint(spark.createDataFrame([(t,) for t in every], "t string"), "t", "c").select("t", winnow.digest("c").alias("f")).collect()}
    by_edit = {r["edited_sha256"]: r["edited_fingerprint"] for r in found}
    assert all(by_edit[hashlib.sha256(e.encode()).hexdigest()] == again[e] for e in edited)
    plain = winnow.fingerprints(d).where("doc_id in (50000, 907)").collect()
    for r, text in zip(sorted(plain, key=lambda r: r["doc_id"]), (odd_rows[10][1], odd_rows[6][1]), strict=True):
        assert [(c["hash"], -c["place"]) for c in r["chosen"]] == windows(text, hashed)


def test_a_document_equal_to_another_s_edited_text(spark):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("😀𝔘abcdef gh") for _ in range(n))
    texts = [make(n) for n in (100, 90, 31, 200, 19, 18, 17, 5)]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:], strict=False)]
    rows = {r["doc_id"]: r for r in winnow.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(edited)], "doc_id bigint, text string")).collect()}
    assert all(rows[i]["edited_fingerprint"] == rows[100 + i]["fingerprint"] for i in range(len(edited)))


def test_ranges_in_two_levels(spark, monkeypatch):
    from glyphmill.llm import ranges as module

    df = spark.range(0, 6000, 3).select(F.when(F.col("id") % 999 != 0, F.col("id")).alias("key"))
    one = module.ranges(df, "key", 20)
    monkeypatch.setattr(module, "MOST_COARSE", 10)
    two = module.ranges(df, "key", 20)
    assert len(one.groups) == 1 and len(two.groups) > 1 and abs(len(two) - 100) < 15
    for cuts in (one, two):
        starts = cuts.starts
        assert starts == sorted(set(starts))
        for r in cuts.numbered(df, "key", "at", "start").collect():
            k = max(0, sum(s <= (r["key"] if r["key"] is not None else -1) for s in starts) - 1)
            assert r["at"] == k and (r["key"] is None or r["start"] == starts[k])
    assert len(module.ranges(df.where("key is null"), "key", 5)) == 0 and module.ranges(df, "key", 20, 4).starts[0] == 3


def test_shared_runs_share_a_hash(spark):
    run = "a shared run of text"[: winnow.K + winnow.W - 1]
    rows = spark.createDataFrame([("xyzw" * 5 + run + "0123456789" * 2,), (run + "qwertyuiop" * 3,)], "t string")
    a, b = (set(r["h"]) for r in winnow.with_fingerprint(rows, "t", "c").select(winnow.hashes("c").alias("h")).collect())
    assert a & b


def test_reuse_with_characters_beyond_the_first_plane(spark):
    """Places are code points, and an edited text has the fingerprint of the same text by itself."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("😀𝔘𐍈abc d") for _ in range(n)) for n in (1, 11, 12, 13, 40, 80, 200, 333)] + ["😀" + "abcdefgh" * 20, "no such sign " * 12]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in winnow.edited_fingerprints(df).collect()}
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    both = spark.createDataFrame([(t,) for t in texts + edited], "t string")
    alone = {r["t"]: r for r in winnow.with_fingerprint(both, "t", "c").select("t", winnow.digest("c").alias("f"), winnow.places("c").alias("at")).collect()}
    for k, (text, other) in enumerate(zip(texts, edited, strict=True)):
        assert rows[k]["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest()
        assert (rows[k]["fingerprint"], rows[k]["edited_fingerprint"]) == (alone[text]["f"], alone[other]["f"])
    grams = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.size(winnow.grams(F.col("t"))).alias("n")).collect()
    assert all(r["n"] == max(1, len(r["t"]) - winnow.K + 1) for r in grams)


def test_fingerprints_of_few_rows(spark, nothing):
    assert winnow.edited_fingerprints(nothing).count() == 0 and winnow.fingerprints(nothing).count() == 0
    one = spark.createDataFrame([(1, "only this document, which is its own next one")], "doc_id bigint, text string")
    r = winnow.edited_fingerprints(one).first()
    assert r["near_next"] == 1.0
    none = spark.createDataFrame([(None, "a"), (None, None)], "doc_id bigint, text string")
    assert winnow.edited_fingerprints(none).count() == 2


def test_pieces_of_texts_meet(spark):
    """Texts that end around the borders of pieces, for other grams and windows too: as one text in one go."""
    rng = random.Random(13)
    for k, w in ((winnow.K, winnow.W), (5, 4), (16, 16)):
        step = max(winnow.STEP, k + 2 * w - 1)
        sizes = [n + d for n in (k, k + w - 1, step, step + k + w - 2, 2 * step, 2 * step + k + w - 2, 2 * (step + k + w)) for d in (-1, 0, 1)]
        texts = ["".join(rng.choice("😀é日abab \n") for _ in range(n)) for n in rng.sample(sizes, len(sizes))] + ["ab" * 300, "", "c" * 500]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
        rows = winnow.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), k=k, w=w).collect()
        whole = winnow.with_fingerprint(spark.createDataFrame([(t,) for t in {*texts, *edited}], "t string"), "t", "c", k=k, w=w)
        alone = {r["t"]: r["f"] for r in whole.select("t", winnow.digest("c").alias("f")).collect()}
        assert {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"]) for r in rows} == {i: (alone[t], alone[e]) for i, (t, e) in enumerate(zip(texts, edited, strict=True))}


def test_code_points_of_long_texts_are_not_interpreted(spark, data):
    """Functions over array elements read the code points of texts below one window alone: interpreted ones are too slow for tables of some GB."""
    plan = catalog.op7_fingerprints(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"transform\(split\((?:doc#\d+\.)?(\w+)", plan)) <= {"short", "edited_short"}


def test_fingerprints_use_no_python(spark, data):
    plan = catalog.op7_fingerprints(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href=1>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as all do, and so on.</p></div>{main}<aside>More</aside>
<section id="comments"><p>I think this is wrong, and long enough, too.</p></section><form><p>Sign up, please.</p></form><script>x="</p>"</script><footer>&copy; us</footer></body></html>"""
BODY = "<h1>The  title</h1><p>A first paragraph, with &amp; and&nbsp;more; it is long enough.<p>Short.<p><b>Bold <i>and</i></b> so<br>on, a last paragraph.<ul><li>one<li>two</ul>"
TEXT = "The title\nA first paragraph, with & and more; it is long enough.\nShort.\nBold and so on, a last paragraph.\none\ntwo"


@pytest.mark.parametrize("main", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class=content>{}</div>", "<div id=story class='post no-sidebar'>{}</div>"])
def test_main_text(main):
    assert html.main_text(PAGE.replace("{main}", main.format(BODY))) == TEXT


def test_parts_inside_the_main_part():
    page = "<body><article><header class='entry-header'><h1>Title</h1></header><p>Text of the article, with enough words in it.</p><div class='ad-slot ad'>Buy now, it is cheap, really.</div>"
    page += "<aside><p>Related, and long enough to be text.</p></aside><p>More text, to the end.</p><div class='share-buttons share'>Share this</div><ol class=commentlist><li>A reader's remark, not short.</li></ol><footer>Tags: a, b</footer></article></body>"
    assert html.main_text(page) == "Title\nText of the article, with enough words in it.\nMore text, to the end."
    remarks = "<main><article class='post hentry'><h1>A</h1><p>The text, as it was written by its author.</p></article><section><article class='comment depth-1'><p>A remark by a reader, long enough.</p></article></section></main>"
    assert html.main_text(remarks) == "A\nThe text, as it was written by its author."
    table = "<table><tr><td class=menu><a href=1>A</a><a href=2>B</a></td><td><p>Old pages were laid out in tables, with text like this one.</p><p>Yes.</p></td></tr></table><div class=footer>bye</div>"
    assert html.main_text(table) == "Old pages were laid out in tables, with text like this one.\nYes."


def test_scores_decide_where_article_elements_are_small_boxes():
    story = "".join(f"<p>Part {i} of the story, told at some length, with marks; it goes on, and on.</p>" for i in range(12))
    cards = "".join(f"<article class=card><h3>Card {i}</h3><p>A short text</p></article>" for i in range(4))
    got = html.main_text(f"<body><div class=story><h1>Story</h1>{story}</div><section>{cards}</section></body>").split("\n")
    assert [x for x in got if x.startswith("Part")] == [f"Part {i} of the story, told at some length, with marks; it goes on, and on." for i in range(12)] and "Story" in got


def test_linked_sources_of_an_article_are_kept_and_a_menu_is_not():
    text = "<h1>T</h1><p>The text of it, as long as text is, in whole sentences.</p><p>More text, with marks, of course.</p>"
    links = "".join(f"<li><a href=/{i}>Source {i}</a>" for i in range(5))
    for tag in ("article", "main", "div"):
        assert html.main_text(f"<body><{tag}>{text}<ul>{links}</ul></{tag}></body>").endswith("Source 3\nSource 4")
    assert html.main_text(f"<body>{text}<ul>{links}</ul></body>").endswith("of course.")


def test_deep_pages_take_time_in_proportion():
    import time

    page = "<div>" * 8000 + "".join(f"<p>Text node {i}, of some length.<i>x</i>" for i in range(8000))
    began = time.perf_counter()
    assert html.main_text(page).count("\n") == 7999 and time.perf_counter() - began < 5


def test_pages_of_the_table(spark, data):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = catalog.op6_main_text(spark, data).collect()
    assert len(rows) == len(pages)
    import html as entities

    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:h1|p|ul|li|div)[^>]*>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "plain"), (3, "u", "<p"), (4, "u", "<p>a<script>"), (5, "u", "<div>" * 4000 + "deep" + "</div>"), (6, "u", "a < b && c &#x41; <!-- gone"), (7, "u", "<nav>only a menu</nav>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")).collect()}
    assert got == {1: "", None: "", 2: "plain", 3: "", 4: "a", 5: "deep", 6: "a < b && c A", 7: ""}
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
