"""The pipeline's stages over odd and empty tables, and against plain versions."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from glyphmill.llm import tokens

STAGES = [stage for _, stage in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def odd_folder(odd, spark, data, tmp_path_factory):
    """The odd documents beside the small table's, with labels for some and the table's benchmark."""
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").withColumns({"score": F.lit(None).cast("string"), "key": F.lit(1.0)})
    docs = docs.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd.select("doc_id", "text", "score", "key"))
    docs.withColumns({"set_key": F.lit("s"), "quality": F.lit(1), "Label": F.lit(None).cast("int"), "piece": F.lit("p")}).write.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    labels.withColumn("doc_id", F.col("doc_id") + 1000).union(spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, 0), (5, 0, 0)], labels.schema)).write.parquet(f"{folder}/labels.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    bench.union(spark.createDataFrame([(None, "x"), (10_000, None), (10_001, "")], bench.schema)).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def one_of_each(docs):
    """(doc_id, text) rows that stay: components by comparing all pairs of sets."""
    sets = sorted({shingles(t) for _, t in docs} - {frozenset()}, key=sorted)
    up = list(range(len(sets)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    where = {}
    for k, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    for k, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < k}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                up[find(k)] = find(j)
    place = {s: find(k) for k, s in enumerate(sets)}
    least, out, seen = {}, Counter(), set()
    for i, t in docs:
        s = shingles(t)
        if s and i is not None:
            least[place[s]] = min(i, least.get(place[s], i))
    for i, t in docs:
        s = shingles(t)
        if not s:
            out[i, t] += 1
        elif i == least.get(place[s]) and (i, s) not in seen:
            seen.add((i, s))
            out[i] += 1
    return out


def test_stages_over_odd_rows(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    columns = docs.columns
    for stage in STAGES[:-1]:
        kept = stage(spark, docs, odd_folder)
        assert kept.columns == columns and not rows(kept) - rows(docs), stage
    # whatever the classifier says of odd rows, equal texts go together
    good = Counter(r["text"] or "" for r in STAGES[0](spark, docs, odd_folder).collect())
    every = Counter(r["text"] or "" for r in docs.collect())
    assert good and all(every[t] == n for t, n in good.items())


def test_one_of_each_group_against_all_pairs(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in STAGES[1](spark, docs, odd_folder).collect()]
    want = one_of_each([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter((i, t) if not shingles(t) else i for i, t in kept) == want


def test_packed_pieces_against_the_tokenizer(spark, odd_folder):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    library = tokenizers.Tokenizer.from_file(tokens.VOCABULARY)
    want = Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            part = ids[a : a + 2048]
            want[r["doc_id"], a, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids)] += 1
    got = STAGES[3](spark, docs, odd_folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_stages_over_an_empty_table(spark, odd_folder, data):
    empty = spark.read.parquet(f"{odd_folder}/documents.parquet").where("false")
    for stage in STAGES[:-1]:
        made = stage(spark, empty, odd_folder)
        assert made.columns == empty.columns and made.count() == 0
    assert STAGES[-1](spark, empty, odd_folder).count() == 0


def test_the_whole_run_over_odd_rows(spark, odd_folder):
    packed = corpus_pipeline.run(spark, odd_folder)
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    for stage in STAGES[:-1]:
        docs = stage(spark, docs, odd_folder)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()} and docs.count()
