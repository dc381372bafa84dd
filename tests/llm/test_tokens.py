"""Token ids, packing and the id files, against the library itself."""

import zlib

import numpy as np
import pytest

from glyphmill.llm import catalog, idstore, packing, tokens

ODD = ["", "  ", "İstanbul ΣΑΣ it'ś a b", "é x<|endoftext|>y <|startoftext|>", " a\x1cb\x0bc'LL", "日本語 text’s 123 ½", "a,.b. c,, d!!", "word. word, word word's", "\r\n\t", "ÀÉ é", "(a) b) c;d"]


def whole(text):
    return tokens._kept(tokens.VOCABULARY).library.encode(text or "", add_special_tokens=False).ids + [1]


def test_words_give_the_ids_of_the_whole_text(spark, data):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    for limit in (50, tokens.TABLE_WORDS):
        e = tokens.Encoder(tokens.VOCABULARY, limit)
        assert e.by_word
        for a in range(0, len(texts), 23):
            ids, offsets = e.encode_ended(texts[a : a + 23])
            for i, t in enumerate(texts[a : a + 23]):
                assert ids[offsets[i] : offsets[i + 1]].tolist() == whole(t), t


def test_other_definitions_go_to_the_library_whole():
    import public_tokenizers

    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.by_word
    ids, counts = e.encode(["the  cat", ""])
    assert ids.tolist() == e.library.encode("the  cat").ids and counts.tolist() == [len(ids), 0]


def test_first_fit_decreasing_is_the_plain_loop():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 101, rng.integers(0, 60))
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free, expected = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            b = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
            if b is None:
                b = len(free)
                free.append(100)
            expected[i] = (b, 100 - free[b])
            free[b] -= sizes[i]
        assert [(b, o) for b, o in zip(bins, offsets)] == [expected[i] for i in range(len(sizes))]


def check_pieces(frame, rows, capacity):
    """Every id in exactly one piece, sequences gapless and within the capacity."""
    left = sorted((None if d is None else d, s, n, c, t) for d, s, n, c, t in (
        (d, a, min(capacity, len(ids) - a), zlib.crc32(np.array(ids[a : a + capacity], dtype="<u4").tobytes()), len(ids)) for d, text in rows for ids in [whole(text)] for a in range(0, len(ids), capacity)
    )) if all(d is not None for d, _ in rows) else None
    got = [tuple(None if x != x else int(x) for x in r) for r in frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype("float64").values.tolist()]
    if left is not None:
        assert sorted(got) == left
    for _, own in frame.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= capacity
    return got


def test_packing_of_whole_tables(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    frame = catalog.op5_packing(spark, data).toPandas()
    check_pieces(frame, rows, 2048)
    used = frame.groupby("sequence_id")["length"].sum()
    assert sum(2048 - n for n in used) < 0.03 * used.sum()


def test_packing_of_odd_rows(spark, odd, nothing):
    frame = packing.pack(odd, capacity=64, group_documents=4, with_ids=True).toPandas()
    got = check_pieces(frame, [(r["doc_id"], r["text"]) for r in odd.collect()], 64)
    assert len([g for g in got if g[0] is None]) >= 1 and [g for g in got if g[0] == 4][0][4] == 1
    assert all(zlib.crc32(np.array(i, dtype="<u4").tobytes()) == c for i, c in zip(frame["ids"], frame["ids_crc32"]))
    assert packing.pack(nothing).count() == 0


def test_copies_of_a_row_are_spread_over_groups(spark):
    copies = spark.range(3000).selectExpr("7L as doc_id", "'the same words in every row' as text").unionByName(spark.range(100).selectExpr("id as doc_id", "concat('row ', id) as text"))
    frame = packing.pack(copies, group_documents=100).toPandas()
    size = frame.groupby(frame["sequence_id"] // 2**32).size()
    assert len(frame) == 3100 and len(size) == 31 and size.max() < 200


def test_files_of_whole_tables(spark, data):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    got = [tuple(r) for r in catalog.op10_token_files(spark, data).orderBy("doc_id").collect()]
    start, expected = 0, []
    for d, text in rows:
        ids = whole(text)
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == expected


def test_keyed_reads_of_odd_rows(spark, odd, nothing):
    folder = idstore.write(odd, documents_per_shard=3)
    reader = idstore.Reader(folder)
    assert len(reader.manifest["shards"]) > 1
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(x.tolist() for x in (reader.get(1, 0), reader.get(1, 1))) == [whole(rows[1][1])] * 2
    assert sorted(x.tolist() for x in (reader.get(3, 0), reader.get(3, 1))) == sorted(whole(t) for d, t in rows if d == 3)
    assert reader.get(None).tolist() == whole(rows[0][1]) and reader.get(7).tolist() == whole(next(t for d, t in rows if d == 7))
    assert reader.get(10**9) is None and reader.get(1, 2) is None
    back = idstore.read(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [d for d, _ in rows] and len(back) == odd.count()
    empty = idstore.write(nothing)
    assert idstore.Reader(empty).get(1) is None and idstore.read(spark, empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    table = idstore.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
