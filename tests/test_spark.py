"""The Spark operators: each query against SQL, columns against the engine, and streams against decoding at once."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import pretok
from glyphmill.operators import vocabulary
from glyphmill.operators.columns import Engine
from glyphmill.plans import registry, samples
from glyphmill.sources import ranks
from glyphmill.streaming import decode

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, expected = registry.queries()[name](spark, DATA).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_built_in_splits_equal_the_engines(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60)
    odd = spark.createDataFrame([("a  b\r\n\tc'S don't IT'S 1234 éÉ日本 !?.. x ",), ("",), (" \n ",), ("…¿que? 12½",)], "text string")
    every = docs.union(odd)
    for steps, column in (
        ([{"type": "Split", "pattern": {"Regex": pretok.CL100K}, "behavior": "Isolated"}], pretok.split_matches("text", pretok.CL100K)),
        ([{"type": "Split", "pattern": {"Regex": p}, "behavior": "Isolated"} for p in pretok.DEEPSEEK3], pretok.chained("text", pretok.DEEPSEEK3)),
        ([{"type": "BertPreTokenizer"}], pretok.bert("text")),
        ([{"type": "Punctuation"}], pretok.punctuation("text")),
        ([{"type": "Metaspace"}], pretok.metaspace("text")),
        ([{"type": "WhitespaceSplit"}], pretok.whitespace("text")),
    ):
        own = pretok.compiled(steps)
        for r in every.select("text", column.alias("pieces")).collect():
            assert r["pieces"] == own(r["text"], True), (steps, r["text"])


def test_columns_take_nulls_and_bytes(spark):
    engine = Engine(spark, samples.byte_level())
    df = spark.createDataFrame([(1, None, None), (2, "the <s>", bytearray(b"\xff\xfe the"))], "k int, t string, b binary")
    got = df.select("k", engine.encode("t").alias("t"), engine.decode_bytes(engine.encode("b")).alias("b"), engine.token_count("t").alias("n")).orderBy("k").collect()
    assert got[0]["t"] is None and got[0]["b"] is None and got[0]["n"] is None
    assert bytes(got[1]["b"]) == b"\xff\xfe the" and got[1]["n"] == len(got[1]["t"])


def test_ids_without_a_token_fail(spark):
    vocab = vocabulary.vocabulary(spark, samples.byte_level())
    df = spark.createDataFrame([(1, [5, 99999])], "k int, ids array<int>")
    with pytest.raises(Exception, match="no token 99999"):
        vocabulary.decode_join(df, "k", "ids", vocab, 300).collect()


def test_disallowed_specials_fail(spark):
    engine = Engine(spark, samples.byte_level())
    df = spark.createDataFrame([("a<s>",)], "t string")
    assert df.select(engine.encode_allowed("t", {"<s>"}).alias("x")).first()["x"][-1] == 0
    with pytest.raises(Exception, match="disallowed"):
        df.select(engine.encode_allowed("t")).collect()


def test_rank_file_frame(spark, tmp_path):
    path = tmp_path / "x.ranks"
    path.write_text("YQ== 0\nYg== 1\n\nYWI= 2\n")
    assert [(r["rank"], bytes(r["token"])) for r in ranks.frame(spark, str(path)).orderBy("rank").collect()] == [(0, b"a"), (1, b"b"), (2, b"ab")]


def test_decoding_a_stream_equals_decoding_at_once(spark, tmp_path):
    t = samples.sentencepiece()
    engine = Engine(spark, t)
    texts = {1: "the end é日", 2: "on and on 😀", 3: ""}
    listed = [(k, s, i, False) for k, text in texts.items() for s, i in enumerate(t.encode(text))]
    listed += [(k, 10_000, None, True) for k in texts]
    listed.sort(key=lambda x: (x[1], x[0]))
    schema = "k bigint, seq bigint, id int, done boolean"
    for n in range(0, len(listed), 7):
        spark.createDataFrame(listed[n : n + 7], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = decode.decoded(source, "k", engine).writeStream.format("memory").queryName("decoded").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got: dict[int, str] = dict.fromkeys(texts, "")
    for r in spark.table("decoded").orderBy("k", "seq").collect():
        got[r["k"]] += r["text"]
    assert got == {k: t.decode(t.encode(x), False) for k, x in texts.items()}


def test_windowed_usage_counts_rows_once(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(at(1), "a b"), (at(4), "c"), (at(31), "d e f")], "ts timestamp, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    counted = decode.windowed_usage(source, "ts", F.size(pretok.whitespace("text")))
    query = counted.writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["n_rows"], r["n_tokens"]) for r in spark.table("usage").collect()) == [(1, 3), (2, 3)]
