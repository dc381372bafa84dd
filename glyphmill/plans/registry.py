"""The engine's queries by name, each with SQL for a second engine where SQL can say the same.

Results have scalar columns: numbers are BIGINT, arrays of ids are joined by spaces.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import cuts, normalize, pretok
from glyphmill.operators import added, dictionary, post, tables, vocabulary
from glyphmill.operators.columns import Engine
from glyphmill.operators.tokenizer import ALL, NONE, NONSPECIAL, Tokenizer
from glyphmill.plans import case_sql, cases, samples, sql
from glyphmill.sources import shared
from glyphmill.streaming import keyed

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle is not None:
            _sql[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than the session has cores: a file or two would else be one
    task each.  A larger input has splits enough and is left as it is, so nothing is shuffled there."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _top(pieces: DataFrame, column: str = "piece", n: int = 100) -> DataFrame:
    return pieces.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def _exploded(spark: SparkSession, sf_dir: str, split: Column) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(split).alias("piece"))


def _n(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("bigint")


def _joined(ids: Column | str) -> Column:
    return F.array_join(F.col(ids) if isinstance(ids, str) else ids, " ")


# ---- splits


def _covering(name: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _top(_exploded(spark, sf_dir, pretok.split_matches("text", pretok.COVERING[name])))

    f.__name__ = f"pretok_{name}_top"
    return f


for _name, _pattern in pretok.COVERING.items():
    query(f"SELECT piece, count(*) AS n FROM ({sql.pieces(_pattern, 'documents')}) GROUP BY piece ORDER BY n DESC, piece LIMIT 100")(_covering(_name))


@query(f"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^{sql.SPACES}]+', 0)) AS piece FROM documents) GROUP BY piece ORDER BY n DESC, piece LIMIT 100")
def pretok_whitespace_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_exploded(spark, sf_dir, pretok.whitespace("text")))


@query(f"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[{sql.PUNCT}]|[^{sql.SPACES}{sql.PUNCT}]+', 0)) AS piece FROM documents) GROUP BY piece ORDER BY n DESC, piece LIMIT 100")
def pretok_bert_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_exploded(spark, sf_dir, pretok.bert("text")))


@query("SELECT page_id, count(*) AS n, max(length(piece)) AS longest FROM (SELECT page_id, unnest(regexp_extract_all(url, '\\p{N}+|\\P{N}+', 0)) AS piece FROM pages) GROUP BY page_id")
def digits_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(pretok.digits("url")).alias("piece"))
    return each.groupBy("page_id").agg(F.count("*").alias("n"), _n(F.max(F.length("piece"))).alias("longest"))


@query("SELECT page_id, count(*) AS n, max(length(piece)) AS longest FROM (SELECT page_id, unnest(regexp_extract_all(url, '\\p{N}|\\P{N}+', 0)) AS piece FROM pages) GROUP BY page_id")
def digits_split_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(pretok.digits("url", individual=True)).alias("piece"))
    return each.groupBy("page_id").agg(F.count("*").alias("n"), _n(F.max(F.length("piece"))).alias("longest"))


@query(f"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(url, '[{sql.PUNCT}]|[^{sql.PUNCT}]+', 0)) AS piece FROM pages) GROUP BY piece ORDER BY n DESC, piece LIMIT 200")
def punct_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(table(spark, sf_dir, "pages").select(F.explode(pretok.punctuation("url")).alias("piece")), n=200)


@query("SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(CASE WHEN text = '' OR starts_with(replace(text, ' ', '▁'), '▁') THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END, '▁[^▁]*|[^▁]+', 0)) AS piece FROM documents) GROUP BY piece ORDER BY n DESC, piece LIMIT 100")
def metaspace_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_exploded(spark, sf_dir, pretok.metaspace("text")))


@query(f"SELECT doc_id, count(*) AS n_pieces FROM ({sql.pieces(pretok.GPT2, sql.DIGIT_PARTS)}) GROUP BY doc_id")
def split_chain_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of a chain of two steps, counted inside each text's array."""
    made = _docs(spark, sf_dir).select("doc_id", _n(F.size(pretok.chained("text", pretok.DIGITS_GPT2))).alias("n_pieces"))
    return made.where("n_pieces > 0")


@query(f"SELECT piece, count(*) AS n FROM ({sql.pieces(pretok.GPT2, sql.DIGIT_PARTS)}) GROUP BY piece ORDER BY n DESC, piece LIMIT 100")
def pretok_digits_gpt2_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_exploded(spark, sf_dir, pretok.chained("text", pretok.DIGITS_GPT2)))


@query(f"SELECT piece, count(*) AS n FROM ({sql.pieces(pretok.QWEN2, 'documents')}) GROUP BY piece ORDER BY n DESC, piece LIMIT 100")
def pretok_llada_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another spelling of the qwen2 pattern: the pieces are the same."""
    return _top(_exploded(spark, sf_dir, pretok.split_matches("text", pretok.LLADA)))


@query(f"SELECT piece, count(*) AS n FROM ({sql.pieces(pretok.MINICPM, sql.DIGITS_BY_THREE)}) GROUP BY piece ORDER BY n DESC, piece LIMIT 100")
def pretok_minicpm5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_exploded(spark, sf_dir, pretok.chained("text", pretok.MINICPM5)))


@query(f"SELECT piece, count(*) AS n FROM ({sql.pieces(pretok.QWEN2, sql.LINE_PARTS)}) GROUP BY piece ORDER BY n DESC, piece LIMIT 100")
def pretok_laguna_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_exploded(spark, sf_dir, pretok.laguna("text")))


@query(f"SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?[^{sql.SPACES}(|.,!?…。，、।۔،)]+|.+?', 0, 's')) AS piece FROM documents) GROUP BY piece ORDER BY n DESC, piece LIMIT 40")
def pretok_bloom_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between matches are pieces too; here they are counted by character."""
    pieces = _exploded(spark, sf_dir, pretok.isolated("text", pretok.BLOOM))
    single = F.when(F.col("piece").rlike(rf"(?U)^{pretok.BLOOM}$"), F.array("piece")).otherwise(F.split("piece", ""))
    return _top(pieces.select(F.explode(single).alias("piece")), n=40)


@query(f"SELECT piece, count(*) AS n FROM ({sql.kimi_pieces()}) GROUP BY piece ORDER BY n DESC, piece LIMIT 100")
def pretok_kimi_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_exploded(spark, sf_dir, pretok.kimi("text")))


@query(f"SELECT piece, count(*) AS n FROM ({sql.deepseek_pieces()}) GROUP BY piece ORDER BY n DESC, piece LIMIT 100")
def pretok_deepseek3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_exploded(spark, sf_dir, pretok.chained("text", pretok.DEEPSEEK3)))


@query(f"SELECT length(piece) AS length, strlen(piece) AS bytes, count(*) AS n FROM ({sql.pieces(pretok.CL100K, 'documents')}) GROUP BY 1, 2")
def piece_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _exploded(spark, sf_dir, pretok.split_matches("text", pretok.CL100K))
    return pieces.groupBy(_n(F.length("piece")).alias("length"), _n(F.octet_length("piece")).alias("bytes")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, max(stop) AS last_end, sum(stop)::BIGINT AS sum_ends, count(*) AS n_pieces FROM (SELECT doc_id, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY c, p)::BIGINT AS stop FROM ({sql.placed_pieces(pretok.GPT2)}) x) GROUP BY doc_id")
def piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ends in bytes, by a running sum inside each text's array."""
    sizes = F.transform(pretok.gpt2("text"), lambda p: F.octet_length(p))
    ends = F.aggregate(sizes, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("sum")), lambda a, s: F.struct((a["at"] + s).alias("at"), (a["sum"] + a["at"] + s).alias("sum")))
    made = _docs(spark, sf_dir).select("doc_id", ends.alias("e"), _n(F.size(sizes)).alias("n_pieces")).where("n_pieces > 0")
    return made.select("doc_id", F.col("e.at").alias("last_end"), F.col("e.sum").alias("sum_ends"), "n_pieces")


# ---- normalizers


@query(f"SELECT conv_id, turn, regexp_replace(regexp_replace(text || '  ', '^[{sql.SPACES}]+', ''), '[{sql.SPACES}]+$', '') AS text FROM conversations")
def norm_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normalize.strip(F.concat("text", F.lit("  "))).alias("text"))


@query("SELECT doc_id, length(regexp_replace(replace(text, chr(10), '  '), ' {2,}', ' ', 'g')) AS n, md5(regexp_replace(replace(text, chr(10), '  '), ' {2,}', ' ', 'g')) AS h FROM documents")
def norm_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.collapse_spaces(normalize.replace("text", "\n", "  "))
    return _docs(spark, sf_dir).select("doc_id", _n(F.length(out)).alias("n"), F.md5(out).alias("h"))


@query("SELECT doc_id, md5(CASE WHEN text = '' THEN text ELSE '▁' || replace(text, ' ', '▁') END) AS h FROM documents")
def norm_prepend_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(normalize.prepend(normalize.replace("text", " ", "▁"), "▁")).alias("h"))


@query(f"SELECT doc_id, md5({sql.BERT}) AS h FROM documents")
def norm_bert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.wordpiece())
    return _docs(spark, sf_dir).select("doc_id", F.md5(engine.normalized("text")).alias("h"))


@query("SELECT doc_id, md5(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) AS h FROM documents")
def norm_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.byte_level(normalizer={"type": "NFC"}))
    return _docs(spark, sf_dir).select("doc_id", F.md5(engine.normalized(F.replace("text", F.lit("e"), F.lit("é")))).alias("h"))


@query("""SELECT doc_id, md5(replace(replace(replace(nfc_normalize(replace(text, 'e', 'e' || chr(769))), 'a', chr(13055)), 'o', 'fi'), 'n', 'n' || chr(2200) || chr(790) || chr(769))) AS h
FROM documents""")
def norm_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC by the tables of Unicode 9.0: a ligature is taken apart, a later square era name is not, and marks are put in order
    behind a mark that those tables do not know."""
    engine = Engine(spark, samples.unigram(normalizer={"type": "NFKC"}))
    text = F.col("text")
    for letter, becomes in (("e", "e\u0301"), ("a", "\u32ff"), ("o", "\ufb01"), ("n", "n\u0898\u0301\u0316")):
        text = F.replace(text, F.lit(letter), F.lit(becomes))
    return _docs(spark, sf_dir).select("doc_id", F.md5(engine.normalized(text)).alias("h"))


@query("SELECT doc_id, md5(replace(text, 'e', 'e' || chr(2200))) AS h FROM documents")
def norm_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks go but for those that came after Unicode 9.0, in the JVM."""
    marked = F.replace("text", F.lit("e"), F.lit("e\u0301\u0898"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(normalize.strip_accents(marked)).alias("h"))


# ---- models


@query(f"SELECT doc_id, n_tokens, n_bytes FROM (SELECT doc_id, {sql.bpe_count('text')} AS n_tokens, strlen(text) AS n_bytes FROM ({sql.bpe_texts()}))")
def bpe_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.byte_level())
    return _docs(spark, sf_dir).select("doc_id", engine.token_count("text").alias("n_tokens"), _n(F.octet_length("text")).alias("n_bytes"))


@query(f"SELECT doc_id, n_tokens FROM (SELECT doc_id, {sql.bpe_count('text')} AS n_tokens FROM ({sql.bpe_texts()}))")
def bpe_dictionary_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the distinct-piece dictionary: the model runs once for each piece of the table, and sizes are joined to
    the distinct pieces of each text."""
    return dictionary.count_by_words(Engine(spark, samples.byte_level()), _docs(spark, sf_dir), "doc_id", "text")


@query(f"SELECT lang, sum(n_tokens)::BIGINT AS n_tokens, count(*) AS n_docs FROM (SELECT lang, {sql.bpe_count('text')} AS n_tokens FROM ({sql.bpe_texts()})) GROUP BY lang")
def bpe_tokens_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.byte_level())
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(engine.token_count("text")).alias("n_tokens"), F.count("*").alias("n_docs"))


@query(sql.bpe_top())
def bpe_top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all texts' tokens, by how often they come."""
    engine = Engine(spark, samples.byte_level())
    return _docs(spark, sf_dir).select(F.explode(engine.encode("text")).alias("id")).groupBy(_n("id").alias("id")).agg(F.count("*").alias("n"))


@query(sql.wordpiece("SELECT word, string_agg(id, ' ' ORDER BY k) AS ids FROM parts GROUP BY word"))
def wordpiece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every distinct word of all texts."""
    engine = Engine(spark, samples.wordpiece())
    return _bert_words(spark, sf_dir).select("word").distinct().select("word", _joined(engine.encode("word", add_special_tokens=False)).alias("ids"))


def _bert_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = _docs(spark, sf_dir).select("doc_id", Engine(spark, samples.wordpiece()).normalized("text").alias("normal"))
    return normal.select("doc_id", F.explode(pretok.bert("normal")).alias("word"))


@query(sql.wordpiece("SELECT doc_id, count(*) AS n_words, count(*) FILTER (ids = '1') AS n_unknown FROM words JOIN (SELECT word, string_agg(id, ' ' ORDER BY k) AS ids FROM parts GROUP BY word) USING (word) GROUP BY doc_id"))
def wordpiece_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.wordpiece())
    words = _bert_words(spark, sf_dir)
    known = words.select("word").distinct().withColumn("unknown", _joined(engine.encode("word", add_special_tokens=False)) == "1")
    return words.join(known, "word").groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if("unknown").alias("n_unknown"))


@query(f"SELECT doc_id, {sql.spm_count()} AS n_tokens FROM documents")
def spm_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.sentencepiece())
    return _docs(spark, sf_dir).select("doc_id", engine.token_count("text").alias("n_tokens"))


@query(sql.unigram_counts())
def unigram_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.unigram())
    return _docs(spark, sf_dir).select("doc_id", engine.token_count("text").alias("n_tokens"))


# ---- added tokens and modes

_MARKED = "'<s>' || role || '</s>' || text || '<pad>'"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<s>"), F.col("role"), F.lit("</s>"), F.col("text"), F.lit("<pad>"))
    return table(spark, sf_dir, "conversations").withColumn("marked", marked)


@query(f"SELECT segment, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_MARKED}, '</s>|<pad>|<s>|[^<]+', 0)) AS segment FROM conversations) GROUP BY segment")
def added_token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _marked(spark, sf_dir).select(F.explode(added.segments("marked", list(samples.SPECIALS))).alias("segment"))
    return each.groupBy("segment").agg(F.count("*").alias("n"))


@query(f"SELECT segment, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_MARKED}, '</s>|<pad>|<s>|[^<]+', 0)) AS segment FROM conversations) GROUP BY segment")
def added_token_split_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.byte_level())
    each = _marked(spark, sf_dir).select(F.explode(engine.segments("marked")).alias("s"))
    return each.groupBy(F.col("s.text").alias("segment")).agg(F.count("*").alias("n"))


MANY_TOKENS = 20_000


@query(f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+', 0)) AS w FROM documents),
known AS (SELECT w FROM words GROUP BY w ORDER BY count(*) DESC, w LIMIT {MANY_TOKENS})
SELECT doc_id, count(*) AS n_tokens, sum(CASE WHEN known.w IS NULL THEN 1 ELSE length(words.w) + 2 END)::BIGINT AS n_characters FROM words LEFT JOIN known USING (w) GROUP BY doc_id""")
def many_added_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 20,000 words as added tokens, and their opening mark alone as one more: the longest that fits is taken."""
    docs = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", "([a-z]+)", "<$1>").alias("text"))
    known = _top(docs.select(F.explode(F.regexp_extract_all("text", F.lit("<[a-z]+>"), F.lit(0))).alias("piece")), n=MANY_TOKENS)
    contents = [r["piece"] for r in known.collect()]
    engine = Engine(spark, samples.byte_level(added_tokens=[t | {"id": 1000 + t["id"]} for t in samples._added(("<", *contents))]))
    found = docs.select("doc_id", F.explode(engine.segments("text")).alias("s")).where("s.id is not null")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(_n(F.length("s.text"))).alias("n_characters"))


@query(f"SELECT conv_id, turn, 3 + {sql.bpe_count('role_only')} + {sql.bpe_count('own')} AS n_all, 1 + {sql.bpe_count('plain')} AS n_nonspecial, {sql.bpe_count('marked')} AS n_none FROM ({sql.bpe_modes()})")
def added_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with all added tokens matched, with those alone that are not special (here <pad>), and with none."""
    engine = Engine(spark, samples.byte_level(added_tokens=samples._added(samples.SPECIALS[:2]) + [samples._added(samples.SPECIALS)[2] | {"special": False}]))
    count = lambda mode: engine.token_count("marked", mode=mode)
    return _marked(spark, sf_dir).select("conv_id", "turn", count(ALL).alias("n_all"), count(NONSPECIAL).alias("n_nonspecial"), count(NONE).alias("n_none"))


@query(f"SELECT role, sum(n)::BIGINT AS n_tokens, count(*) AS n_turns FROM (SELECT role, 3 + {sql.bpe_count('role_spaced')} + {sql.bpe_count('text')} AS n FROM ({sql.bpe_turns()})) GROUP BY role")
def chat_template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each turn in its template, the marks being added tokens."""
    engine = Engine(spark, samples.byte_level())
    return _marked(spark, sf_dir).groupBy("role").agg(F.sum(engine.token_count("marked")).alias("n_tokens"), F.count("*").alias("n_turns"))


# ---- post-processing

_IDS = sql.source_ids()


def _source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts encoded: the column ``source``."""
    return _docs(spark, sf_dir).select("doc_id", Engine(spark, samples.byte_level()).encode("source").alias("ids"))


@query(f"SELECT doc_id, array_to_string([1] || ids || [2, 3], ' ') AS ids FROM ({_IDS})")
def template_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_ids(spark, sf_dir).select("doc_id", _joined(post.template("ids", [1], [2, 3])).alias("ids"))


@query(f"SELECT doc_id, array_to_string([1] || ids[1:2] || [2], ' ') AS ids FROM ({_IDS})")
def truncate_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_ids(spark, sf_dir).select("doc_id", _joined(post.template(post.truncate("ids", 4, 2), [1], [2])).alias("ids"))


@query(f"SELECT doc_id, array_to_string(ids || [0 for x in range(greatest(0, 8 - len(ids)))], ' ') AS ids FROM ({_IDS})")
def pad_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_ids(spark, sf_dir).select("doc_id", _joined(post.pad("ids", 0, fixed=8)).alias("ids"))


@query(f"SELECT doc_id, array_to_string([0 for x in range((ceil(len(ids) / 4.0) * 4)::BIGINT - len(ids))] || ids, ' ') AS ids FROM ({_IDS})")
def pad_multiple_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_ids(spark, sf_dir).select("doc_id", _joined(post.pad("ids", 0, multiple=4, left=True)).alias("ids"))


@query(f"SELECT doc_id, array_to_string(ids || [9 for x in range(most - len(ids))], ' ') AS ids FROM (SELECT *, max(len(ids)) OVER () AS most FROM ({_IDS}))")
def pad_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post.pad_longest(_source_ids(spark, sf_dir), "ids", 9).select("doc_id", _joined("ids").alias("ids"))


@query(f"SELECT doc_id, array_to_string(ids || [9 for x in range(most - len(ids))], ' ') AS ids FROM (SELECT *, max(len(ids)) OVER (PARTITION BY doc_id // 8) AS most FROM ({_IDS}))")
def pad_longest_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = _source_ids(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 8))
    return post.pad_longest(batched, "ids", 9, batch="batch").select("doc_id", _joined("ids").alias("ids"))


@query(f"SELECT doc_id, repeat('1', len(ids) + 2) || repeat('0', greatest(0, 6 - len(ids))) AS attention, '1' || repeat('0', len(ids)) || '1' AS special FROM ({_IDS})")
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _source_ids(spark, sf_dir).withColumn("ids", post.template("ids", [1], [2]))
    padded = made.withColumn("padded", post.pad("ids", 0, fixed=8)).withColumn("more", F.greatest(F.lit(0), 8 - F.size("ids")))
    return padded.select("doc_id", F.array_join(post.attention_mask("padded", F.col("more")), "").alias("attention"), F.array_join(post.special_tokens_mask("ids", 1, 1), "").alias("special"))


@query(f"SELECT doc_id, n + 2 AS n_ids, n + 2 AS n_mask, 2::BIGINT AS n_special FROM (SELECT doc_id, {sql.bpe_count('text')} AS n FROM ({sql.bpe_texts()}))")
def encoding_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, masks and types of the whole encoding, with a template of <s> and </s>."""
    engine = Engine(spark, samples.byte_level(post_processor={"type": "BertProcessing", "sep": ["</s>", 1], "cls": ["<s>", 0]}))
    made = _docs(spark, sf_dir).select("doc_id", engine.encoding("text").alias("e"))
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return made.select("doc_id", _n(F.size("e.ids")).alias("n_ids"), total("e.attention_mask").alias("n_mask"), total("e.special_tokens_mask").alias("n_special"))


# ---- vocabulary


def _vocab(spark: SparkSession) -> tuple[DataFrame, int]:
    t = samples.byte_level()
    return vocabulary.vocabulary(spark, t), t.n_vocab


@query(f"SELECT v.id, v.token, v.flags, coalesce(n, 0) AS n_uses FROM (VALUES {sql.vocab_values()}) v(id, token, flags) LEFT JOIN ({sql.bpe_top()}) u USING (id)")
def vocab_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with its flags, and how often the documents have it."""
    used = bpe_top_tokens(spark, sf_dir).withColumnRenamed("n", "n_uses")
    listed = _vocab(spark)[0].select(_n("id").alias("id"), "token", _n("flags").alias("flags"))
    return listed.join(used, "id", "left").select("id", "token", "flags", F.coalesce("n_uses", F.lit(0)).alias("n_uses"))


@query(f"SELECT part_id, token FROM (SELECT p_partkey AS part_id, p_partkey % 400 AS id FROM part) LEFT JOIN (VALUES {sql.vocab_values()}) v(id, token, flags) USING (id)")
def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab, n = _vocab(spark)
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), (F.col("p_partkey") % 400).cast("int").alias("id"))
    return vocabulary.lookup_ids(ids, "id", vocab, n).select("part_id", "token")


@query(f"SELECT count(*) AS n FROM part WHERE p_partkey % 400 NOT IN (SELECT id FROM (VALUES {sql.vocab_values()}) v(id, token, flags))")
def vocab_unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab, n = _vocab(spark)
    ids = table(spark, sf_dir, "part").select((F.col("p_partkey") % 400).cast("int").alias("id"))
    return vocabulary.unknown_ids(ids, "id", vocab, n).agg(F.count("*").alias("n"))


@query(f"SELECT lang, count(*) AS n_words, count(v.w) AS n_known FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+', 0)) AS w FROM documents) d LEFT JOIN (SELECT DISTINCT w FROM (VALUES {sql.words_values()}) x(w)) v ON d.w = v.w GROUP BY lang")
def vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(w,) for w in dict.fromkeys(samples.WORDS.split())], "known string")
    words = _docs(spark, sf_dir).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.join(F.broadcast(known), F.col("word") == F.col("known"), "left").groupBy("lang").agg(F.count("*").alias("n_words"), F.count("known").alias("n_known"))


@query(f"SELECT id::BIGINT AS id, content, true AS special, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all({_MARKED}, '</s>|<pad>|<s>', 0)) AS x FROM conversations) WHERE x = content) AS n_uses FROM (VALUES (0, '<s>'), (1, '</s>'), (2, '<pad>')) v(id, content)")
def added_tokens_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The added tokens, and how often the marked conversations have them."""
    t = samples.byte_level()
    found = _marked(spark, sf_dir).select(F.explode(Engine(spark, t).segments("marked")).alias("s")).where("s.id is not null").groupBy(F.col("s.id").alias("id")).agg(F.count("*").alias("n_uses"))
    return vocabulary.added_tokens(spark, t).join(found, "id", "left").select(_n("id").alias("id"), "content", "special", F.coalesce("n_uses", F.lit(0)).alias("n_uses"))


@query(f"""SELECT m.rank, m."left", m."right", coalesce(u.n, 0) AS n_uses FROM (VALUES {sql.merge_values()}) m(rank, "left", "right") JOIN (VALUES {sql.vocab_values()}) v(id, token, flags) ON v.token = m."left" || m."right" LEFT JOIN ({sql.bpe_top()}) u ON u.id = v.id""")
def merges_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merges by rank, and how often what they make is a token of the documents."""
    ids = _vocab(spark)[0].select(_n("id").alias("id"), F.col("token").alias("out"))
    made = vocabulary.merges(spark, samples.byte_level()).join(ids, "out").join(bpe_top_tokens(spark, sf_dir), "id", "left")
    return made.select(_n("rank").alias("rank"), "left", "right", F.coalesce("n", F.lit(0)).alias("n_uses"))


@query(f"SELECT 'byte_bpe' AS algorithm, {len(samples.byte_vocab())}::BIGINT AS n_ids, 3::BIGINT AS n_added, {sql.isolation()} AS control_isolation, count(*) AS n_used, max(id) AS last_used FROM ({sql.bpe_top()})")
def tokenizer_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tokenizer tells of itself, and how many of its ids the documents have."""
    used = bpe_top_tokens(spark, sf_dir).agg(F.count("*").alias("n_used"), F.max("id").alias("last_used"))
    found = vocabulary.info(spark, samples.byte_level()).crossJoin(used)  # one row with one row
    return found.select("algorithm", _n("n_ids").alias("n_ids"), _n("n_added").alias("n_added"), "control_isolation", "n_used", "last_used")


# ---- decoding


@query("SELECT doc_id, md5(text) AS h FROM documents")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to ids and back."""
    engine = Engine(spark, samples.byte_level())
    return _docs(spark, sf_dir).select("doc_id", F.md5(engine.restored("text")).alias("h"))


@query("SELECT doc_id, md5(text) AS h FROM documents")
def decode_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the vocabulary joined, by built-in functions alone."""
    vocab, n = _vocab(spark)
    ids = _docs(spark, sf_dir).select("doc_id", Engine(spark, samples.byte_level()).encode("text").alias("ids"))
    return vocabulary.decode_join(ids, "doc_id", "ids", vocab, n).select("doc_id", F.md5("text").alias("h"))


@query("SELECT conv_id, turn, md5(role || text) AS skipped, md5('<s>' || role || '</s>' || text || '<pad>') AS kept FROM conversations")
def decode_skip_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.byte_level())
    ids = _marked(spark, sf_dir).select("conv_id", "turn", engine.encode("marked").alias("ids"))
    return ids.select("conv_id", "turn", F.md5(engine.decode("ids")).alias("skipped"), F.md5(engine.decode("ids", skip_special_tokens=False)).alias("kept"))


@query("SELECT doc_id, md5(CASE WHEN starts_with(text, ' ') THEN substr(text, 2) ELSE text END) AS h FROM documents")
def decode_spm_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace, byte fallback, fuse and strip bring back the text; a space that it starts with is taken for the mark."""
    engine = Engine(spark, samples.sentencepiece())
    return _docs(spark, sf_dir).select("doc_id", F.md5(engine.restored("text")).alias("h"))


@query()
def decode_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back: parts are joined, other tokens spaced, and spaces before marks taken out again."""
    engine = Engine(spark, samples.wordpiece())
    return _docs(spark, sf_dir).select("doc_id", engine.restored("text", add_special_tokens=False).alias("text"))


# ---- bounds and cuts


@query("SELECT doc_id, strlen(text) AS bound, true AS holds FROM documents")
def encode_bound_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.byte_level())
    made = _docs(spark, sf_dir).select("doc_id", engine.encode_bound("text").alias("bound"), engine.token_count("text").alias("n"))
    return made.select("doc_id", "bound", (F.col("n") <= F.col("bound")).alias("holds"))


@query("SELECT doc_id, strlen(text) AS byte_level, strlen(text) + CASE WHEN text = '' THEN 0 ELSE 1 END AS whole_texts, strlen(text) + CASE WHEN text = '' THEN 0 ELSE 1 END AS unigram, strlen(text) AS wordpiece, 3 * strlen(text) AS composed, true AS hold FROM documents")
def encode_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proved bounds of four models, and of one that composes characters first; each holds for every text."""
    engines = {"byte_level": samples.byte_level(), "whole_texts": samples.whole_texts(), "unigram": samples.unigram(), "wordpiece": samples.wordpiece(), "composed": samples.byte_level(normalizer={"type": "NFC"})}
    engines = {n: Engine(spark, t) for n, t in engines.items()}
    made = _docs(spark, sf_dir).select("doc_id", *[e.encode_bound("text").alias(n) for n, e in engines.items()], *[e.token_count("text").alias(f"n_{n}") for n, e in engines.items()])
    hold = functools.reduce(lambda a, b: a & b, [F.col(f"n_{n}") <= F.col(n) for n in engines])
    return made.select("doc_id", *engines, hold.alias("hold"))


@query(f"SELECT doc_id, {sql.bpe_count('text')} AS n_tokens, true AS same FROM ({sql.bpe_texts()})")
def split_parts_equal_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at certified places and encoded in parts have the ids of the whole."""
    engine = Engine(spark, samples.byte_level())
    docs = _docs(spark, sf_dir)
    parts = engine.encode_parts(docs, "doc_id", "text", 500).withColumnRenamed("ids", "of_parts")
    both = docs.select("doc_id", engine.encode("text").alias("whole")).join(parts, "doc_id")
    return both.select("doc_id", _n(F.size("of_parts")).alias("n_tokens"), (F.col("whole") == F.col("of_parts")).alias("same"))


# ---- sure cuts by family, pieces of parts, and dictionaries of words

_ORDERS = {"cl100k": sql.covering_order(pretok.CL100K), "o200k": sql.covering_order(pretok.O200K), "deepseek3": sql.deepseek_order()}
_SPLITS = {"cl100k": lambda x: pretok.split_matches(x, pretok.CL100K), "o200k": lambda x: pretok.split_matches(x, pretok.O200K), "deepseek3": lambda x: pretok.chained(x, pretok.DEEPSEEK3)}


def _places(name: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Sure places of each text."""
        return _docs(spark, sf_dir).where("text <> ''").select("doc_id", _n(cuts.places("text", name)).alias("n_places"))

    f.__name__ = f"sure_places_{name}"
    return f


def _part_pieces(name: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Texts in parts of 200 characters and more, each part split by itself; the SQL splits the whole texts."""
        pieces = cuts.split_by_parts("text", name, 200, _SPLITS[name])
        made = _docs(spark, sf_dir).where("text <> ''").select("doc_id", pieces.alias("p"))
        return made.select("doc_id", _n(F.size("p")).alias("n_pieces"), F.md5(F.array_join("p", chr(57347))).alias("h"))

    f.__name__ = f"part_pieces_{name}"
    return f


for _name in _SPLITS:
    query(sql.sure_places(_name))(_places(_name))
    query(sql.piece_digest(_ORDERS[_name]))(_part_pieces(_name))

if samples.published():
    _tokens = "SELECT doc_id, o, unnest(symbols) AS token, generate_subscripts(symbols, 1) AS k FROM own JOIN made USING (piece)"

    @query(sql.byte_pairs(samples.published(), pretok.GPT2, "SELECT doc_id, sum(len(symbols))::BIGINT AS n_tokens FROM own JOIN made USING (piece) GROUP BY doc_id"))
    def real_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Tokens by a published vocabulary, the model running once for each distinct piece of the table."""
        engine = Engine(spark, samples.real())
        return dictionary.count_by_words(engine, _docs(spark, sf_dir).where("text <> ''"), "doc_id", "text", mode=NONE)

    @query(sql.byte_pairs(samples.published(), pretok.GPT2, f"SELECT doc_id, md5(string_agg(id::VARCHAR, ' ' ORDER BY o, k)) AS h, count(*) AS n_tokens FROM ({_tokens}) JOIN vocab USING (token) GROUP BY doc_id"))
    def real_ids_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All ids by a published vocabulary, of texts that are cut into rows at sure places and put together again."""
        made = Engine(spark, samples.real()).encode_cut(_docs(spark, sf_dir).where("text <> ''"), "doc_id", "text", 2000)
        return made.select("doc_id", F.md5(_joined("ids")).alias("h"), _n(F.size("ids")).alias("n_tokens"))

    @query(sql.byte_pairs(samples.published(), pretok.GPT2, f"SELECT doc_id, md5(string_agg(id::VARCHAR, ' ' ORDER BY o, k)) AS h, count(*) AS n_tokens FROM ({_tokens}) JOIN vocab USING (token) GROUP BY doc_id"))
    def appended_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Texts that come in rows of 300 characters, in any place of a word, encoded as the stream does: what stands
        behind the last sure place waits for the next row."""
        docs = _docs(spark, sf_dir).where("text <> ''")
        starts = F.sequence(F.lit(0), F.ceil(F.length("text") / 300).cast("int") - 1)
        given = docs.select("doc_id", "text", F.explode(starts).alias("seq")).select("doc_id", "seq", F.col("text").substr(F.col("seq") * 300 + 1, F.lit(300)).alias("text"))
        made = keyed.encoded_batch(given, "doc_id", Engine(spark, samples.real()), mode=NONE)
        return made.select("doc_id", F.md5(_joined("ids")).alias("h"), _n(F.size("ids")).alias("n_tokens"))

    @query(sql.byte_pairs(samples.published(), pretok.GPT2, f"SELECT id, count(*) AS n FROM ({_tokens}) JOIN vocab USING (token) GROUP BY id"))
    def real_id_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
        """How often each id comes: pieces are counted first, so that each is encoded and unfolded once."""
        engine = Engine(spark, samples.real())
        counted = _exploded(spark, sf_dir, pretok.gpt2("text")).groupBy("piece").agg(F.count("*").alias("n"))
        return counted.select(F.explode(engine.encode_ordinary("piece")).alias("id"), "n").groupBy(_n("id").alias("id")).agg(F.sum("n").alias("n"))


@query(f"SELECT doc_id, {sql.whole_text_count()} AS n_tokens FROM documents WHERE text <> ''")
def whole_text_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition without a split: each text is one piece, cut where no merge joins its characters, by dictionary."""
    engine = Engine(spark, samples.whole_texts())
    return dictionary.count_by_words(engine, _docs(spark, sf_dir).where("text <> ''"), "doc_id", "text", mode=NONE)


@query(
    f"""WITH own AS (SELECT doc_id % 3 AS batch, piece FROM ({sql.pieces(pretok.GPT2, 'documents')})), firsts AS (SELECT piece, min(batch) AS batch FROM own GROUP BY piece),
seen AS (SELECT batch, count(DISTINCT piece) AS n_distinct FROM own GROUP BY batch), fresh AS (SELECT batch, count(*) AS n_modelled FROM firsts GROUP BY batch),
tokens AS (SELECT doc_id % 3 AS batch, sum({sql.bpe_count('text')})::BIGINT AS n_tokens FROM ({sql.bpe_texts()}) GROUP BY 1)
SELECT batch, n_distinct, coalesce(n_modelled, 0) AS n_modelled, n_tokens FROM seen LEFT JOIN fresh USING (batch) JOIN tokens USING (batch)"""
)
def dictionary_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of documents into one kept dictionary: the model sees a piece in the first batch that has it only."""
    engine = Engine(spark, samples.byte_level())
    path = shared.folder(spark, "dictionary")
    kept = dictionary.PieceDictionary(engine, spark, "words_" + path[-12:], path, buckets=8)
    docs = _docs(spark, sf_dir)
    for batch in range(3):
        found = dictionary.words(engine, docs.where(F.col("doc_id") % 3 == batch), "doc_id", "text")
        fresh = kept.extend(found)
        tokens = dictionary.counted(engine, found, kept.table(), "doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
        seen = found.agg(F.count_distinct("word").alias("n_distinct"))
        # written before the table grows again: one plan over several of its states would read one of them for all
        tokens.join(seen).select(F.lit(batch).cast("bigint").alias("batch"), "n_distinct", F.lit(fresh).cast("bigint").alias("n_modelled"), "n_tokens").write.mode("append").parquet(f"{path}-report")
    return spark.read.parquet(f"{path}-report")


_WORD_FILE = samples.word_file([("{}", 7)])


@query(f"""WITH words AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) AS r FROM (SELECT lang, unnest(regexp_extract_all(text, '[a-z]+', 0)) AS w FROM documents) GROUP BY lang, w)
SELECT lang, sha256({sql._text(_WORD_FILE.partition('"{}": 7')[0])} || string_agg('"' || w || '": ' || r, ', ' ORDER BY r) || {sql._text(_WORD_FILE.partition('"{}": 7')[2])}) AS h, count(*) AS n_words FROM words WHERE r <= {samples.MOST_WORDS} GROUP BY lang""")
def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SHA-256 of a definition for each language, made of its most frequent words, as the loaded tokenizer tells it."""
    words = _docs(spark, sf_dir).select("lang", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    ranked = words.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= samples.MOST_WORDS)

    def told(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("r")
        t = Tokenizer.from_str(samples.word_file(list(zip(own["w"], own["r"], strict=True))))
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "h": [t.info()["sha256"]], "n_words": [t.get_vocab_size()]})

    return ranked.select("lang", "w", "r").groupBy("lang").applyInPandas(told, "lang string, h string, n_words bigint")


# ---- small definitions with options of added tokens, unknown characters, byte runs and best paths, over all documents


def _case_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in case_sql.MARKED_TEXTS:
        return _docs(spark, sf_dir).select("doc_id", F.expr(case_sql.MARKED_TEXTS[name][0].replace("chr(769)", "'\u0301'")).alias("text"))
    return _docs(spark, sf_dir).where("text <> ''").select("doc_id", "text")


def _there(made: DataFrame, column: str, **told: Column) -> DataFrame:
    """What is told of the rows that have a value.  A filter on what a Python function gives would be pushed to the scan,
    and the function run there a second time, on as few tasks as the input has splits."""
    own = F.array(F.struct(*[c.alias(n) for n, c in told.items()]))
    return made.select("doc_id", F.inline(F.when(F.col(column).isNotNull(), own)))


def _case_encode(name: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, Tokenizer.from_str(cases.DEFINITIONS[name]))
        made = _case_texts(spark, sf_dir, name).select("doc_id", engine.encode("text", empty=False).alias("ids"))
        return _there(made, "ids", h=F.md5(_joined("ids")), n_tokens=_n(F.size("ids")))

    f.__name__ = f"encode_{name}"
    return f


def _case_decode(name: str) -> Query:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, Tokenizer.from_str(cases.DEFINITIONS[name]))
        made = _case_texts(spark, sf_dir, name).select("doc_id", engine.restored("text", empty=False).alias("back"))
        return _there(made, "back", h=F.md5("back"))

    f.__name__ = f"decode_{name}"
    return f


for _name in cases.DEFINITIONS:
    query(case_sql.ENCODE[_name])(_case_encode(_name))
    query(case_sql.DECODE[_name])(_case_decode(_name))


_RANKS = samples.rank_lines()


@query(f"SELECT line.rank::BIGINT AS id, hex(from_base64(line.token)) AS code, coalesce(u.n, 0) AS n_uses FROM (SELECT split_part(line, ' ', 1) AS token, split_part(line, ' ', 2) AS rank FROM (VALUES {sql._values([(x,) for x in _RANKS])}) v(line)) line LEFT JOIN (SELECT hex(from_base64(b.x)) AS code, t.n FROM ({sql.bpe_top()}) t JOIN (VALUES {sql.token_bytes()}) b(id, x) USING (id)) u ON u.code = hex(from_base64(line.token))")
def rank_file_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of a rank file's tokens, by id, and how often the documents have them."""
    t = samples.ranked()
    used = _docs(spark, sf_dir).select(F.explode(Engine(spark, t).encode_ordinary("text")).alias("id")).groupBy("id").agg(F.count("*").alias("n_uses"))
    listed = vocabulary.vocabulary(spark, t).join(used, "id", "left")
    return listed.select(_n("id").alias("id"), F.hex("bytes").alias("code"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"))


@query(f"SELECT doc_id, {sql.bpe_count('text')} AS n_tokens FROM ({sql.bpe_texts()})")
def rank_file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by a rank file whose ranks are those of the byte-level sample's merges: as many as by merges."""
    return _docs(spark, sf_dir).select("doc_id", Engine(spark, samples.ranked()).token_count("text").alias("n_tokens"))


@query("SELECT doc_id, md5(text) AS h, strlen(text)::BIGINT AS n_bytes FROM documents")
def decode_to_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.byte_level())
    made = _docs(spark, sf_dir).select("doc_id", engine.restored_bytes("text").alias("raw"))
    return made.select("doc_id", F.md5("raw").alias("h"), _n(F.length("raw")).alias("n_bytes"))


@query(f"SELECT conv_id, turn, 3 + {sql.bpe_count('role_only')} + {sql.bpe_count('own')} AS n_allowed, {sql.bpe_count('marked')} AS n_ordinary FROM ({sql.bpe_modes()})")
def allowed_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens all allowed, and all taken for plain text."""
    engine = Engine(spark, samples.byte_level())
    return _marked(spark, sf_dir).select("conv_id", "turn", _n(F.size(engine.encode_allowed("marked", "all"))).alias("n_allowed"), _n(F.size(engine.encode_ordinary("marked"))).alias("n_ordinary"))


@query(f"SELECT word, max(v.id) AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+', 0)) AS word FROM documents) d LEFT JOIN (VALUES {sql.vocab_values()}) v(id, token, flags) ON v.token = d.word GROUP BY word")
def vocab_token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of words by their bytes; null for those that are no token."""
    vocab, n = _vocab(spark)
    words = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return vocabulary.lookup_tokens(words.withColumn("raw", F.encode("word", "UTF-8")), "raw", vocab, n).select("word", _n("id").alias("id"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, '(?s).', 0)) END AS n_characters FROM documents")
def no_split_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition without a split takes each text as one piece; its characters alone are told here."""
    engine = Engine(spark, samples.sentencepiece(pre_tokenizer=None))
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(F.aggregate(engine.pieces("text"), F.lit(0).cast("bigint"), lambda a, p: a + F.length(p)), F.lit(0)).alias("n_characters"))


@query(f"SELECT doc_id, count(*) AS n_pieces, sum(stop)::BIGINT AS sum_ends, md5(string_agg(piece, chr(57347) ORDER BY o)) AS h FROM (SELECT doc_id, piece, o, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY o)::BIGINT AS stop FROM ({sql.covering_order(pretok.GPT2)})) GROUP BY doc_id")
def lateral_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with their places and ends by a table function in SQL text."""
    tables.register(spark, "explode_pieces", Engine(spark, samples.byte_level()))
    return spark.sql(
        "SELECT doc_id, count(*) AS n_pieces, sum(p.`end`) AS sum_ends, md5(array_join(transform(array_sort(collect_list(struct(p.place, p.piece))), x -> x.piece), {mark})) AS h "
        "FROM {docs}, LATERAL explode_pieces(text) p GROUP BY doc_id", docs=_docs(spark, sf_dir), mark=chr(57347),
    )


# ---- relational work around tokens


@query(f"SELECT a, b, count(*) AS n FROM (SELECT piece AS a, lead(piece) OVER (PARTITION BY doc_id ORDER BY c, p) AS b FROM ({sql.placed_pieces(pretok.GPT2)})) WHERE b IS NOT NULL GROUP BY a, b ORDER BY n DESC, a, b LIMIT 50")
def piece_bigrams_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring pieces inside each text, from its own array: nothing is shuffled before the count."""
    pieces = pretok.gpt2("text")
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = _docs(spark, sf_dir).select(F.explode(pairs).alias("x")).select("x.a", "x.b")
    return each.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(50)


@query(f"SELECT lang, source, sum(n_tokens)::BIGINT AS n_tokens FROM (SELECT lang, source, {sql.bpe_count('text')} AS n_tokens FROM ({sql.bpe_texts()})) GROUP BY ROLLUP (lang, source)")
def token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, samples.byte_level())
    counted = _docs(spark, sf_dir).select("lang", "source", engine.token_count("text").alias("n"))
    return counted.rollup("lang", "source").agg(F.sum("n").alias("n_tokens"))


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_rows, sum(len(regexp_extract_all(props, '\\p{N}+|\\P{N}+', 0)))::BIGINT AS n_pieces FROM events GROUP BY 1, 2")
def windowed_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of event properties in windows of event time, as the streaming operator counts them."""
    events = table(spark, sf_dir, "events").withColumn("n", F.size(pretok.digits("props")))
    made = events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n_rows"), F.sum("n").cast("bigint").alias("n_pieces"))
    return made.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_rows", "n_pieces")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
