"""From raw documents to packed training sequences: quality, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last returns the
columns of ``docs``, as they are, whatever further columns there are and whatever these are called.  An empty table gives
an empty table of the same columns, before and behind each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate, packing, quality, similar
from glyphmill.llm.session import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    A null text counts as an empty one, which has no feature at all and the model's score for that.  Rows are judged one by
    one, by their whole texts: repeated rows stay or go together, null ids and nulls in other columns make no difference.
    Without labels, or without labelled documents, every score is 0.5 and nothing stays.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "quality_score"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    return quality.score(docs, model, name).where(F.col(name) >= quality.GOOD).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id.

    Of several rows with that id and text one stays.  Null texts and texts without words all stay, since nothing links to
    them.  A row with a null doc_id stays only if nothing that it reaches has an id.
    """
    return similar.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.

    Null and empty texts hold none, and null, empty and repeated items count for nothing more.  Rows are judged one by one,
    so repeated rows and null ids stay or go by their texts.  Without a benchmark everything stays.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences: the columns of ``packing.pack``.

    A null or empty text is one piece of the end id alone; repeated rows are packed as often as they come; a null id is kept.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
