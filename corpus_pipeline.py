"""A corpus pipeline of five stages; each takes the documents its predecessor kept.

Toxic documents go, then those that fail the quality rules, then all but the smallest doc_id of each near-duplicate
group, then repeated passages within the remaining texts; what is left is packed into sequences.  All stages but the
last return the columns of documents.  Rows without doc_id are judged like others by the first two stages and by
packing; they have no near-duplicates, and count as the last document in the search for repeats.  Repeated rows fold to
one in the third stage.  An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findinglake.llm import packing, partenum, quality_mcd, suffix_dedup, toxicity
from findinglake.llm.tables import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model, fitted on labels outside the held-out fold, doesn't predict toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = toxicity.train(docs, labels)
    return toxicity.score_documents(docs.select(*COLUMNS), weights).where(F.col("score") < 0.3).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the robust outlier test of their language and source."""
    return quality_mcd.kept_documents(docs.select(*COLUMNS))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked near-duplicates."""
    return partenum.first_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id holds; documents left empty go.

    A cut can fall inside a character; its stray bytes become U+FFFD in the text.
    """
    left = suffix_dedup.remove_repeats(docs, keep=("lang", "source"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return left.where(F.octet_length("kept") > 0).select(
        "doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars")
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces and their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", one_of_each),
    ("repeats", cut_repeats),
    ("packing", pack),
]

# A trained model, a robust fit and a tokenizer are not SQL; tests compare the pipeline with its parts by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut_lineage(docs) if i else docs, sf_dir)
    return docs
