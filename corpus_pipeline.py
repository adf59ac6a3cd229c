"""From raw documents to packed training sequences: five stages, each written and read again.

All stages keep columns and rows as they are but for their decisions: null texts and texts without words
pass the first three; rows with a null id pass them too, each text judged by itself; repeated rows are
judged alike.  An empty table gives empty tables throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import forget, settle, table
from tramline.llm.mixing import mixed_documents
from tramline.llm.ngram_join import keep_one_of_each
from tramline.llm.packing import pack
from tramline.llm.privacy import sanitize
from tramline.llm.toxicity import drop_toxic, learn, training_rows


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity cutoff; empty texts score 0; without labels all stay."""
    weights, cutoff = learn(training_rows(docs, table(spark, sf_dir, "labels")))
    return drop_toxic(docs, weights, cutoff)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar ones; rows without words or id stay."""
    return keep_one_of_each(docs).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data generalised and terms that disclose it removed; null texts stay null."""
    return sanitize(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, sorted by training position; texts without words are not taken."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents and their places in sequences; repeated rows are packed each."""
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]
#: Learning, joining and tokenising have no SQL form; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)  # a stage's table that the next one has read; documents themselves lie elsewhere
    return STAGES[-1][1](spark, docs, sf_dir)
