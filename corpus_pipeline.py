"""A corpus pipeline: language ID, near-dedup, substring dedup, decontamination, tokens.

Each stage is written as Parquet to the folder that the cluster shares and read again by the next.
Stages but the last return all columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechprep.llm import bpe, decontam, langid, near_dup, substring
from speechprep.llm.queries import read, vocabulary
from speechprep.llm.store import cut, fresh

#: A document stays if its language's posterior reaches this; ``und`` never does.
CONFIDENT = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that naive Bayes knows, learned from four fifths of the labelled rows."""
    langs, matrix = langid.train(docs.filter(langid.fold(F.col("doc_id"), 5) != 0).select("text", "lang"))
    pred, score = fresh(docs.columns, "lang_pred", "score")
    judged = langid.predict(docs, langs, matrix, *[F.col(f"`{c}`") for c in docs.columns], named=(pred, score))
    return judged.filter((F.col(score) >= CONFIDENT) & (F.col(pred) != langid.UNKNOWN)).drop(pred, score)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without spans that an earlier document holds; n_chars follows the text."""
    sentences, removed = fresh(docs.columns, "n_sentences", "n_removed")
    cut_texts = substring.remove_repeats(docs, (sentences, removed))
    return cut_texts.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(sentences, removed)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaked(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *vocabulary())


STAGES = [("language_id", known_language), ("near_dedup", one_of_each_class), ("substring_dedup", without_repeated_spans), ("decontamination", without_benchmark), ("byte_bpe", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
