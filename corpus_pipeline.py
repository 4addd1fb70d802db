"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes the stored rows of the one before.  All but the last return the
columns of documents, so a stage can be left out or put elsewhere.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm import langid, mixing, ngram_join, packing, pii
from doclens.llm.common import Steps, table

#: A document whose best language is less likely than this is rejected.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a language of some likelihood; fills lang where it is null.

    Null and empty texts have no letter and go; so does every row if no language can
    be learned (no labelled row with an id outside the held-out fold).  Rows that
    repeat an id, and equal texts, are judged alike.  An empty table stays empty;
    all columns of docs, whatever their names, pass through.
    """
    model = langid.fit(langid.learnable(docs))
    found = langid.predict(docs, model, lang_out="__lang", score_out="__score")
    kept = found.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Rows that repeat that id all stay, as none of them is the smaller; rows with a
    null id, and texts without words, link with nothing and stay.  Columns pass through.
    """
    return ngram_join.one_of_each(docs, shingle=5, num=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind; n_chars follows the text.

    Every row stays.  A null text stays null and its n_chars becomes null; equal
    texts are masked alike; other columns pass through.
    """
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target wants it.

    Rows that repeat an id draw alike; texts without words have size 0 and are
    taken at their source's rate too; a null source is a source of its own.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequence each stands in.

    A null or empty text is one separator.  Copies that the mixture made are
    packed each for itself, under one doc_id.
    """
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mixture", mixture), ("packed", packed)]
#: Languages, ids of tokens and packing can't be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is stored, and the one before it dropped once its successor is."""
    steps, docs, before = Steps(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = steps.written(stage(spark, docs, sf_dir))
        if before is not None:
            steps.drop(before)
        before = docs
    return docs
