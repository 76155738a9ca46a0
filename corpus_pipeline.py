"""The corpus pipeline: toxicity, exact dedup, near dedup, packing.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``docs``, so stages can be written and read again one after the other.
Further columns, whatever their names, are carried along.  Every stage takes
texts of any length, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stackyard.llm.bestfit_packing import pack
from stackyard.llm.common import saved
from stackyard.llm.exact_dedup import drop_copies
from stackyard.llm.minmax_dedup import drop_near_duplicates
from stackyard.llm.toxicity import drop_toxic
from stackyard.tables import load


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold.

    Null and empty texts are scored as the empty text.  Repeated rows have one score, so all of
    them stay or go; rows with a null id are judged like others.
    """
    return drop_toxic(docs, load(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id.

    A null text is the empty text, and one row with it stays.  A null id is smaller than any
    other; of rows that repeat id and text one stays.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    A null id is larger than any other here, and of rows that repeat the smallest id one stays.
    Texts without words (null, empty, white space) are near nothing and all stay.
    """
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in training sequences.

    Null and empty texts are one piece of one token; every row is packed, also rows of one id or none.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact_dedup),
          ("near_dedup", near_dedup), ("packing", packing)]

#: SQL has no trained classifier; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
