"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairlake.llm import jaccard, mixing, packing, quality_model, substrings
from pairlake.llm.common import table, written
from pairlake.llm.queries import UNNAMED, WEIGHTS, levels
from pairlake.llm.wordpiece import n_tokens

#: Near duplicates: five words, a similarity of 0.8. Repeated passages: 100 bytes.
WORDS, PERCENT, PASSAGE = 5, 80, 100
#: Mixing: as many tokens as there are, a document twice at most.
TOTAL, EPOCHS, SEED = 1.0, 2, 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts get the score of an empty text; very long ones are scored whole, in slices. Repeated rows have one
    score and stay or go together, also with a null doc_id. Other columns aren't looked at and stay, whatever they are called.
    An empty table gives no rows; without labels of both kinds the share of good ones is everybody's score.
    """
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: of linked ones the smallest doc_id.

    Texts without words, null or empty, are linked with nothing and all stay. Of rows that repeat a doc_id one stays of each
    group. Rows with a null doc_id stay. Very long texts are compared whole. An empty table gives no rows.
    """
    return jaccard.keep_one(docs, WORDS, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller doc_id has.

    What is left of a text keeps its whole characters, n_chars follows it; documents of which no word is left go, those
    that lost nothing stay, null and empty texts too. A null doc_id loses nothing and takes nothing from others;
    rows of one doc_id don't count against each other. An empty table gives no rows.
    """
    return substrings.without_repeats(docs, PASSAGE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights of domains and languages, some twice.

    Texts without tokens, null or empty, are in no sequence and go, and so do rows with a null doc_id. A null language or
    source is one of its own. Ties in the seeded order go by doc_id and tokens; rows of a chosen doc_id are taken each. An
    empty table gives no rows.
    """
    return mixing.resampled(docs, levels(), n_tokens("text"), WEIGHTS, TOTAL, EPOCHS, SEED, UNNAMED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place.

    A null or empty text is its end token alone; a text longer than a sequence is cut, into full pieces. A null doc_id and
    repeated rows are packed each; equal lengths are placed by hash of doc_id. An empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("pack", pack)]

#: SQL can't express a learnt classifier, transitive links or tokenizers; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
