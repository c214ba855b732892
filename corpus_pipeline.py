"""A training corpus from documents: five stages, each one operator of broadsheet.llm.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of
documents. run() writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from broadsheet.llm.common import materialize, table
from broadsheet.llm.queries import tokenizer_path



def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what op10 rejects (`und`: null texts and texts without letters), and nothing for being of a rare language.

    Columns stay as they are, whatever their names; repeated rows stay; an empty table gives no rows.
    """
    return language_id.decided(docs, language_id.learn(docs.filter(~language_id.held_out())))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (white space apart) keeps the one of the smallest id; null texts are equal to empty ones."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links tie together keeps the one of the smallest id; rows without words are tied to nothing and stay."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's words by its quota: documents come once for each whole pass and once for their chosen spans of a
    shard, with n_chars of the new text. Rows without words, and those no quota takes, go. Null sources are one source."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else mixed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, packed into sequences; a null text is its end token alone."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The stages' models, hashes and seeds have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
