"""Operator 3: exact deduplication by a 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import materialize, normalised


def _keyed(df: DataFrame, id_col: str, text_col: str, content_hash) -> DataFrame:
    text = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    return text.withColumn("_hash", content_hash(F.col("_text")))


def _groups(keyed: DataFrame) -> DataFrame:
    """A row for each hash: rows, smallest id, and how many different texts share it.

    Grouping by (hash, text) compares the bytes; only one copy of a text leaves each task, so a hot group is small.
    """
    texts = keyed.groupBy("_hash", "_text").agg(F.min("_id").alias("_keep"), F.count("*").alias("_n"))
    return texts.groupBy("_hash").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count("*").alias("_texts"))


def md5_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=md5_hash) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after each run of white space is made one space; null counts as empty. keep_id is
    the smallest non-null id of the group (null if there is none). Of rows that repeat the kept id in one group just
    one is kept. An empty table gives no rows.
    """
    keyed = _keyed(df, id_col, text_col, content_hash)
    groups = materialize(_groups(keyed), "exact-groups")
    hashed = keyed.select("_id", "_hash", F.sha2("_text", 256).alias("text_sha256"))
    rows = hashed.groupBy("_id", "_hash", "text_sha256").agg(F.count("*").alias("_m"))
    found = rows.join(groups.filter("_texts = 1"), "_hash").select("_id", "text_sha256", "_m", "_keep", "_n")
    if not groups.filter("_texts > 1").isEmpty():
        # a true collision of the hash: these few groups are told apart by their bytes
        mixed = keyed.join(groups.filter("_texts > 1").select("_hash"), "_hash")
        apart = mixed.groupBy("_hash", "_text").agg(F.min("_id").alias("_keep"), F.count("*").alias("_n"))
        again = mixed.groupBy("_hash", "_text", "_id").agg(F.count("*").alias("_m")).join(apart, ["_hash", "_text"])
        found = found.unionByName(again.select("_id", F.sha2("_text", 256).alias("text_sha256"), "_m", "_keep", "_n"))
    each = found.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))))
    return each.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_i") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=md5_hash) -> DataFrame:
    """The rows of df that exact_dedup keeps, whole, with the columns of df.

    Rows that repeat one id with equal texts are one row afterwards; which of them stays is not defined beyond that.
    """
    columns = df.columns
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    keyed = keyed.withColumn("_hash", content_hash(F.col("_text")))
    groups = materialize(_groups(keyed.select("_id", "_text", "_hash")), "exact-groups")
    kept = keyed.join(groups.filter("_texts = 1"), "_hash").filter(F.col("_id").eqNullSafe(F.col("_keep"))).select("_row", "_id", "_hash", F.lit("").alias("_same"))
    if not groups.filter("_texts > 1").isEmpty():
        mixed = keyed.join(groups.filter("_texts > 1").select("_hash"), "_hash")
        apart = mixed.groupBy("_hash", "_text").agg(F.min("_id").alias("_keep"))
        again = mixed.join(apart, ["_hash", "_text"]).filter(F.col("_id").eqNullSafe(F.col("_keep")))
        kept = kept.unionByName(again.select("_row", "_id", "_hash", F.col("_text").alias("_same")))
    return kept.dropDuplicates(["_id", "_hash", "_same"]).select("_row.*")
