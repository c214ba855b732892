"""Ingestion of fetched feeds, with its diagnostics taken in the same pass."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from broadsheet.operators.items import normalize_items
from broadsheet.session import shared_folder
from broadsheet.sources.feeds import feed_format, parse_feeds


@dataclass(frozen=True)
class Diagnostics:
    """Counts of a run by status, and what became of each source (a row a source: as many as the registry has)."""

    total_sources: int
    successful: int
    not_modified: int
    failed: int
    parsed_items: int
    sources: list[dict]


def with_status(fetched: DataFrame) -> DataFrame:
    """Rows of fetching.SCHEMA with status: success, not-modified, fetch-failure, or parse-failure for a body that is
    empty or no JSON where it should be."""
    kind = feed_format(F.col("body"), F.col("content_type"))
    unreadable = F.col("body").isNull() | (kind == "empty") | ((kind == "json") & F.try_parse_json("body").isNull())
    status = F.when(F.col("kind") == "not-modified", "not-modified").when(F.col("kind") != "success", "fetch-failure").when(unreadable, "parse-failure").otherwise("success")
    return fetched.withColumn("outcome", status)


def ingest(fetched: DataFrame, folder: str | None = None) -> tuple[DataFrame, Diagnostics]:
    """Normal items of fetched feeds, written to folder (by default one of the session's shared folder), and diagnostics.

    The fetched rows are read once: sources are observed as they stream into the parser, items as they stream into the
    files. fetched may be a source that asks a server each time it is read.
    """
    spark = fetched.sparkSession
    path = folder or f"{shared_folder(spark)}/ingested-{uuid.uuid4().hex}"
    by_source, by_item = Observation("sources"), Observation("items")
    seen = with_status(fetched)
    row = F.struct("source_id", F.col("outcome").alias("status"), F.col("status").alias("http_status"), F.coalesce("code", F.when(F.col("outcome") == "parse-failure", "unreadable")).alias("error"))
    count = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    seen = seen.observe(by_source, F.count("*").alias("total"), count("success"), count("not-modified"), count("fetch-failure"), count("parse-failure"), F.collect_list(row).alias("sources"))
    # one reading: bodies go to the parser as rows of one table, which is written before formats part
    bodies = f"{path}-bodies"
    seen.filter("outcome = 'success'").select("source_id", "content_type", "body").write.parquet(bodies)
    items = normalize_items(parse_feeds(spark.read.schema("source_id string, content_type string, body string").parquet(bodies)))
    items = items.observe(by_item, F.count("*").alias("items"))
    items.write.parquet(path)
    out = spark.read.schema(items.schema).parquet(path)
    n = {r["source_id"]: r["n"] for r in out.groupBy("source_id").agg(F.count("*").alias("n")).collect()}  # a row a source
    s = by_source.get
    sources = sorted((r.asDict() | {"item_count": n.get(r["source_id"], 0)} for r in s["sources"]), key=lambda r: r["source_id"])
    return out, Diagnostics(s["total"], s["success"], s["not-modified"], s["fetch-failure"] + s["parse-failure"], by_item.get["items"], sources)
