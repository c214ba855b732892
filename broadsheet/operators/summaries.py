"""Deterministic summaries: a cluster's own words within bounds, nothing added."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text
from broadsheet.functions.similarity import numeric_conflict
from broadsheet.operators.findings import OPINION

WHY = "No additional context is included because the reviewed source provided no permitted description material."
UNSURE = "Figures and specific details differ across initial source reporting."


def restrict(clusters: DataFrame, registry: DataFrame | None) -> DataFrame:
    """clusters(cluster_id, primary_source_id, items array<struct<ordinal,source_id,guid,title,description,published_at>>)
    with only items of sources that permit generated summaries; a cluster without any goes.

    The primary item is the first of the same source, else the first; sources, times and title follow from what is left.
    """
    if registry is None:
        return clusters.withColumn("permitted", F.col("items")).withColumn("described", F.transform("items", lambda i: i["source_id"]))
    allows = lambda use: F.col("active") & F.array_contains("permittedUses", use)
    of = registry.select("source_id", allows("generated-summary").alias("sums"), allows("supplied-description").alias("says")).filter("sums OR says")
    each = clusters.select("cluster_id", F.posexplode("items").alias("at", "item")).withColumn("source_id", F.col("item.source_id")).join(of, "source_id")
    by = each.groupBy("cluster_id").agg(  # CLUSTER_SIZE items at most
        F.transform(F.sort_array(F.collect_list(F.when(F.col("sums"), F.struct("at", "item")))), lambda x: x["item"]).alias("permitted"),
        F.collect_set(F.when(F.col("says"), F.col("source_id"))).alias("described"),
    )
    return clusters.join(by.filter(F.size("permitted") > 0), "cluster_id")


def summarize(clusters: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """clusters(cluster_id, topic, cleaned_title, primary_source_id, items) -> one story row each."""
    c = restrict(clusters, registry)
    items = F.col("permitted")
    sources = F.array_sort(F.array_distinct(F.transform(items, lambda i: i["source_id"])))
    long = F.filter(items, lambda i: F.array_contains("described", i["source_id"]) & (F.length(text.trimmed(F.coalesce(i["description"], F.lit("")))) >= 20))
    numbers = F.transform(items, lambda i: text.title_tokens(i["title"])["numbers"])
    times = F.array_compact(F.transform(items, lambda i: i["published_at"]))
    c = c.select(
        "cluster_id", "topic", F.coalesce(F.nullif("cleaned_title", F.lit("")), items[0]["title"]).alias("base"), F.coalesce(F.try_element_at(long, F.lit(1))["description"], F.lit("")).alias("said"),
        F.slice(sources, 1, 20).alias("sourceIds"), F.array_min(times).alias("first"), F.array_max(times).alias("last"),
        F.forall(items, lambda i: i["title"].rlike(OPINION)).alias("opinion"), F.exists(numbers, lambda a: F.exists(numbers, lambda b: numeric_conflict(a, b))).alias("disputed"),
    )
    c = c.withColumn("headline", text.bounded(F.col("base"), 10, 160, "Developing news story from verified sources"))
    deck = text.bounded(F.coalesce(F.nullif("said", F.lit("")), F.col("base")), 10, 240, "Reporting on the headline")
    told = text.bounded(F.when(F.length("said") >= 20, F.col("said")).otherwise(F.concat(F.lit("The source headline reports: "), "headline", F.lit("."))), 20, 800, "The source provided no permitted description for this draft.")
    plain = F.regexp_replace(F.regexp_replace(F.lower("cluster_id"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    story_id = F.regexp_replace(F.substring(F.when(plain.startswith("s-"), plain).otherwise(F.concat(F.lit("s-"), plain)), 1, 64), "-+$", "")
    c = c.withColumn("story_id", story_id)
    return c.select(
        "cluster_id", "story_id", F.regexp_replace(F.substring(F.concat_ws("-", "topic", "story_id"), 1, 60), "-+$", "").alias("slug"), "topic",
        F.when(F.col("opinion"), "opinion").otherwise("reporting").alias("reportingType"), "headline", deck.alias("deck"), F.array(told).alias("whatChanged"),
        F.lit(WHY).alias("whyItMatters"), F.when(F.col("disputed"), UNSURE).alias("uncertainty"), "sourceIds", F.size("sourceIds").alias("sourceCount"),
        F.when(F.col("disputed"), "disputed").when(F.size("sourceIds") > 1, "multi-source").otherwise("single-source").alias("confidence"),
        F.col("first").alias("first_published_at"), F.col("last").alias("updated_at"), F.lit(False).alias("reviewed"),
    )


def official_labels(stories: DataFrame, registry: DataFrame) -> DataFrame:
    """Stories whose cited sources are all known and official are labelled official."""
    cites = stories.select("story_id", F.explode("sourceIds").alias("source_id")).join(registry.select("source_id", "sourceType"), "source_id", "left")
    official = cites.groupBy("story_id").agg(F.every(F.coalesce(F.col("sourceType") == "official", F.lit(False))).alias("all")).filter("all")
    return stories.join(official, "story_id", "left").withColumn("reportingType", F.when(F.col("all"), "official").otherwise(F.col("reportingType"))).drop("all")


def prompt(turns: DataFrame, group: str, order: str, role: str, said: str) -> DataFrame:
    """A conversation's or cluster's parts as one text, in order."""
    part = F.struct(F.col(order).alias("o"), F.concat_ws(": ", role, said).alias("t"))
    return turns.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["t"]), "\n").alias("prompt"))


ANSWER = "struct<headline:string,deck:string,whatChanged:array<struct<sentence:string,sourceIds:array<string>>>,whyItMatters:string,background:string,uncertainty:string,reportingType:string>"


def parse_answer(raw: Column, allowed: Column) -> Column:
    """A model's answer without its code fence, as a struct; problem tells why it can't be used."""
    bare = text.trimmed(F.regexp_replace(F.regexp_replace(text.trimmed(raw), r"^```(?:json)?", ""), r"```$", ""))
    answer = F.from_json(bare, ANSWER)
    cited = F.flatten(F.transform(answer["whatChanged"], lambda w: w["sourceIds"]))
    problem = F.when(answer.isNull() | answer["headline"].isNull() | answer["whatChanged"].isNull(), "malformed").when(F.size(F.array_except(cited, allowed)) > 0, "cites other sources")
    return F.struct(answer.alias("answer"), problem.alias("problem"))


def paragraphs(sentences: Column, room: int = 750, most: int = 4) -> Column:
    """Sentences packed in order into paragraphs of at most room characters."""

    def step(ps: Column, s: Column) -> Column:
        fits = (F.size(ps) > 0) & (F.length(F.coalesce(F.try_element_at(ps, F.lit(-1)), F.lit(""))) + 1 + F.length(s) <= room)
        joined = F.concat(F.slice(ps, 1, F.greatest(F.size(ps) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(ps, F.lit(-1)), s)))
        return F.when(fits, joined).otherwise(F.array_append(ps, s))

    return F.slice(F.aggregate(sentences, F.array().cast("array<string>"), step), 1, most)


def summarize_with(clusters: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A provider's stories for clusters, batch by batch where the clusters are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield provider(batch)

    return clusters.mapInPandas(run, schema)


def golden_metrics(cases: DataFrame) -> DataFrame:
    """cases(case_id, kind prompt/fallback/golden/trap, passed): rates, 1 where there are none."""
    rate = lambda kind: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("passed").cast("double"))), F.lit(1.0)).alias(f"{kind}_rate")
    return cases.agg(*[rate(k) for k in ("prompt", "fallback", "golden", "trap")])
