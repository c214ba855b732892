"""The draft pipeline: normal items to edition documents, one a day, with their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import constants as K
from broadsheet.functions import text
from broadsheet.operators import clusters, findings, lifecycle, ranking, summaries
from broadsheet.session import written


def looked_up(found: DataFrame, members: DataFrame, registry: DataFrame | None, recent: DataFrame | None) -> DataFrame:
    """Clusters with kinds and regions of their sources, permitted descriptions of their items, and the repetition penalty.

    registry: source_id, sourceType, region, active, permittedUses. recent: title_id, unigrams (see text.title_tokens).
    What isn't given stays null, and the features have their defaults.
    """
    out = found
    if registry is not None:
        of = found.select("leader", F.explode("sources").alias("source_id")).join(registry.select("source_id", "sourceType", "region"), "source_id", "left")
        of = of.groupBy("leader").agg(F.collect_list("sourceType").alias("kinds"), F.collect_set("region").alias("regions"))
        may = registry.filter(F.col("active") & F.array_contains("permittedUses", "supplied-description")).select("source_id")
        said = members.join(may, "source_id", "left_semi").groupBy("leader").agg(F.collect_list("description").alias("descriptions"))  # CLUSTER_SIZE at most
        out = out.join(of, "leader", "left").join(said, "leader", "left")
    else:
        out = out.withColumn("kinds", F.lit(None).cast("array<string>")).withColumn("regions", F.lit(None).cast("array<string>")).withColumn("descriptions", F.lit(None).cast("array<string>"))
    if recent is not None:
        titles = found.select(F.col("leader").alias("id"), text.title_tokens(F.col("representative_title"))["unigrams"].alias("unigrams"))
        return out.join(ranking.repetition_penalties(titles, recent).select(F.col("id").alias("leader"), "penalty"), "leader", "left")
    return out.withColumn("penalty", F.lit(0.0))


def score(found: DataFrame, members: DataFrame | None = None, registry: DataFrame | None = None, recent: DataFrame | None = None) -> DataFrame:
    """Clusters with edition (the day in India of their last item), topic and composite score (see looked_up)."""
    c = looked_up(found, members, registry, recent)
    topic = ranking.topic_of(F.col("representative_title"), F.coalesce("descriptions", F.array().cast("array<string>")))["topic"]
    out = c.withColumn("edition", text.editorial_day(F.col("last_published_at"))).withColumn("topic", topic)
    given = registry is not None
    scores = {
        "recency": ranking.recency(F.col("last_published_at"), F.col("edition").cast("timestamp")),
        "corroboration": ranking.corroboration(F.col("source_count")),
        "source_tier": ranking.source_tier(F.coalesce("kinds", F.array().cast("array<string>")) if given else None),
        "india_relevance": ranking.india_relevance(text.title_tokens(F.col("representative_title")), F.coalesce("regions", F.array().cast("array<string>")) if given else None),
        "topic_weight": ranking.topic_weight(F.col("topic")),
    }
    return out.withColumn("composite_score", ranking.composite(scores, F.coalesce("penalty", F.lit(0.0)))).drop("kinds", "regions", "descriptions", "penalty")


def compose(found: DataFrame, members: DataFrame | None = None, registry: DataFrame | None = None, recent: DataFrame | None = None) -> DataFrame:
    return ranking.compose(ranking.rank(score(found, members, registry, recent)))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def resolve_sources(cites: DataFrame, items: DataFrame, registry: DataFrame | None) -> DataFrame:
    """cites(edition, source_id) with what an edition says of a source: title and URL of its first item, its earliest
    time; publisher and kind from the registry, else a name made of its id."""
    first = F.min_by(F.struct("title", "url"), F.struct(F.col("published_at").isNull().alias("undated"), "published_at", "guid"))
    of_items = items.groupBy("source_id").agg(first.alias("i"), F.min("published_at").alias("earliest"))
    out = cites.distinct().join(of_items, "source_id", "left")
    if registry is not None:
        out = out.join(registry.select("source_id", "publisher", "sourceType", "siteUrl"), "source_id", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("string").alias(c) for c in ("publisher", "sourceType", "siteUrl")])
    name = F.coalesce("publisher", text.slug_to_name(F.col("source_id")))
    url = F.coalesce("i.url", "siteUrl", F.concat(F.lit("https://"), "source_id", F.lit(".example/")))
    s = F.struct(
        F.col("source_id").alias("id"), name.alias("publisher"), *[F.lit(None).cast("string").alias("attribution"), F.lit(None).cast("array<string>").alias("authors"), F.lit(None).cast("string").alias("termsUrl"), F.lit(None).cast("string").alias("licenseUrl")],
        F.coalesce("i.title", name).alias("title"), url.alias("url"), F.coalesce("sourceType", F.lit("publisher")).alias("sourceType"), iso(F.col("earliest")).alias("publishedAt"),
    )
    return out.select("edition", s.alias("source"))


def draft_editions(items: DataFrame, registry: DataFrame | None = None, now: str | None = None, recent: DataFrame | None = None) -> DataFrame:
    """Edition documents (file and the columns of findings.EDITION) of all days of normal items.

    Clusters without a source that permits summaries are passed over, so a core may be short. now is the time of the run;
    without it each draft carries midnight of its day. recent are titles of earlier editions, which lower what repeats them.
    """
    members = written(clusters.cluster_items(items), "draft-members")
    composed = written(compose(clusters.clusters(members), members, registry, recent).filter("decision <> 'rejected'"), "draft-composed")
    place = F.row_number().over(Window.partitionBy("edition", "topic", "decision").orderBy("rank"))
    chosen = composed.withColumn("place", place).filter((F.col("decision") == "selected_core") | (F.col("place") <= K.PIPELINE_POOL))
    item = F.struct(F.col("join_ordinal").alias("ordinal"), "source_id", "guid", "title", "description", "published_at")
    grouped = members.groupBy("leader").agg(F.sort_array(F.collect_list(item)).alias("items"))
    ready = chosen.join(grouped, "leader").select("edition", "rank", "decision", "cluster_id", "topic", "cleaned_title", "items")
    stories = summaries.summarize(ready.select("cluster_id", "topic", "cleaned_title", "items"), registry)
    if registry is not None:
        stories = summaries.official_labels(stories, registry)
    stamp = F.coalesce(F.lit(now), F.date_format("edition", "yyyy-MM-dd'T'00:00:00'Z'"))
    s = stories.join(ready.select("edition", "rank", "decision", "cluster_id"), "cluster_id")
    story = F.struct(
        F.col("story_id").alias("id"), "slug", "topic", "reportingType", "headline", "deck", "whatChanged", "whyItMatters", F.lit(None).cast("string").alias("background"), "uncertainty", "sourceIds", "sourceCount", "confidence",
        F.coalesce(iso(F.col("first_published_at")), stamp).alias("firstPublishedAt"), F.coalesce(iso(F.col("updated_at")), stamp).alias("updatedAt"),
        F.lit(None).cast("string").alias("generatedBy"), F.lit(None).cast("string").alias("promptVersion"), "reviewed",
    )
    s = written(s.select("edition", "rank", "decision", story.alias("story")), "draft-stories")
    core = F.col("decision") == "selected_core"
    entry = F.struct((~core).alias("pooled"), "rank", "story")
    pools = s.filter(~core).groupBy("edition", "story.topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("story.id").alias("id")))), lambda x: x["id"]).alias("ids"))
    pools = pools.groupBy("edition").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("topic", "ids")))).alias("interestPools"))
    sources = resolve_sources(s.select("edition", F.explode("story.sourceIds").alias("source_id")), items, registry).groupBy("edition").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    made = s.groupBy("edition").agg(F.sort_array(F.collect_list(entry)).alias("entries")).join(pools, "edition", "left").join(sources, "edition", "left")
    listed = F.transform("entries", lambda e: e["story"])
    first = F.transform(F.filter("entries", lambda e: ~e["pooled"]), lambda e: e["story"]["id"])
    made = made.withColumn("stories", listed).withColumn("coreStoryIds", first)
    return made.select(
        F.concat(F.col("edition").cast("string"), F.lit(".json")).alias("file"), F.lit(1).alias("schemaVersion"), F.col("edition").cast("string").alias("date"), F.lit(1).alias("editionVersion"), F.lit("draft").alias("status"),
        stamp.alias("publishedAt"), stamp.alias("updatedAt"), lifecycle.minutes(F.col("stories"), F.col("coreStoryIds")).alias("estimatedMinutes"), "coreStoryIds",
        F.coalesce("interestPools", F.create_map().cast("map<string,array<string>>")).alias("interestPools"), "stories", "sources",
        F.array().cast(f"array<{findings.NOTE}>").alias("correctionNotes"),
    )


def draft_report(editions: DataFrame) -> DataFrame:
    """One row a draft: counts of findings and whether it could be published."""
    return findings.report(editions, findings.edition_findings(editions))


def summary_markdown(editions: DataFrame, reports: DataFrame) -> DataFrame:
    """date, markdown: what a draft holds and what its rules say."""
    line = lambda s: F.concat(F.lit("| "), text.escape_pipes(s["headline"]), F.lit(" | "), s["topic"], F.lit(" | "), s["sourceCount"].cast("string"), F.lit(" |"))
    body = F.array_join(F.transform("stories", line), "\n")
    both = editions.join(reports.select("date", "blocking", "warnings"), "date")
    head = F.format_string("# Draft %s\n\n%d core stories, %d blocking findings, %d warnings, %d minutes\n\n| Story | Topic | Sources |\n|---|---|---|\n", "date", F.size("coreStoryIds"), "blocking", "warnings", "estimatedMinutes")
    return both.select("date", F.concat(head, body).alias("markdown"))
