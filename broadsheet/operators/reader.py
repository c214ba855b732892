"""What a reader sees and what is remembered of it, for many readers and editions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import constants as K


def core_list(editions: DataFrame) -> DataFrame:
    """date, position, story_id of core stories that are there, in rank order."""
    core = editions.select("date", F.posexplode("coreStoryIds").alias("position", "story_id"), F.transform("stories", lambda s: s["id"]).alias("ids"))
    return core.filter(F.array_contains("ids", F.col("story_id"))).select("date", "position", "story_id")


def pick_pooled(pools: DataFrame, chosen: DataFrame) -> DataFrame:
    """pools(date, interest, position, story_id) and chosen(reader_id, date, interest) -> two stories a reader and edition.

    Chosen interests go first, then the place in a pool, then the id; a story counts once. position numbers the stories
    that can be shown.
    """
    # of a pool no more than two can be shown, and of all pools of a day two more than the chosen ones may already hold
    first = lambda *by: Window.partitionBy(*by).orderBy("position", "story_id")
    own = pools.withColumn("_r", F.row_number().over(first("date", "interest"))).filter(F.col("_r") <= K.KEPT_INTERESTS).drop("_r")
    each = pools.groupBy("date", "story_id").agg(F.min("position").alias("position"))
    rest = each.withColumn("_r", F.row_number().over(first("date"))).filter(F.col("_r") <= 2 * K.KEPT_INTERESTS).drop("_r")
    wants = chosen.filter("interest is not null").select("reader_id", "date", "interest").distinct()
    wanted = wants.join(own, ["date", "interest"]).select("reader_id", "date", "story_id", F.lit(0).alias("chosen"), "position")
    others = chosen.select("reader_id", "date").distinct().join(rest, "date").select("reader_id", "date", "story_id", F.lit(1).alias("chosen"), "position")
    best = wanted.unionByName(others).groupBy("reader_id", "date", "story_id").agg(F.min(F.struct("chosen", "position")).alias("b"))
    place = F.row_number().over(Window.partitionBy("reader_id", "date").orderBy("b.chosen", "b.position", "story_id"))
    return best.withColumn("place", place).filter(F.col("place") <= K.KEPT_INTERESTS).select("reader_id", "date", "place", "story_id")


def pools_of(editions: DataFrame) -> DataFrame:
    """date, interest, position, story_id of pooled stories that are there and not in the core."""
    each = editions.select("date", "coreStoryIds", F.transform("stories", lambda s: s["id"]).alias("ids"), F.explode("interestPools").alias("interest", "pool"))
    shown = F.filter("pool", lambda i: F.array_contains("ids", i) & ~F.array_contains("coreStoryIds", i))
    return each.select("date", "interest", F.posexplode(shown).alias("position", "story_id"))


def freshness(route: Column, date: Column, today: Column) -> Column:
    return F.when(route == "latest", F.when(date < today, "stale").otherwise("current")).otherwise("archived")


# Notices by freshness and where the edition came from.
NOTICES = [
    ("current", "cache", "This is today's edition, saved on this device."),
    ("stale", "cache", "This is the most recent edition saved on this device. It is not today's edition."),
    ("stale", "network", "Today's edition is not published yet. This is the most recent edition."),
    ("archived", "cache", "This is a past edition, saved on this device."),
    ("archived", "network", "This is a past edition."),
]


def notice(fresh: Column, source: Column) -> Column:
    out = F.lit(None).cast("string")
    for f, s, words in NOTICES:
        out = F.when((fresh == f) & (source == s), words).otherwise(out)
    return out


def progress(shown: DataFrame, viewed: DataFrame, ended: DataFrame) -> DataFrame:
    """shown(reader_id, date, story_id), viewed(the same), ended(reader_id, date) -> counts, text, and whether it is over."""
    hits = shown.join(viewed.select("reader_id", "date", "story_id").distinct().withColumn("hit", F.lit(1)), ["reader_id", "date", "story_id"], "left")
    by = hits.groupBy("reader_id", "date").agg(F.count("hit").alias("viewed_count"), F.count("*").alias("total"))
    out = by.join(ended.select("reader_id", "date").distinct().withColumn("ended", F.lit(True)), ["reader_id", "date"], "left")
    complete = (F.col("total") > 0) & (F.col("viewed_count") == F.col("total"))
    return out.select("reader_id", "date", "viewed_count", "total", F.format_string("%d of %d viewed", "viewed_count", "total").alias("text"), complete.alias("complete"), (complete | F.coalesce("ended", F.lit(False))).alias("over"))


def remembered(views: DataFrame, current: DataFrame | None = None, keep: int = K.KEPT_EDITIONS) -> DataFrame:
    """views(reader_id, date, story_id) -> reader_id, date, stories (sorted, each once) of the newest editions.

    The current edition of a reader (reader_id, date) is kept before all others.
    """
    by = views.groupBy("reader_id", "date").agg(F.sort_array(F.collect_set("story_id")).alias("stories"))
    if current is not None:
        by = by.join(current.select("reader_id", "date", F.lit(True).alias("now")), ["reader_id", "date"], "left")
    else:
        by = by.withColumn("now", F.lit(False))
    w = Window.partitionBy("reader_id").orderBy(F.desc(F.coalesce("now", F.lit(False))), F.desc("date"))
    return by.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).drop("r", "now")


def known_interests(interests: Column) -> Column:
    """Known ones, each once, sorted, two at most."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(interests, lambda i: i.isin(K.INTEREST_TOPICS)))), 1, K.KEPT_INTERESTS)


def state_kind(raw: Column) -> Column:
    """usable (version 1), foreign (a newer version: never overwritten) or replaceable (anything else)."""
    version = F.try_variant_get(F.try_parse_json(raw), "$.schemaVersion", "int")
    return F.when(version == 1, "usable").when(version > 1, "foreign").otherwise("replaceable")


def last_choice(choices: DataFrame) -> DataFrame:
    """choices(reader_id, at, interests, theme): the last of each reader; no theme is the system's."""
    last = choices.groupBy("reader_id").agg(F.max_by("interests", "at").alias("interests"), F.max_by("theme", "at").alias("theme"))
    return last.select("reader_id", known_interests(F.col("interests")).alias("interests"), F.when(F.col("theme").isin("light", "dark"), F.col("theme")).otherwise("system").alias("theme"))


def source_count_label(n: Column) -> Column:
    return F.when(n == 1, "single source").otherwise(F.concat(n.cast("string"), F.lit(" sources")))


def update_marker(stories: DataFrame, notes: DataFrame) -> DataFrame:
    """stories(date, story_id, first_published_at, updated_at) with marker Corrected, Updated or none."""
    named = notes.select("date", "story_id").distinct().withColumn("noted", F.lit(True))
    both = stories.join(named, ["date", "story_id"], "left")
    return both.withColumn("marker", F.when(F.col("noted"), "Corrected").when(F.col("updated_at") > F.col("first_published_at"), "Updated")).drop("noted")


def route(path: Column) -> Column:
    """latest, edition with its date, or unknown."""
    date = F.regexp_extract(path, r"^/editions/(\d{4}-\d{2}-\d{2})/?$", 1)
    real = F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).isNotNull()
    kind = F.when(path.isin("/", ""), "latest").when(real, "edition").otherwise("unknown")
    return F.struct(kind.alias("kind"), F.when(kind == "edition", date).alias("date"))


def prior_date(dates: DataFrame, failed: str) -> DataFrame:
    """The newest other edition to offer."""
    return dates.filter(F.col("date") != failed).agg(F.max("date").alias("date"))
