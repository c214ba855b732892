"""What happens to editions after they are drafted: publish, correct, roll back, stage, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import constants as K
from broadsheet.functions.text import safe_relative_name, visible_word_count


def publish(drafts: DataFrame, now: str) -> DataFrame:
    """Drafts of version 1 without corrections become published, all stories reviewed at now; others raise an error."""
    ok = (F.col("status") == "draft") & (F.coalesce(F.size("correctionNotes"), F.lit(0)) <= 0) & (F.col("editionVersion") == 1)
    checked = drafts.withColumn("status", F.when(ok, "published").otherwise(F.raise_error(F.concat(F.lit("not a clean first draft: "), "date"))))
    stories = F.transform("stories", lambda s: s.withField("reviewed", F.lit(True)).withField("updatedAt", F.lit(now)))
    return checked.withColumn("updatedAt", F.lit(now)).withColumn("stories", stories)


def visible_words(story: Column) -> Column:
    return visible_word_count(F.concat_ws(" ", F.concat(F.array(story["deck"]), story["whatChanged"], F.array(story["whyItMatters"], F.coalesce(story["uncertainty"], F.lit(""))))))


def minutes(stories: Column, core: Column) -> Column:
    """Minutes for the core and the two wordiest other stories (ties to the smaller id), between 1 and 60."""
    of_core = F.aggregate(F.filter(stories, lambda s: F.array_contains(core, s["id"])), F.lit(0), lambda a, s: a + visible_words(s))
    rest = F.array_sort(F.transform(F.filter(stories, lambda s: ~F.array_contains(core, s["id"])), lambda s: F.struct((-visible_words(s)).alias("n"), s["id"].alias("id"))))
    pooled = F.aggregate(F.slice(rest, 1, K.POOLED_VISIBLE), F.lit(0), lambda a, s: a - s["n"])
    return F.greatest(F.lit(1), F.least(F.lit(60), F.ceil((of_core + pooled) / K.WORDS_PER_MINUTE).cast("int")))


def correct(editions: DataFrame, corrections: DataFrame, now: str) -> DataFrame:
    """corrections(date, storyId, summary, detail, headline, deck) applied to their editions, one an edition and run.

    The version grows by one, a note corr-<story>-v<version> is added, the story's given fields replace its own, and the
    minutes are counted anew. A draft, or a story that isn't there, raises an error.
    """
    c = corrections.select("date", F.struct(*[x for x in corrections.columns if x != "date"]).alias("c"))
    e = editions.join(c, "date")
    known = F.exists("stories", lambda s: s["id"] == F.col("c.storyId"))
    ok = (F.col("status") != "draft") & known
    version = F.col("editionVersion") + 1
    fields = [f for f in corrections.columns if f in ("headline", "deck", "whyItMatters", "uncertainty")]

    def changed(s: Column) -> Column:
        out = s.withField("updatedAt", F.lit(now))
        for f in fields:
            out = out.withField(f, F.coalesce(F.col(f"c.{f}"), s[f]))
        return F.when(s["id"] == F.col("c.storyId"), out).otherwise(s)

    note = F.struct(
        F.concat(F.lit("corr-"), F.col("c.storyId"), F.lit("-v"), version.cast("string")).alias("id"), F.col("c.storyId").alias("storyId"), F.lit(now).alias("correctedAt"),
        version.alias("editionVersion"), F.col("c.summary").alias("summary"), F.col("c.detail").alias("detail"),
    )
    out = e.withColumn("stories", F.transform("stories", changed)).withColumn("correctionNotes", F.concat(F.coalesce("correctionNotes", F.array().cast(editions.schema["correctionNotes"].dataType)), F.array(note)))
    out = out.withColumn("editionVersion", version).withColumn("updatedAt", F.lit(now)).withColumn("estimatedMinutes", minutes(F.col("stories"), F.col("coreStoryIds")))
    return out.withColumn("status", F.when(ok, "corrected").otherwise(F.raise_error(F.concat(F.lit("can't be corrected: "), "date")))).drop("c")


def eligible(editions: DataFrame) -> DataFrame:
    return editions.filter(F.col("status").isin("published", "corrected"))


def rollback_plan(editions: DataFrame, target: str | None = None, to_previous: bool = False, withdraw: bool = True) -> DataFrame:
    """One row: current_latest, target_date, withdrawn (newest first), remaining (oldest first), error.

    Dates of editions are a few thousand at most a decade; they are the only thing gathered.
    """
    dates = eligible(editions).agg(F.sort_array(F.collect_set("date")).alias("d"))
    n = F.size("d")
    latest = F.when(n > 0, F.element_at("d", -1))
    goal = F.when(n > 1, F.element_at("d", -2)) if to_previous else F.lit(target).cast("string")
    row = dates.select("d", latest.alias("current_latest"), goal.alias("target_date"))
    error = (
        F.when(F.size("d") == 0, "no edition to roll back")
        .when(F.lit(to_previous) & (F.size("d") < 2), "only one edition")
        .when(F.col("target_date").isNull(), "no target given")
        .when(F.col("target_date") > F.col("current_latest"), F.when(F.array_contains("d", F.col("target_date")), "newer than the latest").otherwise("not a published edition"))
        .when(~F.array_contains("d", F.col("target_date")), "not a published edition")
        .when(F.col("target_date") == F.col("current_latest"), "already the latest")
    )
    out = F.filter("d", lambda x: x > F.col("target_date")) if withdraw else F.array().cast("array<string>")
    return row.withColumn("error", error).select(
        "current_latest", "target_date", "error",
        F.when(F.col("error").isNull(), F.reverse(out)).alias("withdrawn"), F.when(F.col("error").isNull(), F.array_except("d", out)).alias("remaining"),
    )


def withdraw(editions: DataFrame, plan: DataFrame) -> DataFrame:
    """Editions after a rollback: withdrawn ones are drafts again and their stories unreviewed, unless corrected."""
    gone = plan.select(F.explode("withdrawn").alias("date")).withColumn("gone", F.lit(True))
    e = editions.join(gone, "date", "left")
    back = F.coalesce("gone", F.lit(False)) & (F.col("status") == "published")
    stories = F.when(back, F.transform("stories", lambda s: s.withField("reviewed", F.lit(False)))).otherwise(F.col("stories"))
    return e.withColumn("stories", stories).withColumn("status", F.when(back, "draft").otherwise(F.col("status"))).drop("gone")


def staging_plan(reports: DataFrame, mode: str = "published") -> DataFrame:
    """reports(file, date, blocking, warnings, publishable) with stage, reason and rank (newest first, files break ties)."""
    may = F.col("publishable") if mode == "published" else F.col("blocking") == 0
    reason = F.when(F.col("date").isNull(), "no date").when(~may, "not publishable" if mode == "published" else "blocked")
    out = reports.withColumn("reason", reason).withColumn("stage", F.col("reason").isNull())
    return out.withColumn("rank", F.when(F.col("stage"), F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("date"), "file"))))


def staged_index(plan: DataFrame, mode: str = "published") -> DataFrame:
    """The one-row index: schemaVersion, contentSet, latest, editions newest first, each date once."""
    dates = F.reverse(F.sort_array(F.collect_set(F.when(F.col("stage"), F.col("date")))))
    return plan.agg(dates.alias("editions")).select(F.lit(1).alias("schemaVersion"), F.lit("published" if mode == "published" else "sample").alias("contentSet"), F.when(F.size("editions") > 0, F.col("editions")[0]).alias("latest"), "editions")


def index_problems(index: DataFrame) -> DataFrame:
    """problem rows of index documents: an unknown version, a latest that isn't first, dates out of order or repeated."""
    checks = {
        "schemaVersion: must be 1": ~F.col("schemaVersion").eqNullSafe(F.lit(1)),
        "contentSet: unknown": ~F.coalesce(F.col("contentSet").isin("published", "sample"), F.lit(False)),
        "latest: must be the newest edition": ~F.col("latest").eqNullSafe(F.when(F.size("editions") > 0, F.col("editions")[0])),
        "editions: must be newest first and unique": F.col("editions") != F.reverse(F.sort_array(F.array_distinct("editions"))),
    }
    return index.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("problem"))


def removal_plan(present: DataFrame, keep: DataFrame) -> DataFrame:
    """name, action: remove what is there and isn't kept; names that could leave the folder are refused."""
    gone = present.select("name").distinct().join(keep.select("name").distinct(), "name", "left_anti")
    return gone.withColumn("action", F.when(safe_relative_name(F.col("name")), "remove").otherwise("refuse"))


def prefixed_removals(existing: DataFrame, keep: DataFrame, prefix: str) -> DataFrame:
    return existing.filter(F.col("name").startswith(prefix)).select("name").distinct().join(keep.select("name"), "name", "left_anti")


def precache(names: DataFrame, excluded: list[str], folder: str = "content/") -> DataFrame:
    """Built files to keep at hand: not in a folder, not among a few names; unsafe names are refused."""
    wanted = names.select("name").distinct().filter(~F.col("name").startswith(folder) & ~F.col("name").isin(excluded))
    return wanted.withColumn("action", F.when(safe_relative_name(F.col("name")), "cache").otherwise("refuse"))


def system_status(registry_report: DataFrame, reports: DataFrame, index: DataFrame) -> DataFrame:
    """One row: status from the registry (blocking), the editions (n, publishable, blocking) and the index pointer."""
    r = registry_report.agg(F.count_if(F.col("severity") == "blocking").alias("registry_blocking"))
    e = reports.agg(F.count("*").alias("n"), F.count_if("publishable").alias("publishable"), F.count_if(F.col("blocking") > 0).alias("blocked"), F.max(F.when(F.col("publishable"), F.col("date"))).alias("newest"))
    i = index.agg(F.max("latest").alias("latest"))
    one = r.crossJoin(e).crossJoin(i)
    status = (
        F.when((F.col("n") == 0) | (F.col("publishable") == 0), "offline")
        .when(F.col("registry_blocking") > 0, "degraded")
        .when((F.col("blocked") > 0) | ~F.col("latest").eqNullSafe(F.col("newest")), "warning")
        .otherwise("healthy")
    )
    return one.withColumn("status", status)
