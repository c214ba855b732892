"""Golden evaluation: cases with a summary that is right and poisoned ones that the factual rules must catch.

A case is a cluster, a golden story and traps. A trap is the golden story with some fields replaced and the rule that
must block it. Cases and traps are rows: golden stories, a summarizer's own stories and all poisoned ones go through the
factual rules together, and what was caught is a semi join of traps with blocking findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators import findings, summarizing
from broadsheet.session import written

_STORY = "headline:string,deck:string,whatChanged:array<string>,whyItMatters:string,background:string,uncertainty:string,sourceIds:array<string>,reportingType:string,confidence:string"
_ITEM = "struct<ordinal:int,source_id:string,guid:string,title:string,description:string,published_at:timestamp>"
CASE = f"case_id string, topic string, title string, items array<{_ITEM}>, golden struct<{_STORY}>, traps array<struct<name:string,rule:string,story:struct<{_STORY}>>>"
_FIELDS = [f.split(":")[0] for f in _STORY.split(",") if ":" in f]


@dataclass(frozen=True)
class Metrics:
    """Rates over all cases; 1 where there is nothing to rate."""

    cases: int
    passed: int
    traps: int
    caught: int
    prompt_rate: float
    fallback_rate: float
    golden_rate: float
    trap_rate: float
    number_rate: float
    entity_rate: float
    attribution_rate: float
    uncertainty_rate: float


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON files, a case an object; a file may be one list of them."""
    return spark.read.schema(CASE).option("multiLine", True).json(path)


def _sources() -> Column:
    return F.array_sort(F.array_distinct(F.transform("items", lambda i: i["source_id"])))


def evaluate(cases: DataFrame, provider: summarizing.Provider | None = None, patience: summarizing.Patience = summarizing.Patience()) -> DataFrame:
    """A row a case: case_id, topic, prompt_ok, fallback_ok, golden_ok, traps, caught, missed (names of traps), blocking (rules
    that the summarizer's or the golden story broke), and passed. Cases without traps have none to catch."""
    c = written(cases.withColumn("sources", _sources()), "golden-cases")
    clusters = c.select(F.col("case_id").alias("cluster_id"), "topic", F.col("title").alias("cleaned_title"), "items")
    prompts = c.select("case_id", (F.length(F.to_json(F.struct("topic", "title", "items"))) > 50).alias("prompt_ok"))

    made = summarizing.summarize(clusters, provider, patience=patience).select("cluster_id", *[F.col(f) if f != "background" else F.lit(None).cast("string").alias(f) for f in _FIELDS])
    own = made.join(c.select(F.col("case_id").alias("cluster_id"), "sources", "items"), "cluster_id")
    story = lambda kind, name: F.concat_ws("\u001f", F.lit(kind), F.col(name), F.coalesce(F.col("trap"), F.lit(""))).alias("story_id")
    own = own.withColumn("trap", F.lit(None).cast("string")).select(story("own", "cluster_id"), *_FIELDS, "sources", "items")
    gold = c.withColumn("trap", F.lit(None).cast("string")).select(story("golden", "case_id"), *[F.col(f"golden.{f}").alias(f) for f in _FIELDS], "sources", "items")
    each = written(c.select("case_id", "golden", "sources", "items", F.explode("traps").alias("t")).withColumn("trap", F.col("t.name")), "golden-traps")
    poisoned = each.select(story("trap", "case_id"), *[F.coalesce(F.col(f"t.story.{f}"), F.col(f"golden.{f}")).alias(f) for f in _FIELDS], "sources", "items")

    found = written(findings.factual_findings(own.unionByName(gold).unionByName(poisoned)), "golden-findings")
    found = found.withColumn("at", F.split("story_id", "\u001f")).select(F.col("at")[0].alias("kind"), F.col("at")[1].alias("case_id"), F.col("at")[2].alias("trap"), "rule_id", "severity")
    blocking = found.filter("severity = 'blocking'")
    # any rule that blocks a poisoned story catches it; that of the trap is the one to be expected
    caught = each.select("case_id", "trap").join(blocking.filter("kind = 'trap'").select("case_id", "trap"), ["case_id", "trap"], "left_semi").withColumn("is_caught", F.lit(True))
    traps = each.select("case_id", "trap").join(caught, ["case_id", "trap"], "left").groupBy("case_id").agg(F.count("*").alias("traps"), F.count("is_caught").alias("caught"), F.sort_array(F.collect_list(F.when(F.col("is_caught").isNull(), F.col("trap")))).alias("missed"))
    broken = blocking.filter("kind <> 'trap'").groupBy("case_id").agg(F.sort_array(F.collect_set(F.concat_ws(" ", "kind", "rule_id"))).alias("blocking"))
    gone = clusters.select(F.col("cluster_id").alias("case_id")).join(made.select(F.col("cluster_id").alias("case_id")), "case_id", "left_anti").withColumn("gone", F.lit(True))
    out = c.select("case_id", "topic").join(prompts, "case_id").join(traps, "case_id", "left").join(broken, "case_id", "left").join(gone, "case_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("blocking", F.coalesce("blocking", none)).withColumn("missed", F.coalesce("missed", none)).na.fill(0, ["traps", "caught"])
    of = lambda kind: ~F.exists("blocking", lambda b: b.startswith(kind + " "))
    out = out.withColumn("fallback_ok", of("own") & F.col("gone").isNull()).withColumn("golden_ok", of("golden")).drop("gone")
    return out.withColumn("passed", F.col("prompt_ok") & F.col("fallback_ok") & F.col("golden_ok") & (F.col("caught") == F.col("traps")))


def metrics(evaluated: DataFrame) -> Metrics:
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(1.0))
    free = lambda rule: rate(~F.array_contains("blocking", f"golden fact/{rule}"))
    r = evaluated.agg(
        F.count("*"), F.count_if("passed"), F.coalesce(F.sum("traps"), F.lit(0)), F.coalesce(F.sum("caught"), F.lit(0)), rate(F.col("prompt_ok")), rate(F.col("fallback_ok")), rate(F.col("golden_ok")),
        F.when(F.sum("traps") > 0, F.sum("caught") / F.sum("traps")).otherwise(1.0), free("number-containment"), free("entity-containment"), free("source-attribution"), free("uncertainty-on-conflict"),
    ).first()
    return Metrics(*r)


def report(evaluated: DataFrame) -> str:
    """The evaluation as Markdown: rates, and a line for each case that failed."""
    m = metrics(evaluated)
    lines = ["# Golden evaluation", "", f"{m.passed} of {m.cases} cases passed; {m.caught} of {m.traps} traps caught.", "", "| Rate | |", "|---|---|"]
    lines += [f"| {n} | {getattr(m, n + '_rate'):.1%} |" for n in ("prompt", "fallback", "golden", "trap", "number", "entity", "attribution", "uncertainty")]
    failed = evaluated.filter("NOT passed").orderBy("case_id").limit(1000).collect()  # the text shows so many; the table has all
    lines += ["", *[f"- {r['case_id']}: {', '.join([*r['blocking'], *(f'missed {t}' for t in r['missed'])]) or 'no story'}" for r in failed]]
    return "\n".join(lines).rstrip() + "\n"
