"""Summaries by a provider, with retries, a deadline, and the deterministic summary for whatever it doesn't answer.

Each cluster ends in one outcome: an answer that holds, or the reason why there is none. Answers are read on the JVM side;
clusters without one are found by an anti join and summarised from their own words, so every cluster has a story.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text
from broadsheet.operators import summaries
from broadsheet.session import written


@dataclass(frozen=True)
class Patience:
    """How long an attempt may take, how often it is made again, and the delay before that, doubled each time."""

    timeout_ms: int = 15_000
    retries: int = 2
    delay_ms: int = 500


class Refused(Exception):
    """The provider said no, and would again."""


class Unavailable(Exception):
    """Overload, a broken connection: worth another attempt."""


class Provider(Protocol):
    """A model behind a name. complete() gets the prompt and its time in milliseconds; it may raise the above, TimeoutError
    or anything else. It is sent to tasks, so it must be picklable."""

    name: str
    model: str | None

    def complete(self, prompt: dict, timeout_ms: int) -> str: ...


def provider_of(config: dict | None, make: dict[str, Callable[[dict], Provider]]) -> Provider | None:
    """The provider that a configuration names, from those that can be made; None, for the deterministic summary alone, if
    it names `fallback`, an unknown one, or lacks what its provider needs (make raises KeyError)."""
    try:
        return make[config["provider"]](config) if config else None
    except KeyError:
        return None


def _asked(provider: Provider, prompt: dict, patience: Patience, sleep: Callable[[float], None], clock: Callable[[], float]) -> tuple[str | None, str | None, int]:
    """A raw answer or the reason of the last failure, and the attempts made."""
    reason = None
    for attempt in range(patience.retries + 1):
        if attempt:
            sleep(patience.delay_ms * 2 ** (attempt - 1) / 1000)
        began = clock()
        try:
            raw = provider.complete(prompt, patience.timeout_ms)
        except Refused as e:
            return None, f"refused: {e}"[:200], attempt + 1
        except TimeoutError:
            reason = "timeout"
        except Unavailable as e:
            reason = f"unavailable: {e}"[:200]
        except Exception as e:  # noqa: BLE001 - a provider's fault must not fail a task
            reason = f"error: {type(e).__name__}"
        else:
            if (clock() - began) * 1000 > patience.timeout_ms:
                reason = "timeout"
            elif not isinstance(raw, str) or not raw.strip():
                reason = "empty answer"
            else:
                return raw, None, attempt + 1
    return None, reason, patience.retries + 1


def answers(clusters: DataFrame, provider: Provider, patience: Patience = Patience(), sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """clusters(cluster_id, topic, cleaned_title, permitted) -> cluster_id, raw, reason, attempts, latency_ms: batch by batch
    where the clusters are."""
    item = F.transform("permitted", lambda i: F.struct(i["source_id"].alias("source_id"), i["title"].alias("title"), i["description"].alias("description")))
    prompts = clusters.select("cluster_id", F.to_json(F.struct("topic", F.col("cleaned_title").alias("title"), item.alias("items"))).alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            out = []
            for cluster_id, prompt in zip(batch["cluster_id"], batch["prompt"]):
                began = clock()
                out.append((cluster_id, *_asked(provider, json.loads(prompt), patience, sleep, clock), int((clock() - began) * 1000)))
            yield pd.DataFrame(out, columns=["cluster_id", "raw", "reason", "attempts", "latency_ms"])

    return prompts.mapInPandas(run, "cluster_id string, raw string, reason string, attempts int, latency_ms long")


def summarize(clusters: DataFrame, provider: Provider | None = None, registry: DataFrame | None = None, patience: Patience = Patience(), sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """clusters(cluster_id, topic, cleaned_title, items) -> a story each, as summaries.summarize gives it, with provider,
    model, used_fallback, fallback_reason, attempts and latency_ms.

    A provider is asked about items whose sources permit summaries only. Its answer must be readable, within the bounds of
    a story, and cite these sources alone. Repeated cluster ids are asked about once.
    """
    plain = summaries.summarize(clusters, registry)
    extra = ["provider", "model", "used_fallback", "fallback_reason", "attempts", "latency_ms"]
    if provider is None:
        none = {"provider": F.lit("fallback"), "model": F.lit(None).cast("string"), "used_fallback": F.lit(False), "fallback_reason": F.lit(None).cast("string"), "attempts": F.lit(0), "latency_ms": F.lit(0).cast("long")}
        return plain.withColumns(none)
    asked = summaries.restrict(clusters, registry).dropDuplicates(["cluster_id"])
    raw = written(answers(asked, provider, patience, sleep, clock), "summary-answers")  # a provider isn't asked twice
    allowed = asked.select("cluster_id", F.array_distinct(F.transform("permitted", lambda i: i["source_id"])).alias("allowed"))
    read = raw.join(allowed, "cluster_id").withColumn("read", summaries.parse_answer(F.col("raw"), F.col("allowed")))
    a = F.col("read.answer")
    told = summaries.paragraphs(F.filter(F.transform(a["whatChanged"], lambda w: text.trimmed(w["sentence"])), lambda s: s != ""))
    trim = lambda c, least, most: F.when(F.length(text.trimmed(c)).between(least, most), text.trimmed(c))
    read = read.withColumn("headline", trim(a["headline"], 10, 160)).withColumn("deck", trim(a["deck"], 10, 240)).withColumn("why", trim(a["whyItMatters"], 10, 800)).withColumn("told", told)
    read = read.withColumn("cites", F.array_sort(F.array_distinct(F.flatten(F.transform(a["whatChanged"], lambda w: w["sourceIds"])))))
    outside = F.col("headline").isNull() | F.col("deck").isNull() | F.col("why").isNull() | F.coalesce(F.size("told") == 0, F.lit(True)) | F.coalesce(F.size("cites") == 0, F.lit(True))
    reason = F.coalesce("reason", "read.problem", F.when(outside, "outside a story's bounds"))
    read = written(read.withColumn("why_not", reason), "summary-read")
    good, bad = read.filter("why_not IS NULL"), read.filter("why_not IS NOT NULL")
    note = [F.lit(provider.name).alias("provider"), F.lit(provider.model).cast("string").alias("model")]
    g = good.select("cluster_id", "headline", "deck", "told", "why", F.nullif(text.trimmed(F.col("read.answer.uncertainty")), F.lit("")).alias("unsure"), F.col("read.answer.reportingType").alias("kind"), F.slice("cites", 1, 20).alias("cites"), "attempts", "latency_ms")
    base = plain.select(*[F.col(c).alias(f"_{c}") for c in plain.columns])
    made = g.join(base, F.col("cluster_id") == F.col("_cluster_id"))
    of = {"headline": F.col("headline"), "deck": F.col("deck"), "whatChanged": F.col("told"), "whyItMatters": F.col("why"), "uncertainty": F.coalesce("unsure", "_uncertainty"), "sourceIds": F.col("cites"), "sourceCount": F.size("cites")}
    of["confidence"] = F.when(F.col("_confidence") == "disputed", "disputed").when(F.size("cites") > 1, "multi-source").otherwise("single-source")
    of["reportingType"] = F.when(F.col("kind").isin("reporting", "analysis", "opinion"), F.col("kind")).otherwise(F.col("_reportingType"))
    made = made.select(*[of.get(c, F.col(f"_{c}")).alias(c) for c in plain.columns], *note, F.lit(False).alias("used_fallback"), F.lit(None).cast("string").alias("fallback_reason"), "attempts", "latency_ms")
    rest = plain.join(good.select("cluster_id"), "cluster_id", "left_anti").join(bad.select("cluster_id", F.col("why_not").alias("fallback_reason"), "attempts", "latency_ms"), "cluster_id", "left")
    return made.unionByName(rest.select(*plain.columns, *note, F.lit(True).alias("used_fallback"), "fallback_reason", "attempts", "latency_ms")).select(*plain.columns, *extra)


def outcomes(stories: DataFrame) -> DataFrame:
    """Stories by outcome: answered, or the kind of reason for which the deterministic summary stands in."""
    kind = F.when(~F.col("used_fallback"), F.when(F.col("provider") == "fallback", "deterministic").otherwise("answered")).otherwise(F.split_part("fallback_reason", F.lit(":"), F.lit(1)))
    return stories.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))
