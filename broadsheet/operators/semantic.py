"""Semantic merges: clusters take in later clusters of their time that an outside provider calls the same story.

In order (latest first), a cluster looks at each later one that is still on its own and takes it in if both together have
CLUSTER_SIZE items at most, their first items are CLUSTER_HOURS apart at most, and the provider says so with enough
confidence. One that was taken in takes in none. A call that fails counts as a no.

That order is kept without a loop over clusters. In a round, a cluster moves if no pair is open in which it may still be
taken in; it goes along its own pairs until one whose later side an earlier cluster may still want. Whatever
waits, the earliest cluster with open pairs can move, so each round settles something, and clusters of different
stories settle at the same time. Each round starts from a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import constants as K
from broadsheet.operators import clusters as C
from broadsheet.session import written

#: Pairs of a cluster that are gone along in a round, at most; the rest wait for the next.
STRIDE = 64


class Provider(Protocol):
    """Decides whether two clusters tell one story. It is sent to tasks, so it must be picklable."""

    name: str

    def evaluate(self, a: dict, b: dict) -> tuple[bool, float, str | None]:
        """Whether b belongs to a, the confidence of that, and why. May raise."""


class NoMerges:
    """The provider of a run without one."""

    name = "noop"

    def evaluate(self, a: dict, b: dict) -> tuple[bool, float, str | None]:
        return False, 0.0, None


def order_key(last_at: Column, sources: Column, cluster_id: Column) -> Column:
    """Clusters in order: the latest first, those without a time last; then the most sources; then the id."""
    return F.struct(last_at.isNull().alias("undated"), (-F.unix_millis(last_at)).alias("last"), (-sources).cast("long").alias("sources"), cluster_id.alias("id"))


def window_pairs(found: DataFrame, on: list[str] | None = None) -> DataFrame:
    """All pairs (a, b) of clusters (leader, primary_at) whose first items are CLUSTER_HOURS apart at most, by bands of that
    width; with `on`, only those that are equal in these columns. Clusters without a time are near all."""
    width = K.CLUSTER_HOURS * 3600000
    at = found.select("leader", F.unix_millis("primary_at").alias("at"), *(on or [])).withColumn("band", F.floor(F.col("at") / width))
    other = at.select(F.col("leader").alias("b"), F.col("at").alias("then"), F.col("band").alias("there"), *(on or []))
    apart = (F.col("leader") != F.col("b")) & (F.abs(F.col("at") - F.col("then")) <= width)
    near = at.filter("at is not null").withColumn("there", F.explode(F.array("band", F.col("band") + 1)))
    pairs = near.join(other.filter("then is not null"), ["there", *(on or [])]).filter(apart & ((F.col("band") < F.col("there")) | (F.col("leader") < F.col("b")))).select(F.col("leader").alias("a"), "b")
    undated = at.filter("at is null")
    if undated.isEmpty():
        return pairs
    meets = undated.join(other, on) if on else undated.crossJoin(other.drop("there"))
    return pairs.union(meets.filter((F.col("leader") != F.col("b")) & (F.col("then").isNotNull() | (F.col("leader") < F.col("b")))).select(F.col("leader").alias("a"), "b"))


def decisions(pairs: DataFrame, views: DataFrame, provider: Provider, least: float) -> DataFrame:
    """pairs (i, j, ...) with yes, confidence and reason, as the provider judges their views (leader, view)."""
    side = lambda x: views.select(F.col("leader").alias(x), F.to_json("view").alias(f"view_{x}"))
    both = pairs.select("i", "j").join(side("i"), "i").join(side("j"), "j")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            out = []
            for a, b in zip(batch["view_i"], batch["view_j"]):
                try:
                    yes, confidence, reason = provider.evaluate(json.loads(a), json.loads(b))
                    confidence = float(confidence)
                    out.append((bool(yes) and np.isfinite(confidence) and confidence >= least, confidence, reason))
                except Exception:  # noqa: BLE001 - whatever a provider raises keeps its two clusters apart
                    out.append((False, 0.0, None))
            yield pd.DataFrame({"i": batch["i"], "j": batch["j"]} | dict(zip(("yes", "confidence", "reason"), map(list, zip(*out)))) if out else {"i": [], "j": [], "yes": [], "confidence": [], "reason": []})

    return pairs.join(both.mapInPandas(judge, "i long, j long, yes boolean, confidence double, reason string"), ["i", "j"])


def _moves(open_pairs: DataFrame, one: bool) -> DataFrame:
    """For each cluster that can move: what it takes in (`taken`, in order), and `upto`, the key before which its pairs are
    settled (null: all of them). one: it stops after the first that it takes in."""
    free = open_pairs.join(open_pairs.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
    first = open_pairs.groupBy("j").agg(F.min("ki").alias("first"))
    place = F.row_number().over(Window.partitionBy("i").orderBy("kj"))
    near = free.join(first, "j").withColumn("place", place).filter(F.col("place") <= STRIDE + 1)
    pair = F.struct("kj", "j", "size_j", "confidence", "reason", ((F.col("first") < F.col("ki")) | (F.col("place") > STRIDE)).alias("waits"), "yes")
    each = near.groupBy("i").agg(F.first("size_i").alias("size_i"), F.sort_array(F.collect_list(pair)).alias("pairs"))
    kind = each.schema["pairs"].dataType.elementType
    key = kind["kj"].dataType.simpleString()
    state = F.struct(F.col("size_i").alias("size"), F.lit(None).cast(key).alias("upto"), F.array().cast(f"array<{kind.simpleString()}>").alias("taken"))

    def step(s: Column, p: Column) -> Column:
        fits = p["yes"] & (s["size"] + p["size_j"] <= K.CLUSTER_SIZE)
        stop = (fits & p["waits"]) | (p["waits"] & (p["kj"] == F.element_at("pairs", -1)["kj"]) & (F.size("pairs") > STRIDE))
        if one:
            stop = stop | (F.size(s["taken"]) > 0)
        halted = F.struct(s["size"].alias("size"), p["kj"].alias("upto"), s["taken"].alias("taken"))
        took = F.struct((s["size"] + p["size_j"]).alias("size"), s["upto"].alias("upto"), F.concat(s["taken"], F.array(p)).alias("taken"))
        return F.when(s["upto"].isNotNull(), s).when(stop, halted).when(fits, took).otherwise(s)

    return each.select("i", F.aggregate("pairs", state, step).alias("s")).select("i", F.col("s.size").alias("size"), F.col("s.upto").alias("upto"), F.col("s.taken").alias("taken"))


def absorptions(found: DataFrame, pairs: DataFrame, provider: Provider, views: DataFrame, least: float = K.SEMANTIC_FLOOR, grown: object = None, most_rounds: int = 500) -> DataFrame:
    """(leader, into, place, confidence, reason): the clusters that are taken in, by which, and as its how-manieth.

    found: leader, key (see order_key), size, primary_at. pairs: (a, b) that may merge, each once. views: (leader, view),
    what the provider sees. grown, if given, is called with what has been taken in so far and returns new views of the
    clusters that grew: the provider is then asked anew about their other pairs. Without it decisions are made once.
    """
    c = found.select("leader", "key", "size", F.unix_millis("primary_at").alias("at"))
    side = lambda x, o: c.select(F.col("leader").alias(o), F.col("key").alias(f"k_{o}"), F.col("size").alias(f"s_{o}"), F.col("at").alias(f"t_{o}"))
    both = pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").filter(F.col("a") != F.col("b"))
    both = both.filter(F.coalesce(F.abs(F.col("t_a") - F.col("t_b")) <= K.CLUSTER_HOURS * 3600000, F.lit(True)) & (F.col("s_a") + F.col("s_b") <= K.CLUSTER_SIZE))
    ahead = F.col("k_a") < F.col("k_b")
    pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    oriented = both.select(pick("a", "b").alias("i"), pick("b", "a").alias("j"), pick("k_a", "k_b").alias("ki"), pick("k_b", "k_a").alias("kj"), pick("s_a", "s_b").alias("size_i"), pick("s_b", "s_a").alias("size_j"))
    left = written(decisions(oriented.distinct(), views, provider, least), "semantic-pairs")
    done: list[DataFrame] = []
    for number in range(most_rounds):
        # a cluster without a yes that fits never grows: its pairs are settled
        may = left.groupBy("i").agg(F.bool_or(F.col("yes") & (F.col("size_i") + F.col("size_j") <= K.CLUSTER_SIZE)).alias("may")).filter("may").select("i")
        left = left.join(may, "i", "left_semi").filter(F.col("size_i") + F.col("size_j") <= K.CLUSTER_SIZE)
        left = written(left if grown else left.filter("yes"), "semantic-open")
        if left.isEmpty():
            break
        moves = written(_moves(left, grown is not None), "semantic-moves")
        taken = moves.select("i", F.posexplode("taken").alias("k", "p")).select(F.col("p.j").alias("leader"), F.col("i").alias("into"), (F.lit(number * STRIDE * 2) + F.col("k")).alias("place"), F.col("p.confidence").alias("confidence"), F.col("p.reason").alias("reason"))
        done.append(taken)
        gone = taken.select("leader")
        rest = left.join(gone.select(F.col("leader").alias("i")), "i", "left_anti").join(gone.select(F.col("leader").alias("j")), "j", "left_anti")
        rest = rest.join(moves.select("i", "size", "upto", (F.size("taken") > 0).alias("grew"), F.lit(True).alias("moved")), "i", "left")
        rest = rest.filter(F.col("moved").isNull() | (F.col("upto").isNotNull() & (F.col("kj") >= F.col("upto"))))
        rest = rest.withColumn("size_i", F.coalesce("size", "size_i"))
        if grown:
            anew = written(rest.filter("grew").select("i", "j", "ki", "kj", "size_i", "size_j"), "semantic-anew")
            same = rest.filter(~F.coalesce("grew", F.lit(False))).select(left.columns)
            if not anew.isEmpty():
                fresh = grown(_union(done, taken))
                now = views.join(fresh.select("leader"), "leader", "left_anti").unionByName(fresh)
                same = same.unionByName(decisions(anew, now, provider, least).select(left.columns))
            left = written(same, "semantic-pairs")
        else:
            left = rest.select(left.columns)
    else:
        raise RuntimeError(f"merges did not settle in {most_rounds} rounds")
    if not done:
        return found.sparkSession.createDataFrame([], "leader long, into long, place int, confidence double, reason string")
    return _union(done, done[0])


def _union(parts: list[DataFrame], first: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged_members(members: DataFrame, taken: DataFrame) -> DataFrame:
    """Members of C.cluster_items with those of clusters that were taken in moved behind those of the cluster that took
    them, in the order in which it did. The first of each carries the decision as its join_score and merge_reason."""
    t = taken.select("leader", "into", "place", F.col("confidence").alias("_c"))
    both = members.join(t, "leader", "left")
    first = F.col("into").isNotNull() & (F.col("join_ordinal") == 0)
    both = both.withColumn("join_score", F.when(first, F.least(F.lit(1.0), "_c")).otherwise(F.col("join_score")))
    both = both.withColumn("merge_reason", F.when(first, F.lit("semantic")).otherwise(F.col("merge_reason"))).withColumn("merged_with", F.when(first, F.col("into")).otherwise(F.col("merged_with")))
    both = both.withColumn("_p", F.coalesce("place", F.lit(-1))).withColumn("leader", F.coalesce("into", "leader"))
    order = Window.partitionBy("leader").orderBy("_p", "join_ordinal")  # CLUSTER_SIZE rows at most
    return both.withColumn("join_ordinal", (F.row_number().over(order) - 1).cast("int")).select(*members.columns)


def semantic_merge(members: DataFrame, provider: Provider, pairs: DataFrame | None = None, least: float = K.SEMANTIC_FLOOR) -> DataFrame:
    """Members of C.cluster_items after the merges that the provider calls for; it sees clusters as C.clusters gives them,
    with the titles of their items, and sees a cluster that has grown anew.

    pairs: (a, b), leaders that are worth asking about, each pair once (by vectors or rare words, say). Without it, all
    pairs within the time window are asked about, which is what a run over one edition's items does.
    """
    members = written(members, "semantic-members")

    def views_of(m: DataFrame) -> DataFrame:
        titles = m.groupBy("leader").agg(F.transform(F.sort_array(F.collect_list(F.struct("join_ordinal", "title"))), lambda x: x["title"]).alias("titles"))
        seen = C.clusters(m).join(titles, "leader")
        return seen.select("leader", F.struct(*[c for c in seen.columns if c != "leader"]).alias("view"))

    def grown(taken: DataFrame) -> DataFrame:
        into = taken.select(F.col("into").alias("leader")).distinct()
        touched = members.join(into.unionByName(taken.select("leader")).distinct(), "leader", "left_semi")
        return written(views_of(merged_members(touched, taken)), "semantic-views")

    seen = written(C.clusters(members), "semantic-clusters")
    first = members.filter("join_ordinal = 0").select("leader", F.col("published_at").alias("primary_at"))
    found = seen.join(first, "leader").select("leader", "primary_at", F.col("item_count").alias("size"), order_key(F.col("last_published_at"), F.col("source_count"), F.col("cluster_id")).alias("key"))
    found = written(found, "semantic-found")
    taken = absorptions(found, window_pairs(found) if pairs is None else pairs, provider, written(views_of(members), "semantic-views"), least, grown)
    return merged_members(members, written(taken, "semantic-taken"))
