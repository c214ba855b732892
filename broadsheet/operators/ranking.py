"""Feature scores of story candidates, their order, and the greedy composition of an edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import constants as K
from broadsheet.functions.text import bound, title_tokens
from broadsheet.operators import alike


def recency(published_at: Column, reference: Column, half_life: float = K.HALF_LIFE_HOURS) -> Column:
    """0.5 without a time, 0.05 beyond 72 hours, else halved every half_life hours; the future counts as now."""
    hours = F.greatest(F.lit(0.0), (F.unix_millis(reference) - F.unix_millis(published_at)) / F.lit(3600000.0))
    return F.when(hours.isNull() | published_at.isNull(), 0.5).when(hours > 72, 0.05).otherwise(F.exp(-F.ln(F.lit(2.0)) * hours / half_life))


def corroboration(sources: Column) -> Column:
    return F.when(sources <= 1, 0.35).when(sources == 2, 0.65).when(sources == 3, 0.85).otherwise(1.0)


def source_tier(kinds: Column | None) -> Column:
    """The best of the sources' kinds; 0.8 where no kinds are looked up or there is no source."""
    if kinds is None:
        return F.lit(0.8)
    score = F.transform(kinds, lambda k: F.when(k.isin("official", "primary"), 1.0).when(k == "research", 0.9).when(k == "publisher", 0.8).otherwise(0.6))
    return F.when(F.size(kinds) == 0, 0.8).otherwise(F.greatest(F.lit(0.6), F.coalesce(F.array_max(score), F.lit(0.6))))


def india_relevance(tokens: Column, regions: Column | None = None) -> Column:
    home = F.lit(True) if regions is None else F.coalesce(F.arrays_overlap(regions, F.array(F.lit("india"), F.lit("south-asia"))), F.lit(False))
    terms = F.array(*[F.lit(t) for t in K.INDIA_TERMS])
    named = bound(tokens, lambda t: F.arrays_overlap(F.concat(t["unigrams"], t["bigrams"]), terms))
    base = F.when(home, 0.8).otherwise(0.35)
    return F.when(named, F.least(F.lit(1.0), base + 0.25)).otherwise(base)


def penalty_of(dice: Column) -> Column:
    return F.when(dice >= 0.7, 1.0).when(dice >= 0.45, (dice - 0.45) / 0.25).otherwise(0.0)


def repetition(candidates: DataFrame, recent: DataFrame) -> DataFrame:
    """candidates(id, unigrams) and recent(title_id, unigrams) -> id, dice (the largest to a recent title), penalty.

    Titles meet by the words they share, never all with all. A recent title without words is like a candidate without.
    """
    sized = lambda df, key: df.select(key, F.size("unigrams").alias(f"n_{key}"), F.explode("unigrams").alias("word"))
    shared = sized(candidates, "id").join(sized(recent, "title_id"), "word").groupBy("id", "title_id", "n_id", "n_title_id").agg(F.count("*").alias("c"))
    best = shared.groupBy("id").agg(F.max(2.0 * F.col("c") / (F.col("n_id") + F.col("n_title_id"))).alias("best"))
    bare = recent.agg(F.coalesce(F.max((F.size("unigrams") == 0).cast("double")), F.lit(0.0)).alias("bare"))  # one row
    out = candidates.join(best, "id", "left").crossJoin(F.broadcast(bare))
    dice = F.when(F.size("unigrams") == 0, F.col("bare")).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("id", dice.alias("dice"), penalty_of(dice).alias("penalty"))


#: Dice from which a repeated title costs something.
REPEATED = 0.45


def repeated_titles(candidates: DataFrame, recent: DataFrame, least: float = REPEATED) -> DataFrame:
    """candidates(id, unigrams) and recent(title_id, unigrams) -> id, title_id, dice of the pairs with dice >= least.

    Blocks of titles meet in tasks (see alike.dice_rows); titles of the same words are compared once a meeting. Titles without
    words are alike.
    """
    both = candidates.select(F.col("id").cast("string").alias("key"), F.lit(0).alias("side"), "unigrams").unionByName(recent.select(F.col("title_id").cast("string").alias("key"), F.lit(1).alias("side"), "unigrams"))
    found = alike.dice_rows(both, least)
    bare = both.filter(F.size("unigrams") == 0)
    none = bare.filter("side = 0").select("key").crossJoin(F.broadcast(bare.filter("side = 1").agg(F.min("key").alias("other")).filter("other IS NOT NULL"))).withColumn("dice", F.lit(1.0))
    return found.unionByName(none.select(F.col("key").alias("id"), F.col("other").alias("title_id"), "dice"))


def titles_of_others(titles: DataFrame, least: float = REPEATED) -> DataFrame:
    """titles(id, unigrams) -> id, title_id, dice of each with each other one that is so alike; those without words are left out."""
    return alike.dice_rows(titles.select(F.col("id").alias("key"), F.lit(0).alias("side"), "unigrams"), least, itself=True)


def repetition_penalties(candidates: DataFrame, recent: DataFrame) -> DataFrame:
    """candidates(id, unigrams) -> id, penalty by the most alike recent title (see repetition, which gives all dice)."""
    worst = repeated_titles(candidates, recent).groupBy("id").agg(F.max("dice").alias("dice"))
    keyed = candidates.select("id", F.col("id").cast("string").alias("_key")).join(worst.withColumnRenamed("id", "_key"), "_key", "left")
    return keyed.select("id", penalty_of(F.coalesce("dice", F.lit(0.0))).alias("penalty"))


def topic_weight(topic: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.TOPIC_WEIGHTS.items() for x in kv])
    return F.coalesce(F.element_at(table, topic), F.lit(0.7))


def composite(scores: dict[str, Column], penalty: Column, weights: dict[str, float] | None = None, share: float = K.PENALTY_SHARE) -> Column:
    """Weighted mean of the features, less for repetition, between 0 and 1."""
    weights = weights or K.FEATURE_WEIGHTS
    total = sum(weights.values())
    mean = sum((scores[k] * w for k, w in weights.items()), F.lit(0.0)) / total
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean * F.greatest(F.lit(0.0), 1.0 - share * penalty)))


def topic_of(title: Column, descriptions: Column) -> Column:
    """Struct of topic and score: 3 for each keyword in the title, else 1 for each in a permitted description.

    Topics are tried in a fixed order and the first with the highest score wins; without any hit it is india.
    """
    both = lambda t: F.concat(t["unigrams"], t["bigrams"])

    def best(words: Column, texts: Column) -> Column:
        scored = []
        for order, (topic, keywords) in enumerate(K.TOPIC_KEYWORDS.items()):
            terms = F.array(*[F.lit(k) for k in keywords])
            in_title = F.array_intersect(terms, words)
            in_texts = F.array_except(F.array_intersect(terms, texts), in_title)
            scored.append(F.struct((3 * F.size(in_title) + F.size(in_texts)).alias("score"), F.lit(-order).alias("first"), F.lit(topic).alias("topic")))
        return F.array_max(F.array(*scored))

    words = bound(title_tokens(title), both)
    texts = F.flatten(F.transform(descriptions, lambda d: bound(title_tokens(d), both)))
    found = bound(words, lambda w: bound(texts, lambda t: best(w, t)))
    return bound(found, lambda b: F.struct(F.when(b["score"] > 0, b["topic"]).otherwise("india").alias("topic"), b["score"].alias("score")))


def rank(scored: DataFrame, edition: str = "edition") -> DataFrame:
    """rank in each edition: by score, then sources, then id."""
    order = Window.partitionBy(edition).orderBy(F.desc("composite_score"), F.desc("source_count"), F.collate("cluster_id", "UNICODE"))
    return scored.withColumn("rank", F.row_number().over(order))


def compose(ranked: DataFrame, core: int = K.CORE_STORIES, per_topic: int = K.PER_TOPIC, per_publisher: int = K.PER_PUBLISHER, pool: int = K.POOL_STORIES) -> DataFrame:
    """ranked(edition, rank, cluster_id, topic, primary_source_id, …) with decision and reason.

    In rank order a candidate is taken into the core unless its topic or its publisher is full; when the core is full the
    rest waits. What isn't core goes to the pool of its topic while that has room. Behind per_publisher candidates of the
    same topic and publisher, and behind core + per_topic of those that are left of a topic, none is ever taken: windows
    thin an edition to a short list, and only that is folded.
    """
    group = Window.partitionBy("edition", "topic", "primary_source_id").orderBy("rank")
    can = ranked.withColumn("_nth", F.row_number().over(group)).filter(F.col("_nth") <= per_publisher)
    by_topic = Window.partitionBy("edition", "topic").orderBy("rank")
    can = can.withColumn("_nth", F.row_number().over(by_topic)).filter(F.col("_nth") <= core + per_topic)
    entries = can.groupBy("edition").agg(F.sort_array(F.collect_list(F.struct("rank", "topic", "primary_source_id"))).alias("list"))
    state = F.struct(
        F.array().cast("array<int>").alias("ranks"), F.array().cast("array<string>").alias("topics"), F.array().cast("array<string>").alias("publishers")
    )

    def step(s: Column, c: Column) -> Column:
        n = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
        fits = (F.size(s["ranks"]) < core) & (n(s["topics"], c["topic"]) < per_topic) & (n(s["publishers"], c["primary_source_id"]) < per_publisher)
        taken = F.struct(
            F.array_append(s["ranks"], c["rank"]).alias("ranks"), F.array_append(s["topics"], c["topic"]).alias("topics"), F.array_append(s["publishers"], c["primary_source_id"]).alias("publishers")
        )
        return F.when(fits, taken).otherwise(s)

    cores = entries.select("edition", F.aggregate("list", state, step).alias("s")).select(F.col("edition").alias("_e"), F.col("s.ranks").alias("ranks"), F.when(F.size("s.ranks") >= core, F.array_max("s.ranks")).alias("full"))
    out = ranked.join(cores, F.col("edition").eqNullSafe(F.col("_e")), "left").withColumn("_core", F.coalesce(F.array_contains("ranks", F.col("rank")), F.lit(False)))
    # caps as they stood when a candidate was looked at
    before = lambda *k: Window.partitionBy("edition", *k).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    held = F.col("_core").cast("int")
    out = out.withColumn("_t", F.coalesce(F.sum(held).over(before("topic")), F.lit(0)))
    reason = F.when(F.col("_core"), "core_selection").when(F.col("full").isNotNull() & (F.col("rank") > F.col("full")), "below_score_threshold").when(F.col("_t") >= per_topic, "topic_cap_exceeded").otherwise("publisher_cap_exceeded")
    place = F.row_number().over(Window.partitionBy("edition", "topic", "_core").orderBy("rank"))
    pooled = ~F.col("_core") & F.col("topic").isin(K.INTEREST_TOPICS) & (place <= pool)
    out = out.withColumn("_pooled", pooled)
    return out.withColumn("decision", F.when(F.col("_core"), "selected_core").when(F.col("_pooled"), "selected_topic_pool").otherwise("rejected")).withColumn(
        "reason", F.when(F.col("_pooled"), "topic_pool_selection").otherwise(reason)
    ).drop("_e", "ranks", "full", "_core", "_t", "_pooled")


def diagnostics(composed: DataFrame) -> DataFrame:
    """One row an edition: candidates, core and pool stories, publishers in the core, and its stories by topic."""
    core = F.col("decision") == "selected_core"
    topics = [F.count_if(core & (F.col("topic") == t)).alias("core_" + t.replace("-", "_")) for t in K.TOPIC_WEIGHTS]
    return composed.groupBy("edition").agg(
        F.count("*").alias("total_evaluated"), F.count_if(core).alias("core_count"), F.count_if(F.col("decision") == "selected_topic_pool").alias("pool_count"),
        F.count_distinct(F.when(core, F.col("primary_source_id"))).alias("publishers_in_core"), *topics,
    )
