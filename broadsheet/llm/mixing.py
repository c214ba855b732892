"""Operator 9: mixing sources to target weights by Sainte-Lague apportionment of words, taken in equal blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.common import materialize

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Share of all words that the mix takes, and how often a source's words may repeat.
SHARE = 1.5
MOST_REPEATS = 2
#: Words in a block, at any input: long enough that most documents lie in one or two.
BLOCK_WORDS = 4096
#: Blocks and sources up to so many are sent to every task; more are joined by a shuffle.
SEATS = 1 << 16
#: Shards that the mix falls into.
SHARDS = 8
# Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in a bucket of the running totals, of documents and of blocks.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources: table (source, source_size) -> with weight and target.

    The words to take are shared by weight; a target stops at MOST_REPEATS times the source's size and the excess is
    shared anew by weight. That fixed point is target = min(cap, level * weight): with the sources in order of
    cap / weight, the level is set by the first source whose ratio holds the rest.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_REPEATS))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("level", left / F.sum("weight").over(rest))
    held = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return t.select("source", "source_size", "weight", F.least("cap", F.coalesce(held["level"] * F.col("weight"), F.col("cap"))).alias("target"))


def quotas(goals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Words of each source in each shard: (source, ends), where shard i takes ends[i] - ends[i - 1] words (ends[-1]: 0).

    Each word is a seat, seats go to the highest quotients target / (2k + 1), and shard i is filled when its part of the
    seats, i + 1 of `shards`, is given: Sainte-Lague never takes a seat back when there are more, so the quotas of shards
    are whole numbers that add up. All but a few seats are certain. Rounded targets miss the seats by at most half the
    sources and one, so the divisor that meets them moves a source's quota by at most its part of that and one: only these
    seats are ranked, a number in proportion to the sources. A source's words times MOST_REPEATS are the most it gets.
    """
    part = Window.partitionBy("shard")
    t = goals.filter("target > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    t = t.withColumn("seats", F.ceil(F.ceil(F.sum("target").over(part)) * (F.col("shard") + 1) / shards))
    t = t.withColumn("share", F.col("seats") * F.col("target") / F.sum("target").over(part))
    t = t.withColumn("reach", F.ceil((F.count("*").over(part) / 2 + 1) * F.col("target") / F.sum("target").over(part)) + 2)
    t = t.withColumn("certain", F.greatest(F.lit(0).cast("long"), F.floor("share") - F.col("reach")))
    t = t.withColumn("open", F.col("seats") - F.sum("certain").over(part))
    last = F.least(F.ceil("share") + F.col("reach"), F.col("source_size") * MOST_REPEATS) - 1
    each = t.withColumn("k", F.explode(F.when(last >= F.col("certain"), F.sequence("certain", last)).otherwise(F.array().cast("array<bigint>"))))
    highest = part.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").isNull(), "source", "k")
    won = each.withColumn("rank", F.row_number().over(highest)).filter("rank <= open").groupBy("source", "shard").agg(F.count("*").alias("more"))
    both = t.alias("t").join(won.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source")) & (F.col("t.shard") == F.col("w.shard")), "left")
    ends = both.select("t.source", "t.shard", (F.col("certain") + F.coalesce("more", F.lit(0))).alias("end"))
    return ends.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "end")))["end"].alias("ends"))


def mix_plan(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per row of df: id, key, copy (numbers repeated rows), size, source_size, target, epochs, shards, spans, taken.

    A document is taken whole `epochs` times, for `shards` (one each), and once more in its `spans` (word ranges from, to,
    and their shard). The words of a source stand in a seeded order, end to end, and are cut into blocks of BLOCK_WORDS
    words. The shards' quotas of the source are met in turn by blocks in a seeded order: all of them once or twice, then
    the first ones again, and to the word by a part of one more block; so no word is taken more than MOST_REPEATS times,
    and a source of less than a block gets its part like any other. A block at the end of a shard's quota is parted
    between it and the next shard; a document that is taken whole is in the shard of its first block. Spans that touch in one
    shard are one. Null sources are one source, placed last; null and empty
    texts have no words and nothing is taken of them. Repeated rows count as rows of their own, other columns of df take
    no part. An empty table gives no rows.
    """
    sized = df.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"), word_count(F.col(f"`{text_col}`")).alias("size"), document_key(id_col, text_col, seed).alias("key"))
    slim = materialize(sized, "mix-sizes")
    by_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goals = materialize(targets(by_source), "mix-targets")
    totals = by_source.agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count("*")).first()
    block = BLOCK_WORDS

    # where each document starts in its source: bucket totals first, then inside the bucket, so no task holds a source
    entries = slim.groupBy("source", "id", "key", "size").agg(F.count("*").alias("m"))
    entries = entries.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(max(1, totals[0] // BUCKET_ROWS))))
    sums = entries.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("m")).alias("n_words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n_words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    placed = placed.select("source", "id", "key", "copy", "size", (F.col("start") + F.col("inner") + (F.col("copy") - 1) * F.col("size")).alias("at"))

    plan = goals.alias("g").join(quotas(goals).alias("q"), F.col("g.source").eqNullSafe(F.col("q.source")), "left")
    plan = plan.select("g.source", "source_size", "target", F.coalesce("ends", F.array().cast("array<bigint>")).alias("ends"), F.ceil(F.col("source_size") / block).alias("blocks"))
    plan = plan.withColumn("quota", F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0))
    plan = materialize(plan.withColumn("extra", F.col("quota") - F.col("epochs") * F.col("source_size")), "mix-plan")
    many = plan.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]

    # a block's place in its source's seeded order: bucket totals first, then inside the bucket, as for documents
    chunks = plan.filter("quota > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(blocks - 1) div {BUCKET_ROWS}"))))
    inner = F.sequence(F.col("chunk") * BUCKET_ROWS, F.least(F.col("blocks"), (F.col("chunk") + 1) * BUCKET_ROWS) - 1)
    every = chunks.repartition("source", "chunk").withColumn("block", F.explode(inner)).drop("chunk")
    every = every.withColumn("length", F.least(F.lit(block), F.col("source_size") - F.col("block") * block))  # the last block of a source is shorter
    every = every.withColumn("turn", F.xxhash64(F.lit(seed + 2), "source", "block")).withColumn("bucket", F.expr(f"pmod(turn, 1 + blocks div {BUCKET_ROWS})"))
    sums = every.groupBy("source", "bucket").agg(F.sum("length").alias("n_words"))
    firsts = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n_words").over(before), F.lit(0)).alias("start"))
    turn = Window.partitionBy("source", "bucket").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = every.withColumn("inner", F.coalesce(F.sum("length").over(turn), F.lit(0))).join(firsts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    ranked = ranked.withColumn("before", F.col("start") + F.col("inner")).drop("_s", "_b")
    # a block's place in each pass tells whose quota it is; the last pass may part it
    shard_of = lambda at: F.size(F.filter("ends", lambda e: e <= at))
    passes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("epochs")), lambda e: shard_of(e * F.col("source_size") + F.col("before")))
    line = F.col("epochs") * F.col("source_size") + F.col("before")

    def part_of(h: Column) -> Column:
        begins = F.greatest(line, F.when(h > 0, F.get("ends", h - 1)).otherwise(F.lit(0)))
        return F.struct((begins - line).alias("from"), (F.least(line + F.col("length"), F.get("ends", h)) - line).alias("to"), h.alias("shard"))

    parts = F.filter(F.transform(F.sequence(F.lit(0), F.size("ends") - 1), part_of), lambda p: p["to"] > p["from"])
    chosen = ranked.select(F.col("source").alias("_s"), F.col("block").alias("_b"), passes.alias("_h"), parts.alias("_p"))

    small = F.broadcast if totals[1] + many <= SEATS else (lambda t: t)
    touched = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {block}L"), F.expr(f"greatest(at, at + size - 1) div {block}L")))))
    hit = touched.join(small(chosen), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    first = F.col("_b") * block - F.col("at")
    inside = F.transform("_p", lambda p: F.struct(F.greatest(F.lit(0).cast("long"), first + p["from"]).alias("from"), F.least("size", first + p["to"]).alias("to"), p["shard"].alias("shard")))
    inside = F.filter(inside, lambda p: p["to"] > p["from"])
    spans = hit.groupBy("source", "id", "key", "copy", "size").agg(F.array_sort(F.flatten(F.collect_list(inside))).alias("found"), F.min_by("_h", "block").alias("_h"))
    # a span that begins where one of the same shard ends goes on with it
    none = F.lit(None).cast("struct<from:bigint,to:bigint,shard:int>")
    run = F.struct(F.array().cast("array<struct<from:bigint,to:bigint,shard:int>>").alias("done"), none.alias("open"))

    def joined(run: Column, p: Column) -> Column:
        on = (run["open"]["to"] == p["from"]) & (run["open"]["shard"] == p["shard"])
        longer = F.struct(run["open"]["from"].alias("from"), p["to"].alias("to"), p["shard"].alias("shard"))
        return F.when(on, F.struct(run["done"].alias("done"), longer.alias("open"))).otherwise(F.struct(F.concat(run["done"], F.array_compact(F.array(run["open"]))).alias("done"), p.alias("open")))

    spans = spans.withColumn("spans", F.aggregate("found", run, joined, lambda run: F.concat(run["done"], F.array_compact(F.array(run["open"])))))
    out = spans.join(small(plan.select(F.col("source").alias("_s"), "source_size", "target", "epochs")), F.col("source").eqNullSafe(F.col("_s")))
    out = out.withColumn("shards", F.slice(F.coalesce("_h", F.array().cast("array<int>")), F.lit(1), F.col("epochs").cast("int")))
    part = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return out.select("id", "key", "copy", "size", "source_size", "target", "epochs", "shards", "spans", (F.col("epochs") * F.col("size") + part).alias("taken"))


def document_key(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


@F.pandas_udf(T.StringType())
def word_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The text between the first and the last character of each span of words, joined by one space."""

    def cut(t, ranges):
        at = [m.span() for m in re.finditer(WORD, t)]
        return " ".join(t[at[s["from"]][0] : at[s["to"] - 1][1]] for s in ranges if s["to"] > s["from"])

    return pd.Series([cut(t, r) for t, r in zip(text, spans, strict=True)], dtype=object)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 42, shard_col: str | None = None) -> DataFrame:
    """The mix itself, with the columns of df: each document once for every whole pass, and its chosen spans once a shard.

    With a shard_col the rows' shards are in a column of that name, which replaces one of df. Rows of which nothing is
    taken are left out.
    """
    columns = [c for c in df.columns if c != shard_col]
    plan = mix_plan(df, id_col, source_col, text_col, seed).filter("taken > 0").select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("copy").alias("_copy"), "shards", "spans")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{id_col}`").alias("_rid"), document_key(id_col, text_col, seed).alias("_rkey"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_rid", "_rkey").orderBy("_rkey")))
    both = rows.join(plan, F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_rkey") == F.col("_key")) & (F.col("_n") == F.col("_copy")))
    kind = both.schema["spans"].dataType.simpleString()
    whole = F.transform("shards", lambda h: F.struct(F.lit(None).cast(kind).alias("spans"), h.alias("shard")))
    parts = F.transform(F.array_distinct(F.col("spans")["shard"]), lambda h: F.struct(F.filter("spans", lambda s: s["shard"] == h).alias("spans"), h.alias("shard")))
    each = both.select("_row", F.explode(F.concat(whole, parts)).alias("_turn"))
    tail = [F.col("_turn.shard").alias(shard_col)] if shard_col else []
    cut = F.col("_row").withField(f"`{text_col}`", word_spans(F.col("_row")[text_col], F.col("_turn.spans")))
    whole = each.filter("_turn.spans is null").select("_row.*", *tail)
    return whole.unionByName(each.filter("_turn.spans is not null").withColumn("_row", cut).select("_row.*", *tail))
