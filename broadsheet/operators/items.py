"""Feed items: normalisation of raw items and greedy deduplication inside each source."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import constants as K
from broadsheet.functions import text, urls
from broadsheet.session import written


def positive_limits(**limits: int) -> None:
    """Limits are whole numbers of zero or more."""
    for name, value in limits.items():
        if not isinstance(value, int) or isinstance(value, bool) or not 0 <= value <= 2**53 - 1:
            raise ValueError(f"{name} must be a non-negative integer: {value!r}")


def normalize_items(raw: DataFrame, title_cap: int = K.TITLE_CAP, description_cap: int = K.DESCRIPTION_CAP) -> DataFrame:
    """Raw items (source_id, item_ordinal, guid, title, author, description, link, published_at, updated_at) as normal ones.

    The hash is over the texts as cut; an item's id is its own, else its URL, else one made of the hash.
    """
    positive_limits(title_cap=title_cap, description_cap=description_cap)
    plain = raw.select(
        "source_id",
        "item_ordinal",
        urls.guid(F.col("guid")).alias("own_guid"),
        text.truncated(text.html_to_text(F.col("title")), title_cap).alias("title"),
        F.nullif(text.truncated(text.html_to_text(F.col("author")), K.AUTHOR_CAP), F.lit("")).alias("author"),
        text.truncated(text.html_to_text(F.col("description")), description_cap).alias("description"),
        urls.canonicalize(F.col("link")).alias("url"),
        text.feed_date(F.col("published_at")).alias("published_at"),
        text.feed_date(F.col("updated_at")).alias("updated_at"),
    )
    hashed = plain.withColumn("content_hash", text.content_hash(F.col("title"), F.col("description")))
    made = F.concat(F.lit("content-"), F.col("content_hash"))
    return hashed.withColumn("guid", F.coalesce("own_guid", "url", made)).drop("own_guid")


def identity_keys(items: DataFrame) -> DataFrame:
    """A row for each key an item is known by: its guid always, its URL if any, else its hash."""
    keys = F.array(F.concat(F.lit("guid:"), "guid"), F.coalesce(F.concat(F.lit("url:"), "url"), F.concat(F.lit("hash:"), "content_hash")))
    return items.select("source_id", "item_ordinal", F.explode(keys).alias("key"))


def dedup_first_wins(items: DataFrame, most_rounds: int = 200) -> DataFrame:
    """items with kept: greedy in the order of item_ordinal inside each source, and not transitive.

    An item is kept unless one of its keys is that of a kept item before it. Each round keeps the items that come first for
    all of their keys, and drops those that share a key with one of them; what is left goes on, from a written table. No
    group is ever held whole: a round is an aggregate by key and by item, so a key or a source of any size is combined
    before it is shuffled. Items that share no key are settled by the first round, and items
    without a source are kept.
    """
    left = written(identity_keys(items), "dedup-keys")
    settled: list[DataFrame] = []
    item = ["source_id", "item_ordinal"]
    for _ in range(most_rounds):
        first = left.groupBy("source_id", "key").agg(F.min("item_ordinal").alias("first"))
        led = left.join(first, ["source_id", "key"])
        leads = led.groupBy(*item).agg(F.every(F.col("first") == F.col("item_ordinal")).alias("kept"))
        taken = leads.filter("kept").select("source_id", F.col("item_ordinal").alias("first"), F.lit(True).alias("taken"))
        now = led.join(taken, ["source_id", "first"], "left").groupBy(*item).agg(
            F.every(F.col("first") == F.col("item_ordinal")).alias("kept"), F.bool_or(F.coalesce("taken", F.lit(False)) & (F.col("first") != F.col("item_ordinal"))).alias("dropped")
        )
        now = written(now, "dedup-round")
        settled.append(now.filter("kept OR dropped").select(*item, "kept"))
        left = written(left.join(now.filter("NOT kept AND NOT dropped").select(*item), item), "dedup-keys")
        if left.isEmpty():
            return items.join(reduce(DataFrame.unionByName, settled), item, "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
    raise RuntimeError(f"items did not settle in {most_rounds} rounds")


def kept_items(items: DataFrame) -> DataFrame:
    return dedup_first_wins(items).filter("kept").drop("kept")


def required(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
