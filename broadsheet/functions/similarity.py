"""Similarity of titles and the classification of a pair of items, as Column expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions import constants as K
from broadsheet.functions.text import bound, hours_between


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def dice(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """2 |A B| / (|A| + |B|); both empty: both_empty (1 for titles, 0 for the editorial rules)."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(both_empty)).otherwise(2.0 * _shared(a, b) / total)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(_shared(a, b) / least)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(_shared(a, b) / union)


def common_tokens(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def numeric_conflict(a: Column, b: Column) -> Column:
    """Both name numbers and none is the same."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def title_similarity(a: Column, b: Column) -> Column:
    """Of two token structs: half Dice and half overlap of words, with a share for bigrams; less if numbers conflict."""
    both = (F.size(a["bigrams"]) > 0) & (F.size(b["bigrams"]) > 0)

    def blend(u: Column) -> Column:
        mixed = F.greatest(K.UNIGRAM_FLOOR * u, K.UNIGRAM_SHARE * u + K.BIGRAM_SHARE * dice(a["bigrams"], b["bigrams"]))
        return F.when(both, mixed).otherwise(u) - F.when(numeric_conflict(a["numbers"], b["numbers"]), K.NUMBER_PENALTY).otherwise(0.0)

    words = 0.5 * dice(a["unigrams"], b["unigrams"]) + 0.5 * overlap(a["unigrams"], b["unigrams"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound(words, blend)))


def exact_reason(a: Column, b: Column) -> Column:
    """Why two items are the same: url, content-hash or guid; null if they aren't known to be."""
    return (
        F.when(a["url"].isNotNull() & (a["url"] == b["url"]), "url")
        .when(a["content_hash"] == b["content_hash"], "content-hash")
        .when((a["source_id"] == b["source_id"]) & (a["guid"] == b["guid"]) & ~a["guid"].startswith("content-"), "guid")
    )


def classify_pair(a: Column, b: Column) -> Column:
    """exact, near or distinct, with the score: cheap tests first, in the order that decides."""
    ta, tb = a["tokens"], b["tokens"]
    hours = hours_between(a["published_at"], b["published_at"])
    common = F.size(F.array_intersect(ta["unigrams"], tb["unigrams"]))
    least = F.least(F.lit(K.NEAR_TOKENS), F.size(ta["unigrams"]), F.size(tb["unigrams"]))
    reason = exact_reason(a, b)
    score = F.when(reason.isNotNull(), 1.0).otherwise(title_similarity(ta, tb))

    def kind(score: Column) -> Column:
        return (
            F.when(reason.isNotNull(), "exact")
            .when(hours > K.NEAR_HOURS, "distinct")
            .when(numeric_conflict(ta["numbers"], tb["numbers"]), "distinct")
            .when(common < least, "distinct")
            .when(score >= K.NEAR_SCORE, "near")
            .otherwise("distinct")
        )

    return bound(score, lambda s: F.struct(kind(s).alias("match_type"), reason.alias("reason"), s.alias("score"), common.alias("common"), hours.alias("hours")))
