"""Operator 12: importance resampling towards a target, with weights summed over bit planes.

Features are runs of words, hashed into buckets. Counts of the buckets over all documents and over all target texts give a
whole number for each bucket, its gain: how much commoner it is in the target. A document's weight is the mean of the gains
of its features. It is computed bit-sliced: the document's bucket counts are written as planes, plane k holding bit k of
every bucket's count, and the gains as planes of their two's complement. A plane of counts and a plane of gains are ANDed;
the bits that are left, counted, are worth 2**(k + l), and minus that for the gains' top plane. The sum of these is the
exact sum of gains, in integers alone.

Gumbel noise from a hash of the id is added, so that the highest scores are a draw without replacement in proportion to the
exponentials of the weights. The draw is ranked without bringing rows together: scores are whole numbers, so a count for
each different score, summed from the top, tells how many rows stand above, and only rows of equal score are ordered among
each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import claim, materialize, release

BUCKETS = 10_000
#: Longest run of words that is a feature.
MAX_N = 1
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
SEED = 2024
#: Documents whose planes are worked on together, and the words of a step at most (one longer text is a step of its own).
STEP = 32

#: Letters A-Z lower-cased; all other ASCII but digits and a-z parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: bytes | None, max_n: int, buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of each feature of a text, repeats included, and the number of its words."""
    words = text.translate(_WORDS).split() if text else []
    hashes = list(map(crc32, words))
    for n in range(2, max_n + 1):
        hashes += [crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    return np.array(hashes, dtype=np.uint32) % np.uint32(buckets), len(words)


def bucket_counts(df: DataFrame, text_col: str, max_n: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: a task sums its own, Spark sums the tasks', and one number a bucket comes back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("resampling")
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += np.bincount(features(text, max_n, buckets)[0], minlength=buckets)
        release()
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found.astype(np.int32), "n": total[found]})

    texts = df.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of B buckets, in doubles; one sample of each is added."""
    own, other, b = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: (float(t + 1) * float(own + b)) / (float(s + 1) * float(other + b))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target)], dtype=np.int64)


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Bits 0 to bits - 1 of each value as packed planes: (rows, bits, 64-bit words) for (rows, values)."""
    room = -values.shape[1] % 64
    padded = np.pad(values, ((0, 0), (0, room)))
    out = np.empty((len(values), bits, padded.shape[1] // 64), dtype=np.uint64)
    for k in range(bits):
        out[:, k] = np.packbits(((padded >> k) & 1).astype(np.uint8), axis=1).view(np.uint64)
    return out


class Gains:
    """Gains as planes of their two's complement, and what each plane is worth."""

    def __init__(self, gains: np.ndarray) -> None:
        self.bits = int(np.abs(gains).max(initial=0)).bit_length() + 1
        self.planes = planes(gains[None, :], self.bits)[0]
        self.worth = np.array([1 << k for k in range(self.bits - 1)] + [-(1 << (self.bits - 1))], dtype=np.int64)

    def sums(self, counts: np.ndarray) -> np.ndarray:
        """For each row of counts, the sum of count times gain."""
        out = np.zeros(len(counts), dtype=np.int64)
        most = counts.max(axis=1, initial=0)
        for k in range(int(most.max(initial=0)).bit_length()):
            rows = np.flatnonzero(most >> k)  # most documents have no count as large as the largest
            plane = planes(counts[rows] >> k, 1)
            both = np.bitwise_count(plane & self.planes[None]).sum(axis=2, dtype=np.int64)
            out[rows] += (both @ self.worth) << k
        return out


def weighed(text: Column, gains: Gains, max_n: int, buckets: int, df: DataFrame) -> Column:
    """n_features, n_words and weight of a text as a struct."""
    shared = df.sparkSession.sparkContext.broadcast(gains)  # a few planes of the buckets' bits

    @F.pandas_udf("n_features long, n_words long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("resampling")
        g = shared.value
        for texts in batches:
            values, out = texts.tolist(), []
            for at in range(0, len(values), STEP):
                found = [features(t, max_n, buckets) for t in values[at : at + STEP]]
                counts = np.stack([np.bincount(b, minlength=buckets) for b, _ in found])
                n = np.array([len(b) for b, _ in found], dtype=np.int64)
                weight = np.where(n > 0, g.sums(counts) // np.maximum(n, 1), 0)
                out.append(pd.DataFrame({"n_features": n, "n_words": np.array([w for _, w in found], dtype=np.int64), "weight": weight}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n_features": [], "n_words": [], "weight": []}, dtype=np.int64)
        release()

    return weigh(text.cast("binary"))


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, share: int) -> DataFrame:
    """rows with rank: 1, 2, 3... over the highest `share` in a hundred of the rows that `may` be drawn, null for others.

    Order is score descending, then key ascending (nulls last). Different scores are few: whole thousandths of a logarithm
    within what gains and noise can reach, some 10**5 at most, however many rows there are.
    """
    scores = rows.filter("may").groupBy("score").agg(F.count("*").alias("n"))
    by = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = materialize(scores.withColumn("upto", F.sum("n").over(by)), "resampling-scores")
    found = upto.agg(F.max("upto").alias("n")).first()["n"] or 0
    drawn = found * share // 100
    reached = upto.select("score", (F.col("upto") - F.col("n")).alias("above")).filter(F.col("above") < drawn)
    held = rows.join(F.broadcast(reached), "score", "left").withColumn("in", F.col("may") & F.col("above").isNotNull())
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("key").asc_nulls_last()))
    top = held.filter("in").withColumn("rank", F.col("above") + place).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = held.filter(~F.col("in")).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("above", "in")


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    share: int = 10,
    keep: list[str] | None = None,
    max_n: int = MAX_N,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of df: its columns (or those of keep), n_features, weight, score, rank; rank is null if not drawn.

    floor(share * N / 100) of the N rows with least_words words or more are drawn, ties going to the smaller id. Null and
    empty texts have no features and weight 0. Repeated rows count and are ranked each, in any order among themselves; a null
    id is hashed as an empty one and comes last among equals. Columns of df named as an output are replaced. An empty
    target gives gains that only smooth; an empty table gives no rows.
    """
    outputs = ("n_features", "weight", "score", "rank")
    names = [c for c in (keep or df.columns) if c not in outputs]
    gains = Gains(gains_of(bucket_counts(df, text_col, max_n, buckets), bucket_counts(target, target_col, max_n, buckets)))
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0))
    each = df.select(row.alias("row"), F.col(f"`{id_col}`").alias("key"), weighed(F.col(f"`{text_col}`"), gains, max_n, buckets, df).alias("w"))
    scored = each.select("row", "key", "w.*", (F.col("w.weight") + gumbel(F.col("key"), seed)).alias("score"))
    scored = materialize(scored.withColumn("may", F.col("n_words") >= least_words).drop("n_words"), "resampling-scored")
    return ranked(scored, share).select(*[F.col(f"row.`{c}`") for c in names], *outputs)
