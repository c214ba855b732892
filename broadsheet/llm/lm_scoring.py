"""Operator 4: language-model scores by stupid backoff over count tables that are partitioned by hash.

    S(w | v) = c(v w) / c(v)          if c(v w) >= MIN_COUNT
             = BACKOFF * c(w) / N     otherwise

Documents are dealt into blocks of a few megabytes. The different n-grams of a block, with their counts in it, are dealt
into slices of the hash range, a row for each (slice, block), and shuffled by slice. There they are exploded, counted over
all blocks into the slice's count table, and joined to it. The totals go back by block in the order in which the block sent
its n-grams; the block's documents look them up and sum their scores.

A hot n-gram stands at most once in a block's rows however often it occurs, so no slice is larger than others. All that is
shuffled follows the number of different n-grams of blocks: there is no vocabulary, no cap, and nothing is broadcast or
collected. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import claim, materialize
from broadsheet.llm.words import encoded, ngram_hashes, word_hashes

BACKOFF = 0.4
#: Bigrams seen less often count as not seen.
MIN_COUNT = 2
#: Text in a block, about: what one group of a task holds.
BLOCK_BYTES = 6 << 20
#: Text whose n-grams fall into a slice, about; a slice is a partition, and there are MOST_SLICES at most (beyond, they grow).
SLICE_BYTES = 8 << 20
MOST_SLICES = 100_000


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts end to end, words of each text, and each bigram inside a text with the place of its second word."""
    words, n = word_hashes([encoded(t) for t in texts])
    owner = np.repeat(np.arange(len(n)), n)
    second = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    return words, n, ngram_hashes(words, 2)[second - 1], second


def count_block(group: pd.DataFrame, slices: int) -> pd.DataFrame:
    """The different words and bigrams of a block and how often each occurs in it: a row for each slice, in its order."""
    claim("lm_scoring")
    words, _, pairs, _ = _grams(group["text"].tolist())
    gram, n = np.unique(np.concatenate([words, pairs]), return_counts=True)
    of = ((gram >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int32)
    which, at = np.unique(of, return_index=True)
    parts = np.append(at, len(gram)).tolist()
    cut = lambda x: [x[lo:hi] for lo, hi in zip(parts, parts[1:])]
    return pd.DataFrame({"block": group["block"].iloc[0], "slice": which, "grams": cut(gram.view(np.int64)), "ns": cut(n.astype(np.int32))})


def score_block(group: pd.DataFrame, told: pd.DataFrame, min_count: int) -> pd.DataFrame:
    """A block's documents: words, sum of the logs of S without N, and how many of them have N in them."""
    claim("lm_scoring")
    words, n, pairs, second = _grams(group["text"].tolist())
    table, where = np.unique(np.concatenate([words, pairs]), return_inverse=True)
    told = told.sort_values("slice")
    total = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, dtype=np.int64) for x in told["small"])])
    total[total < 0] = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, dtype=np.int64) for x in told["large"])])
    if len(total) != len(table):
        raise AssertionError("a block was told of other n-grams than it sent")
    single, double = np.log(total[where[: len(words)]]), total[where[len(words) :]]
    each, backed = single.copy(), np.ones(len(words))  # the first word of a text has no context and isn't weighed
    seen = double >= min_count
    each[second] = np.where(seen, np.log(double) - single[second - 1], np.log(BACKOFF) + single[second])
    backed[second] = ~seen
    owner = np.repeat(np.arange(len(n)), n)
    sums = [np.bincount(owner, weights=x, minlength=len(n)) for x in (each, backed)]
    return pd.DataFrame({"id": group["id"], "n_words": n, "logs": sums[0], "backed": sums[1]})


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, seed: int = 42) -> DataFrame:
    """One row per row of df: id, n_words, log_score (sum of the natural logs of S; the first word's is c(w) / N) and mean_log_score.

    Words are what stands between ASCII white space. Null and texts without words have n_words 0, log_score 0 and a
    null mean. Repeated rows are scored each. Other columns of df take no part, whatever their names. An empty table
    gives no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    # the place in the input keeps repeated rows apart; both reads of the blocks share one exchange
    block = F.pmod(F.xxhash64(F.lit(seed), "id", "text", F.monotonically_increasing_id()), F.lit(blocks))
    dealt = docs.withColumn("block", block).repartition("block")
    slices = min(MOST_SLICES, max(1, -(-int(size) // SLICE_BYTES)))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        return count_block(group, slices)

    def both(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return score_block(group, answers, min_count)

    sent = dealt.groupBy("block").applyInPandas(count, "block long, slice int not null, grams array<long>, ns array<int>").repartitionById(slices, F.col("slice"))
    each = sent.select("slice", "block", F.posexplode(F.arrays_zip("grams", "ns")).alias("i", "g")).select("slice", "block", "i", F.col("g.grams").alias("gram"), F.col("g.ns").alias("n"))
    # a slice holds all rows of its n-grams: counting them and joining the counts to each row moves nothing
    joined = each.withColumn("total", F.sum("n").over(Window.partitionBy("slice", "gram")))
    told = joined.groupBy("slice", "block").agg(F.sort_array(F.collect_list(F.struct("i", "total"))).alias("x"))
    # most totals fit in a byte; -1 stands for the next of the large ones
    small = F.transform("x", lambda t: F.when(t["total"] < 128, t["total"]).otherwise(-1).cast("tinyint"))
    large = F.transform(F.filter("x", lambda t: t["total"] >= 128), lambda t: t["total"])
    told = told.select("block", "slice", small.alias("small"), large.alias("large"))
    found = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(both, f"id {kind}, n_words long, logs double, backed double")
    found = materialize(found, "lm-scores")
    total = found.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    log_score = F.when(F.col("n_words") > 0, F.col("logs") - F.col("backed") * float(np.log(max(1, total)))).otherwise(F.lit(0.0))
    return found.select(F.col("id").alias(id_col), "n_words", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"))
