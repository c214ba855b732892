"""Operator 1: two-pass external shuffle into shards.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash; pass two applies the Fisher-Yates
shuffle to each bucket and writes it. Buckets end to end are a random order of all rows, which is cut into shards
whose row counts are at most one apart (law `rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import materialize

#: A bucket's text when the table is large; smaller tables are still dealt over LEAST_BUCKETS.
BUCKET_BYTES = 32 << 20
LEAST_BUCKETS = 64
#: Offsets are 16 bytes a bucket: up to so many they are broadcast, beyond they are joined by shuffle.
BROADCAST_BUCKETS = 100_000


def shuffle_into_shards(df: DataFrame, size_col: str, shards: int = 8, seed: int = 42) -> DataFrame:
    """The rows of df in a seeded random order, with _shard (0 to shards - 1) and _slot (gapless from 0 in its shard).

    size_col gives a row's bytes (nulls count as nothing) and only sizes the buckets. All columns are kept, but for ones
    named _shard or _slot, which are replaced. Nulls, repeated rows and ties need no care: each row has a key of its own,
    drawn from its content and its place in the input. An empty table gives no rows.
    """
    columns = [c for c in df.columns if c not in ("_shard", "_slot")]
    total = df.agg(F.coalesce(F.sum(F.col(f"`{size_col}`")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-int(total) // BUCKET_BYTES))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    key = F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *[F.col(f"`{c}`") for c in columns])
    scattered = df.select(key.alias("_key"), row.alias("_row")).withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), F.lit(buckets)).cast("int"))
    # a partition is a bucket and its rows are sorted, so that the seeded shuffle draws the same numbers again
    bucketed = scattered.repartitionById(buckets, F.col("_bucket")).groupBy("_bucket").agg(F.sort_array(F.collect_list(F.struct("_key", "_row"))).alias("_rows"))
    shuffled = bucketed.select("_bucket", F.posexplode(F.shuffle("_rows", seed + 2)).alias("_at", "_it"))
    written = materialize(shuffled.select("_bucket", F.col("_at").cast("long").alias("_at"), "_it._row"), "shards")

    counts = written.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    starts = F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts
    place = F.col("_start") + F.col("_at")
    placed = written.join(starts, "_bucket").withColumn("_place", place)
    shard = F.expr(f"(_place * {shards}L) div _total")
    placed = placed.withColumn("_shard", shard.cast("int"))
    return placed.select("_row.*", "_shard", F.expr(f"_place - (_shard * _total + {shards - 1}) div {shards}L").alias("_slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write shuffled rows as one folder a shard, each file sorted by slot."""
    df.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
