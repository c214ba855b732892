"""Operator 5: approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors get one more component so that the largest inner product is the smallest distance, and are rotated at random.
Lists are fitted on a bounded sample and hold every row. In each list that a query probes, distances grow by blocks of
rotated columns; a test on the partial distance abandons a candidate as soon as it is unlikely to be near enough. What
is left is measured exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import materialize

#: Rows that the lists are fitted on, and lists, at most (centroids are broadcast: LISTS * dimensions * 8 bytes).
SAMPLE_ROWS = 8192
LISTS = 1024
#: Share of the lists that a query probes, and how many at least. Vectors spread evenly over the sphere need many probes
#: (at a quarter of the lists 0.70 of the true neighbours are found, at seven tenths 0.97); clustered ones need few.
PROBE_SHARE, LEAST_PROBES = 0.7, 32
#: Rows and queries of a list that one task takes at a time; larger lists are split.
CHUNK_ROWS, CHUNK_QUERIES = 1024, 2048
#: Columns in a block, and the test's width: larger abandons later.
COLUMNS, EPSILON = 16, 2.1


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    reach: float
    probes: int
    sample: np.ndarray
    sample_ids: np.ndarray

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """With the added component: nothing for queries, what is missing to the longest norm for rows."""
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.reach**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, extra])

    def bounds(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """The k-th largest inner product with other rows of the sample, which is at most that with all rows; none: -inf."""
        if k > len(self.sample_ids):
            return np.full(len(q), -np.inf)
        rough = (q @ self.sample.T).astype(np.float32)
        rough[own[:, None] == self.sample_ids[None, :]] = -np.inf
        j = np.argpartition(-rough, k - 1, axis=1)[:, :k].ravel()
        i = np.repeat(np.arange(len(q)), k)
        other = self.sample_ids[j] != own[i]
        i, j = i[other], j[other]
        least = np.full(len(q), np.inf)
        np.minimum.at(least, i, (self.sample[j] * q[i]).sum(axis=1))
        return np.where(np.bincount(i, minlength=len(q)) >= k, least - 1e-9, -np.inf)

    def lists(self, lifted: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        d = (self.centroids**2).sum(axis=1) - 2 * lifted @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there, not zero, and has finite components only."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def fit(vectors: DataFrame, rows: int, reach: float, dim: int, seed: int = 42) -> Index:
    """Lists by k-means on a hashed sample of SAMPLE_ROWS rows at most; only the sampled rows are shuffled."""
    share = int(min(1.0, 1.2 * SAMPLE_ROWS / max(1, rows)) * (1 << 30))
    drawn = vectors.filter(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1 << 30)) <= share)
    found = drawn.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE_ROWS).toPandas()
    sample = np.array(found["v"].tolist(), dtype=float).reshape(-1, dim)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
    bare = Index(rotation, np.zeros((0, 0)), reach, 0, sample, found["id"].to_numpy(dtype=np.int64))
    x = bare.lift(sample, False)
    k = int(min(LISTS, max(1, round(rows**0.5 / 2)), len(x)))
    centroids = x[rng.choice(len(x), k, replace=False)] if len(x) else x
    for _ in range(8):
        near = np.argmin((centroids**2).sum(axis=1) - 2 * x @ centroids.T, axis=1) if k else []
        for c in range(k):
            own = x[near == c]
            if len(own):
                centroids[c] = own.mean(axis=0)
    return replace(bare, centroids=centroids, probes=int(min(k, max(LEAST_PROBES, round(k * PROBE_SHARE)))))


def scan(index: Index, q: np.ndarray, q_ids: np.ndarray, bounds: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows for each query among those that beat its bound: places of queries, places of rows, inner products.

    Partial distances over the columns seen so far, scaled up to all columns, are held against the bound with a margin
    that narrows as more is seen. While most pairs are alive a block is one matrix product; then pairs go on singly.
    """
    rows, asked = (index.lift(x, False) @ index.rotation).astype(np.float32), (index.lift(q, True) @ index.rotation).astype(np.float32)
    total = rows.shape[1]
    limit = np.maximum(index.reach**2 + (q * q).sum(axis=1) - 2 * bounds, 0)
    part = np.zeros((len(q), len(x)), dtype=np.float32)
    i = j = np.zeros(0, dtype=np.int64)
    dense = True
    for lo in range(0, total, COLUMNS):
        hi = min(total, lo + COLUMNS)
        margin = (1 + EPSILON / hi**0.5) ** 2 if hi < total else 1.0
        # what single precision can lose grows with the squared norms
        most = (margin * limit * (hi / total) + 1e-5 * (index.reach**2 + (q * q).sum(axis=1)) + 1e-12).astype(np.float32)
        r, a = rows[:, lo:hi], asked[:, lo:hi]
        if dense:
            part += (r * r).sum(axis=1)[None, :] + (a * a).sum(axis=1)[:, None] - 2 * (a @ r.T)
            alive = part <= most[:, None]
            if hi == total or alive.sum() < 0.2 * alive.size:
                dense = False
                i, j = np.nonzero(alive)
                part = part[i, j]
        else:
            d = r[j] - a[i]
            part = part + (d * d).sum(axis=1)
            stay = part <= most[i]
            i, j, part = i[stay], j[stay], part[stay]
    other = ids[j] != q_ids[i]
    i, j = i[other], j[other]
    scores = (x[j] * q[i]).sum(axis=1)
    order = np.lexsort((ids[j], -scores, i))
    i, j, scores = i[order], j[order], scores[order]
    first = np.searchsorted(i, np.arange(len(q)))
    best = np.arange(len(i)) - first[i] < k
    return i[best], j[best], scores[best]


def one_each(vectors: DataFrame) -> DataFrame:
    """Rows (id, v) with one vector an id, the smallest: only ids that are repeated are grouped, and ids alone tell which."""
    twice = vectors.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if twice.isEmpty():
        return vectors
    again = vectors.join(twice, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    return materialize(vectors.join(twice, "id", "left_anti").unionByName(again), "nearest-ids")


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of df with the largest inner product found for each row of queries.

    A row isn't a candidate for the query of its own id. Rows whose vector is null, zero, or holds null or non-finite
    components take no part, nor do vectors of another length than most. Ties go to the smaller id. Of an id that is
    repeated, the smallest vector counts, by components in order. An empty table gives no rows.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    take = lambda t: usable(t, vector_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null")
    lengths = take(df).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("most")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    vectors, asked = (one_each(take(t).filter(F.size("v") == dim)) for t in (df, queries))
    index = fit(vectors, lengths["n"], lengths["most"] ** 0.5, dim, seed)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = shared.value
        for batch in batches:
            if len(batch):
                v = np.array(batch["v"].tolist(), dtype=float)
                yield batch.assign(list=found.lists(found.lift(v, False), 1)[:, 0])

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = shared.value
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.iloc[at : at + 1024].reset_index(drop=True)
                v = np.array(some["v"].tolist(), dtype=float)
                near = found.lists(found.lift(v, True), found.probes)
                some = some.assign(bound=found.bounds(v, some["id"].to_numpy(), k))
                yield some.loc[some.index.repeat(near.shape[1])].assign(list=near.ravel())

    kind = f"id long, v {vectors.schema['v'].dataType.simpleString()}"
    members, probes = vectors.mapInPandas(assign, f"{kind}, list int"), asked.mapInPandas(probe, f"{kind}, bound double, list int")
    # LISTS rows at most: how many parts a list's rows and queries fall into
    count = lambda t, most: {r["list"]: -(-r["n"] // most) for r in t.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts, turns = count(members, CHUNK_ROWS), count(probes, CHUNK_QUERIES)

    def of(found: dict[int, int]):
        return F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for kv in found.items() for x in kv]), F.col("list")), F.lit(1)) if found else F.lit(1)

    part = lambda t, n: F.pmod(F.xxhash64(F.lit(seed), "id"), n)
    each = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    members = members.withColumn("part", part(members, of(parts)).cast("int")).withColumn("turn", each(of(turns)))
    probes = probes.withColumn("turn", part(probes, of(turns)).cast("int")).withColumn("part", each(of(parts)))

    def search(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if len(rows) and len(qs):
            rows = rows.sort_values("id")
            ids, x, q = rows["id"].to_numpy(), np.array(rows["v"].tolist(), dtype=float), np.array(qs["v"].tolist(), dtype=float)
            i, j, scores = scan(shared.value, q, qs["id"].to_numpy(), qs["bound"].to_numpy(), x, ids, k)
            return pd.DataFrame({"query_id": qs["id"].to_numpy()[i], "vec_id": ids[j], "score": scores})
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    keys = ["list", "part", "turn"]
    found = members.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
