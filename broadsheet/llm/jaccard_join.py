"""Operator 2: exact Jaccard self-join on word shingles by pivots, Voronoi regions and triangle-inequality windows.

Unrelated texts share no shingle: each is at distance 1 from every pivot, so regions around pivots drawn at random would
hold every document. Pivots are therefore drawn where documents meet. Of a document's shingles, three tenths in a fixed
order (its prefix) must hold a twelfth that it shares with any document it links to (see least_shared); documents whose
prefixes share less have no links. The document with the smallest key among those that have a shingle in their prefix is
the pivot of that shingle, and its region holds all of them.

In a region the distances to its pivot are measured exactly. What is within the radius of the pivot (its ball) is tied to
it and so to each other. A larger region draws more pivots, far from each other: a document goes to the cell of its nearest
pivot and, as far as the triangle inequality leaves a partner possible, to the cells of others (see windows); documents
far from all pivots are a cell of their own; cells join recursively. Where one pivot is left, only documents outside its
ball are compared, with those whose distance to the pivot differs by the radius at most. A region too large for a task is parted
into cells by the same rule over DataFrames; one that pivots don't part is compared in blocks, outside its ball only.

Links inside a ball come by way of its pivot, so components are whole though not every link is listed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.common import claim, materialize, release
from broadsheet.llm.components import components
from broadsheet.llm.words import encoded, mix, ngram_hashes, word_hashes

WORDS = 5
SIMILARITY = Fraction(4, 5)
RADIUS = float(1 - SIMILARITY)
#: Documents of the sample that tells which shingles are common, and how often one must be seen there. Any order of
#: shingles gives the same links; this one keeps common passages out of prefixes.
SAMPLE_ROWS, COMMON = 8192, 4
#: Common shingles that are broadcast at most (8 bytes each), the most frequent first.
COMMON_SHINGLES = 1 << 20
#: From this distance a document is far from a pivot; any value gives the same links.
FAR = 0.6
#: Documents of a region that one task joins; pivots of a region; regions up to SMALL have one.
BLOCK, PIVOTS, SMALL = 1024, 8, 16
#: Pivots of a region above BLOCK, and how often such regions are parted over DataFrames at most.
LARGE_PIVOTS, ROUNDS = 16, 4
#: Documents that tasks handle together where regions are small.
BUCKET_ROWS = 2048
#: Texts that are hashed together, by their characters.
STEP = 1 << 20
#: The filter that keeps texts without a region from being shuffled has 16 bits a key, up to 2 ** FILTER_BITS (16 MB).
#: Beyond some 10 ** 8 keys it lets most texts pass, which costs one shuffle of them and changes nothing.
FILTER_BITS = 27

_EMPTY = np.zeros(0, dtype=np.int64)


def shingle_sets(texts: list[str | None], common: np.ndarray = _EMPTY) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted numbers: A-Z lower-cased, words parted by ASCII white space.

    With fewer words than a shingle has, the whole sequence is one; without words there is none. Shingles in common
    (sorted) get a high bit, so that they come last.
    """
    words, n = word_hashes([encoded(t).lower() for t in texts])

    def numbers(h: np.ndarray) -> np.ndarray:
        g = (h >> np.uint64(2)).view(np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, g), len(common) - 1)
            g = g | ((common[at] == g).astype(np.int64) << 62)
        return g

    grams, out = numbers(ngram_hashes(words, WORDS)), []
    for start, m in zip((np.cumsum(n) - n).tolist(), n.tolist()):
        if m >= WORDS:
            out.append(np.unique(grams[start : start + m - WORDS + 1]))
        else:
            out.append(numbers(ngram_hashes(words[start : start + m], m)) if m else _EMPTY)
    return out


def steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP characters each, at least one text."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= STEP:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def prefix_length(n: int) -> int:
    """Of a document's n shingles in their order the first n - ceil(s n) + n // 10 + 1: a partner shares ceil(s n) or
    more, so n // 10 + 1 of these, and they are the first ones that both share."""
    return n and n - -(-SIMILARITY.numerator * n // SIMILARITY.denominator) + n // 10 + 1


def least_shared(n: Column) -> Column:
    """Shingles that the prefixes of a document of n shingles and of any partner share: the shorter has ceil(s n)."""
    shorter = F.ceil(n * SIMILARITY.numerator / SIMILARITY.denominator)
    return (F.floor(shorter / 10) + 1).cast("int")


def windows(d: np.ndarray) -> np.ndarray:
    """Which cells a document joins, by its distances to all pivots: one cell a pivot, and the last one for what is far.

    Let x and y be within the radius r, m their distances to their nearest pivots, m(x) <= m(y), and p the nearest of x.
    If m(x) < FAR, d(y, p) <= m(x) + r, which is at most m(y) + 2 r and FAR + r: both are in p's cell. Otherwise both are
    far from all pivots, and in the last cell.
    """
    nearest = d.min(axis=1, keepdims=True)
    return np.column_stack([d <= np.minimum(nearest + 2 * RADIUS, FAR + RADIUS) + 1e-9, nearest >= FAR])


class Region:
    """Sets of a region, each of at least one shingle, by the places of their shingles in one table."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)

    def shared(self, pivot: int, at: np.ndarray) -> np.ndarray:
        """Shingles that a pivot shares with the sets at some places."""
        mask = np.zeros(len(self.values), dtype=np.int64)
        mask[self.ids[self.starts[pivot] : self.starts[pivot] + self.sizes[pivot]]] = 1
        return np.add.reduceat(mask[self.ids], self.starts)[at]

    def measured(self, pivot: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to a pivot, and which are within the radius, exactly."""
        both = self.shared(pivot, at)
        either = self.sizes[at] + self.sizes[pivot] - both
        return 1 - both / either, SIMILARITY.denominator * both >= SIMILARITY.numerator * either

    def links(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Links between two lists of places as pairs, exactly; a place in both isn't linked with itself."""
        every = np.unique(np.concatenate([left, right]))
        owner = np.repeat(np.arange(len(every)), self.sizes[every])
        ids = np.concatenate([self.ids[self.starts[i] : self.starts[i] + self.sizes[i]] for i in every])
        _, column, counts = np.unique(ids, return_inverse=True, return_counts=True)
        held = counts[column] > 1
        column, owner = (np.cumsum(counts > 1) - 1)[column[held]], owner[held]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        rows, columns = np.searchsorted(every, left), np.searchsorted(every, right)
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            has = np.zeros((len(every), 4096), dtype=np.float32)
            has[owner[a:b], column[a:b] - lo] = 1
            both += has[rows] @ has[columns].T
        either = self.sizes[left][:, None] + self.sizes[right][None, :] - both
        i, j = np.nonzero(SIMILARITY.denominator * both >= SIMILARITY.numerator * either)
        other = left[i] != right[j]
        return np.column_stack([left[i][other], right[j][other]])

    def join(self, at: np.ndarray, tally: Counter) -> Iterator[np.ndarray]:
        """Pairs that tie together all places at (the first is the region's pivot) that links tie together.
        """
        if len(at) < 2:
            return
        pivots, distances, balls = [], [], []
        pivot = at[0]
        for _ in range(1 if len(at) <= SMALL else PIVOTS):
            d, near = self.measured(pivot, at)
            pivots.append(pivot)
            distances.append(d)
            balls.append(near)
            tied = at[near & (at != pivot)]
            tally["ball"] += len(tied)
            yield np.column_stack([tied, np.full(len(tied), pivot)])
            nearest = np.min(distances, axis=0)
            if nearest.max() < FAR:
                break
            pivot = at[np.argmax(nearest)]
        d = np.column_stack(distances)
        window = windows(d)
        if len(pivots) > 1 and (window.sum(axis=0) ** 2).sum() <= 0.5 * len(at) ** 2:
            tally["cells"] += window.shape[1]
            for c, p in enumerate(pivots):
                yield from self.join(np.concatenate([[p], at[window[:, c] & (at != p)]]), tally)
            yield from self.join(at[window[:, -1]], tally)
            return
        # one pivot is left: no two of its ball need meet, nor a document and one that is farther off by more than r
        best = int(np.argmax([b.sum() for b in balls]))
        order = np.argsort(d[:, best], kind="stable")
        place, far = at[order], d[order, best]
        for lo in range(0, len(place), 64):
            outside = np.flatnonzero(~balls[best][order][lo : lo + 64]) + lo
            if len(outside):
                first, last = np.searchsorted(far, [far[outside[0]] - RADIUS - 1e-9, far[outside[-1]] + RADIUS + 1e-9])
                partners = place[first:last]
                partners = partners[partners != pivots[best]]
                if len(partners) > 1:
                    found = self.links(place[outside], partners)
                    tally["window"] += len(found)
                    yield found


def join_region(sets: list[np.ndarray], tally: Counter | None = None) -> Iterator[np.ndarray]:
    """Pairs of places that tie together what links tie together (see Region.join); tally counts where they were found."""
    if len(sets) > 1:
        yield from Region(sets).join(np.arange(len(sets)), Counter() if tally is None else tally)


def spanning(n: int, pairs: Iterator[np.ndarray]) -> np.ndarray:
    """The smallest place that each of n places is tied to."""
    root = np.arange(n)
    for some in pairs:
        while len(some):
            a, b = root[some[:, 0]], root[some[:, 1]]
            apart = a != b
            if not apart.any():
                break
            some, a, b = some[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _sample_common(docs: DataFrame, seed: int) -> np.ndarray:
    """Shingles that a bounded sample of the documents has often: COMMON_SHINGLES at most."""
    n = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    some = docs.filter(F.pmod(F.xxhash64(F.lit(seed), "tkey"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("text")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in steps(texts):
                g, k = np.unique(np.concatenate(shingle_sets(texts[lo:hi])), return_counts=True)
                yield pd.DataFrame({"gram": g, "n": k})

    counts = some.mapInPandas(grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(counts.orderBy(F.desc("n"), "gram").limit(COMMON_SHINGLES).select("gram").toPandas()["gram"].to_numpy(dtype=np.int64))


def _held(keys: DataFrame, n: int):
    """A test for long keys that may be among these n: a bitmap of one hash, built by Spark in slices of 4 kB."""
    bits = min(FILTER_BITS, max(15, int(16 * n).bit_length()))
    at = F.shiftrightunsigned(F.xxhash64(F.lit(17), "tkey"), 64 - bits)
    slices = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    every: list[bytes] = [bytes(4096)] * ((1 << (bits - 15)) + 1)
    for row in slices.collect():  # 2 ** (FILTER_BITS - 15) rows of 4 kB at most
        every[row["slice"]] = bytes(row["bits"])
    flat = b"".join(every)
    shared = keys.sparkSession.sparkContext.broadcast(np.frombuffer(flat, dtype=np.uint8))

    @F.pandas_udf(T.BooleanType())
    def held(bucket: pd.Series, position: pd.Series) -> pd.Series:
        b, p = bucket.to_numpy(dtype=np.int64), position.to_numpy(dtype=np.int64)
        return pd.Series((shared.value[b * 4096 + (p >> 3)] >> (p & 7).astype(np.uint8) & 1).astype(bool))

    return held(F.bitmap_bucket_number(at), F.bitmap_bit_position(at))


def _tied(keys: np.ndarray, pairs: Iterator[np.ndarray]) -> pd.DataFrame:
    root = spanning(len(keys), pairs)
    tied = root != np.arange(len(keys))
    return pd.DataFrame({"a": keys[tied], "b": keys[root[tied]]})


def _small_regions(members: DataFrame, texts: DataFrame, seed: int) -> DataFrame:
    """Links (a, b) in regions of BLOCK documents at most. members: region, node; several regions share a task's group."""
    buckets = max(1, -(-members.count() // BUCKET_ROWS))
    # a text goes to a bucket once, with all its regions there
    wanted = members.groupBy("node", F.pmod(F.xxhash64(F.lit(seed), "region"), F.lit(buckets)).alias("bucket")).agg(F.collect_set("region").alias("regions"))
    wanted = wanted.groupBy("node").agg(F.collect_list(F.struct("bucket", "regions")).alias("places"))
    placed = texts.join(wanted, "node").select("node", "text", F.explode("places").alias("p"))
    placed = placed.select("p.bucket", "p.regions", "node", "text").repartition("bucket")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        claim("jaccard_join")
        once = group.drop_duplicates("node")
        nodes, texts = once["node"].to_numpy(), once["text"].tolist()
        known: dict[int, np.ndarray] = {}
        for lo, hi in steps(texts):
            known.update(zip(nodes[lo:hi].tolist(), shingle_sets(texts[lo:hi])))
        out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
        for _, region in group[["regions", "node"]].explode("regions").groupby("regions"):
            keys = np.unique(region["node"].to_numpy())
            out.append(_tied(keys, join_region([known[k] for k in keys.tolist()])))
        known.clear()
        release()
        return pd.concat(out)

    return placed.groupBy("bucket").applyInPandas(compare, "a long, b long")


def _part_large(members: DataFrame, seed: int, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over regions too large for a task: members (region, size, node, text) -> links, cells, and the rest.

    LARGE_PIVOTS documents of a region, drawn by a seeded hash, go to all blocks of it, which measure distances. cells
    (region, node): the Voronoi cells with windows of regions that pivots part. rest (region, node, ball): the others,
    with whether a document is within the radius of the pivot with the largest ball.
    """
    order = Window.partitionBy("region").orderBy(F.xxhash64(F.lit(seed + turn), "node"), "node")
    drawn = members.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= LARGE_PIVOTS).drop("_r")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = members.select("region", "node", "text", F.pmod(F.xxhash64(F.lit(seed), "node"), blocks).cast("int").alias("salt"), F.lit(False).alias("drawn"))
    pivots = drawn.select("region", "node", "text", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"), F.lit(True).alias("drawn"))

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["drawn", "node"], ascending=[False, True])
        texts = group["text"].tolist()
        sets = [s for lo, hi in steps(texts) for s in shingle_sets(texts[lo:hi])]
        n = int(group["drawn"].sum())
        region, own = Region(sets), np.arange(n, len(sets))
        both = [region.measured(p, own) for p in range(n)]
        del sets, region, texts
        release()
        return pd.DataFrame({
            "region": group["region"].iloc[n:], "node": group["node"].iloc[n:], "pivots": [group["node"].iloc[:n].to_numpy()] * len(own),
            "near": list(np.column_stack([b[1] for b in both])), "cells": list(windows(np.column_stack([b[0] for b in both]))),
        })

    shape = "region long, node long, pivots array<long>, near array<boolean>, cells array<boolean>"
    found = materialize(rows.unionByName(pivots).groupBy("region", "salt").applyInPandas(measure, shape), "large-regions")
    links = found.select("node", F.explode(F.arrays_zip("pivots", "near")).alias("x")).filter("x.near AND x.pivots <> node").select(F.col("node").alias("a"), F.col("x.pivots").alias("b"))
    # at most LARGE_PIVOTS + 1 rows a region
    held = found.select("region", F.posexplode("cells").alias("cell", "held")).groupBy("region", "cell").agg(F.count_if("held").alias("held"), F.count("*").alias("n"))
    balls = found.select("region", F.posexplode("near").alias("cell", "near")).groupBy("region", "cell").agg(F.count_if("near").alias("ball"))
    plan = held.groupBy("region").agg((F.sum(F.col("held") * F.col("held")) <= 0.5 * F.max(F.col("n") * F.col("n"))).alias("parted"))
    plan = plan.join(balls.groupBy("region").agg(F.max_by("cell", F.struct("ball", -F.col("cell"))).alias("best")), "region")
    planned = found.join(plan, "region")
    parted = planned.filter("parted").select("region", "node", F.posexplode("cells").alias("cell", "held")).filter("held")
    parted = parted.select(F.xxhash64(F.lit(seed + turn), "region", "cell").alias("region"), "node")
    rest = planned.filter("NOT parted").select("region", "node", F.get("near", "best").alias("ball"))
    return links, parted, rest


def _blocks_of_rest(rest: DataFrame, texts: DataFrame, seed: int) -> DataFrame:
    """Links in regions that pivots don't part: outside the ball all blocks meet each other and the ball's blocks."""
    counts = rest.groupBy("region").agg(F.count_if(~F.col("ball")).alias("outer"), F.count_if("ball").alias("inner"))
    rows = rest.join(counts.filter("outer > 0"), "region").join(texts, "node")
    outer, inner = (F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int") for c in ("outer", "inner"))
    own = F.pmod(F.xxhash64(F.lit(seed), "node"), F.when(F.col("ball"), inner).otherwise(outer)).cast("int")
    among = F.transform(F.sequence(F.lit(0), outer - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j"), F.lit(False).alias("with_ball"), (own <= b).alias("left"), (own >= b).alias("right")))
    to_ball = F.transform(F.sequence(F.lit(0), inner - 1), lambda b: F.struct(own.alias("i"), b.alias("j"), F.lit(True).alias("with_ball"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    from_ball = F.transform(F.sequence(F.lit(0), outer - 1), lambda b: F.struct(b.alias("i"), own.alias("j"), F.lit(True).alias("with_ball"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    pairs = F.when(F.col("ball"), from_ball).when(F.col("inner") > 0, F.concat(among, to_ball)).otherwise(among)
    placed = rows.select("region", "node", "text", F.explode(pairs).alias("p"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        claim("jaccard_join")
        group = group.sort_values("node")
        texts, keys = group["text"].tolist(), group["node"].to_numpy()
        left, right = (np.flatnonzero(group[side].to_numpy()) for side in ("left", "right"))
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        region = Region([s for lo, hi in steps(texts) for s in shingle_sets(texts[lo:hi])])
        found = _tied(keys, (region.links(left[i : i + 256], right) for i in range(0, len(left), 256)))
        del region, texts
        release()
        return found

    keyed = placed.select("region", "p.*", "node", "text")
    return keyed.groupBy("region", "i", "j", "with_ball").applyInPandas(compare, "a long, b long")


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, component_sets (different sets in its component),
    stays (the component's first row) and text_key.

    Two rows link when their sets of shingles are similar by SIMILARITY or more; component_id is the smallest id that
    links reach, the own id included (null if all are null). Rows without words link with nothing; rows whose sets are
    equal are linked. Repeated rows are rows of their own. Other columns of df take no part, whatever their names. An
    empty table gives no rows. Shingles are told apart by 62 bits of a hash, sets by 128.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(f"`{id_col}`").alias("id"), text_key(text_col, seed).alias("tkey"), F.col(f"`{text_col}`").alias("text"))
    common = spark.sparkContext.broadcast(_sample_common(docs, seed))

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("jaccard_join")
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in steps(texts):
                sets, rows, here = shingle_sets(texts[lo:hi], common.value), [], set()
                for g in sets:
                    h = g.view(np.uint64)
                    key = int(mix(h, 11).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(h, 13)).view(np.int64)) if len(g) else 0
                    # of equal sets that stand together the first brings the prefix
                    rows.append((len(g), *key, None if key in here else g[: prefix_length(len(g))]))
                    here.add(key)
                out = pd.DataFrame(rows, columns=["n", "k", "k2", "prefix"])
                out.insert(0, "id", batch["id"].iloc[lo:hi].to_numpy())
                out.insert(1, "tkey", batch["tkey"].iloc[lo:hi].to_numpy())
                yield out
        release()

    table = materialize(docs.mapInPandas(sets_of, f"id {kind}, tkey long, n long, k long, k2 long, prefix array<long>"), "shingles")
    # equal sets are one document from here on, by a number of its own
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tkey"))
    alike = table.filter("n > 0").groupBy("k", "k2").agg(first.alias("first"), F.min("n").alias("n"))
    alike = materialize(alike.select(F.monotonically_increasing_id().alias("node"), "k", "k2", "n", "first.id", "first.tkey"), "sets")

    # smallest and largest key of a shingle, combined in tasks first: what is common to millions is a row a task, and
    # joining them back is a join that Spark may split; documents that share k only are candidates at most
    met = table.filter("n > 0").select("k", F.explode("prefix").alias("gram"))
    ends = met.groupBy("gram").agg(F.min("k").alias("pivot"), F.max("k").alias("other")).filter("pivot <> other")
    live = met.join(ends.select("gram", "pivot"), "gram").select("gram", "k", "pivot").distinct().groupBy("k").agg(F.sort_array(F.collect_list(F.struct("gram", "pivot"))).alias("live"))
    least = least_shared(F.col("n"))
    # with the last least - 1 left out, the first shared shingle is still in on both sides
    some = live.join(alike, "k").filter(F.size("live") >= least).select("node", "id", "tkey", F.array_distinct(F.slice("live", F.lit(1), F.size("live") - least + 1)["pivot"]).alias("regions"))
    some = materialize(some, "regions")
    members = some.select("node", F.explode("regions").alias("region"))
    sizes = members.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialize(members.join(sizes, "region"), "region-members")
    likely = _held(some.select("tkey"), some.count())
    met_texts = docs.filter(likely).join(some.select("node", F.col("id").alias("_id"), F.col("tkey").alias("_tkey")), F.col("id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey")))
    # rows that repeat an id and a text are one here
    texts = met_texts.select("node", "text")

    edges = _small_regions(members.filter(F.col("size") <= BLOCK).select("region", "node"), texts, seed)
    large, turn = members.filter(F.col("size") > BLOCK), 0
    if not large.isEmpty():
        texts = materialize(texts.join(large.select("node").distinct(), "node").dropDuplicates(["node"]), "large-texts")
        while turn < ROUNDS and not large.isEmpty():
            links, parted, rest = _part_large(large.join(texts, "node"), seed, turn)
            edges = edges.union(links).union(_blocks_of_rest(rest, texts, seed))
            cells = parted.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
            parted = materialize(parted.join(cells, "region").select("node", "region", "size"), "cells")
            edges = edges.union(_small_regions(parted.filter(F.col("size") <= BLOCK).select("region", "node"), texts, seed))
            large, turn = parted.filter(F.col("size") > BLOCK), turn + 1
        edges = edges.union(_blocks_of_rest(large.select("region", "node", F.lit(False).alias("ball")), texts, seed))
    roots = components(edges)
    named = alike.join(roots, "node", "left").select("node", "k", "k2", "id", "tkey", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(first.alias("first"), F.count("*").alias("n_sets"))
    where = named.select("k", "k2", "root").join(smallest, "root").select(F.col("k").alias("_k"), F.col("k2").alias("_k2"), "first", "n_sets")
    has = F.col("n") > 0
    out = table.select("id", "tkey", "n", "k", "k2").join(where, (F.col("k") == F.col("_k")) & (F.col("k2") == F.col("_k2")) & has, "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(has, F.col("first.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(has, F.col("n_sets")).otherwise(1).alias("component_sets"),
        (~has | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tkey") == F.col("first.tkey")))).alias("stays"),
        F.col("tkey").alias("text_key"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """The rows of df without all but one of each component: the one of the smallest id stays (nulls last).

    Rows without words stay. Of rows that repeat both the id and the text of the one that stays, one stays.
    """
    columns = df.columns
    found = materialize(jaccard_groups(df, id_col, text_col, seed).filter("stays").select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), F.col("n_shingles").alias("_n")), "kept")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{id_col}`").alias("_rid"), text_key(text_col, seed).alias("_rkey"))
    kept = rows.join(found.select("_id", "_key", "_n").distinct(), F.col("_rid").eqNullSafe(F.col("_id")) & (F.col("_rkey") == F.col("_key")))
    if found.filter("_n > 0").groupBy("_id", "_key").count().filter("count > 1").isEmpty():
        return kept.select("_row.*")
    return kept.filter("_n = 0").select("_row.*").unionByName(kept.filter("_n > 0").dropDuplicates(["_rid", "_rkey"]).select("_row.*"))


def text_key(text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 9), F.col(f"`{text_col}`"))
