"""Operator 11: a quality classifier of naive Bayes support vectors.

A text's features are indicators of its n-grams: its words, and runs of one to three word shapes (how a word is cased, what
marks it carries, whether it repeats the word before), hashed into buckets. Every labelled text is counted; a bucket's
log-count ratio r says how much commoner it is in good texts than in bad ones. Each indicator is scaled by its r, each text
to unit length, and a linear model with hinge loss is fitted to a bounded sample by dual coordinate descent. Its weights are
drawn towards their mean size, which is naive Bayes itself. Margins of texts that a model has not seen give the sigmoid that
turns a margin into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import claim, release
from broadsheet.llm.words import mix, ngram_hashes, word_hashes

BUCKETS = 1 << 18
#: Longest run of shapes that is a feature.
SHAPES = 3
#: Added to every count.
SMOOTHING = 1.0
#: The fit's sample: rows of each label, and bytes of their text, about, at most (its documented bound). Ratios take all rows.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 12 << 20
#: Cost of a violated margin; the part of the fitted weights, the rest being their mean size; passes over the sample at most.
COST = 4.0
OWN_PART = 0.25
PASSES = 40
FOLDS = 3
#: Labels, up to this many, are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Bytes of text worked through at once; a longer text is a step of its own.
STEP = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Letters (all of several bytes, too), capitals, digits and white space are one of their kind each.
_KINDS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_REPEAT = np.uint64(0x5BD1E995)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of each text's features, and the text that each belongs to, ordered by text and bucket."""
    own = [t or b"" for t in texts]
    words, n = word_hashes([t.translate(_LOWER) for t in own])
    kinds = np.frombuffer(b"\n".join(own).translate(_KINDS), dtype=np.uint8)
    shapes = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])] if len(kinds) else kinds
    shapes, _ = word_hashes([shapes.tobytes()])  # runs are one mark each: a word is as many words as before
    owner = np.repeat(np.arange(len(n)), n)
    again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
    shapes[again] = _REPEAT
    found, of = [mix(words, 1)], [owner]
    for k in range(1, SHAPES + 1):
        inside = owner[k - 1 :] == owner[: len(owner) - k + 1]
        found.append(mix(ngram_hashes(shapes, k), k + 1)[inside])
        of.append(owner[: len(owner) - k + 1][inside])
    bucket = (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)
    both = np.unique(np.concatenate(of) * BUCKETS + bucket)
    return both % BUCKETS, both // BUCKETS


def steps(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= STEP:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def log_count_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    p, q = SMOOTHING + good, SMOOTHING + bad
    return np.log(p / p.sum()) - np.log(q / q.sum())


def scaled(rows: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    """The values of each row's buckets: ratios, to unit length."""
    out = []
    for r in rows:
        x = ratios[r]
        out.append(x / max(np.sqrt(x @ x), 1e-12))
    return out


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, passes: int = PASSES, tolerance: float = 0.01, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last is the intercept's) and duals of the hinge loss: of w @ w / 2 + sum cost * max(0, 1 - y * (w @ x)).

    One dual at a time goes to its best value between 0 and its cost; w follows. Rows come in a new order in each pass, and
    passes end when no dual wants to move by more than the tolerance.
    """
    w, alpha = np.zeros(BUCKETS + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        furthest = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i], values[i]
            slope = y[i] * (w[at] @ x + w[-1]) - 1
            wanted = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= cost[i] else slope
            if wanted:
                furthest = max(furthest, abs(wanted))
                new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
                move = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[at] += move * x
                w[-1] += move
        if furthest < tolerance:
            break
    return w, alpha


def sigmoid_of(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton's method; targets are drawn in from 0 and 1 as by one more row each."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    ab = np.zeros(2)
    loss = lambda ab: float((weight * (np.logaddexp(0, x @ ab) - target * (x @ ab))).sum() + 1e-6 * ab @ ab)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -500, 500)))
        slope = x.T @ (weight * (p - target)) + 2e-6 * ab
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-6 and loss(ab - size * step) > loss(ab):
            size /= 2
        ab = ab - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


@dataclass(frozen=True)
class Model:
    """Weights times ratios and squares of ratios by bucket, intercept, and the sigmoid."""

    weights: np.ndarray
    squares: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        bucket, of = features(texts)
        total, length = (np.bincount(of, weights=x[bucket], minlength=len(texts)) for x in (self.weights, self.squares))
        return total / np.sqrt(np.maximum(length, 1e-24)) + self.intercept

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -500, 500)))


def fit(rows: list[np.ndarray], label: np.ndarray, ratios: np.ndarray, sizes: tuple[int, int]) -> Model:
    """A model from a sample's features and labels; sizes: of all labelled rows, by label."""
    values, y = scaled(rows, ratios), np.where(label == 1, 1.0, -1.0)
    there = np.array([(label == 0).sum(), (label == 1).sum()])

    def fitted(at: np.ndarray) -> np.ndarray:
        n = np.bincount(label[at], minlength=2)
        cost = COST * len(at) / (2.0 * np.maximum(n[label[at]], 1))  # both labels weigh alike
        w, _ = dual_coordinate_descent([rows[i] for i in at], [values[i] for i in at], y[at], cost)
        used = w[:-1] != 0
        mean = np.abs(w[:-1]).sum() / max(1, used.sum())
        w[:-1] = np.where(used, (1 - OWN_PART) * mean + OWN_PART * w[:-1], 0.0)
        return w

    fold = np.arange(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    parted = all(len(np.unique(label[fold != k])) == 2 for k in range(FOLDS))
    for k in range(FOLDS if parted else 1):
        w = fitted(np.flatnonzero(fold != k) if parted else np.arange(len(rows)))
        for i in np.flatnonzero(fold == k) if parted else range(len(rows)):
            margins[i] = w[rows[i]] @ values[i] + w[-1]
    a, b = sigmoid_of(margins, label.astype(float), (np.array(sizes) / np.maximum(there, 1))[label])
    w = fitted(np.arange(len(rows)))
    return Model((w[:-1] * ratios).astype(np.float32), (ratios**2).astype(np.float32), float(w[-1]), a, b)


def constant(share: float) -> Model:
    """Of a table that has not both labels: all texts get the share of label 1, and with no label at all a half."""
    none = np.zeros(BUCKETS, dtype=np.float32)
    return Model(none, none, 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))


def with_label(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, text and label (0 or 1) of the rows that have one; null ids and labels have none. Of ids that are labelled or
    given several times, all pairs are rows."""
    known = labels.filter(F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).join(known, "id")


def learn(labelled: DataFrame, seed: int = 11) -> Model:
    """A model from rows of with_label. All rows are counted; the fit takes a sample bounded by SAMPLE_ROWS and SAMPLE_BYTES
    for each label, one task. The same rows give the same model, however they are dealt."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("quality")
        found = np.zeros((2, BUCKETS + 2), dtype=np.int64)  # the last two: rows and bytes
        for batch in batches:
            texts, label = batch["text"].tolist(), batch["label"].to_numpy()
            for lo, hi in steps(texts):
                bucket, of = features(texts[lo:hi])
                for k in (0, 1):
                    found[k, :BUCKETS] += np.bincount(bucket[label[lo:hi][of] == k], minlength=BUCKETS)
            found[:, BUCKETS] += np.bincount(label, minlength=2)
            found[:, BUCKETS + 1] += np.bincount(label, weights=[len(t or b"") for t in texts], minlength=2).astype(np.int64)
        release()
        at = np.flatnonzero(found.any(axis=0))
        yield pd.DataFrame({"bucket": at.astype(np.int32), "bad": found[0, at], "good": found[1, at]})

    counts = labelled.select("text", "label").mapInPandas(count, "bucket int, bad long, good long")
    counts = counts.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()  # a row a bucket
    total = np.zeros((2, BUCKETS + 2), dtype=np.int64)
    total[:, counts["bucket"].to_numpy(np.int64)] = counts[["bad", "good"]].to_numpy(np.int64).T
    sizes, size = total[:, BUCKETS], total[:, BUCKETS + 1]
    if not sizes.all():
        return constant(0.5 if not sizes.any() else float(sizes[1] > 0))
    ratios = log_count_ratios(total[1, :BUCKETS], total[0, :BUCKETS])

    key = F.xxhash64(F.lit(seed), "id", "text")
    share = [min(1.0, SAMPLE_ROWS / int(sizes[k]), SAMPLE_BYTES / max(1, int(size[k]))) for k in (0, 1)]
    limit = F.when(F.col("label") == 1, F.lit(int(share[1] * (1 << 30)))).otherwise(F.lit(int(share[0] * (1 << 30))))
    sample = labelled.filter(F.pmod(key, F.lit(1 << 30)) < limit).select(key.alias("key"), "text", "label")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("quality")
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in steps(texts):
                bucket, of = features(texts[lo:hi])
                parts = np.split(bucket.astype(np.int32), np.searchsorted(of, np.arange(1, hi - lo)))
                yield pd.DataFrame({"key": batch["key"].iloc[lo:hi].to_numpy(), "label": batch["label"].iloc[lo:hi].to_numpy(), "buckets": parts})
        release()

    shared = labelled.sparkSession.sparkContext.broadcast(ratios)

    def fit_one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "label"], kind="stable")
        m = fit([np.asarray(b, dtype=np.int64) for b in rows["buckets"]], rows["label"].to_numpy(), shared.value, (int(sizes[0]), int(sizes[1])))
        release()
        return pd.DataFrame({"weights": [m.weights.tobytes()], "intercept": [m.intercept], "slope": [m.slope], "shift": [m.shift]})

    encoded = sample.mapInPandas(encode, "key long, label int, buckets array<int>")
    r = encoded.groupBy(F.lit(0).alias("one")).applyInPandas(fit_one, "weights binary, intercept double, slope double, shift double").first()
    if r is None:
        return constant(float(sizes[1] / sizes.sum()))
    return Model(np.frombuffer(r["weights"], dtype=np.float32), (ratios**2).astype(np.float32), r["intercept"], r["slope"], r["shift"])


def scored(text: Column, model: Model, df: DataFrame) -> Column:
    """How likely label 1 is, 0 to 1. Null and empty texts have no features: theirs is the score of the intercept."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("quality")
        for texts in batches:
            values = texts.tolist()
            out = [shared.value.scores(values[lo:hi]) for lo, hi in steps(values)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))
        release()

    return score(text.cast("binary"))


def classify(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """df with score and predicted (1 from `least` on, else 0); columns of df with these names are replaced, others stay.
    Repeated rows are scored each; an empty table gives no rows."""
    names = [c for c in df.columns if c not in ("score", "predicted")]
    found = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), scored(F.col(f"`{text_col}`"), model, df).alias("score"))
    return found.select(*[F.col(f"row.`{c}`") for c in names], "score", (F.col("score") >= least).cast("int").alias("predicted"))
