"""Operator 10: language identification with language-bitmask n-gram filters.

Every language has a Bloom filter of the character n-grams that are common in it. The filters are bit-sliced: one table
holds, at each position, the bits of all languages, so that looking an n-gram up once returns all languages that contain
it. A text goes to the language whose bit is set most often, after the share that false positives explain is taken off.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.common import claim, materialize, release

#: Characters in an n-gram; words are parted by one blank.
N = 4
#: Bits of a language's filter, and positions an n-gram sets in it.
BITS = 1 << 22
HASHES = 3
#: Labelled rows of each language that its filter is learned from, about, at most (the documented bound of the sample).
LANGUAGE_ROWS = 5_000
#: An n-gram belongs to a language if it is at least LEAST_SHARE of the language's n-grams (so at most 1 / LEAST_SHARE of
#: them do), and at least NEAR times as common as in the language where it is most common.
LEAST_SHARE = 4e-6
NEAR = 0.25
UNDECIDED = "und"
#: Characters looked at in one step; longer texts are worked through in as many steps as they need.
STEP = 1 << 18

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """2 for code points that are letters, 1 for marks, which belong to words, too."""
    global _letters
    if _letters is None:
        _letters = np.fromiter(("ML".find(unicodedata.category(chr(c))[0]) + 1 for c in range(sys.maxunicode + 1)), dtype=np.uint8)
    return _letters


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of many texts end to end, the text each belongs to, and which texts have a letter."""
    joined = "".join(f"{t.lower().replace(chr(0), ' ')}\x00" if t else "\x00" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
    breaks = codes == 0
    owner = np.cumsum(breaks) if len(codes) else np.zeros(0, dtype=np.int64)
    kind = letters()[codes]
    letter = kind > 0
    has = np.zeros(len(texts), dtype=bool)
    has[owner[kind == 2]] = True
    # one blank after each run of letters, the last of a text, too
    keep = letter | np.concatenate([[False], letter[:-1]]) if len(codes) else letter
    c = np.where(letter, codes, 32)[keep].astype(np.uint64)
    own = owner[keep] - breaks[keep]
    if len(c) < N:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), has
    h = np.zeros(len(c) - N + 1, dtype=np.uint64)
    for k in range(N):
        h = h * np.uint64(0x100000001B3) + c[k : len(c) - N + 1 + k]
    inside = own[: len(own) - N + 1] == own[N - 1 :]
    return _mix(h[inside]), own[: len(own) - N + 1][inside], has


def positions(h: np.ndarray) -> list[np.ndarray]:
    """Where an n-gram's bits are: double hashing over BITS."""
    a, b = h & np.uint64(BITS - 1), (h >> np.uint64(32)) | np.uint64(1)
    return [(a + np.uint64(k) * b) & np.uint64(BITS - 1) for k in range(HASHES)]


def steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STEP characters each; at least one text, so that a longer one is a step of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= STEP:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


@dataclass(frozen=True)
class Filters:
    """languages[i] has bit i % 8 of plane i // 8; false_positives are the filters' own rates; usual: of the most n-grams."""

    languages: list[str]
    usual: int
    planes: np.ndarray
    false_positives: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of known n-grams for each text and language, and which texts have letters."""
        h, own, has = grams(texts)
        n = np.bincount(own, minlength=len(texts)).astype(float)
        out = np.zeros((len(texts), len(self.languages)))
        at = positions(h)
        for plane in range(len(self.planes)):
            masks = self.planes[plane][at[0]]
            for p in at[1:]:
                masks = masks & self.planes[plane][p]
            for bit in range(min(8, len(self.languages) - 8 * plane)):
                hits = np.bincount(own[(masks >> np.uint8(bit)) & np.uint8(1) == 1], minlength=len(texts))
                fp = self.false_positives[8 * plane + bit]
                out[:, 8 * plane + bit] = np.clip((hits / np.maximum(n, 1) - fp) / (1 - fp), 0, 1)
        return out, has


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Filters:
    """Filters from rows with a language; of a language's rows beyond LANGUAGE_ROWS a hashed sample of about that size is
    read, of rare languages all. Null texts teach nothing; a table without labelled rows gives no filters.

    Counts are summed by Spark, a filter is set by one task a language from at most 1 / LEAST_SHARE n-grams, and only the
    filters' bits (BITS / 8 bytes a language) come to the driver.
    """
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{id_col}`").alias("id")).filter("lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    limits = {lang: int(LANGUAGE_ROWS / n * (1 << 30)) for lang, n in sizes.items() if n > LANGUAGE_ROWS}
    if limits:
        limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("lang")]
        rows = rows.filter(limit.isNull() | (F.pmod(F.xxhash64(F.lit(7), "id", "text"), F.lit(1 << 30)) < limit))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("language_id")
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                texts = part["text"].tolist()
                for lo, hi in steps(texts):
                    h, k = np.unique(grams(texts[lo:hi])[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "n": k})
        release()

    counts = rows.select("text", "lang").mapInPandas(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.select("gram", F.struct("lang", "n").alias("x")).groupBy("gram").agg(F.collect_list("x").alias("xs"))
    counts = materialize(counts, "language-grams")
    totals = counts.select(F.explode("xs").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("total")).collect()
    languages = sorted(r["lang"] for r in totals)
    if not languages:
        return Filters([], 0, np.zeros((0, BITS), dtype=np.uint8), np.zeros(0))
    total = F.create_map(*[x for r in totals for x in (F.lit(r["lang"]), F.lit(float(r["total"])))])
    shares = F.transform("xs", lambda x: F.struct(x["lang"].alias("lang"), (x["n"] / total[x["lang"]]).alias("share")))
    near = counts.select("gram", shares.alias("xs")).withColumn("top", F.array_max(F.transform("xs", lambda x: x["share"])))
    common = near.select("gram", "top", F.explode("xs").alias("x")).filter((F.col("x.share") >= LEAST_SHARE) & (F.col("x.share") >= NEAR * F.col("top")))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BITS, dtype=bool)
        for p in positions(part["gram"].to_numpy().view(np.uint64)):
            bits[p] = True
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    found = common.select("gram", F.col("x.lang").alias("lang")).groupBy("lang").applyInPandas(fill, "lang string, bits binary").collect()
    planes = np.zeros((-(-len(languages) // 8), BITS), dtype=np.uint8)
    rates = np.zeros(len(languages))
    for r in found:
        i = languages.index(r["lang"])
        bits = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8))
        planes[i // 8] |= bits << np.uint8(i % 8)
        rates[i] = bits.mean() ** HASHES
    usual = max(range(len(languages)), key=lambda i: (next(r["total"] for r in totals if r["lang"] == languages[i]), -i))
    return Filters(languages, usual, planes, rates)


def predicted(text: Column, filters: Filters, spark: SparkSession) -> Column:
    """lang_pred, score (0 to 1: the language's part of what all languages explain) and known (share of n-grams) as a struct."""
    shared = spark.sparkContext.broadcast(filters)
    names = [*filters.languages, UNDECIDED]

    @F.pandas_udf("lang_pred string, score double, known double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("language_id")
        f = shared.value
        for texts in batches:
            pred, score, known = [], [], []
            values = texts.tolist()
            for lo, hi in steps(values):
                out, has = f.scores(values[lo:hi])
                top = out.max(axis=1, initial=0.0)
                best = np.where(top > 0, out.argmax(axis=1), f.usual) if out.shape[1] else np.zeros(hi - lo, dtype=int)
                pred += [names[b] if letters else UNDECIDED for b, letters in zip(best, has)]
                score += list(np.where(top > 0, top / np.maximum(out.sum(axis=1), 1e-12), 0.0))
                known += list(top)
            yield pd.DataFrame({"lang_pred": pred, "score": score, "known": known})
        release()

    return predict(text)


def _with_prediction(df: DataFrame, filters: Filters, text_col: str) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("row"), predicted(F.col(f"`{text_col}`"), filters, df.sparkSession).alias("found"))


def identify(df: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score and known (see predicted); columns of df with these names are replaced, others stay.

    A null text or one without letters is `und` with score 0; one of whose n-grams no filter knows any is of the usual
    language with score 0. If no language was learned, all is `und`. Repeated rows are answered each; an empty table gives
    no rows.
    """
    found = _with_prediction(df, filters, text_col)
    own = [F.col(f"row.`{c}`") for c in df.columns if c not in ("lang_pred", "score", "known")]
    return found.select(*own, "found.*")


def decided(df: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """The rows of df, with all its columns as they are, whose prediction isn't `und`."""
    return _with_prediction(df, filters, text_col).filter(F.col("found.lang_pred") != UNDECIDED).select("row.*")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row's fold, from the checksum of its id as text, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
