"""Operator 13: how far sources of a language part from each other in the words they use.

Counts by (language, source, term) are large, and a term is a string of any length. So strings stay where they are until
something asks for them. What is counted and shuffled are digests of fixed width. Afterwards only the digests that
are kept fetch their strings, smallest and largest: where the two differ, several terms share a digest, and those digests
are counted again, term by term. The rows of a report get their text at the very end.

A term's probability in a group is p = 1 + floor(SCALE * (count + 1) / (N + V)), and a group parts from another by
f = floor((p - q)**2 / q). Terms that neither of two sources has add the same f each, so that a slice of the terms costs
what its non-zero counts cost and the rest is one multiplication.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import claim, materialize, release
from broadsheet.llm.words import word_hashes

#: A language keeps the terms in at least so many of its documents.
LEAST_DOCS = 3
SCALE = 1_000_000_000
#: Rows of a group in the part `term`.
TOP = 200
#: Text whose terms are counted in one step, and different entries a task holds before it sends them, about.
STEP_BYTES = 4 << 20
HELD = 1 << 20
#: Bits of the table that thins what fetches its strings; it is 16 MB whatever the corpus, and only ever lets too much pass.
BITS = 1 << 27
BIT_SLICES = 64
#: (term, source) counts of a language in a slice, about.
SLICE_ROWS = 200_000
#: Parts in which a group's best terms are ranked before they meet.
LANES = 32

#: Letters A-Z lower-cased; all other ASCII but a-z parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def digests(terms: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the terms of texts whose terms stand between blanks, end to end, and the number of each text's."""
    h, n = word_hashes(terms)
    return h >> np.uint64(64 - bits), n


def _steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a few megabytes of text; a longer text is a step of its own. Their terms stand between blanks."""
    for batch in batches:
        texts = [t.translate(_TERMS) if t else b"" for t in batch["text"]]
        sizes = np.cumsum([len(t) for t in texts]) // STEP_BYTES
        batch["text"] = texts
        for _, step in batch.groupby(sizes, sort=False):
            yield step


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(group, digest, docs, n) with sums for each (group, digest), ordered by both."""
    group, digest, docs, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((digest, group))
    group, digest = group[order], digest[order]
    first = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]) | (group[1:] != group[:-1])])) if len(group) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(x[order], first) if len(first) else x for x in (docs, n)]
    return group[first], digest[first], *sums


def _step_counts(texts: list[bytes], group: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    h, n = digests(texts, bits)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    return _merged([(group[doc[first]], h[first], np.ones(len(first), np.int64), times)])


def digest_counts(rows: DataFrame, bits: int) -> DataFrame:
    """Documents and occurrences by (lang, source, digest); a task adds up its own before it sends them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("source_audit")
        groups: dict[tuple[str, str], int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def sent() -> Iterator[pd.DataFrame]:
            group, digest, docs, n = _merged(parts)
            langs, sources = (np.array(x, dtype=object) for x in zip(*groups))
            for lo in range(0, len(group), 100_000):
                g = group[lo : lo + 100_000]
                yield pd.DataFrame({"digest": digest[lo : lo + 100_000].view(np.int64), "lang": langs[g], "source": sources[g], "docs": docs[lo : lo + 100_000], "n": n[lo : lo + 100_000]})

        for step in _steps(batches):
            group = np.array([groups.setdefault(x, len(groups)) for x in zip(step["lang"], step["source"])], dtype=np.int32)
            parts.append(_step_counts(step["text"].tolist(), group, bits))
            held += len(parts[-1][0])
            if held > 2 * HELD:
                parts = [_merged(parts)]
                held = len(parts[0][0])
            if held > HELD:
                yield from sent()
                parts, held = [], 0
        if held:
            yield from sent()
        release()

    sent = rows.mapInPandas(count, "digest long, lang string, source string, docs long, n long")
    return sent.repartition("digest").groupBy("digest", "lang", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def bit_table(digest: DataFrame) -> list[np.ndarray]:
    """A bit for each digest, at its lowest bits: a task for each part of the table, and the table's fixed size to the driver."""
    place, size = F.pmod("digest", F.lit(BITS)), BITS // BIT_SLICES
    dealt = digest.select((place / size).cast("int").alias("part"), (place % size).cast("int").alias("at")).distinct()

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, dtype=bool)
        bits[part["at"].to_numpy()] = True
        return pd.DataFrame({"part": [part["part"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    out = [np.zeros(size // 8, dtype=np.uint8)] * BIT_SLICES
    for r in dealt.groupBy("part").applyInPandas(fill, "part int, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def in_table(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = h & np.uint64(BITS - 1)
    return (table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


def kept_terms(counts: DataFrame, keys: list[str], least_docs: int) -> DataFrame:
    """The counts of terms in at least least_docs documents of their language; `head` is true for one row a (lang, term)."""
    term = Window.partitionBy(*keys, "lang")
    found = counts.withColumn("all_docs", F.sum("docs").over(term)).filter(F.col("all_docs") >= least_docs)
    return found.select(*keys, "lang", "source", "n", (F.row_number().over(term.orderBy("source")) == 1).alias("head"))


def term_strings(rows: DataFrame, digest: DataFrame, bits: int) -> DataFrame:
    """For each of the digests the smallest and the largest term that has it. Strings of no other digest leave their task,
    but for the few that share a bit of the table with one."""
    shared = rows.sparkSession.sparkContext.broadcast(np.concatenate(bit_table(digest)))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("source_audit")
        seen: set[bytes] = set()

        def sent() -> Iterator[pd.DataFrame]:
            terms = list(seen)
            for lo in range(0, len(terms), 100_000):
                part = terms[lo : lo + 100_000]
                h, _ = digests(part, bits)
                at = np.flatnonzero(in_table(h, shared.value))
                yield pd.DataFrame({"digest": h[at].view(np.int64), "term": [part[i] for i in at]})

        for step in _steps(batches):
            seen.update(*(t.split() for t in step["text"]))
            if len(seen) > HELD // 2:
                yield from sent()
                seen.clear()
        yield from sent()
        release()

    sent = rows.select("text").mapInPandas(fetch, "digest long, term binary")
    ends = sent.groupBy("digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi")).join(digest, "digest", "left_semi")
    return ends.select("digest", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"))


def split_counts(rows: DataFrame, digest: DataFrame, bits: int) -> DataFrame:
    """Documents and occurrences by (lang, source, digest, term) for digests that several terms share."""
    shared = rows.sparkSession.sparkContext.broadcast(np.concatenate(bit_table(digest)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("source_audit")
        for step in _steps(batches):
            docs: Counter = Counter()
            n: Counter = Counter()
            for lang, source, text in zip(step["lang"], step["source"], step["text"]):
                times = Counter(text.split())
                terms = list(times)
                for i in np.flatnonzero(in_table(digests(terms, bits)[0], shared.value)) if terms else ():
                    docs[lang, source, terms[i]] += 1
                    n[lang, source, terms[i]] += times[terms[i]]
            if docs:
                langs, sources, terms = (list(x) for x in zip(*docs))
                yield pd.DataFrame({"digest": digests(terms, bits)[0].view(np.int64), "lang": langs, "source": sources, "term": terms, "docs": list(docs.values()), "n": list(n.values())})
        release()

    sent = rows.mapInPandas(count, "digest long, lang string, source string, term binary, docs long, n long").join(digest, "digest", "left_semi")
    keys = ["digest", F.col("term").cast("string").alias("term"), "lang", "source"]
    return sent.repartition("digest", "term").groupBy(*keys).agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def probability(count: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / of), exactly: count + 1 is at most `of`, and the quotient is found three digits at a time."""
    whole, rest = np.divmod(count + 1, of)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, of)
        whole = whole * 1000 + digit
    return whole + 1


def parting(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    return (p - q) * (p - q) // q


def audit_slice(counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """A slice of a language's terms: for each ordered pair of its sources the sum of f over the terms of either, and how
    many they are; for each source its best `top` terms, with all that are equal to the last."""
    lang, kept, total = groups["lang"][0].as_py(), groups["kept"][0].as_py(), groups["lang_total"][0].as_py()
    names, of = groups["source"].to_pylist(), groups["total"].to_numpy() + kept
    if counts.num_rows == 0:
        return pa.Table.from_pylist([], _FOUND)
    column = pc.index_in(counts["source"], value_set=groups["source"].combine_chunks()).to_numpy()
    order = np.argsort(counts["term_key"].to_numpy(), kind="stable")
    key, column, digest, n = (x[order] for x in (counts["term_key"].to_numpy(), column, counts["digest"].to_numpy(), counts["n"].to_numpy()))
    term = counts["term"].to_pandas().to_numpy()[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    row, start = np.cumsum(first) - 1, np.flatnonzero(first)
    own, bases = probability(n, of[column]), probability(np.zeros(len(of), np.int64), of)
    whole = probability(np.add.reduceat(n, start), total + kept)[row]
    more = np.flatnonzero(own > whole)
    who, f = column[more], parting(own[more], whole[more])
    width = len(names)
    value, seen = np.zeros((width, width), np.int64), np.zeros((width, width), np.int64)
    step = max(1, 4_000_000 // width)
    for lo in range(0, len(start), step):
        inside = slice(start[lo], start[lo + step] if lo + step < len(start) else len(row))
        r, c = row[inside] - lo, column[inside]
        p, has = np.tile(bases, (r[-1] + 1, 1)), np.zeros((r[-1] + 1, width), bool)
        p[r, c], has[r, c] = own[inside], True
        for j in range(width):
            mine = np.flatnonzero(has[:, j])
            if len(mine):
                value[j] += parting(p[mine, j : j + 1], p[mine]).sum(axis=0)
                value[:, j] += np.where(has[mine], 0, parting(p[mine], p[mine, j : j + 1])).sum(axis=0)
        both = has.astype(np.float64).T @ has.astype(np.float64)  # counts of terms, far below 2**53
        seen += (np.diag(both)[:, None] + np.diag(both)[None, :] - both).astype(np.int64)
    chosen = []
    for j in range(width):
        mine = np.flatnonzero(who == j)
        if len(mine) > top:
            mine = mine[f[mine] >= np.partition(f[mine], len(mine) - top)[len(mine) - top]]
        chosen.append(mine)
    chosen = np.concatenate(chosen)
    a, b = np.nonzero(seen * (1 - np.eye(width, dtype=np.int64)))
    pairs = pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": pa.array([names[i] for i in a], pa.string()), "other": pa.array([names[i] for i in b], pa.string()),
                      "digest": pa.nulls(len(a), pa.int64()), "term": pa.nulls(len(a), pa.string()), "value": value[a, b], "seen": seen[a, b]})
    terms = pa.table({"lang": pa.array([lang] * len(chosen), pa.string()), "source": pa.array([names[i] for i in who[chosen]], pa.string()), "other": pa.nulls(len(chosen), pa.string()),
                      "digest": digest[more[chosen]], "term": pa.array(term[more[chosen]], pa.string()), "value": f[chosen], "seen": pa.nulls(len(chosen), pa.int64())})
    return pa.concat_tables([pairs.cast(_FOUND), terms.cast(_FOUND)])


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("digest", pa.int64()), ("term", pa.string()), ("value", pa.int64()), ("seen", pa.int64())])


def _best(rows: DataFrame, top: int, *more: Column) -> DataFrame:
    """Of each (lang, source) the `top` rows of largest value, in lanes first; equal ones stay unless `more` parts them."""
    place = F.row_number() if more else F.rank()
    for by in (["lang", "source", "lane"], ["lang", "source"]):
        rows = rows.withColumn("rank", place.over(Window.partitionBy(*by).orderBy(F.col("value").desc(), *more))).filter(F.col("rank") <= top)
    return rows


def audit(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    digest_bits: int = 64,
) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) its `pair` with each other source of the language and
    its first `top` `term`s by what they part it from the language. Ranks follow value, then item, by bytes.

    Null texts, languages and sources count as empty ones. Repeated rows are documents each. Groups without terms have
    pairs; where a language keeps no term, their value is 0. A language of one source has no pairs. Other columns of df take
    no part, whatever their names. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary"))
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(text.alias("text"), name(lang_col).alias("lang"), name(source_col).alias("source"))

    kept = materialize(kept_terms(digest_counts(rows, digest_bits), ["digest"], least_docs), "audit-kept")
    wanted = kept.select("digest").distinct()
    strings = materialize(term_strings(rows, wanted, digest_bits), "audit-strings")
    shared = strings.filter(F.col("lo") != F.col("hi")).select("digest")
    kept = kept.withColumn("term", F.lit(None).cast("string"))
    if not shared.isEmpty():
        again = kept_terms(split_counts(rows, shared, digest_bits), ["digest", "term"], least_docs)
        kept = materialize(kept.join(shared, "digest", "left_anti").unionByName(again), "audit-split")

    # sizes of the groups, all that occur: few against the terms, as each pair of a language is a row of the result
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("head").cast("long")).alias("heads"), F.count("*").alias("entries"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "heads", "entries"])
    sizes = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("kept"), F.greatest(F.lit(1), F.ceil(F.sum("entries") / SLICE_ROWS)).alias("slices"))
    groups = materialize(groups.join(sizes, "lang"), "audit-groups").select("lang", "source", "total", "lang_total", "kept", "slices")

    # a slice of a language's terms meets the sizes of the language's groups
    term_key = F.when(F.col("term").isNull(), F.col("digest")).otherwise(F.xxhash64("digest", "term"))
    counts = kept.join(groups.select("lang", "slices").distinct(), "lang").select("lang", F.pmod("digest", "slices").alias("slice"), "source", "digest", "term", "n", term_key.alias("term_key"))
    dealt = groups.select("lang", "source", "total", "lang_total", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))

    def look(counts: pa.Table, groups: pa.Table) -> pa.Table:
        claim("source_audit")
        return audit_slice(counts, groups, top)

    schema = "lang string, source string, other string, digest long, term string, value long, seen long"
    found = counts.groupBy("lang", "slice").cogroup(dealt.groupBy("lang", "slice")).applyInArrow(look, schema)
    found = materialize(found, "audit-found")

    sums = found.filter("other IS NOT NULL").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    base = F.when(F.col("kept") > 0, F.expr(f"1 + {SCALE} div (total + kept)")).otherwise(F.lit(1).cast("long"))
    bases = groups.select("lang", "source", "kept", base.alias("base"))
    pairs = bases.join(bases.select("lang", F.col("source").alias("other"), F.col("base").alias("q")), "lang").filter("source != other").join(sums, ["lang", "source", "other"], "left")
    unseen = (F.col("kept") - F.coalesce("seen", F.lit(0).cast("long"))) * F.expr("((base - q) * (base - q)) div q")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.coalesce("value", F.lit(0).cast("long")) + unseen).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))

    lane = F.pmod(F.xxhash64("digest", "term"), F.lit(LANES)).alias("lane")
    best = _best(found.filter("other IS NULL").select("lang", "source", "digest", "term", "value", lane), top).drop("rank")
    named = best.join(strings.select("digest", "lo"), "digest", "left").withColumn("item", F.coalesce("term", "lo"))
    terms = _best(named, top, F.col("item")).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
