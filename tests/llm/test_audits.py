"""Quality classifier, importance resampling and source audit, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from broadsheet.llm import quality, queries, resampling, source_audit
from broadsheet.llm.language_id import held_out
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHES, SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- op 12 ---------------------------------------------------------------------------------------------------------


def plain_resample(rows, target, share=10, max_n=1, buckets=10_000, least=20):
    def grams(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(ws) - n + 1)], len(ws)

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text)[0])
    for text in target:
        t.update(grams(text)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out, may = [], []
    for i, text in rows:
        g, n = grams(text)
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(g), weight, score))
        may += [(-score, i is None, i or 0)] if n >= least else []
    drawn = sorted(may)[: len(may) * share // 100]
    return out, [(-s, None if null else i) for s, null, i in drawn]


@pytest.mark.parametrize("max_n,buckets,share", [(1, 10_000, 10), (2, 97, 60)])
def test_resampling_equals_plain(spark, docs, rows, max_n, buckets, share):
    target = ["w1 w2 w3 W3 w399", None, "", "Same text here w7"]
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), max_n=max_n, buckets=buckets, share=share).collect()
    want, drawn = plain_resample([r[:2] for r in rows], target, share, max_n, buckets)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(want)
    ranks = sorted((r["rank"], r["score"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert ranks == [(k + 1, s, i) for k, (s, i) in enumerate(drawn)]


def test_bit_planes_sum_exactly():
    rng = np.random.default_rng(3)
    for size in (1, 64, 1000):
        gains = rng.integers(-20_000, 20_000, size)
        counts = rng.integers(0, 5, (9, size)) * rng.integers(0, 40_000, (9, 1))
        assert (resampling.Gains(gains).sums(counts) == counts @ gains).all()
    assert (resampling.Gains(np.zeros(10, np.int64)).sums(np.ones((2, 10), np.int64)) == 0).all()
    assert (resampling.Gains(np.full(3, -8)).sums(np.eye(3, dtype=np.int64)) == -8).all()


def test_resampling_names_and_empty(spark, clashing, docs, empty):
    target = docs.select("text").limit(5)
    got = resampling.resample(clashing.withColumn("rank", F.lit("x")), target)
    assert set(CLASHES) <= set(got.columns) and got.count() == clashing.count()
    assert [r["node"] for r in got.filter("doc_id = 3").collect()] == ["node3"]
    assert resampling.resample(empty, target).collect() == []
    none = resampling.resample(docs, empty.select("text")).collect()
    assert len(none) == docs.count() and sum(r["rank"] is not None for r in none) > 0


def test_equal_scores_are_drawn_by_id(spark):
    same = spark.createDataFrame([(7, "a " * 30)] * 40, "doc_id long, text string")
    got = resampling.resample(same, same.select("text"), share=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))


# --- op 13 ---------------------------------------------------------------------------------------------------------


def plain_audit(rows, top=200, least=3):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = {t for t in df if df[t] >= least}
        counts = defaultdict(Counter)
        for _, source, c in own:
            counts[source].update({t: n for t, n in c.items() if t in kept})
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for source, c in counts.items():
            parts = {
                "pair": [(-sum(f(p(c, t), p(o, t)) for t in kept), other.encode()) for other, o in counts.items() if other != source],
                "term": [(-f(p(c, t), p(whole, t)), t.encode()) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)],
            }
            for part, found in parts.items():
                out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(found)) if part == "pair" or k < top]
    return Counter(out)


@pytest.fixture(scope="module")
def audited(rows):
    rng = random.Random(2)
    own = [(r[1], r[2], r[3]) for r in rows if r[1] is None or len(r[1]) < 4000]
    own += [(" ".join(rng.choice(["Älg", "älg", "zeta", "eta", "THETA", "x1y", "ét"]) for _ in range(9)), "sv", s) for s in ("a", "a", "b", None, "")]
    return own + [("once only", "xx", "a"), ("1 2 3", "yy", "a"), (None, "yy", "b")]


@pytest.mark.parametrize("bits,top", [(64, 200), (64, 3), (6, 200), (9, 5)])
def test_audit_equals_plain(spark, audited, bits, top, monkeypatch):
    monkeypatch.setattr(source_audit, "SLICE_ROWS", 40)  # many slices
    df = spark.createDataFrame(audited, "text string, lang string, source string").repartition(4)
    got = source_audit.audit(df, top=top, digest_bits=bits)
    assert Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect()) == plain_audit(audited, top)


def test_audit_holds_little_and_sends_often(spark, audited, monkeypatch):
    """Entries are sent in many parts, and steps are one text each: sums stay the same."""
    df = spark.createDataFrame(audited, "text string, lang string, source string").coalesce(1)
    rows = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    want = Counter(tuple(r) for r in source_audit.digest_counts(rows, 64).select("digest", "lang", "source", "docs", "n").collect())
    parts = [source_audit._merged([source_audit._step_counts(["b c b".encode()], np.array([0]), 64), source_audit._step_counts(["c d".encode()], np.array([0]), 64)])]
    assert parts[0][2].tolist() and sorted(zip(parts[0][2].tolist(), parts[0][3].tolist())) == [(1, 1), (1, 2), (2, 2)]
    assert sum(k[3] for k in want) == sum(len(set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for t, _, _ in audited)


def test_probability_is_exact():
    rng = random.Random(4)
    for _ in range(200):
        of = rng.randrange(1, 10**15)
        count = rng.randrange(0, of)
        assert source_audit.probability(np.array([count]), of)[0] == 1 + 10**9 * (count + 1) // of


def test_audit_names_and_empty(spark, clashing, docs, empty):
    assert source_audit.audit(clashing).exceptAll(source_audit.audit(docs)).count() == 0
    assert source_audit.audit(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, 1), (2, "", "", "b", 1)], SCHEMA)
    assert sorted(map(tuple, source_audit.audit(blank).collect())) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


# --- op 11 ---------------------------------------------------------------------------------------------------------


def plain_features(text):
    """Words and runs of up to three shapes of a text, as strings."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    kind = lambda c: "a" if 97 <= c <= 122 or c >= 128 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else chr(c)
    low = [w.lower() for w in words]
    shapes = ["repeat" if i and low[i] == low[i - 1] else re.sub(r"(.)\1+", r"\1", "".join(map(kind, w)), flags=re.S) for i, w in enumerate(words)]
    return set(low), {tuple(shapes[i : i + k]) for k in (1, 2, 3) for i in range(len(shapes) - k + 1)}


def test_features_are_words_and_shapes(rows):
    texts = [None if r[1] is None else r[1].encode() for r in rows if r[1] is None or len(r[1]) < 5000]
    bucket, of = quality.features(texts)
    named = {}
    for i, t in enumerate(texts):
        words, shapes = plain_features(t or b"")
        alone, _ = quality.features([t])
        assert sorted(alone) == sorted(bucket[of == i])  # what stands beside it makes no difference
        assert len(alone) <= len(words) + len(shapes) and len(alone) >= 0.98 * (len(words) + len(shapes))
        named[i] = set(alone)
    one, two = quality.features([b"The the THE end"])[0], quality.features([b"An the the wag"])[0]
    assert set(one) & set(two)  # equal shapes of different words


def test_dual_coordinate_descent_reaches_the_optimum():
    """Primal and dual objectives meet, duals stay in their bounds, and w is what the duals say."""
    rng = np.random.default_rng(8)
    rows = [np.sort(rng.choice(200, rng.integers(1, 30), replace=False)) for _ in range(150)]
    values = [rng.normal(size=len(r)) / 5 for r in rows]
    y = np.where(rng.random(150) < 0.4, 1.0, -1.0)
    cost = np.where(y > 0, 2.0, 0.7)
    w, alpha = quality.dual_coordinate_descent(rows, values, y, cost, passes=2000, tolerance=1e-7)
    assert (alpha >= 0).all() and (alpha <= cost).all()
    again = np.zeros_like(w)
    for a, label, r, v in zip(alpha, y, rows, values):
        again[r] += a * label * v
        again[-1] += a * label
    assert np.allclose(w, again)
    margins = np.array([label * (w[r] @ v + w[-1]) for label, r, v in zip(y, rows, values)])
    primal, dual = w @ w / 2 + (cost * np.maximum(0, 1 - margins)).sum(), alpha.sum() - w @ w / 2
    assert abs(primal - dual) < 1e-4 * primal


def test_ratios_and_sigmoid():
    good, bad = np.array([3, 0, 7]), np.array([1, 1, 0])
    p, q = (good + 1) / (good + 1).sum(), (bad + 1) / (bad + 1).sum()
    assert np.allclose(quality.log_count_ratios(good, bad), np.log(p / q))
    x = np.linspace(-3, 3, 4000)
    label = (np.random.default_rng(1).random(4000) < 1 / (1 + np.exp(-(2 * x + 0.5)))).astype(float)
    a, b = quality.sigmoid_of(x, label, np.ones(4000))
    assert abs(a - 2) < 0.2 and abs(b - 0.5) < 0.2


def marked(n, seed):
    """Good prose and two kinds of junk: repeated words and words with marks; empty and null texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 8)))
    out = []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "repeat", "marks"])
        ws = [word() for _ in range(rng.randint(5, 80))]
        text = " ".join(ws).capitalize() + "." if kind == "good" else " ".join(w for w in ws[:9] for _ in range(8)) if kind == "repeat" else " ".join(w + rng.choice(["%%%", "$$"]) for w in ws)
        out.append((i, text, int(kind == "good")))
    return out


def test_held_out_accuracy_and_reruns(spark):
    data = marked(900, 6)
    docs = spark.createDataFrame([r[:2] for r in data] + [(901, ""), (902, None), (902, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in data] + [(5000, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = []
    for parts in (1, 7):
        model = quality.learn(quality.with_label(docs.repartition(parts).filter(~held_out()), labels.repartition(parts)))
        found.append({(r["doc_id"], r["score"], r["predicted"]) for r in quality.classify(docs, model).collect()})
    assert found[0] == found[1]
    truth = {r[0]: r[2] for r in data}
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for _, s, p in found[0])
    wrong = [i for i, _, p in found[0] if i in truth and zlib.crc32(str(i).encode()) % 5 == 0 and p != truth[i]]
    assert len(wrong) <= 2
    assert {i for i, _, _ in found[0]} == {r[0] for r in data} | {901, 902}


def test_the_sample_is_bounded_and_ratios_are_not(spark, monkeypatch):
    """A fit on a tenth of the rows: counts still take all, and the model is as good."""
    data = marked(900, 9)
    df = spark.createDataFrame([(i, t.encode(), k) for i, t, k in data], "id long, text binary, label int")
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 60)
    model = quality.learn(df)
    truth = np.array([r[2] for r in data])
    assert ((model.scores([r[1].encode() for r in data]) >= 0.3) == truth).mean() > 0.97
    good = np.zeros(quality.BUCKETS)
    bad = np.zeros(quality.BUCKETS)
    for _, t, k in data:
        (good if k else bad)[quality.features([t.encode()])[0]] += 1
    assert np.allclose(model.squares, (quality.log_count_ratios(good, bad) ** 2).astype(np.float32))


def test_one_label_or_none(spark, docs, empty, clashing):
    known = docs.select("doc_id", F.lit(1).alias("quality"))
    model = quality.learn(quality.with_label(docs, known))
    assert {round(r["score"], 6) for r in quality.classify(docs, model).collect()} == {1.0}
    none = quality.learn(quality.with_label(docs, known.filter("false")))
    assert {(r["score"], r["predicted"]) for r in quality.classify(docs, none).collect()} == {(0.5, 1)}
    got = quality.classify(clashing, none)
    assert set(CLASHES) <= set(got.columns) and got.count() == clashing.count()
    assert quality.classify(empty, none).collect() == []


def test_query_learns_from_training_rows_only(spark, tmp_path):
    data = marked(400, 3)
    held = [r for r in data if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held
    for k, turned in enumerate((False, True)):  # labels of held-out rows make no difference
        d = tmp_path / str(k)
        spark.createDataFrame([(r[0], r[1], "en", "a", 1) for r in data], SCHEMA).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(r[0], 1 - r[2] if turned and r in held else r[2], 0) for r in data], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    a, b = ({tuple(r) for r in queries.op11_quality(spark, f"{tmp_path}/{k}").collect()} for k in (0, 1))
    assert a == b and {r[1] for r in a} == {True, False}
