import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from broadsheet.llm import language_id, lm_scoring, mixing, nearest, sharding, words
from pyspark.sql import functions as F


def expected_scores(rows, least=2):
    split = [(r[1] or "").encode().split() for r in rows]
    c1 = Counter(w for s in split for w in s)
    c2 = Counter(p for s in split for p in zip(s, s[1:]))
    total = sum(c1.values())
    out = []
    for r, s in zip(rows, split):
        if not s:
            out.append((r[0], 0, 0.0))
            continue
        score = math.log(c1[s[0]] / total)
        score += sum(math.log(c2[a, b] / c1[a]) if c2[a, b] >= least else math.log(0.4 * c1[b] / total) for a, b in zip(s, s[1:]))
        out.append((r[0], len(s), round(score, 5)))
    return Counter(out)


def test_lm_scores(clashing, rows):
    got = lm_scoring.score(clashing).collect()
    assert Counter((r["doc_id"], r["n_words"], round(r["log_score"], 5)) for r in got) == expected_scores(rows)
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got)


def test_lm_many_blocks(docs, rows, monkeypatch):
    """Counts that blocks share, and counts of one block alone; repeated rows; a word that is longer than a chunk."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm_scoring, "SLICE_BYTES", 5000)
    for least in (2, 3):
        got = lm_scoring.score(docs, min_count=least).collect()
        assert Counter((r["doc_id"], r["n_words"], round(r["log_score"], 5)) for r in got) == expected_scores(rows, least)


def test_lm_shuffles_each_different_gram_of_a_block_once(docs):
    plan = lm_scoring.score(docs)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan  # the result reads a written table; nothing was sent whole before


def test_words_of_many_texts(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 64)
    monkeypatch.setattr(words, "_tables", None)
    texts = [b"", b" a  b\t", b"b a b", b"\n", b"x" * 200 + b" a", b"yy " * 90, b"x" * 200, "é\u00a0z".encode(), b"ab ba"]
    hashes, n = words.word_hashes(texts)
    split = [t.split() for t in texts]
    assert n.tolist() == [len(s) for s in split]
    table = {}
    for w, h in zip([w for s in split for w in s], hashes.tolist()):
        assert table.setdefault(w, h) == h
    assert len(set(table.values())) == len(table)
    assert words.word_hashes([])[0].tolist() == [] and words.word_hashes([b""])[1].tolist() == [0]
    two = words.ngram_hashes(hashes, 2)
    assert len(two) == len(hashes) - 1 and len(words.ngram_hashes(hashes[:1], 2)) == 0


def test_lm_rare_words(spark):
    """More words than any table of them could hold, most of them once: each is scored by its own count."""
    rows = [(i, " ".join(f"w{1000 * i + k}" for k in range(1000)) + " w7 w8 the end") for i in range(265)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_words"], round(r["log_score"], 5)) for r in got) == expected_scores(rows)


def test_lm_empty(empty):
    assert lm_scoring.score(empty).count() == 0


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(clashing, rows):
    plan = mixing.mix_plan(clashing).collect()
    again = mixing.mix_plan(clashing.repartition(3)).collect()
    assert Counter(map(str, plan)) == Counter(map(str, again))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = expected_targets(sizes)
    assert len(plan) == len(rows)
    taken = defaultdict(int)
    for p in plan:
        assert 0 <= p["taken"] <= 2 * p["size"]
    source = {}
    for r in rows:
        source.setdefault((r[0], len((r[1] or "").encode().split())), r[3])
    for p in plan:
        s = source[(p["id"], p["size"])]
        taken[s] += p["taken"]
        assert p["source_size"] == sizes[s] and abs(p["target"] - want[s]) < 1e-6
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t), (s, taken[s], t)


def test_mixing_gives_small_sources_their_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SEATS", 16)  # blocks of hundreds of words
    sizes = {"big": 3000, "other": 900, "small": 30, "tiny": 7}
    rows = [(i, " ".join(["w"] * 10), s) for s, n in sizes.items() for i in range(n // 10)] + [(0, "a b c d e f g", "tiny")]
    df = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(df).collect()
    taken = defaultdict(int)
    for p in plan:
        assert 0 <= p["taken"] <= 2 * p["size"] and all(0 <= s["from"] < s["to"] <= p["size"] for s in p["spans"])
        taken[rows[p["id"]][2]] += p["taken"]
    for s, t in expected_targets(sizes).items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)
    assert {r["source"] for r in mixing.mixed_documents(df).select("source").distinct().collect()} == set(sizes)


def test_mixing_apportions_like_sainte_lague(spark):
    rng = np.random.default_rng(4)
    for n in (1, 3, 40):
        sizes = {f"s{i:02}": int(x) for i, x in enumerate(rng.pareto(0.7, n) * 9 + 1)}
        goals = expected_targets(sizes)
        seats = math.ceil(round(sum(goals.values()), 6))
        quotients = sorted(((-t / (2 * k + 1), s) for s, t in goals.items() for k in range(2 * sizes[s])))
        df = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        got = {r["source"]: r["ends"] for r in mixing.quotas(df).collect()}
        assert set(got) == set(sizes)
        for shard in range(mixing.SHARDS):
            first = math.ceil(seats * (shard + 1) / mixing.SHARDS)
            want = Counter(s for _, s in quotients[:first])
            assert sum(e[shard] for e in got.values()) == first and all(abs(got[s][shard] - want[s]) <= 1 for s in sizes)
        assert all(e == sorted(e) for e in got.values())


@pytest.mark.parametrize("block", [1, 100, mixing.BLOCK_WORDS])
def test_shards_of_a_mix_meet_their_quotas(docs, rows, block, monkeypatch):
    """A source that is taken in part gives each shard its quota to the word, whatever the blocks."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", block)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)  # several buckets of documents and of blocks
    # a source of a third of the words and of less than its part is taken in part
    docs = docs.unionByName(docs.sparkSession.createDataFrame([(1000 + i, "one two three", "en", "zz", 1) for i in range(5000)], docs.schema))
    rows = rows + [(1000 + i, "one two three", "en", "zz", 1) for i in range(5000)]
    plan = mixing.mix_plan(docs).collect()
    sizes, source = defaultdict(int), {}
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
        source[r[0], len((r[1] or "").encode().split())] = r[3]
    sizes = {k: v for k, v in sizes.items() if v}
    df = mixing.targets(docs.sparkSession.createDataFrame(list(sizes.items()), "source string, source_size long"))
    ends = {r["source"]: r["ends"] for r in mixing.quotas(df).collect()}
    got, whole = defaultdict(int), set()
    for p in plan:
        s = source[p["id"], p["size"]]
        assert len(p["shards"]) == (p["epochs"] if p["size"] else 0) and all(0 <= h < mixing.SHARDS for h in p["shards"])
        if p["epochs"]:
            whole.add(s)
        for x in p["spans"]:
            got[s, x["shard"]] += x["to"] - x["from"]
    part = [s for s in sizes if s not in whole]
    assert part
    for s in part:
        assert [got[s, h] for h in range(mixing.SHARDS)] == [e - b for e, b in zip(ends[s], [0, *ends[s]])]
    mixed = mixing.mixed_documents(docs, shard_col="shard")
    assert mixed.columns == [*docs.columns, "shard"]
    by = Counter()
    for r in mixed.collect():
        by[r["source"], r["shard"]] += len(r["text"].encode().split())
    assert all(by[s, h] == got[s, h] for s in part for h in range(mixing.SHARDS))


def test_partly_taken_documents_are_in_one_piece_or_few(spark):
    """Blocks don't shrink with the table: of 300 documents, those taken in part are cut into a few spans."""
    rows = [(i, " ".join(f"w{k}" for k in range(40 + 13 * (i % 90))), "big" if i % 3 else "small") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans = [p["spans"] for p in mixing.mix_plan(df).collect() if p["spans"] and p["taken"] % p["size"]]
    assert spans and sum(map(len, spans)) <= 1.5 * len(spans) and max(map(len, spans)) <= 3
    for s in spans:
        assert s == sorted(s) and not any(a["to"] == b["from"] and a["shard"] == b["shard"] for a, b in zip(s, s[1:]))


def test_mixed_documents(clashing, rows):
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == clashing.columns
    plan = mixing.mix_plan(clashing)
    words = mixed.select(F.sum(F.coalesce(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)))).first()[0]
    assert words == plan.agg(F.sum("taken")).first()[0]


def test_mixing_empty(empty):
    assert mixing.mix_plan(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_shards(clashing, rows):
    sized = clashing.withColumn("bytes", F.octet_length("text"))
    got = sharding.shuffle_into_shards(sized, "bytes", shards=8).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["_shard"]].append(r["_slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["_shard"], r["_slot"])) if r["doc_id"] is not None]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3


def test_shards_empty(empty):
    assert sharding.shuffle_into_shards(empty.withColumn("bytes", F.lit(1)), "bytes").count() == 0


def test_shards_keep_columns(clashing):
    df = clashing.withColumn("bytes", F.lit(1))
    got = sharding.shuffle_into_shards(df, "bytes", shards=3)
    assert sorted(got.columns) == sorted(df.columns) and dict(got.dtypes)["_shard"] == "int"
    assert all(r["a.b"] == (f"a.b{r['doc_id']}" if r["doc_id"] is not None else None) for r in got.collect())
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[:, 0] *= 3
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, [1.0] * 3), (405, []), (20, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    got = nearest.nearest(df, df.filter("vec_id % 20 = 0"), k=5).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == list(range(0, 400, 20))
    d = x.astype(float)
    hits = 0
    for q, found in by.items():
        scores = (d * d[q]).sum(axis=1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(400), -scores))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(scores[f[1]] - f[2]) < 1e-9 for f in found)
        hits += len({f[1] for f in found} & set(best))
    assert hits >= 0.9 * 5 * len(by)
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("sample", [300, 20_000])
def test_nearest_in_many_lists(spark, monkeypatch, sample):
    """Rows that the fit never saw: answers come by way of the probed lists alone."""
    monkeypatch.setattr(nearest, "SAMPLE_ROWS", sample)
    rng = np.random.default_rng(7)
    x = (rng.standard_normal((30, 24))[rng.integers(0, 30, 12_000)] + 0.5 * rng.standard_normal((12_000, 24))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = nearest.nearest(df, df.filter("vec_id % 60 = 0"), k=20).toPandas()
    d, hits = x.astype(float), 0
    for q, found in got.groupby("query_id"):
        scores = d @ d[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -scores))[:20]
        assert found["rank"].sort_values().tolist() == list(range(1, 21))
        assert np.allclose(scores[found["vec_id"]], found["score"], atol=1e-9) and q not in set(found["vec_id"])
        hits += len(set(best) & set(found["vec_id"]))
    assert got["query_id"].nunique() == 200 and hits >= 0.9 * 20 * 200


def test_repeated_ids_give_one_result(spark):
    """Of an id with several vectors the smallest counts, however the rows are dealt."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((900, 8)).astype(np.float32).round(1)
    rows = [(i % 450, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [sorted(map(tuple, nearest.nearest(d, d.filter("vec_id % 30 = 0"), k=6).collect())) for d in (df.coalesce(1), df.repartition(5), df.orderBy(F.rand(4)).repartition(3))]
    assert found[0] == found[1] == found[2]
    d = np.array([min(x[i].tolist(), x[i + 450].tolist()) for i in range(450)], dtype=float)
    for q, rank, v, score in found[0]:
        assert abs(d[q] @ d[v] - score) < 1e-9
    assert len(found[0]) == 15 * 6 and len({r[:2] for r in found[0]}) == len({(r[0], r[2]) for r in found[0]}) == 90


def test_nearest_keeps_no_sampled_row_aside(spark):
    """With lists that no query probes there are no answers, whatever the sample holds."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(100)], "vec_id long, embedding array<double>")
    assert nearest.nearest(df, df.filter("vec_id = 1000")).count() == 0
    one = nearest.nearest(df.filter("vec_id < 2"), df.filter("vec_id < 2"), k=20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in one) == [(0, 1, 1), (1, 1, 0)]


def plain_grams(text):
    """Runs of letters and marks, lower-cased, with one blank after each; all runs of four characters."""
    out = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower() + ".")
    out = re.sub(" +", " ", out).lstrip(" ")
    return [out[i : i + 4] for i in range(len(out) - 3)]


def test_filters_against_exact_sets(spark):
    rng = np.random.default_rng(8)
    sounds = {"aa": ["ka", "lo", "mi", "ter"], "bb": ["zu", "pre", "sto", "ka"], "cc": ["é", "lo", "ñu", "x\u0301a"]}
    text = lambda lang: " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(rng.integers(1, 25)))
    rows = [(i, text(lang) if i % 50 else None, lang) for i, lang in enumerate(["aa", "bb", "cc"] * 120)]
    filters = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: Counter(g for r in rows if r[2] == lang for g in plain_grams(r[1])) for lang in sounds}
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    share = lambda lang, g: counts[lang][g] / total[lang]
    sets = {lang: {g for g in c if share(lang, g) >= language_id.LEAST_SHARE and share(lang, g) >= language_id.NEAR * max(share(o, g) for o in sounds)} for lang, c in counts.items()}
    texts = [text(lang) for lang in sounds for _ in range(40)] + ["", "ka 12", None]
    scores, has = filters.scores(texts)
    for t, row, letters in zip(texts, scores, has):
        grams = plain_grams(t)
        exact = [sum(g in sets[lang] for g in grams) / max(1, len(grams)) for lang in filters.languages]
        assert np.allclose(row, exact, atol=0.01) and letters == any(c.isalpha() for c in t or "")


def test_rare_languages_are_learned_whole(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGE_ROWS", 40)
    rows = [(i, "the quick brown fox jumps over the lazy dog", "en") for i in range(600)] + [(600 + i, "žluťoučký kůň úpěl ďábelské ódy", "cs") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["lang"], r["lang_pred"]) for r in language_id.identify(df, language_id.learn(df)).collect()}
    assert got == {("en", "en"), ("cs", "cs")}


def test_language_keeps_columns(clashing, empty):
    filters = language_id.learn(clashing)
    got = language_id.identify(clashing, filters)
    assert sorted(got.columns) == sorted(clashing.columns) and dict(got.dtypes)["score"] == "double"
    kept = language_id.decided(clashing, filters)
    assert kept.columns == clashing.columns and all(r["score"] == (f"score{r['doc_id']}" if r["doc_id"] is not None else None) for r in kept.collect())
    assert language_id.identify(empty, filters).count() == 0 and language_id.identify(empty, language_id.learn(empty)).count() == 0


def test_language(spark, docs):
    rng = np.random.default_rng(3)
    sounds = {"aa": ["ka", "lo", "mi", "ter"], "bb": ["zu", "pre", "sto", "ngi"]}
    text = lambda lang: " ".join("".join(rng.choice(sounds[lang], 3)) for _ in range(30))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.learn(df.filter(~language_id.held_out()))
    got = language_id.identify(df, filters).withColumn("held", language_id.held_out()).collect()
    held = [r for r in got if r["held"]]
    assert held and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = language_id.identify(docs, filters).collect()
    for r in odd:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
    none = language_id.learn(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
