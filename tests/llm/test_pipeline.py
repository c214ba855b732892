import re
from collections import Counter

import corpus_pipeline
from broadsheet.llm import language_id, packing
from pyspark.sql import functions as F
from tests.llm.test_dedup import norm, shingle_set


def run(spark, docs):
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None).cache()
        stages[name] = docs
    return stages


def test_stages(spark, docs, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "packing"]
    stages = run(spark, docs)
    for name in list(stages)[:-1]:
        assert stages[name].columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in stages["language_id"].collect())
    # the texts are letters with digits: what has no letters goes, what is short or known stays
    assert not any(t is None or not re.search(r"[^\W\d_]", t) for _, t in kept)
    first = Counter((r["doc_id"], r["text"]) for r in stages["exact_dedup"].collect())
    assert len({norm(t) for _, t in kept}) == first.total() == len({norm(t) for _, t in first})
    near = [(r["doc_id"], r["text"]) for r in stages["jaccard_join"].collect()]
    sets = [shingle_set(t) for _, t in near]
    for i, a in enumerate(sets):
        assert not any(100 * len(a & b) >= 80 * len(a | b) for b in sets[:i] if a and b)
    for _, text in first:
        s = shingle_set(text)
        assert not s or any(len(s & t) for t in sets) or (None, text) in near
    mixed = stages["mixing"].collect()
    assert {r["doc_id"] for r in mixed} <= {i for i, _ in near}
    assert all(r["n_chars"] == len(r["text"]) for r in mixed)
    pieces = stages["packing"].collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r["doc_id"] for r in mixed)
    by = {}
    for r in pieces:
        by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + r["length"]
    assert max(by.values()) <= packing.ROOM
    for df in stages.values():
        df.unpersist()


def test_clean_texts_of_a_rare_language_stay(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGE_ROWS", 40)
    rows = [(i, "the quick brown fox jumps over the lazy dog", "en", "a", 1) for i in range(400)]
    rows += [(400 + i, "žluťoučký kůň úpěl ďábelské ódy", "cs", "a", 1) for i in range(2)] + [(500, "12345 67890 12345 67890 ab 123", "en", "a", 1), (501, "12 34 !!", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, None).collect()}
    assert kept == {r[0] for r in rows} - {501}


def test_stages_keep_columns(spark, clashing):
    """Extra columns pass through unharmed, whatever their names."""
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, None).cache()
        assert docs.columns == clashing.columns, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in docs.filter("doc_id IS NOT NULL").collect() for c in ("score", "a.b", "_shard", "taken"))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() >= docs.count()


def test_empty(spark, empty):
    stages = run(spark, empty)
    assert all(df.count() == 0 for df in stages.values())


def test_run_is_a_query(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    df = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert df.agg(F.sum("length")).first()[0] > 0
