"""Findings of round 3: what grew faster than its input, and where SQL and query said different things."""

import json
import random
import tracemalloc
from datetime import datetime

import duckdb
import pandas as pd
import pytest
import yaml
from pyspark.sql import functions as F

from broadsheet import catalogue, catalogue_more, catalogue_rules
from broadsheet.functions import facts, text
from broadsheet.operators import clusters, findings, ranking
from broadsheet.session import written
from broadsheet.sources import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_fact_rule_makes_only_what_it_looks_at(spark):
    claims = catalogue_more.claims_of(spark, SF)
    asked = findings.factual_findings(claims, ["fact/source-attribution"])
    assert {r["rule_id"] for r in asked.select("rule_id").distinct().collect()} == {"fact/source-attribution"}
    assert "regexp_extract_all" not in plan(catalogue.QUERIES["fact_source_attribution"](spark, SF))
    every = findings.factual_findings(claims).groupBy("rule_id").count().collect()
    alone = {r: findings.factual_findings(claims, [r]).count() for r in findings.FACT_RULES}
    assert {r["rule_id"]: r["count"] for r in every} == {r: n for r, n in alone.items() if n}


def test_a_number_is_brought_to_its_form_once(spark):
    df = spark.createDataFrame([("7,00.50 crore",)], "t string")
    assert plan(df.select(facts.numbers(F.col("t")).alias("x"))).count("regexp_extract_all") == 1
    assert plan(df.select(facts.canonical_number(F.col("t")).alias("x"))).count("regexp_extract(") == 1


@pytest.mark.parametrize("published", [0, 1, 2, 3])
def test_a_rollback_without_an_earlier_edition_says_why(spark, tmp_path, published):
    """The SQL gave no error, and withdrew the only edition."""
    rows = [(k, datetime(2026, 1, 1 + k), "F" if k < published else "O") for k in range(4)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * REPLACE (o_orderdate::TIMESTAMP AS o_orderdate) FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLE["rollback_plan"]).fetchall()
    assert [tuple(r) for r in catalogue.QUERIES["rollback_plan"](spark, str(tmp_path)).collect()] == want
    assert want[0][2] == {0: "no edition to roll back", 1: "only one edition"}.get(published)


def test_hashes_of_long_texts_take_little_memory():
    def plain(t):
        h = 0xCBF29CE484222325
        for b in t.encode("utf-8", "replace"):
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    texts = ["", None, "a", "é" * 50, "x" * 200_000, *(f"text {k}" * (k % 900) for k in range(600))]
    tracemalloc.start()
    got = text.fnv1a64_of(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [None if t is None else plain(t) for t in texts]
    assert peak < 2 * text.HASHED_BYTES


def test_written_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    rows = written(spark.range(1000).select("id", F.repeat(F.lit("word "), 1000).alias("t")), "test-rows")

    def strategy(df):
        return df._jdf.queryExecution().sparkPlan().toString()

    many = rows.select(F.explode(F.split("t", " ")).alias("word"), "id")
    assert "BroadcastHashJoin" not in strategy(spark.range(10).join(many, "id"))
    assert "BroadcastHashJoin" in strategy(spark.range(10).join(F.broadcast(rows.filter("id < 3")), "id"))


@pytest.mark.parametrize("rule", ["diversity/min-publishers", "length/estimated-minutes", "structural/no-markup-in-text", "structural/source-not-after-story-update"])
def test_a_rule_of_a_table_puts_no_documents_together(spark, rule):
    name = "rule_" + rule.replace("/", "_").replace("-", "_")
    got = catalogue.QUERIES[name](spark, SF)
    assert "collect_list(story" not in plan(got)
    whole = findings.Edition(catalogue_rules.editions_of(spark, SF))
    want = next(r for r in findings.EDITION_RULES if r.id == rule).find(whole).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["fact_editorial_alignment", "fact_entity_containment", "fact_number_containment", "rule_length_deck_one_line"])
def test_findings_of_a_row_are_made_once(spark, name):
    assert "(size(" not in "".join(line for line in plan(catalogue.QUERIES[name](spark, SF)).splitlines() if "Filter" in line)


def test_the_driver_never_holds_the_plans_of_all_edition_rules(spark):
    """Findings are written a few rules at a time: what is left is to read them."""
    found = findings.edition_findings(written(catalogue_rules.editions_of(spark, SF), "test-editions"))
    assert not any(step in plan(found) for step in ("Join", "Aggregate", "Generate", "Window"))


def test_json_registries_are_not_read_as_yaml(monkeypatch):
    """PyYAML is slow; what it reads in another way still goes through it."""
    plain, asked = yaml.load, []
    monkeypatch.setattr(yaml, "load", lambda t, loader: asked.append(t) or plain(t, loader))
    read = lambda t: registry.yaml_to_json.func(pd.Series([t]))[0]
    for t in ('{"a":[1,-2.5,true,null,"\\ud83d\\ude00 é"],"b":{"c":"2026-08-01"}}', '{"a": 1, "a": 2}', "[]"):
        assert read(t) == json.dumps(plain(t, yaml.SafeLoader))
    assert asked == []
    for t in ('{"a": 1e5}', '{"a": NaN}', '{"a": {"<<": {"b": 1}}}', "a: 2.5"):
        assert read(t) == json.dumps(plain(t, yaml.SafeLoader))
    assert len(asked) == 4 and read("a: [1") is None and read("") == "null"


def test_titles_of_common_words_are_no_candidates(spark):
    """Pairs that share many words and no bigrams became rows, with the words of both, in the square of the titles."""
    rng = random.Random(5)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(45)]
    rows = [(k, datetime(2026, 1, 1), " ".join(rng.sample(words, 20))) for k in range(200)]
    items = written(clusters.with_tokens(spark.createDataFrame(rows, "node long, published_at timestamp, title string")), "common-words")
    t = {r["node"]: r["tokens"] for r in items.collect()}

    def near(a, b):
        c, g = len(set(a["unigrams"]) & set(b["unigrams"])) / 20, len(set(a["bigrams"]) & set(b["bigrams"])) / 19
        return c >= 0.1 and max(0.9 * c, 0.7 * c + 0.3 * g) >= 0.48

    want = {(a, b) for a in t for b in t if a < b and near(t[a], t[b])}
    got = {(r["a"], r["b"]) for r in clusters.near_candidates(items).collect()}
    assert want <= got and len(got) < len(want) + 0.35 * (200 * 199 / 2 - len(want)), (len(want), len(got))


def test_titles_of_the_same_words_are_compared_once(spark):
    rows = [(k, ["alpha", "beta", "gamma"] if k < 30 else ["alpha", "beta", f"w{k}"] if k < 40 else [f"x{k}"]) for k in range(45)]
    df = spark.createDataFrame(rows, "id long, unigrams array<string>")
    found = ranking.repeated_titles(df, df.withColumnRenamed("id", "title_id"))
    got = sorted((int(r["id"]), int(r["title_id"]), round(r["dice"], 6)) for r in found.collect())
    sim = lambda a, b: 2 * len(set(a) & set(b)) / (len(a) + len(b))
    assert got == sorted((i, j, round(sim(a, b), 6)) for i, a in rows for j, b in rows if sim(a, b) >= 0.45)
