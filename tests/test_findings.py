import copy
import json

import pytest
from broadsheet.operators import findings, lifecycle
from broadsheet.sources import documents
from pyspark.sql import functions as F

RULES = {r.id: r.severity for r in findings.EDITION_RULES}
TOPICS = ["india", "world", "business-economy", "sports", "technology-ai", "policy-geopolitics", "culture-entertainment", "science-health-climate"]


def base():
    """An edition without findings: eight core stories and two pooled ones, each with a source of its own."""
    words = ["harbour", "orchard", "library", "railway", "granite", "meadow", "lantern", "compass", "violin", "glacier"]
    stories, sources = [], []
    for i, w in enumerate(words):
        topic = TOPICS[i] if i < 8 else ("sports" if i == 8 else "technology-ai")
        stories.append({
            "id": f"s-{w}", "slug": f"{w}-{i}", "topic": topic, "reportingType": "reporting", "headline": f"The {w} and {w}ing", "deck": f"All of {w}ed", "whatChanged": [f"What {w} changed"],
            "whyItMatters": f"Why {w} matters", "sourceIds": [f"src-{w}"], "sourceCount": 1, "confidence": "single-source", "firstPublishedAt": "2026-08-01T00:00:00Z", "updatedAt": "2026-08-02T00:00:00Z", "reviewed": True,
        })
        sources.append({"id": f"src-{w}", "publisher": f"Pub {i}", "title": f"T {w}", "url": f"https://news{i}.in/a", "sourceType": "publisher", "publishedAt": "2026-08-01T00:00:00Z"})
    return {
        "schemaVersion": 1, "date": "2026-08-02", "editionVersion": 1, "status": "published", "publishedAt": "2026-08-02T00:00:00Z", "updatedAt": "2026-08-02T01:00:00Z", "estimatedMinutes": 1,
        "coreStoryIds": [s["id"] for s in stories[:8]], "interestPools": {"sports": ["s-violin"], "technology-ai": ["s-glacier"]}, "stories": stories, "sources": sources, "correctionNotes": [],
    }


def _note(e, **more):
    e["correctionNotes"] = [{"id": "n", "storyId": "s-harbour", "correctedAt": "2026-08-02T00:30:00Z", "editionVersion": 2, "summary": "s"} | more]
    e["status"], e["editionVersion"] = "corrected", 2
    e["stories"][0]["updatedAt"] = "2026-08-02T00:45:00Z"


def _set(e, i, **fields):
    e["stories"][i].update(fields)


def _hosts(e, hosts):
    for s, h in zip(e["sources"], hosts):
        s["url"] = f"https://{h}/a"


def _double(e):
    for i in (0, 1):
        _set(e, i, sourceIds=["src-harbour", "src-orchard"], sourceCount=2, confidence="multi-source")


BREAKS = {
    "structural/duplicate-slug": lambda e: _set(e, 1, slug="harbour-0"),
    "structural/unreviewed-story-gate": lambda e: _set(e, 1, reviewed=False),
    "structural/source-not-after-story-update": lambda e: e["sources"][0].update(publishedAt="2026-09-01T00:00:00Z"),
    "structural/generated-provenance-pair": lambda e: _set(e, 0, generatedBy="x"),
    "structural/no-markup-in-text": lambda e: _set(e, 0, deck="A <b>deck</b>"),
    "structural/disputed-requires-uncertainty": lambda e: _set(e, 0, confidence="disputed"),
    "structural/official-source-only-needs-official-label": lambda e: e["sources"][0].update(sourceType="official"),
    "diversity/min-publishers": lambda e: [s.update(publisher="One") for s in e["sources"][:6]],
    "diversity/publisher-primary-cap": lambda e: [s.update(publisher="One") for s in e["sources"][:3]],
    "diversity/publisher-concentration": lambda e: [s.update(publisher="One") for s in e["sources"][:3]],
    "diversity/topic-cap": lambda e: [_set(e, i, topic="india") for i in range(4)],
    "diversity/all-hard-news": lambda e: [_set(e, i, headline=f"{e['stories'][i]['headline']} war") for i in range(8)],
    "duplicate/shared-source-majority": _double,
    "duplicate/shared-source": _double,
    "duplicate/headline-similarity": lambda e: _set(e, 1, headline=e["stories"][0]["headline"], deck=e["stories"][0]["deck"]),
    "duplicate/slug-similarity": lambda e: (_set(e, 0, slug="one-two-three"), _set(e, 1, slug="one-two-four")),
    "length/estimated-minutes": lambda e: e.update(estimatedMinutes=9),
    "length/deck-one-line": lambda e: _set(e, 0, deck="word " * 31),
    "length/what-changed-paragraph-words": lambda e: _set(e, 0, whatChanged=["word " * 91]),
    "length/why-it-matters-one-paragraph": lambda e: _set(e, 0, whyItMatters="word " * 81),
    "url/no-credentials": lambda e: e["sources"][0].update(url="https://u:p@news.in/a"),
    "url/no-ip-literal": lambda e: e["sources"][0].update(url="https://10.0.0.1/a"),
    "url/no-private-host": lambda e: e["sources"][0].update(url="https://a.internal/a"),
    "url/mixed-host-classes": lambda e: _hosts(e, ["x.example"]),
    "url/sample-data-hosts": lambda e: _hosts(e, [f"n{i}.example" for i in range(10)]),
    "url/https-only": lambda e: e["sources"][0].update(url="http://news0.in/a"),
    "correction/status-requires-note": lambda e: e.update(status="corrected"),
    "correction/version-requires-note": lambda e: e.update(editionVersion=2),
    "correction/corrected-after-published": lambda e: _note(e, correctedAt="2026-08-01T00:00:00Z"),
    "correction/corrected-within-updated": lambda e: _note(e, correctedAt="2026-08-05T00:00:00Z"),
    "correction/story-reflects-correction": lambda e: (_note(e), _set(e, 0, updatedAt="2026-08-02T00:10:00Z")),
}


def editions(spark, docs):
    rows = [(name, json.dumps(doc)) for name, doc in docs.items()]
    return spark.createDataFrame(rows, "file string, value string").select("file", F.from_json("value", findings.EDITION).alias("e")).select("file", "e.*")


def test_the_rules_are_these():
    assert len(RULES) == 31 and sum(s == "blocking" for s in RULES.values()) == 22
    assert set(BREAKS) == set(RULES)


def test_each_rule_fires_and_a_clean_edition_has_none(spark):
    docs = {"clean/2026-08-02.json": base()}
    for rule, spoil in BREAKS.items():
        doc = copy.deepcopy(base())
        spoil(doc)
        docs[f"{rule}/2026-08-02.json"] = doc
    df = editions(spark, docs).cache()
    found = findings.edition_findings(df).collect()
    by = {}
    for r in found:
        by.setdefault(r["file"], {}).setdefault(r["rule_id"], set()).add(r["severity"])
    assert "clean/2026-08-02.json" not in by
    for rule, severity in RULES.items():
        assert by.get(f"{rule}/2026-08-02.json", {}).get(rule) == {severity}, (rule, by.get(f"{rule}/2026-08-02.json"))
    reports = findings.report(df, findings.edition_findings(df)).collect()
    assert {r["file"]: r["publishable"] for r in reports}["clean/2026-08-02.json"]
    assert not {r["file"]: r["publishable"] for r in reports}["url/sample-data-hosts/2026-08-02.json"]
    df.unpersist()


@pytest.mark.parametrize("check, spoil", [
    ("eight-core-stories", lambda e: e["coreStoryIds"].pop()), ("citation-unresolved", lambda e: e["sources"].pop(0)), ("repeated-story-id", lambda e: _set(e, 1, id="s-harbour")), ("pool-topic", lambda e: _set(e, 8, topic="india")),
    ("published-unreviewed", lambda e: _set(e, 0, reviewed=False)), ("orphan-story", lambda e: e["interestPools"].pop("sports")), ("updated-before-published", lambda e: e.update(updatedAt="2026-08-01T00:00:00Z")),
])
def test_form(spark, check, spoil):
    doc = base()
    spoil(doc)
    got = findings.schema_findings(findings.Edition(editions(spark, {"f.json": doc}))).collect()
    assert check in {r["detail"] for r in got}


def test_publish_correct_withdraw(spark):
    draft = base() | {"status": "draft"}
    for s in draft["stories"]:
        s["reviewed"] = False
    published = lifecycle.publish(editions(spark, {"f": draft}), "2026-08-02T02:00:00Z")
    row = published.first()
    assert row["status"] == "published" and all(s["reviewed"] for s in row["stories"])
    fix = spark.createDataFrame([("2026-08-02", "s-harbour", "wrong name", None, "A new headline of the day")], "date string, storyId string, summary string, detail string, headline string")
    fixed = lifecycle.correct(published, fix, "2026-08-03T00:00:00Z").first()
    assert fixed["editionVersion"] == 2 and fixed["correctionNotes"][0]["id"] == "corr-s-harbour-v2" and fixed["stories"][0]["headline"] == "A new headline of the day"
    with pytest.raises(Exception, match="not a clean first draft"):
        lifecycle.publish(published, "2026-08-02T02:00:00Z").collect()
    with pytest.raises(Exception, match="can't be corrected"):
        lifecycle.correct(editions(spark, {"f": draft}), fix, "2026-08-03T00:00:00Z").collect()


def test_documents(spark, tmp_path):
    (tmp_path / "2026-08-02.json").write_text(json.dumps(base()))
    (tmp_path / "bad.json").write_text("{not json")
    read = documents.read_editions(spark, str(tmp_path))
    assert {r["file"]: r["corrupt"] is not None for r in read.collect()} == {"2026-08-02.json": False, "bad.json": True}
    assert documents.json_findings(read).first()["rule_id"] == "edition/file-json"
    assert findings.exit_code(findings.report(read.limit(0), findings.edition_findings(read.limit(0)))) == 3
    documents.write_editions(read.filter("corrupt is null").drop("corrupt"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_registry(spark):
    rows = [
        {"id": "a", "feedUrl": "https://www.n.in/feed/", "active": True, "permittedUse": "same note", "permittedUses": ["headline"]}, {"id": "b", "feedUrl": "https://n.in/feed", "active": True, "permittedUse": "same note"},
        {"id": "c", "feedUrl": "https://10.0.0.1/f", "active": True}, {"id": "d", "feedUrl": "https://x.example/f", "active": True}, {"id": "e", "feedUrl": "https://real.in/f", "sample": True}, {"id": "f", "feedUrl": "https://a.local/f"},
    ]
    registry = documents.registry_table(spark, rows)
    found = {(r["rule_id"], r["source_id"]) for r in findings.registry_findings(registry).collect()}
    assert {("url/no-address-literal", "c"), ("sample/reserved-host-only", "d"), ("sample/reserved-host-required", "e"), ("url/no-private-host", "f"), ("url/mixed-host-classes", None), ("duplicate/near-feed-url", "a"), ("duplicate/permitted-use-note", "a")} == found
    local = findings.registry_findings(registry).filter("source_id is not null")
    assert {r["source_id"] for r in findings.fetchable(registry, local).collect()} == {"a", "b"}
    assert findings.fetchable(registry, findings.registry_findings(registry)).count() == 0
    with pytest.raises(ValueError):
        documents.registry_table(spark, [{"id": "a", "surprise": 1}])


def test_facts_must_be_in_the_cluster(spark):
    item = "struct<source_id:string,title:string,description:string,published_at:timestamp>"
    schema = f"story_id string, headline string, deck string, whatChanged array<string>, whyItMatters string, background string, uncertainty string, sourceIds array<string>, reportingType string, confidence string, sources array<string>, items array<{item}>"
    src = [("a-b", "ISRO launches 5 satellites", "The Supreme Court said 1,000 on 2026-08-01.", None)]
    ok = ("ok", "ISRO launches 5 satellites", "d", ["The Supreme Court said 1000"], "w", None, None, ["a-b"], "reporting", "single-source", ["a-b"], src)
    bad = ("bad", "NASA launches 7 satellites", "d", ["On Monday in New York"], "w", None, None, ["zz"], "reporting", "single-source", ["a-b"], src)
    clash = ("clash", "ISRO launches satellites", "d", [], "w", None, None, ["a-b"], "reporting", "single-source", ["a-b"], [*src, ("c", "Opinion: ISRO launches 6 satellites", "", None)])
    opinion = ("opinion", "view", "d", [], "w", None, None, ["a-b"], "reporting", "single-source", ["a-b"], [("a-b", "Opinion: a view", "", None)])
    stories = spark.createDataFrame([ok, bad, clash, opinion], schema)
    found = findings.factual_findings(stories)
    got = {(r["story_id"], r["rule_id"]) for r in found.collect()}
    assert got == {("bad", "fact/number-containment"), ("bad", "fact/entity-containment"), ("bad", "fact/date-containment"), ("bad", "fact/source-attribution"), ("clash", "fact/uncertainty-on-conflict"), ("opinion", "fact/editorial-alignment")}
    metrics = {r["story_id"]: r for r in findings.factual_metrics(stories, found).collect()}
    assert metrics["ok"]["attribution_score"] == 1 and metrics["bad"]["attribution_score"] == 0 and metrics["bad"]["blocking"] == 3


def test_health(spark):
    fetches = spark.createDataFrame([("a", "success", 10), ("b", "success", 9000), ("c", "failure", 1), ("d", "success", 1), ("e", "not-modified", 1)], "source_id string, kind string, duration_ms long")
    latest = spark.sql("select * from values ('a', 3L, timestamp '2026-08-01 00:00:00'), ('b', 1L, timestamp '2026-07-01 00:00:00'), ('e', 0L, null) as t(source_id, n_items, latest_at)")
    got = findings.source_health(fetches, latest, F.lit("2026-08-02 00:00:00").cast("timestamp"))
    assert {r["source_id"]: (r["status"], tuple(r["warnings"])) for r in got.collect()} == {"a": ("healthy", ()), "b": ("warning", ("latency/high", "staleness/old")), "c": ("failing", ("fetch/failed",)), "d": ("warning", ("items/empty",)), "e": ("healthy", ())}
    assert tuple(findings.health_rollup(got).first()) == (2, 2, 1)
