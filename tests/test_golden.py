"""Fifty golden cases made by a rule: ten beats, five clusters each, every trap of which must be caught."""

import json

import pytest
from broadsheet.operators import golden, summarizing

BEATS = [
    ("business-economy", "Reserve Bank", "raises lending target", "crore rupees"), ("science-health-climate", "Space Agency", "tests upper stage engine", "seconds of burn"), ("technology-ai", "Telecom Board", "opens spectrum auction", "megahertz on offer"),
    ("sports", "Hockey Federation", "names touring squad", "players in camp"), ("culture-entertainment", "Film Institute", "restores silent classics", "reels recovered"), ("policy-geopolitics", "Foreign Ministry", "signs ports accord", "berths covered"),
    ("india", "Election Office", "revises voter rolls", "lakh entries checked"), ("world", "Harbour Authority", "reopens northern channel", "ships waiting"), ("business-economy", "Market Regulator", "tightens disclosure norms", "firms affected"), ("science-health-climate", "Weather Bureau", "warns coastal districts", "villages alerted"),
]
PLACES = ["Delhi", "Chennai", "Pune", "Kolkata", "Kochi"]


def cases():
    out = []
    for b, (topic, body, does, unit) in enumerate(BEATS):
        for k, place in enumerate(PLACES):
            n = 110 + 37 * b + 7 * k
            disputed = k == 4
            titles = [f"{body} {does} in {place} with {n} {unit}", f"{body} {does} in {place}, {n + 5 if disputed else n} {unit} counted"]
            said = f"The {body} said on Monday that {n} {unit} were part of the plan in {place}."
            items = [{"ordinal": i, "source_id": s, "guid": f"g{i}", "title": t, "description": said if i == 0 else None, "published_at": f"2026-08-0{i + 3}T06:00:00Z"} for i, (s, t) in enumerate(zip(("first-post", "second-desk"), titles))]
            good = {"headline": titles[0], "deck": f"The {body} gave details in {place}.", "whatChanged": [said], "whyItMatters": "The plan reaches readers across the region.", "background": None, "sourceIds": ["first-post", "second-desk"], "reportingType": "reporting",
                    "uncertainty": "Figures differ across the first reports of this." if disputed else None, "confidence": "disputed" if disputed else "multi-source"}
            traps = [("number", "fact/number-containment", {"headline": titles[0].replace(str(n), str(n * 9 + 1))}), ("entity", "fact/entity-containment", {"deck": f"The {body} met Zorvan Quillby in {place}."}), ("source", "fact/source-attribution", {"sourceIds": ["first-post", "nowhere"]})]
            if disputed:
                traps.append(("settled", "fact/uncertainty-on-conflict", {"uncertainty": "", "confidence": "multi-source"}))
            out.append({"case_id": f"case-{b}-{k}", "topic": topic, "title": titles[0], "items": items, "golden": good, "traps": [{"name": a, "rule": r, "story": s} for a, r, s in traps]})
    return out


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "cases.json"
    path.write_text(json.dumps(cases()))
    return golden.read_cases(spark, str(path))


def test_all_cases_pass_and_all_traps_are_caught(spark, dataset):
    done = golden.evaluate(dataset).cache()
    m = golden.metrics(done)
    assert (m.cases, m.passed, m.traps, m.caught) == (50, 50, 160, 160), golden.report(done)
    assert {getattr(m, f"{n}_rate") for n in ("prompt", "fallback", "golden", "trap", "number", "entity", "attribution", "uncertainty")} == {1.0}
    assert golden.report(done).startswith("# Golden evaluation\n\n50 of 50 cases passed; 160 of 160 traps caught.\n") and "case-" not in golden.report(done)


class Inventing:
    name, model = "inventing", "m"

    def complete(self, prompt, timeout_ms):
        return json.dumps({"headline": "Minister Zorvan Quillby wins 987654 votes", "deck": "A deck for readers here", "whatChanged": [{"sentence": "It changed.", "sourceIds": ["first-post"]}], "whyItMatters": "It matters to readers."})


def test_faults_are_found(spark, dataset):
    """A provider that makes things up fails its cases, a wrong golden story and a trap that is none are told."""
    few = [c for c in cases() if c["case_id"] in ("case-0-0", "case-1-0")]
    few[0]["golden"]["deck"] = "The budget names 4711 new offices."
    few[1]["traps"].append({"name": "harmless", "rule": "fact/number-containment", "story": {"whyItMatters": "The plan reaches some readers."}})
    df = spark.read.schema(golden.CASE).json(spark.sparkContext.parallelize([json.dumps(c) for c in few]))
    by = {r["case_id"]: r for r in golden.evaluate(df).collect()}
    assert by["case-0-0"]["blocking"] == ["golden fact/number-containment"] and not by["case-0-0"]["golden_ok"] and by["case-0-0"]["fallback_ok"]
    assert by["case-1-0"]["missed"] == ["harmless"] and by["case-1-0"]["caught"] == 3 and not by["case-1-0"]["passed"]
    told = golden.evaluate(df, Inventing(), summarizing.Patience(retries=0))
    assert not any(r["fallback_ok"] for r in told.collect()) and golden.metrics(told).fallback_rate == 0.0
    assert "- case-1-0: " in golden.report(told) and "missed harmless" in golden.report(told)
    assert golden.metrics(golden.evaluate(df.limit(0))).trap_rate == 1.0
