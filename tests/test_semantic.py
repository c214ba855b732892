import random
from datetime import datetime, timedelta

import pytest
from broadsheet.functions import constants as K
from broadsheet.operators import clusters, semantic
from pyspark.sql import functions as F

START = datetime(2026, 8, 1)


class ByTitle:
    """Says yes to titles of one letter, with a confidence that both views decide; fails for some."""

    name = "by-title"

    def __init__(self, grows: bool) -> None:
        self.grows = grows

    def evaluate(self, a, b):
        n = sum(map(ord, a["id"] + b["id"]))
        if n % 11 == 0:
            raise TimeoutError("no answer")
        if n % 13 == 0:
            return True, float("nan"), None
        size = a["n"] if self.grows else 0
        return a["word"] == b["word"], 0.7 + ((n + 3 * size) % 30) / 100, f"{a['id']} and {b['id']}"


def plain(rows, provider):
    """The loop itself: rows (id, word, size, hours) in order; [(leader, into, confidence)] in the order of merging."""
    state = {r["id"]: {"id": r["id"], "word": r["word"], "n": r["size"]} for r in rows}
    gone, out = set(), []
    for x, r in enumerate(rows):
        if r["id"] in gone:
            continue
        for other in rows[x + 1 :]:
            if other["id"] in gone or state[r["id"]]["n"] + other["size"] > K.CLUSTER_SIZE:
                continue
            if None not in (r["at"], other["at"]) and abs(r["at"] - other["at"]) > timedelta(hours=K.CLUSTER_HOURS):
                continue
            try:
                yes, confidence, _ = provider.evaluate(state[r["id"]], state[other["id"]])
            except TimeoutError:
                continue
            if yes and confidence >= K.SEMANTIC_FLOOR:
                gone.add(other["id"])
                state[r["id"]]["n"] += other["size"]
                out.append((other["leader"], r["leader"], confidence))
    return out


@pytest.mark.parametrize("grows,seed", [(False, 1), (False, 2), (True, 3)])
def test_absorptions_equal_a_plain_loop(spark, grows, seed, monkeypatch):
    monkeypatch.setattr(semantic, "STRIDE", 4)
    rng = random.Random(seed)
    rows = [{"leader": i, "id": f"c{i:03}", "word": rng.choice("abcdefgh"), "size": rng.choice([1, 1, 2, 5, 9, 20]), "at": START + timedelta(hours=rng.randint(0, 300)) if rng.random() < 0.95 else None, "sources": rng.randint(1, 3)} for i in range(70)]
    rows.sort(key=lambda r: (r["at"] is None, -(r["at"] or START).timestamp(), -r["sources"], r["id"]))
    provider = ByTitle(grows)
    df = spark.createDataFrame(rows, "leader long, id string, word string, size int, at timestamp, sources int").repartition(4)
    found = df.select("leader", F.col("at").alias("primary_at"), "size", semantic.order_key(F.col("at"), F.col("sources"), F.col("id")).alias("key"))
    view = lambda d: d.select("leader", F.struct("id", "word", F.col("size").alias("n")).alias("view"))
    by = {r["leader"]: r for r in rows}

    def grown(taken):
        size = {}
        for t in taken.collect():
            size[t["into"]] = size.get(t["into"], by[t["into"]]["size"]) + by[t["leader"]]["size"]
        return view(spark.createDataFrame([by[i] | {"size": n} for i, n in size.items()], df.schema))

    pairs = semantic.window_pairs(found)
    assert pairs.count() == pairs.distinct().count() == sum(None in (a["at"], b["at"]) or abs(a["at"] - b["at"]) <= timedelta(hours=K.CLUSTER_HOURS) for k, a in enumerate(rows) for b in rows[:k])
    got = semantic.absorptions(found, pairs, provider, view(df), grown=grown if grows else None).orderBy("place").collect()
    want = plain(rows, provider)
    assert {(r["leader"], r["into"], round(r["confidence"], 9)) for r in got} == {(a, b, round(c, 9)) for a, b, c in want} and len(want) > 8
    for into in {b for _, b, _ in want}:
        assert [r["leader"] for r in got if r["into"] == into] == [a for a, b, _ in want if b == into]


ITEMS = "source_id string, item_ordinal long, guid string, title string, description string, url string, published_at timestamp, content_hash string"


class Says:
    def __init__(self, confidence, fails=False):
        self.name, self.confidence, self.fails = "says", confidence, fails

    def evaluate(self, a, b):
        if self.fails:
            raise RuntimeError("rate limit")
        assert a["item_count"] == len(a["titles"]) and a["representative_title"] in a["titles"]
        return True, self.confidence, "one line"


@pytest.fixture
def tram(spark):
    rows = [("gazette", 0, "g-1", "Council opens second tram line to harbour", "x", "https://n.in/1", START, "h1"), ("courier", 1, "c-1", "Streetcar service now reaches the docks", "y", "https://n.in/2", START + timedelta(hours=1), "h2"),
            ("courier", 2, "c-2", "Orchestra plays its hundredth season", "z", "https://n.in/3", START + timedelta(hours=100), "h3")]
    return clusters.cluster_items(spark.createDataFrame(rows, ITEMS))


def test_a_sure_provider_merges_within_the_window(spark, tram):
    got = clusters.clusters(semantic.semantic_merge(tram, Says(0.9))).orderBy("item_count").collect()
    assert [r["item_count"] for r in got] == [1, 2]
    assert got[1]["confidence_score"] == 0.9 and got[1]["primary_source_id"] == "courier" and got[1]["sources"] == ["courier", "gazette"]
    assert {(r["merge_reason"], r["join_ordinal"]) for r in semantic.semantic_merge(tram, Says(0.9)).collect()} == {(None, 0), ("semantic", 1)}


@pytest.mark.parametrize("provider", [Says(0.79), Says(float("nan")), Says(0.9, fails=True), semantic.NoMerges()])
def test_unsure_failing_and_absent_providers_merge_nothing(spark, tram, provider):
    assert clusters.clusters(semantic.semantic_merge(tram, provider)).count() == 3


def test_pairs_that_are_given_are_the_only_ones_asked_about(spark, tram):
    none = spark.createDataFrame([], "a long, b long")
    assert clusters.clusters(semantic.semantic_merge(tram, Says(0.9), pairs=none)).count() == 3
    assert semantic.semantic_merge(tram.limit(0), Says(0.9)).count() == 0
