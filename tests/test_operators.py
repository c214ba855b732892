import random
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from broadsheet.functions import constants as K
from broadsheet.functions import similarity
from broadsheet.operators import clusters, items, lifecycle, ranking, reader, summaries
from broadsheet.operators.blocks import blocks
from pyspark.sql import functions as F

RAW = "source_id string, item_ordinal long, guid string, title string, author string, description string, link string, published_at string, updated_at string"


def test_normalize_and_dedup(spark):
    rows = [
        ("s", 0, "g1", "A <b>title</b>", None, "text", "https://n.in/a?utm_x=1", "2026-08-01", None),
        ("s", 1, "g1", "Other", None, "x", "https://n.in/b", None, None),
        ("s", 2, "g2", "Third", None, "y", "https://n.in/b#f", None, None),
        ("s", 3, None, "No link", None, "z", None, None, None), ("s", 4, None, "no link", None, "z", None, None, None), ("t", 0, "g1", "A title", None, "text", None, None, None),
    ]
    normal = items.normalize_items(spark.createDataFrame(rows, RAW))
    got = {(r["source_id"], r["item_ordinal"]): r for r in items.dedup_first_wins(normal).collect()}
    assert got["s", 0]["title"] == "A title" and got["s", 0]["url"] == "https://n.in/a"
    assert [got["s", i]["kept"] for i in range(5)] == [True, False, True, True, False] and got["t", 0]["kept"]
    assert got["s", 3]["guid"].startswith("content-")
    with pytest.raises(ValueError):
        items.normalize_items(spark.createDataFrame(rows, RAW), title_cap=-1)


def test_blocks(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)]
    root = {i: i for i in range(460)}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = blocks(spark.range(460).select(F.col("id").alias("node")), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["block"] for r in got} == {i: find(i) for i in range(460)}


@pytest.fixture
def news(spark):
    rng = random.Random(7)
    topics = ["isro launches navic satellite orbit", "rbi keeps repo rate unchanged inflation", "cyclone hits odisha coast evacuation begins", "supreme court hears privacy petition today", "india wins cricket final against australia"]
    start, rows = datetime(2026, 8, 1), []
    for i in range(140):
        words = rng.choice(topics).split()
        rng.shuffle(words) if rng.random() < 0.2 else None
        words = [w if rng.random() < 0.85 else rng.choice(["report", "officials", "minister", "centre"]) for w in words]
        title = " ".join(words) + rng.choice(["", " 5", " 7", " - NDTV", ""])
        url = f"https://n.in/{rng.randint(0, 90)}" if rng.random() < 0.4 else None
        at = start + timedelta(hours=rng.randint(0, 240)) if rng.random() < 0.9 else None
        rows.append((f"s{rng.randint(0, 6)}", i, f"g{rng.randint(0, 100)}", title if rng.random() < 0.97 else "…", f"text {rng.randint(0, 100)}", url, at, f"{rng.randint(0, 120):016x}"))
    return spark.createDataFrame(rows, "source_id string, item_ordinal long, guid string, title string, description string, url string, published_at timestamp, content_hash string")


def members(df):
    out = defaultdict(list)
    for r in clusters.cluster_items(df).collect():
        out[r["leader"]].append((r["join_ordinal"], r["item_ordinal"], round(r["join_score"], 9)))
    return sorted(tuple(sorted(v)) for v in out.values())


def plain_clusters(rows):
    """One pass over all items in their order, looking at every cluster for each: leader of each node, in join order."""
    found = []
    for r in rows:
        item = {"node": r["node"], "url": r["url"], "hash": r["content_hash"], "source": r["source_id"], "guid": r["guid"], "at": r["at"]}
        item |= {"u": frozenset(r["unigrams"]), "b": frozenset(r["bigrams"]), "n": frozenset(r["numbers"])}
        best = None
        for members in found:
            lead = members[0][0]
            if len(members) >= K.CLUSTER_SIZE or None not in (item["at"], lead["at"]) and abs(item["at"] - lead["at"]) > K.CLUSTER_HOURS * 3600000:
                continue
            if any(clusters._same(item, m) for m, _ in members):
                members.append((item, 1.0))
                break
            scores = [clusters._similarity(item, m) for m, _ in members]
            near = scores[0][0] >= K.NEAR_SCORE and len(item["u"] & lead["u"]) >= min(K.NEAR_TOKENS, len(item["u"]), len(lead["u"]))
            if near and not any(c for _, c in scores) and min(s for s, _ in scores) >= K.MEMBER_FLOOR and (best is None or scores[0][0] > best[0]):
                best = (scores[0][0], members)
        else:
            if best:
                best[1].append((item, best[0]))
            else:
                found.append([(item, 1.0)])
    return found


@pytest.mark.parametrize("rows_of_a_slice", [5000, 9, 2])
def test_clusters_equal_a_sequential_run(spark, news, rows_of_a_slice, monkeypatch):
    """Blocks and slices give what one pass over all items gives, whatever the order and dealing of the rows."""
    monkeypatch.setattr(clusters, "FOLD_ROWS", rows_of_a_slice)
    nodes = clusters.with_tokens(news.withColumn("node", F.xxhash64("source_id", "guid", "content_hash", "item_ordinal")))
    order = [F.asc_nulls_last("published_at"), "source_id", "guid", "content_hash", "node"]
    flat = nodes.orderBy(*order).select("node", "item_ordinal", "url", "content_hash", "source_id", "guid", F.unix_millis("published_at").alias("at"), "tokens.unigrams", "tokens.bigrams", "tokens.numbers").collect()
    ordinal = {r["node"]: r["item_ordinal"] for r in flat}
    want = sorted(tuple((k, ordinal[m["node"]], round(s, 9)) for k, (m, s) in enumerate(c)) for c in plain_clusters(flat))
    assert members(news) == want
    assert members(news.orderBy(F.rand(3)).repartition(7)) == want
    assert any(len(c) > 2 for c in want)


def test_a_hot_story_is_many_tasks(spark, monkeypatch):
    """Thousands of variations of one title: each slice is a task of its own and only open clusters go on."""
    monkeypatch.setattr(clusters, "FOLD_ROWS", 400)
    rng = random.Random(3)
    words = "isro launches navic satellite orbit successfully from sriharikota today".split()
    rows = [(f"s{i % 5}", i, f"g{i}", " ".join(rng.sample(words, 7)) + rng.choice(["", "", " 5", " 7"]), None, datetime(2026, 8, 1) + timedelta(minutes=7 * i), f"{i:016x}") for i in range(2000)]
    df = spark.createDataFrame(rows, "source_id string, item_ordinal long, guid string, title string, url string, published_at timestamp, content_hash string").repartition(5)
    nodes = clusters.with_tokens(df.withColumn("node", F.xxhash64("source_id", "guid", "content_hash", "item_ordinal")))
    flat = nodes.orderBy("published_at").select("node", "item_ordinal", "url", "content_hash", "source_id", "guid", F.unix_millis("published_at").alias("at"), "tokens.unigrams", "tokens.bigrams", "tokens.numbers").collect()
    ready = clusters._sliced(nodes, spark.createDataFrame([(r["node"], 1) for r in flat], "node long, block long"))
    assert {r["slice"]: r["count"] for r in ready.groupBy("slice").count().collect()} == {k: 400 for k in range(5)}
    leader = {m["node"]: c[0][0]["node"] for c in plain_clusters(flat) for m, _ in c}
    assert {r["node"]: r["leader"] for r in clusters._folded(ready).collect()} == leader
    assert 60 < len(set(leader.values())) < 700


def test_first_wins_against_a_plain_fold(spark):
    """Chains and hot keys: keys of a dropped item aren't recorded, so what it alone shares with a later one counts not."""
    rng = random.Random(11)
    rows = [(s, i, f"g{rng.randint(0, 60)}", None if rng.random() < 0.5 else f"u{rng.randint(0, 40)}", f"h{rng.randint(0, 50)}") for s in ("a", "b") for i in range(200)]
    rows += [("c", i, f"c{i}", f"d{i // 2}", "") for i in range(60)] + [("c", 100 + i, "hot", f"x{i}", "") for i in range(80)]
    rows += [("d", i, f"k{i // 2}", f"l{(i + 1) // 2}", "") for i in range(40)]  # a chain: every other item is kept
    want, seen = {}, set()
    for s, i, guid, url, h in sorted(rows):
        keys = {(s, "guid", guid), (s, "url", url) if url else (s, "hash", h)}
        want[s, i] = not keys & seen
        seen |= keys if want[s, i] else set()
    df = spark.createDataFrame(rows, "source_id string, item_ordinal long, guid string, url string, content_hash string").repartition(6)
    assert {(r["source_id"], r["item_ordinal"]): r["kept"] for r in items.dedup_first_wins(df).collect()} == want


def test_similarity_is_the_same_in_python(spark, news):
    t = clusters.with_tokens(news).select("item_ordinal", F.struct("tokens.unigrams", "tokens.bigrams", "tokens.numbers").alias("t")).limit(60)
    pairs = t.alias("a").join(t.alias("b"), F.col("a.item_ordinal") < F.col("b.item_ordinal")).select(F.col("a.t").alias("a"), F.col("b.t").alias("b"))
    plain = lambda t: {"u": frozenset(t["unigrams"]), "b": frozenset(t["bigrams"]), "n": frozenset(t["numbers"])}
    for r in pairs.select("a", "b", similarity.title_similarity(F.col("a"), F.col("b")).alias("s"), similarity.numeric_conflict(F.col("a.numbers"), F.col("b.numbers")).alias("c")).collect():
        score, conflict = clusters._similarity(plain(r["a"]), plain(r["b"]))
        assert abs(score - r["s"]) < 1e-12 and conflict == r["c"]


def test_copies_of_a_title_make_few_links(spark):
    """Thousands of items of one title: links in proportion, clusters of the greatest size in order."""
    rows = [(f"s{i % 3}", i, f"g{i}", "isro launches navic satellite orbit", None, datetime(2026, 8, 1) + timedelta(minutes=i % 600), f"{i:016x}") for i in range(3000)]
    df = spark.createDataFrame(rows, "source_id string, item_ordinal long, guid string, title string, url string, published_at timestamp, content_hash string")
    nodes = clusters.with_tokens(df.withColumn("node", F.col("item_ordinal")))
    assert clusters.near_links(nodes).count() < 3100
    sizes = clusters.cluster_items(df).groupBy("leader").count().collect()
    assert len(sizes) == 3000 // K.CLUSTER_SIZE and {r["count"] for r in sizes} == {K.CLUSTER_SIZE}


@pytest.mark.parametrize("kind", ["news", "sizes"])
def test_near_pairs_lose_none(spark, news, kind):
    """Titles of one word to hundreds, with and without repeats, parts of each other: every near pair is found."""
    if kind == "sizes":
        rng = random.Random(12)
        titles = []
        for _ in range(130):
            base = [f"w{min(int(rng.paretovariate(0.7)), 60)}x" for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 30, 120, 300]))]
            titles += [base, base[: rng.randint(1, len(base))] + [f"n{rng.randint(0, 5)}e"] * rng.randint(0, 2)]
        rows = [("s", i, f"g{i}", " ".join(t), "", None, datetime(2026, 8, 1) + timedelta(hours=rng.randint(0, 60)), f"{i:016x}") for i, t in enumerate(titles)]
        news = spark.createDataFrame(rows, news.schema)
    nodes = clusters.with_tokens(news.withColumn("node", F.col("item_ordinal")))
    every = nodes.select(F.col("node").alias("a")).crossJoin(nodes.select(F.col("node").alias("b"))).filter("a < b")
    want = {(r["a"], r["b"]) for r in clusters.classified_pairs(nodes, every).filter("match.match_type = 'near'").collect()}
    got = {(r["a"], r["b"]) for r in clusters.near_pairs(nodes).collect()}
    bare = {r["node"] for r in nodes.filter(F.size("tokens.unigrams") == 0).collect()}
    assert {p for p in want if not set(p) <= bare} == {p for p in got if not set(p) <= bare}


def test_cluster_table(spark, news):
    got = clusters.clusters(clusters.cluster_items(news)).collect()
    assert sum(r["item_count"] for r in got) == news.count()
    assert all(r["cluster_id"].startswith("cluster-") and 0 < r["confidence_score"] <= 1 and r["source_count"] == len(r["sources"]) for r in got)


def test_features(spark):
    df = spark.createDataFrame([(datetime(2026, 8, 1, 0), datetime(2026, 8, 1, 18)), (None, datetime(2026, 8, 1)), (datetime(2026, 7, 20), datetime(2026, 8, 1)), (datetime(2026, 8, 2), datetime(2026, 8, 1))], "p timestamp, r timestamp")
    assert [round(r[0], 6) for r in df.select(ranking.recency(F.col("p"), F.col("r"))).collect()] == [0.5, 0.5, 0.05, 1.0]
    t = spark.createDataFrame([("isro satellite launch", ["bank"]), ("nothing here", ["market gold"]), ("words", [])], "t string, d array<string>").select(ranking.topic_of(F.col("t"), F.col("d")).alias("r")).collect()
    assert [(r["r"]["topic"], r["r"]["score"]) for r in t] == [("science-health-climate", 6), ("business-economy", 2), ("india", 0)]
    kinds = spark.createDataFrame([(["aggregator"],), (["research", None],), (["official"],), ([],)], "k array<string>")
    assert [r[0] for r in kinds.select(ranking.source_tier(F.col("k"))).collect()] == [0.6, 0.9, 1.0, 0.8]


def test_composition_equals_a_plain_greedy(spark):
    rng = random.Random(3)
    rows = [(e, r, f"c{r}", rng.choice(list(K.TOPIC_WEIGHTS)[: rng.choice([2, 4, 8])]), f"p{rng.randint(0, rng.choice([1, 5, 20]))}") for e in range(20) for r in range(1, rng.randint(2, 90))]
    got = {(x["edition"], x["rank"]): x["decision"] for x in ranking.compose(spark.createDataFrame(rows, "edition int, rank int, cluster_id string, topic string, primary_source_id string")).collect()}
    for e in range(20):
        core, topics, publishers, pools = 0, defaultdict(int), defaultdict(int), defaultdict(int)
        mine = sorted(x for x in rows if x[0] == e)
        chosen = set()
        for _, r, _, t, p in mine:
            if core < 8 and topics[t] < 3 and publishers[p] < 2:
                core, topics[t], publishers[p] = core + 1, topics[t] + 1, publishers[p] + 1
                chosen.add(r)
        for _, r, _, t, _ in mine:
            if r in chosen:
                assert got[e, r] == "selected_core"
            elif t in K.INTEREST_TOPICS and pools[t] < 4:
                pools[t] += 1
                assert got[e, r] == "selected_topic_pool"
            else:
                assert got[e, r] == "rejected"


def test_repetition(spark):
    c = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, ["x"])], "id long, unigrams array<string>")
    t = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "z"])], "title_id long, unigrams array<string>")
    assert {r["id"]: (r["dice"], r["penalty"]) for r in ranking.repetition(c, t).collect()} == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    assert {r["id"]: r["dice"] for r in ranking.repetition(c, t.union(spark.createDataFrame([(3, [])], t.schema))).collect()}[2] == 1.0


def test_rollback_and_staging(spark):
    days = spark.createDataFrame([("2026-08-01", "published"), ("2026-08-02", "corrected"), ("2026-08-03", "draft"), ("2026-08-04", "published")], "date string, status string")
    plan = lifecycle.rollback_plan(days, to_previous=True).first()
    assert (plan["target_date"], plan["withdrawn"], plan["remaining"], plan["error"]) == ("2026-08-02", ["2026-08-04"], ["2026-08-01", "2026-08-02"], None)
    errors = [lifecycle.rollback_plan(days, target=t).first()["error"] for t in ("2026-08-04", "2026-08-03", "2027-01-01", None)]
    assert errors == ["already the latest", "not a published edition", "not a published edition", "no target given"]
    reports = spark.createDataFrame([("b.json", "2026-08-01", 0, 0, True), ("a.json", "2026-08-02", 0, 1, True), ("c.json", "2026-08-03", 1, 0, False), ("d.json", None, 0, 0, True)], "file string, date string, blocking long, warnings long, publishable boolean")
    staged = lifecycle.staging_plan(reports)
    assert [r["file"] for r in staged.filter("stage").orderBy("rank").collect()] == ["a.json", "b.json"]
    index = lifecycle.staged_index(staged)
    assert index.first()["latest"] == "2026-08-02" and lifecycle.index_problems(index).count() == 0
    present = spark.createDataFrame([("x.json",), ("../y.json",), ("b.json",)], "name string")
    keep = spark.createDataFrame([("b.json",)], "name string")
    assert {tuple(r) for r in lifecycle.removal_plan(present, keep).collect()} == {("x.json", "remove"), ("../y.json", "refuse")}


def test_reader(spark):
    pools = spark.createDataFrame([("d", "sports", 0, "s1"), ("d", "sports", 1, "s2"), ("d", "technology-ai", 0, "t1"), ("d", "technology-ai", 1, "s1")], "date string, interest string, position int, story_id string")
    chosen = spark.createDataFrame([("r1", "d", "technology-ai"), ("r2", "d", None)], "reader_id string, date string, interest string")
    got = defaultdict(list)
    for r in reader.pick_pooled(pools, chosen).orderBy("place").collect():
        got[r["reader_id"]].append(r["story_id"])
    assert got == {"r1": ["t1", "s1"], "r2": ["s1", "t1"]}
    views = spark.createDataFrame([("r", f"2026-{m:02d}-01", s) for m in range(1, 13) for s in ("b", "a", "a")], "reader_id string, date string, story_id string")
    kept = reader.remembered(views, spark.createDataFrame([("r", "2026-02-01")], "reader_id string, date string"), keep=3).orderBy("date").collect()
    assert [r["date"] for r in kept] == ["2026-02-01", "2026-11-01", "2026-12-01"] and kept[0]["stories"] == ["a", "b"]
    raw = spark.createDataFrame([('{"schemaVersion": 1}',), ('{"schemaVersion": 2}',), ("nonsense",), (None,)], "r string")
    assert [r[0] for r in raw.select(reader.state_kind(F.col("r"))).collect()] == ["usable", "foreign", "replaceable", "replaceable"]
    paths = spark.createDataFrame([("/",), ("/editions/2026-08-01",), ("/editions/2026-13-01",), ("/x",)], "p string").select(reader.route(F.col("p")).alias("r")).collect()
    assert [r["r"]["kind"] for r in paths] == ["latest", "edition", "unknown", "unknown"]


def test_summaries(spark):
    item = "struct<source_id:string,guid:string,title:string,description:string,published_at:timestamp>"
    rows = [("cluster-1", "india", "Court hears petition on privacy", [("a", "g", "Court hears petition", "The court heard a petition on privacy on Monday.", datetime(2026, 8, 1)), ("b", "h", "Court to decide on 5 pleas", None, datetime(2026, 8, 2)), ("c", "i", "Court to decide on 7 pleas", None, None)])]
    df = spark.createDataFrame(rows, f"cluster_id string, topic string, cleaned_title string, items array<{item}>")
    s = summaries.summarize(df).first()
    assert s["story_id"] == "s-cluster-1" and s["slug"] == "india-s-cluster-1" and s["confidence"] == "disputed" and s["uncertainty"]
    assert s["sourceIds"] == ["a", "b", "c"] and s["whatChanged"] == ["The court heard a petition on privacy on Monday."]
    registry = spark.createDataFrame([("b", True, ["generated-summary"], "official")], "source_id string, active boolean, permittedUses array<string>, sourceType string")
    only = summaries.official_labels(summaries.summarize(df, registry), registry).first()
    assert only["sourceIds"] == ["b"] and only["confidence"] == "single-source" and only["reportingType"] == "official"
    parts = spark.createDataFrame([(["x" * 400, "y" * 300, "z" * 100],)], "s array<string>").select(summaries.paragraphs(F.col("s")).alias("p")).first()["p"]
    assert [len(p) for p in parts] == [701, 100]
    good = '```json\n{"headline":"h","whatChanged":[{"sentence":"s","sourceIds":["a"]}]}\n```'
    answers = spark.createDataFrame([(good, ["a"]), (good, ["b"]), ("nope", ["a"])], "r string, a array<string>").select(summaries.parse_answer(F.col("r"), F.col("a"))["problem"]).collect()
    assert [r[0] for r in answers] == [None, "cites other sources", "malformed"]


def test_no_clock_or_chance_in_operators():
    import pathlib

    root = pathlib.Path(items.__file__).parent
    for path in root.glob("*.py"):
        assert not {"current_timestamp", "current_date", "F.rand(", "datetime.now"} & set(path.read_text().split()), path
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def test_features_are_looked_up(spark):
    from broadsheet.functions import text
    from broadsheet.plans import draft

    at = datetime(2026, 8, 1, 6)
    rows = [(k, [s], t, 1, s, f"c{k}", at) for k, s, t in ((1, "gov", "Bridge opens in town"), (2, "blog", "Bridge opens in town"), (3, "gov", "Rates held steady again"), (4, "none", "Nothing to report"))]
    found = spark.createDataFrame(rows, "leader long, sources array<string>, representative_title string, source_count int, primary_source_id string, cluster_id string, last_published_at timestamp")
    members = spark.createDataFrame([(1, "gov", "the bank raised the market rate"), (2, "blog", "cricket")], "leader long, source_id string, description string")
    registry = spark.createDataFrame([("gov", "official", "india", True, ["supplied-description"]), ("blog", "aggregator", "europe", True, ["generated-summary"])], "source_id string, sourceType string, region string, active boolean, permittedUses array<string>")
    recent = spark.createDataFrame([("t", "Rates held steady again")], "title_id string, title string").select("title_id", text.title_tokens(F.col("title"))["unigrams"].alias("unigrams"))
    got = {r["leader"]: r for r in draft.score(found, members, registry, recent).collect()}
    plain = {r["leader"]: r for r in draft.score(found).collect()}
    assert got[1]["composite_score"] > got[2]["composite_score"] and plain[1]["composite_score"] == plain[2]["composite_score"]
    assert got[1]["topic"] == "business-economy" and got[2]["topic"] == "india" == plain[1]["topic"]  # only permitted descriptions count
    assert got[3]["composite_score"] < 0.6 * plain[3]["composite_score"] and set(got[1].asDict()) == set(plain[1].asDict())


def test_draft_editions(spark, news):
    from broadsheet.plans import draft

    items_ = news.withColumn("updated_at", F.lit(None).cast("timestamp")).withColumn("author", F.lit(None).cast("string")).filter("published_at is not null")
    editions = draft.draft_editions(items_).cache()
    rows = editions.collect()
    assert rows and all(len(r["coreStoryIds"]) <= 8 and 1 <= r["estimatedMinutes"] <= 60 for r in rows)
    for r in rows:
        ids = [s["id"] for s in r["stories"]]
        assert ids[: len(r["coreStoryIds"])] == r["coreStoryIds"] and len(set(ids)) == len(ids)
        assert {x for s in r["stories"] for x in s["sourceIds"]} == {s["id"] for s in r["sources"]}
        assert all(1 <= len(p) <= 3 for p in r["interestPools"].values())
    assert {str(r) for r in draft.draft_editions(items_.orderBy(F.rand(1)).repartition(3)).collect()} == {str(r) for r in rows}
    reports = draft.draft_report(editions)
    assert reports.count() == len(rows)
    assert draft.summary_markdown(editions, reports).first()["markdown"].startswith("# Draft 2026-08")
    editions.unpersist()
