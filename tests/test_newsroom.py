"""Streams of feeds, summaries by providers, ingestion, registries and staging."""

import json
from datetime import datetime

import pytest
from broadsheet.operators import findings, loading, ranking, summarizing
from broadsheet.sources import ingestion, registry, staging
from broadsheet.streaming import devices, feed_stream
from pyspark.sql import functions as F

# --- feeds as a stream -----------------------------------------------------------------------------------------------


def server(path):
    """Feeds in a file: {url: [etag, body] or null}. A null feed doesn't answer; an etag that is known brings a 304."""

    def environment():
        import json as j

        from broadsheet.sources.fetching import FetchError, Response

        def request(url, addresses, headers, bodies=True):
            with open(path) as f:
                feed = j.load(f)[url]
            with open(f"{path}.log", "a") as f:
                f.write(f"{'GET' if bodies else 'HEAD'} {url}\n")
            if feed is None:
                raise FetchError("timeout")
            etag, body = feed
            if etag and headers.get("if-none-match") == etag:
                return Response(304, {"etag": etag})
            return Response(200, {"content-type": "text/xml"} | ({"etag": etag} if etag else {}), body.encode() if bodies else b"")

        return (lambda host: ["8.8.8.8"]), request, (lambda ms: None), (lambda u, a, h: request(u, a, h, False))

    return environment


def test_stream_of_feeds_reads_changes_only_and_restarts(spark, tmp_path):
    path = str(tmp_path / "feeds.json")
    a, b, c = (f"https://{n}.in/f" for n in "abc")

    def put(**feeds):
        (tmp_path / "feeds.json").write_text(json.dumps({a: feeds["a"], b: feeds["b"], c: feeds["c"]}))

    def start():
        df = feed_stream.stream_feeds(spark, [("a", a), ("b", b), ("c", c)], server(path))
        return df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()

    def rows():
        return sorted((r["source_id"], r["kind"], r["body"], r["code"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(a=["1", "A1"], b=["1", "B1"], c=["9", "C1"])
    q = start()
    q.processAllAvailable()
    assert rows() == [("a", "success", "A1", None), ("b", "success", "B1", None), ("c", "success", "C1", None)]
    put(a=["1", "A1"], b=["2", "B2"], c=["9", "C1"])
    q.processAllAvailable()
    q.stop()
    want = [("a", "success", "A1", None), ("b", "success", "B1", None), ("b", "success", "B2", None), ("c", "success", "C1", None)]
    assert rows() == want
    q = start()  # nothing moved meanwhile: offsets tell, and no feed is fetched
    before = (tmp_path / "feeds.json.log").read_text().count("GET")
    q.processAllAvailable()
    assert rows() == want and (tmp_path / "feeds.json.log").read_text().count("GET") == before
    put(a=["2", "A2"], b=["2", "B2"], c=["9", "C1"])
    q.processAllAvailable()
    q.stop()
    assert rows() == sorted([*want, ("a", "success", "A2", None)])


def test_reader_keeps_validators_of_failing_and_unchanged_sources(tmp_path):
    path = str(tmp_path / "f.json")
    url = "https://a.in/f"
    put = lambda feed: (tmp_path / "f.json").write_text(json.dumps({url: feed}))
    ticks = iter(range(1, 100))
    reader = feed_stream.FeedStreamReader([("a", url)], server(path), feed_stream.Policy(retries=0), lambda: next(ticks))
    zero = reader.initialOffset()
    put(["x", "one"])
    one = reader.latestOffset()
    assert one["a"]["etag"] == "x" and len(reader.partitions(zero, one)) == 1 and reader.partitions(one, one) == []
    assert [r[6] for r in reader.read(reader.partitions(zero, one)[0])] == ["one"]
    assert list(reader.read(feed_stream._Changed("a", url, one["a"]))) == []  # a 304 is no row
    assert reader.latestOffset() == one  # and moves nothing
    put(None)
    two = reader.latestOffset()
    assert two["a"]["etag"] == "x" and two != one
    assert [r[1:3] for r in reader.read(reader.partitions(one, two)[0])] == [("failure", "timeout")]
    put([None, "no validators"])
    assert reader.latestOffset() != reader.latestOffset()  # asked for anew each time
    fresh = feed_stream.FeedStreamReader([("a", url)], server(path), feed_stream.Policy(retries=0), lambda: next(ticks))
    fresh.partitions(one, one)  # what a restarted query says of its last run
    put(["x", "one"])
    assert fresh.latestOffset() == one


# --- summaries by a provider -----------------------------------------------------------------------------------------

ITEM = "array<struct<ordinal:int,source_id:string,guid:string,title:string,description:string,published_at:timestamp>>"


class Model:
    """Answers by the cluster's title: what it is told to do."""

    name, model = "fake", "m-1"

    def __init__(self):
        self.calls = {}

    def complete(self, prompt, timeout_ms):
        what, source = prompt["title"].split()[0], prompt["items"][0]["source_id"]
        self.calls[what] = self.calls.get(what, 0) + 1
        if what == "down" or what == "late" and self.calls[what] < 3:
            raise summarizing.Unavailable("HTTP 503")
        if what == "slow":
            raise TimeoutError
        if what == "no":
            raise summarizing.Refused("HTTP 403")
        if what == "bug":
            raise ZeroDivisionError
        if what == "empty":
            return " "
        if what == "broken":
            return "{not json"
        cited = "elsewhere" if what == "foreign" else source
        answer = {"headline": "Ministers agree on a plan" if what != "short" else "x", "deck": "A deck that is long enough", "whatChanged": [{"sentence": "Something changed.", "sourceIds": [cited]}], "whyItMatters": "It matters to many readers."}
        return f"```json\n{json.dumps(answer)}\n```" if what == "fenced" else json.dumps(answer)


def stories_of(spark, *whats, registry=None, **more):
    rows = [(f"c-{w}", "india", f"{w} title of the cluster", [(0, "src", "g", f"{w} title of the cluster", "A description that is long enough.", datetime(2026, 8, 1))]) for w in whats]
    df = spark.createDataFrame(rows, f"cluster_id string, topic string, cleaned_title string, items {ITEM}").coalesce(1)
    return summarizing.summarize(df, Model(), registry, sleep=lambda s: None, **more)


def test_each_failure_has_its_fallback(spark):
    whats = ["good", "fenced", "late", "down", "slow", "no", "bug", "empty", "broken", "foreign", "short"]
    got = {r["cluster_id"][2:]: r for r in stories_of(spark, *whats).collect()}
    assert set(got) == set(whats)
    assert {w for w in whats if not got[w]["used_fallback"]} == {"good", "fenced", "late"}
    assert all(got[w]["headline"] == "Ministers agree on a plan" and got[w]["whatChanged"] == ["Something changed."] for w in ("good", "fenced", "late"))
    assert {w: (got[w]["fallback_reason"], got[w]["attempts"]) for w in whats if got[w]["used_fallback"]} == {
        "down": ("unavailable: HTTP 503", 3), "slow": ("timeout", 3), "no": ("refused: HTTP 403", 1), "bug": ("error: ZeroDivisionError", 3), "empty": ("empty answer", 3),
        "broken": ("malformed", 1), "foreign": ("cites other sources", 1), "short": ("outside a story's bounds", 1),
    }
    assert got["late"]["attempts"] == 3 and got["down"]["headline"].startswith("down title") and all(r["provider"] == "fake" for r in got.values())
    counts = {r["outcome"]: r["n"] for r in summarizing.outcomes(stories_of(spark, *whats)).collect()}
    assert counts["answered"] == 3 and sum(counts.values()) == len(whats)


def test_backoff_doubles_and_late_answers_count_as_timeouts():
    waits, now = [], iter(range(0, 1000, 20))
    assert summarizing._asked(Model(), {"title": "down x", "items": [{"source_id": "s"}]}, summarizing.Patience(retries=3, delay_ms=500), waits.append, lambda: 0)[1:] == ("unavailable: HTTP 503", 4)
    assert waits == [0.5, 1.0, 2.0]
    assert summarizing._asked(Model(), {"title": "good x", "items": [{"source_id": "s"}]}, summarizing.Patience(retries=0), waits.append, lambda: next(now))[1] == "timeout"


def test_no_provider_and_sources_that_forbid_summaries(spark):
    assert summarizing.provider_of(None, {}) is None and summarizing.provider_of({"provider": "fallback"}, {}) is None
    make = {"fake": lambda c: (c["token"], Model())[1]}
    assert summarizing.provider_of({"provider": "fake"}, make) is None and summarizing.provider_of({"provider": "fake", "token": "t"}, make).name == "fake"
    may = spark.createDataFrame([("src", True, ["headline"], "publisher")], "source_id string, active boolean, permittedUses array<string>, sourceType string")
    assert stories_of(spark, "good", registry=may).count() == 0
    rows = [("c", "india", "A title of the cluster", [(0, "src", "g", "A title of the cluster", None, None)])]
    r = summarizing.summarize(spark.createDataFrame(rows, f"cluster_id string, topic string, cleaned_title string, items {ITEM}")).first()
    assert (r["provider"], r["used_fallback"], r["attempts"]) == ("fallback", False, 0)


# --- ingestion -------------------------------------------------------------------------------------------------------


def test_diagnostics_are_taken_in_the_same_pass(spark, tmp_path):
    rss = "<rss><channel><item><title>One title</title><guid>1</guid></item><item><title>Two titles</title><guid>2</guid></item></channel></rss>"
    rows = [("a", "success", None, 200, "text/xml", rss), ("b", "not-modified", None, 304, None, None), ("c", "failure", "timeout", None, None, None), ("d", "success", None, 200, "application/json", "{broken"), ("e", "success", None, 200, "text/xml", " ")]
    log = str(tmp_path / "reads")

    def read(batches):
        with open(log, "a") as f:
            f.write("x")
        yield from batches

    fetched = spark.createDataFrame(rows, "source_id string, kind string, code string, status int, content_type string, body string").coalesce(1)
    counted = fetched.mapInPandas(read, fetched.schema)
    items, d = ingestion.ingest(counted, str(tmp_path / "items"))
    assert open(log).read() == "x"  # the feeds were read once
    assert (d.total_sources, d.successful, d.not_modified, d.failed, d.parsed_items) == (5, 1, 1, 3, 2) and items.count() == 2
    assert [(s["source_id"], s["status"], s["http_status"], s["error"], s["item_count"]) for s in d.sources] == [
        ("a", "success", 200, None, 2), ("b", "not-modified", 304, None, 0), ("c", "fetch-failure", None, "timeout", 0), ("d", "parse-failure", 200, "unreadable", 0), ("e", "parse-failure", 200, "unreadable", 0)]
    second = {r["outcome"]: r["count"] for r in ingestion.with_status(fetched).groupBy("outcome").count().collect()}
    assert second == {"success": 1, "not-modified": 1, "fetch-failure": 1, "parse-failure": 2}
    assert ingestion.ingest(fetched.limit(0), str(tmp_path / "none"))[1].total_sources == 0


# --- registries ------------------------------------------------------------------------------------------------------

GOOD = {"id": "the-gazette", "publisher": "Gazette", "siteUrl": "https://h.in/", "feedUrl": "https://h.in/feed", "sourceType": "publisher", "region": "india", "language": "en", "active": True, "sample": False,
        "termsUrl": "https://h.in/t", "termsReviewedOn": "2026-08-01", "termsReviewedBy": "editor", "permittedUse": "x" * 40, "permittedUses": ["headline"], "attribution": "Gazette"}


def test_registry_files_give_rows_whatever_is_in_them(spark, tmp_path):
    entry = lambda **o: {k: v for k, v in (GOOD | o).items() if v is not ...}
    yaml = "schemaVersion: 1\nsources:\n  - " + "\n    ".join(f"{k}: {json.dumps(v)}" for k, v in GOOD.items() if k != "termsReviewedOn") + "\n    termsReviewedOn: 2026-08-01\n"
    wrong = [entry(id="Bad Id"), entry(id="b", publisher=..., feedUrl="http://u:p@h.in:8443/f#x"), entry(id="c", extra=1, active="yes"), entry(id="d", permittedUses=["all"], region="mars"), entry(id="e", termsUrl=...), entry(id="f", active=False, sample=True), entry(id="d", feedUrl="https://h.in/other", termsReviewedBy="a@b.in", termsReviewedOn="2026-13-01")]
    files = {"good.yaml": yaml, "good.json": json.dumps({"schemaVersion": 1, "sources": [entry(), entry(id="x", feedUrl="https://x.in/f", active=False, attribution=...)]}), "wrong.json": json.dumps({"schemaVersion": 2, "sources": wrong, "more": 1}), "broken.yml": "a: [1", "list.json": "[1]", "empty.json": ""}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    scan = registry.registry_scan(registry.read_registries(spark, str(tmp_path)))
    found = {}
    for r in registry.schema_findings(scan).collect():
        assert (r["rule_id"], r["severity"]) == ("registry/schema", "blocking")
        found.setdefault(r["file"], set()).add((r["path"], r["detail"].split(" ")[0] if r["detail"].startswith("duplicate") else r["detail"]))
    assert set(found) == {"wrong.json", "broken.yml", "list.json", "empty.json"} or set(found) == {"wrong.json", "broken.yml", "list.json"}
    assert found["broken.yml"] == found["list.json"] == {("", "must be a mapping")}
    assert found["wrong.json"] >= {
        ("schemaVersion", "must be 1"), ("more", "isn't known here"), ("sources.0.id", "must be lowercase words joined by dashes"), ("sources.1.publisher", "is required"), ("sources.1.feedUrl", "must use https"),
        ("sources.1.feedUrl", "must not carry credentials"), ("sources.1.feedUrl", "must not name a port"), ("sources.1.feedUrl", "must not carry a fragment"), ("sources.2.extra", "isn't known here"), ("sources.2.active", "must be boolean"),
        ("sources.3.permittedUses", "must name permitted uses"), ("sources.3.region", "must be one of india, south-asia, world"), ("sources.4.termsUrl", "is required of an active source"), ("sources.5.termsUrl", "isn't known here"),
        ("sources.6.termsReviewedBy", "must be a name, not an address"), ("sources.6.termsReviewedOn", "must be a date"), ("sources", "duplicate"),
    }
    good = registry.registry_entries(scan).orderBy("file", "position").collect()
    assert [(r["file"], r["source_id"], r["active"], r["permittedUses"]) for r in good] == [("good.json", "the-gazette", True, ["headline"]), ("good.json", "x", False, ["headline"]), ("good.yaml", "the-gazette", True, ["headline"])]
    assert findings.registry_findings(registry.registry_entries(scan).filter("file = 'good.yaml'")).filter("severity = 'blocking'").count() == 0


# --- staging ---------------------------------------------------------------------------------------------------------


def editions(spark, *dates, status="published"):
    rows = [(f"{d}.json", d, status, [(f"s-{d}", True)]) for d in dates]
    return spark.createDataFrame(rows, "file string, date string, status string, stories array<struct<id:string,reviewed:boolean>>")


def reports(df, blocking=0):
    return df.select("file", "date", F.lit(blocking).alias("blocking"), F.lit(0).alias("warnings"), F.lit(blocking == 0).alias("publishable"))


def seen(spark, folder):
    e, index = staging.staged(spark, folder)
    return sorted(r["date"] for r in e.collect()), index.first()["latest"] if "latest" in index.columns else None


def test_the_pointer_moves_last(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "staged")
    assert staging.current(spark, folder) is None and staging.staged(spark, folder) is None
    one = editions(spark, "2026-08-01", "2026-08-02")
    staging.stage(one, reports(one), folder)
    assert seen(spark, folder) == (["2026-08-01", "2026-08-02"], "2026-08-02")
    two = editions(spark, "2026-08-02", "2026-08-03")
    with pytest.raises(staging.NotStaged):
        staging.stage(two, reports(two, blocking=1), folder)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # a writer that dies between its phases
        m.setattr(staging, "_point", dies)
        with pytest.raises(RuntimeError):
            staging.stage(two, reports(two), folder)
    assert seen(spark, folder) == (["2026-08-01", "2026-08-02"], "2026-08-02")
    staging.stage(two, reports(two), folder)
    assert seen(spark, folder) == (["2026-08-02", "2026-08-03"], "2026-08-03")
    staging.restore(spark, folder)
    assert seen(spark, folder) == (["2026-08-01", "2026-08-02"], "2026-08-02")
    with pytest.raises(staging.NotStaged):
        staging.restore(spark, folder, "version-none")
    assert len(staging.sweep(spark, folder)) == 1 and staging.sweep(spark, folder) == []
    assert seen(spark, folder) == (["2026-08-01", "2026-08-02"], "2026-08-02")


def test_a_rollback_stages_what_is_left(spark, tmp_path):
    folder = str(tmp_path / "staged")
    e = editions(spark, "2026-08-01", "2026-08-02")
    staging.stage(e, reports(e), folder)
    plan = spark.createDataFrame([(None, ["2026-08-02"])], "error string, withdrawn array<string>")
    now = staging.roll_back(e, reports(e), plan, folder)
    assert seen(spark, folder) == (["2026-08-01"], "2026-08-01")
    assert {(r["date"], r["status"]) for r in now.collect()} == {("2026-08-01", "published"), ("2026-08-02", "draft")}
    with pytest.raises(staging.NotStaged):
        staging.roll_back(e, reports(e), spark.createDataFrame([("no such edition", None)], plan.schema), folder)
    assert seen(spark, folder) == (["2026-08-01"], "2026-08-01")


# --- repetition ------------------------------------------------------------------------------------------------------


def test_repeated_titles_lose_none(spark):
    import random

    rng = random.Random(6)
    title = lambda: [f"w{min(int(rng.paretovariate(0.6)), 40)}" for _ in range(rng.choice([0, 1, 2, 4, 8, 20]))]
    uniq = lambda ws: list(dict.fromkeys(ws))
    a, b = [(i, uniq(title())) for i in range(150)], [(f"t{i}", uniq(title())) for i in range(80)]
    dice = lambda x, y: 1.0 if not x and not y else 2 * len(set(x) & set(y)) / (len(x) + len(y))
    ca, re = spark.createDataFrame(a, "id long, unigrams array<string>"), spark.createDataFrame(b, "title_id string, unigrams array<string>")
    want = {(str(i), t): dice(x, y) for i, x in a for t, y in b if x and dice(x, y) >= 0.45}
    got = {(r["id"], r["title_id"]): r["dice"] for r in ranking.repeated_titles(ca, re).collect()}
    bare = {str(i) for i, x in a if not x}
    assert {k: round(v, 9) for k, v in got.items() if k[0] not in bare} == {k: round(v, 9) for k, v in want.items()} and bare <= {k for k, _ in got}
    old = {r["id"]: r["penalty"] for r in ranking.repetition(ca, re).collect()}
    assert {r["id"]: round(r["penalty"], 9) for r in ranking.repetition_penalties(ca, re).collect()} == {k: round(v, 9) for k, v in old.items()}


# --- readers ---------------------------------------------------------------------------------------------------------


def test_loads_fail_in_order(spark):
    """Route, then index, then edition; a prior date only where the edition is what failed."""
    requests = spark.createDataFrame([(1, "/", "2026-08-03"), (2, "/editions/2026-08-01", "2026-08-03"), (3, "/nowhere", "2026-08-03"), (4, "/editions/2026-08-02", "2026-08-03"), (5, "/editions/2026-02-31", "2026-08-03")], "request_id long, path string, today string")
    response = lambda *r: spark.createDataFrame([r], "status int, content_type string, body string")
    good = json.dumps({"schemaVersion": 1, "contentSet": "published", "latest": "2026-08-02", "editions": ["2026-08-02", "2026-08-01"]})
    copies = spark.createDataFrame([("2026-08-02", 500, None, "x", "network"), ("2026-08-01", 200, "application/json", '{"schemaVersion": 1, "date": "2026-08-01"}', "network")], "date string, status int, content_type string, body string, source string")
    rows = lambda index: {r["request_id"]: (r["status"], r["reason"], r["prior_date"], r["fresh"]) for r in loading.load_states(requests, loading.index_of(index), copies).collect()}
    assert rows(response(200, "application/json", good)) == {1: ("failed", "unreachable", "2026-08-01", None), 2: ("ready", None, None, "archived"), 3: ("failed", "unavailable", None, None), 4: ("failed", "unreachable", "2026-08-01", None), 5: ("failed", "unavailable", None, None)}
    assert rows(response(None, None, None))[1] == ("failed", "network", None, None)
    assert rows(response(200, "application/json", "{"))[2] == ("failed", "malformed", None, None)
    assert rows(response(200, "text/html; charset=utf-8", "<html>"))[3] == ("failed", "unavailable", None, None)
    assert rows(response(200, None, '{"schemaVersion": 1, "contentSet": "else"}'))[1] == ("failed", "invalid", None, None)
    empty = rows(response(200, None, '{"schemaVersion": 1, "contentSet": "sample", "latest": null, "editions": []}'))
    assert empty[1] == ("none", None, None, None) and empty[2] == ("ready", None, None, "archived")


def test_devices_of_several_versions(spark, tmp_path):
    """State goes on over batches and a restart; a newer document is never written over."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda k: datetime(2026, 8, 1, 0, k)
    old = json.dumps({"schemaVersion": 1, "viewed": {"2026-07-01": ["s0"]}, "later": {"x": 1}})
    parts = [
        [("a", at(0), "stored", None, old), ("a", at(1), "viewed", "2026-08-01", "s1"), ("b", at(0), "stored", None, '{"schemaVersion": 3, "new": true}'), ("b", at(1), "theme", None, "dark"), ("c", at(0), "stored", None, "{broken"), ("c", at(1), "interests", None, "sports,nothing,technology-ai,culture-entertainment")],
        [("a", at(2), "viewed", "2026-08-01", "s1"), ("a", at(3), "viewed", "2026-08-01", "s2"), ("a", at(4), "ended", "2026-08-01", None), ("b", at(2), "viewed", "2026-08-01", "s1"), ("c", at(2), "theme", None, "pink")],
        [("d", at(k), "viewed", f"2026-{1 + k // 28:02}-{1 + k % 28:02}", "s") for k in range(40)] + [("a", at(5), "theme", None, "dark")],
    ]
    got = {}
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, devices.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(devices.EVENT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        seen = lambda df, _: got.update({r["reader_id"]: (json.loads(r["document"]), r["applied"], r["refused"]) for r in df.collect()})
        devices.device_documents(stream).writeStream.foreachBatch(seen).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        if k == 0:
            assert got["b"] == ({"schemaVersion": 3, "new": True}, 1, 1) and got["c"][0] == {"schemaVersion": 1, "interests": ["culture-entertainment", "sports"]}
    assert got["a"][0] == {"schemaVersion": 1, "later": {"x": 1}, "viewed": {"2026-07-01": ["s0"], "2026-08-01": ["s1", "s2"]}, "ended": ["2026-08-01"], "theme": "dark"}
    assert got["b"] == ({"schemaVersion": 3, "new": True}, 0, 1) and "theme" not in got["c"][0]
    days = sorted(d for _, _, _, d, _ in parts[2] if d)
    assert sorted(got["d"][0]["viewed"]) == days[-30:]


def test_draft_with_registry_keeps_to_permissions(spark):
    """Only sources that may be summarised are cited; stories of official sources alone are labelled so."""
    from broadsheet import catalogue_newsroom as N

    sf = "/root/testdata/sf0.001"
    may = {r["source_id"]: r for r in N.source_registry(spark, sf).collect()}
    rows = N.draft_with_registry(spark, sf).collect()
    cited = [[may[s] for s in r["source_ids"].split(",")] for r in rows]
    assert rows and all(s["active"] for c in cited for s in c) and any(not s["active"] for s in may.values())
    assert all((r["reportingType"] == "official") == all(s["sourceType"] == "official" for s in c) for r, c in zip(rows, cited) if r["reportingType"] != "opinion")
