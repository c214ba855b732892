import pytest
from broadsheet.sources import feeds, fetching
from broadsheet.streaming import ingest
from pyspark.sql import functions as F

RSS = """<rss><item><title><![CDATA[One & two]]></title><link>https://n.in/1</link><description>d &amp;lt;b</description><dc:creator>Ann</dc:creator><pubDate>Sat, 01 Aug 2026 10:00:00 GMT</pubDate></item>
<item><title>Bare</title><guid>g2</guid><content:encoded>body</content:encoded></item></rss>"""
ATOM = """<feed><entry><title>A</title><link href="https://n.in/x"/><link rel="alternate" href="https://n.in/a"/><summary>s</summary><updated>2026-08-01T00:00:00Z</updated><author><name>N</name></author></entry></feed>"""
JSON = '{"items": [{"url": "https://n.in/j", "title": "J", "content_text": "t", "author": {"name": "B"}, "date_published": "2026-08-01"}]}'


def test_feeds(spark):
    rows = [("r", "application/rss+xml", RSS), ("a", "application/atom+xml", ATOM), ("j", "application/json", JSON), ("bad", "application/json", "{nope"), ("none", None, " ")]
    got = {(r["source_id"], r["item_ordinal"]): r for r in feeds.parse_feeds(spark.createDataFrame(rows, "source_id string, content_type string, body string")).collect()}
    assert set(got) == {("r", 0), ("r", 1), ("a", 0), ("j", 0)}
    r = got["r", 0]
    assert (r["title"], r["guid"], r["author"], r["description"]) == ("One & two", "https://n.in/1", "Ann", "d <b")
    assert got["r", 1]["guid"] == "g2" and got["r", 1]["description"] == "body" and got["r", 1]["link"] is None
    a = got["a", 0]
    assert (a["link"], a["guid"], a["author"], a["published_at"], a["updated_at"]) == ("https://n.in/a", "https://n.in/a", "N", "2026-08-01T00:00:00Z", "2026-08-01T00:00:00Z")
    assert got["j", 0]["guid"] == "https://n.in/j" and got["j", 0]["description"] == "t"


def run(script, url="https://n.in/f", addresses=("8.8.8.8",)):
    calls, waits = [], []

    def request(u, _addresses, headers):
        calls.append(u)
        r = script[min(len(calls), len(script)) - 1]
        if isinstance(r, Exception):
            raise r
        return r

    row = fetching.fetch("s", url, lambda host: list(addresses), request, waits.append)
    return row, calls, waits


XML = {"Content-Type": "text/xml; charset=utf-8", "ETag": "e1"}


@pytest.mark.parametrize("script, kind, code, attempts", [
    ([fetching.Response(200, XML, b"<rss/>")], "success", None, 1), ([fetching.Response(304, {})], "not-modified", None, 1), ([fetching.Response(503), fetching.Response(200, XML, b"x")], "success", None, 2),
    ([fetching.Response(500)], "failure", "http-error", 3), ([fetching.FetchError("timeout")], "failure", "timeout", 3), ([fetching.Response(404)], "failure", "http-error", 1), ([fetching.Response(200, {}, b"x")], "failure", "missing-content-type", 1),
    ([fetching.Response(200, {"content-type": "text/html"}, b"x")], "failure", "unsupported-content-type", 1), ([fetching.Response(200, XML | {"content-length": "9999999"})], "failure", "response-too-large", 1),
    ([fetching.Response(200, XML | {"content-length": "x"})], "failure", "invalid-content-length", 1), ([fetching.Response(302)], "failure", "redirect-without-location", 1), ([fetching.Response(302, {"location": "https://n.in/g"})], "failure", "too-many-redirects", 4),
    ([fetching.Response(302, {"location": "http://n.in/g"})], "failure", "not-https", 1), ([fetching.Response(302, {"location": "https://10.0.0.1/g"})], "failure", "unsafe-host", 1),
])
def test_fetch_policy(script, kind, code, attempts):
    row, calls, waits = run(script)
    assert (row[1], row[2], row[9]) == (kind, code, attempts)
    assert len(calls) == attempts and all(w == 250 for w in waits)


def test_unsafe_answers_are_refused():
    assert run([fetching.Response(200, XML, b"x")], addresses=("8.8.8.8", "10.0.0.1"))[0][2] == "unsafe-address"
    assert run([fetching.Response(200, XML, b"x")], url="https://u:p@n.in/f")[0][2] == "credentials"
    assert run([fetching.Response(200, XML, b"x")], url="https://localhost/f")[0][2] == "unsafe-host"


def test_feeds_as_a_source(spark):
    body = RSS.encode()

    def environment():
        from broadsheet.sources.fetching import Response

        def request(url, addresses, headers):
            if "broken" in url:
                raise RuntimeError("boom")
            return Response(200, {"content-type": "text/xml"}, body)

        return (lambda host: ["8.8.8.8"]), request, (lambda ms: None)

    got = {r["source_id"]: r for r in fetching.read_feeds(spark, [("a", "https://n.in/f"), ("b", "https://broken.in/f")], environment).collect()}
    assert got["a"]["kind"] == "success" and got["b"]["code"] == "network-error"


def test_response_columns(spark):
    df = spark.createDataFrame([(200, {"Content-Type": "Text/XML; x"}, 5), (404, {}, 0), (302, {}, 0), (200, {"content-type": "text/html"}, 1), (304, {}, 0)], "s int, h map<string,string>, n long")
    got = [r[0] for r in df.select(feeds.response_problem(F.col("s"), F.col("h"), F.col("n"))).collect()]
    assert got == [None, "http-error", "redirect-without-location", "unsupported-content-type", "not-modified"]


def test_stream_dedup_equals_batch(spark, tmp_path):
    rows = [("s", 0, ["a", "u1"]), ("s", 1, ["a", "u2"]), ("s", 2, ["b", "u2"]), ("t", 0, ["a"]), ("s", 3, ["u1"])]
    schema = "source_id string, item_ordinal long, keys array<string>"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = ingest.first_seen(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["source_id"], r["item_ordinal"]): r["kept"] for r in spark.table("seen").collect()}
    assert got == {("s", 0): True, ("s", 1): False, ("s", 2): True, ("t", 0): True, ("s", 3): False}


def test_stream_joins_near_times(spark, tmp_path):
    rows = [(1, "rbi", "2026-08-01 00:00:00"), (2, "rbi", "2026-08-03 00:00:00"), (3, "rbi", "2026-08-09 00:00:00"), (4, "isro", "2026-08-01 00:00:00"), (5, "rbi", None)]
    df = spark.createDataFrame(rows, "node long, word string, at string").select("node", "word", F.to_timestamp("at").alias("published_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.near_in_time(stream(), stream()).writeStream.format("memory").queryName("near").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["a"], r["b"]) for r in spark.table("near").collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (1, 2), (2, 1)}


def test_stream_tells_stale_sources(spark, tmp_path):
    rows = [("a", "2026-08-01 00:00:00"), ("a", "2026-08-02 00:00:00"), ("b", "2026-08-09 00:00:00")]
    df = spark.createDataFrame(rows, "source_id string, at string").select("source_id", F.to_timestamp("at").alias("published_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.stale_sources(stream).writeStream.format("memory").outputMode("append").queryName("stale").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["source_id"], str(r["last_at"])) for r in spark.table("stale").collect()] == [("a", "2026-08-02 00:00:00")]


def test_views_are_remembered_batch_by_batch(spark, tmp_path):
    rows = [[("r", "2026-08-01", 1), ("r", "2026-08-02", 2)], [("r", "2026-08-02", 3), ("q", "2026-08-01", 1)], [("r", "2026-08-03", 9), ("r", "2026-08-02", 2)]]
    schema = "reader_id string, date string, story_id long"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    merge = ingest.view_memory(str(tmp_path / "memory"), keep=2)
    ingest.remember_views(stream, merge, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    last = lambda: {(r["reader_id"], r["date"], tuple(r["stories"])) for r in spark.read.parquet(str(tmp_path / "memory/2")).collect()}
    assert last() == {("r", "2026-08-03", (9,)), ("r", "2026-08-02", (2, 3)), ("q", "2026-08-01", (1,))}
    merge(spark.createDataFrame(rows[2], schema), 2)  # run again
    assert len(last()) == 3


def test_stream_day_counts_equal_batch(spark, tmp_path):
    events = spark.sql("select timestamp '2026-08-01 18:00:00' + make_interval(0, 0, 0, 0, id * 7, 0, 0) as ts, if(id % 2 = 0, 'a', 'b') as event_type from range(60)")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.day_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(str(r[0]), r[1], r[2]) for r in events.groupBy(F.to_date(F.from_utc_timestamp("ts", "Asia/Kolkata")), "event_type").count().collect()}
    assert {(str(r["day"]), r["event_type"], r["n"]) for r in spark.table("days").collect()} == want
