import pytest
from broadsheet.functions import facts, similarity, text, urls
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value, want", [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv(spark, value, want):
    assert one(spark, text.fnv1a64, value) == want


def test_fnv_many_lengths(spark):
    def plain(t):
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = ((h ^ b) * 0x100000001B3) % (1 << 64)
        return f"{h:016x}"

    values = ["é" * k + "x" * (k % 7) for k in range(700)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.fnv1a64(F.col("v")).alias("h")).collect()
    assert all(r["h"] == plain(r["v"]) for r in got)


def test_build_id(spark):
    h = 0x811C9DC5
    for c in "a.js\nb.css":
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    got = spark.createDataFrame([(["b.css", "a.js"],)], "v array<string>").select(text.build_id(F.col("v")).alias("r")).first()["r"]
    assert got == f"{h:08x}"


@pytest.mark.parametrize("value, want", [
    ("<p>One &amp; two</p><script>x()</script><p>a < b</p>", "One & two\na < b"),
    ("&lt;b&gt; stays", "<b> stays"), ("x<br>y<li>z", "x\ny\nz"), ('<a title="a > b">t</a>', "t"), ("&amp;lt; &#0; &#x41; &nope;", "&lt; &#0; A &nope;"), (None, ""), ("a<!-- c -->b", "ab"),
])
def test_html(spark, value, want):
    assert one(spark, text.html_to_text, value) == want


@pytest.mark.parametrize("value, want", [
    ("2026-08-01", "2026-08-01 00:00:00"), ("2026-02-30", None), ("2026-08-01T10:00", "2026-08-01 10:00:00"), ("2026-08-01T10:00:00+05:30", "2026-08-01 04:30:00"),
    ("Sat, 01 Aug 2026 10:00:00 GMT", "2026-08-01 10:00:00"), ("Sat, 1 Aug 2026 10:00:00 +0530", "2026-08-01 04:30:00"), ("1 Aug 2026 10:00:00 EST", "2026-08-01 15:00:00"), ("Aug 1 2026", None), ("", None), (None, None),
])
def test_feed_dates(spark, value, want):
    got = one(spark, text.feed_date, value)
    assert (str(got) if got else None) == want


def test_title_tokens(spark):
    got = one(spark, text.title_tokens, "LIVE: Govt raises 1,00,000 cr fund by 5.5% — The Hindu")
    assert got["normalized"] == "government raises 100000 crore fund by 5.5 percent"
    assert got["unigrams"] == ["government", "raises", "100000", "crore", "fund", "5.5", "percent"]
    assert got["numbers"] == ["100000", "5.5"] and got["bigrams"][0] == "government raises"
    assert one(spark, text.clean_title, "Opinion: a view | Mint") == "a view"
    assert one(spark, text.title_tokens, "ﬁne ２０２６ café")["unigrams"] == ["fine", "2026", "caf"]


def test_similarity(spark):
    df = spark.createDataFrame([("isro launches navic satellite today", "isro launches navic satellite", "", "budget 5 percent", "budget 7 percent")], "a string, b string, e string, p string, q string")
    t = lambda c: text.title_tokens(F.col(c))
    r = df.select(
        similarity.title_similarity(t("a"), t("b")).alias("ab"), similarity.title_similarity(t("e"), t("e")).alias("ee"), similarity.title_similarity(t("a"), t("e")).alias("ae"),
        similarity.numeric_conflict(t("p")["numbers"], t("q")["numbers"]).alias("pq"), similarity.title_similarity(t("p"), t("q")).alias("s"),
    ).first()
    u = 0.5 * (8 / 9) + 0.5
    assert abs(r["ab"] - max(0.9 * u, 0.7 * u + 0.3 * 6 / 7)) < 1e-12
    assert r["ee"] == 0.5 and r["ae"] == 0 and r["pq"] and r["s"] < 0.3


@pytest.mark.parametrize("value, want", [
    ("HTTPS://Example.COM:443/a/../b?utm_source=x&id=1&fbclid=2#top", "https://example.com/b?id=1"), ("http://h.org", "http://h.org/"), ("https://h.org/p?x=1&amp;y=2", "https://h.org/p?x=1&y=2"),
    ("ftp://h.org/x", None), ("https://u:p@h.org/", None), ("not a url", None), (None, None), ("https://h.org:8080/p", "https://h.org:8080/p"),
])
def test_canonical_urls(spark, value, want):
    assert one(spark, urls.canonicalize, value) == want


@pytest.mark.parametrize("value, kind, reach", [
    ("127.0.0.1", "address", "loopback"), ("172.15.255.255", "address", "public"), ("172.16.0.0", "address", "private"), ("172.31.255.255", "address", "private"), ("172.32.0.0", "address", "public"),
    ("198.19.255.255", "address", "benchmarking"), ("198.20.0.0", "address", "public"), ("255.255.255.255", "address", "broadcast"), ("010.0.0.1", "name", None), ("[::1]", "address", "loopback"),
    ("[::ffff:10.0.0.1]", "address", "private"), ("[2001:db8::1]", "address", "documentation"), ("[2606:4700::1]", "address", "public"), ("[fe80::1]", "address", "link-local"), ("[::8.8.8.8]", "address", "reserved"),
    ("LOCALHOST.", "private-name", None), ("a.internal", "private-name", None), ("x.test", "reserved-name", None), ("www.example.com", "reserved-name", None), ("news.in", "name", None),
])
def test_hosts(spark, value, kind, reach):
    got = one(spark, urls.host_reach, value)
    assert (got["kind"], got["reach"]) == (kind, reach)


def test_facts(spark):
    said = "ISRO spent ₹1,00,000 crore and 15.0% in twelve days. The Supreme Court of India met on 22 August 2026 and Monday, 2026-08-24."
    assert {"₹1,00,000 crore", "100000", "15.0%", "15", "twelve", "12"} <= set(one(spark, facts.numbers, said))
    assert set(one(spark, facts.named_entities, said)) == {"ISRO", "Supreme Court of India"}
    assert set(one(spark, facts.dates, said)) == {"22 August 2026", "2026-08-24", "monday"}
    for raw, want in (("007", "7"), (".50", "0.5"), ("1.50", "1.5"), ("0", "0"), ("lakh", "100000"), ("abc", "abc"), ("12abc", "12")):
        assert one(spark, facts.canonical_number, raw) == want


def test_bounds(spark):
    assert one(spark, lambda c: text.bounded(c, 10, 20, "fallback text"), "short") == "short fallback text"
    assert one(spark, lambda c: text.bounded(c, 10, 20, "fallback text"), "a text that is much too long") == "a text that is mu..."
    assert one(spark, text.slug_to_name, "the-daily-news") == "The Daily News"
    assert one(spark, text.has_markup, "a<b held") is False and one(spark, text.has_markup, "x &nbsp; y") is True
    assert one(spark, text.is_hard_news, "Two wars, and floods") is True and one(spark, text.is_hard_news, "warm award") is False
