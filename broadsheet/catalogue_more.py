"""Registry and factual rules, scalars, lifecycle and reader functions as queries, with SQL beside each.

Suppliers are a source registry, orders are stories with two items each, events are responses of feed servers and acts of
readers; editions are those of catalogue_rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.catalogue import query, sql_list
from broadsheet.catalogue_rules import _WORDS_OF_STORY, BASE_SQL, Tables, editions_of
from broadsheet.functions import constants as K
from broadsheet.functions import text, urls
from broadsheet.operators import findings as N
from broadsheet.operators import lifecycle as L
from broadsheet.operators import ranking as R
from broadsheet.operators import reader as V
from broadsheet.operators import summaries as U
from broadsheet.session import table
from broadsheet.sources import feeds

# --- source registry --------------------------------------------------------------------------------------------------

_FEED = "CASE k % 8 WHEN 0 THEN 'https://10.0.0.' || (k % 200) || '/feed' WHEN 1 THEN 'https://www.news' || (k % 50) || '.org/feed' WHEN 2 THEN 'https://news' || (k % 50) || '.org/feed/' WHEN 3 THEN 'https://desk' || k || '.local/feed' WHEN 4 THEN 'https://x' || k || '.example.com/feed' ELSE 'https://news' || (k % 50) || '.org/feed' END"
_SITE = "CASE WHEN k % 12 = 0 THEN 'https://site' || k || '.example.org/' ELSE 'https://site' || k || '.org/' END"


def registry_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))
    kinds = F.array(*[F.lit(x) for x in ("official", "publisher", "research", "aggregator")])
    uses = F.when(F.col("k") % 3 == 0, F.array(F.lit("generated-summary"))).otherwise(F.array(F.lit("supplied-description")))
    return s.select(
        F.concat(F.lit("s"), F.col("k").cast("string")).alias("source_id"), F.expr(_FEED).alias("feedUrl"), F.expr(_SITE).alias("siteUrl"), F.lit(None).cast("string").alias("termsUrl"), F.lit(None).cast("string").alias("licenseUrl"),
        (F.col("k") % 6 != 1).alias("active"), F.expr("k % 8 = 4 OR k % 20 = 5").alias("sample"), F.concat(F.lit("use "), (F.col("k") % 60).cast("string")).alias("permittedUse"), uses.alias("permittedUses"),
        F.element_at(kinds, (F.col("s_nationkey") % 4 + 1).cast("int")).alias("sourceType"), F.col("s_name").alias("publisher"),
    )


_REGISTRY_SQL = f"""
    registry AS (SELECT 's' || k AS source_id, k, {_FEED} AS feed, {_SITE} AS site, k % 8 = 4 OR k % 20 = 5 AS sample, 'use ' || (k % 60) AS note, k % 6 <> 1 AS active FROM (SELECT s_suppkey AS k FROM supplier)),
    links AS (SELECT source_id, sample, 'feedUrl' AS path, feed AS url FROM registry UNION ALL SELECT source_id, sample, 'siteUrl', site FROM registry),
    hosts AS (SELECT *, CASE WHEN host SIMILAR TO '[0-9.]+' THEN 'address' WHEN host LIKE '%.local' THEN 'private-name' WHEN host SIMILAR TO '.*[.]example[.](com|org)' THEN 'reserved-name' ELSE 'name' END AS kind FROM (SELECT *, regexp_extract(url, '^https://([^/]+)', 1) AS host FROM links)),
    folded AS (SELECT source_id, feed, regexp_replace(regexp_replace(feed, '^https://www[.]', 'https://'), '/$', '') AS key FROM registry)"""
_REGISTRY_RULES = {
    "url/no-address-literal": "SELECT source_id, path AS detail FROM hosts WHERE kind = 'address'",
    "url/no-private-host": "SELECT source_id, path AS detail FROM hosts WHERE kind = 'private-name'",
    "sample/reserved-host-required": "SELECT source_id, host AS detail FROM hosts WHERE path = 'feedUrl' AND sample AND kind <> 'reserved-name'",
    "sample/reserved-host-only": "SELECT source_id, path AS detail FROM hosts WHERE NOT sample AND kind = 'reserved-name'",
    "url/mixed-host-classes": "SELECT NULL::VARCHAR AS source_id, count(*) FILTER (kind = 'reserved-name') || '/' || count(*) FILTER (kind = 'name') AS detail FROM hosts WHERE path = 'feedUrl'",
    "duplicate/near-feed-url": "SELECT min(source_id) AS source_id, string_agg(source_id, ',' ORDER BY source_id) AS detail FROM folded GROUP BY key HAVING count(*) >= 2 AND count(DISTINCT feed) >= 2",
    "duplicate/permitted-use-note": "SELECT min(source_id) AS source_id, string_agg(source_id, ',' ORDER BY source_id) AS detail FROM registry GROUP BY note HAVING count(*) >= 2",
}


def _registry_rule(rule: str, sql: str) -> None:
    @query("registry_" + rule.replace("/", "_").replace("-", "_"), f"WITH {_REGISTRY_SQL} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return N.registry_findings(registry_of(spark, sf_dir)).filter(F.col("rule_id") == rule).select("source_id", "detail")


for _rule, _sql in _REGISTRY_RULES.items():
    _registry_rule(_rule, _sql)

_BLOCKED = "SELECT source_id FROM hosts WHERE kind IN ('address', 'private-name') OR (path = 'feedUrl' AND sample AND kind <> 'reserved-name') OR (NOT sample AND kind = 'reserved-name')"


@query("fetchable_sources", f"WITH {_REGISTRY_SQL} SELECT source_id FROM registry WHERE active AND NOT sample AND source_id NOT IN ({_BLOCKED})")
def fetchable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that may be fetched; the finding on the registry as a whole is left out here, as it would stop all."""
    registry = registry_of(spark, sf_dir)
    return N.fetchable(registry, N.registry_findings(registry).filter("source_id is not null")).select("source_id")


@query("permitted_items", f"WITH {_REGISTRY_SQL} SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN registry ON k = l_suppkey WHERE active AND k % 3 = 0")
def permitted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("source_id", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    return N.permitted(items, registry_of(spark, sf_dir), "generated-summary").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("feed_keys", f"WITH {_REGISTRY_SQL} SELECT source_id, feed AS href, key FROM folded")
def feed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_of(spark, sf_dir).select("source_id", urls.feed_key(F.col("feedUrl")).alias("href"), urls.folded_feed_key(F.col("feedUrl")).alias("key"))


@query(
    "url_gate",
    """WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages)
       SELECT page_id, CASE WHEN url NOT LIKE 'https://%' THEN 'not-https' WHEN contains(url, '#') THEN 'fragment' WHEN host SIMILAR TO '(.*[.])?example[.](com|org|net)' THEN 'unsafe-host' END AS problem FROM u""",
)
def url_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.url_problem(F.col("url")).alias("problem"))


# --- responses --------------------------------------------------------------------------------------------------------

_STATUSES = [200, 200, 200, 304, 301, 302, 404, 408, 425, 429, 500, 503, 200, 206]
_TYPES = ["Application/RSS+XML; charset=utf-8", "text/html", "", "application/json"]


@query(
    "response_gate",
    f"""WITH r AS (SELECT event_id, ([{", ".join(map(str, _STATUSES))}])[event_id % {len(_STATUSES)} + 1] AS status, ({sql_list(_TYPES)})[event_id % {len(_TYPES)} + 1] AS type, event_id % 5 = 0 AS has_location,
            CASE WHEN event_id % 17 = 0 THEN 'many' WHEN event_id % 19 = 0 THEN '{2 * feeds.BODY_CAP}' ELSE '10' END AS length, CASE WHEN event_id % 23 = 0 THEN {feeds.BODY_CAP + 1} ELSE 10 END AS size FROM events)
        SELECT event_id, status IN (408, 425, 429) OR status >= 500 AS retry, lower(split_part(type, ';', 1)) AS media, CASE WHEN length = 'many' THEN 'invalid-content-length' WHEN length <> '10' THEN 'response-too-large' WHEN status = 304 THEN 'not-modified'
            WHEN status BETWEEN 300 AND 399 THEN CASE WHEN has_location THEN 'redirect' ELSE 'redirect-without-location' END WHEN status NOT BETWEEN 200 AND 299 THEN 'http-error' WHEN type = '' THEN 'missing-content-type'
            WHEN type = 'text/html' THEN 'unsupported-content-type' WHEN size > {feeds.BODY_CAP} THEN 'response-too-large' END AS problem FROM r""",
)
def response_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    length = F.when(i % 17 == 0, "many").when(i % 19 == 0, str(2 * feeds.BODY_CAP)).otherwise("10")
    headers = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("Content-Type"), pick(_TYPES)), F.struct(F.lit("CONTENT-LENGTH"), length), F.when(i % 5 == 0, F.struct(F.lit("Location"), F.lit("/b"))))))
    r = table(spark, sf_dir, "events").select("event_id", pick(_STATUSES).alias("status"), headers.alias("headers"), F.when(i % 23 == 0, feeds.BODY_CAP + 1).otherwise(10).alias("size"))
    media = feeds.media_type(feeds.header(F.col("headers"), "content-type"))
    return r.select("event_id", feeds.is_retryable(F.col("status")).alias("retry"), media.alias("media"), feeds.response_problem(F.col("status"), F.col("headers"), F.col("size")).alias("problem"))


# --- scalars ----------------------------------------------------------------------------------------------------------


@query("feed_dates", "SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 2 THEN epoch_ms(date_trunc('day', ts)) // 1000 WHEN 4 THEN epoch_ms(date_trunc('second', ts)) // 1000 - 19800 ELSE epoch_ms(date_trunc('second', ts)) // 1000 END::BIGINT AS seconds FROM events")
def feed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants written in the forms of feeds, and read again: RFC 822, ISO with and without a zone, a day, an offset, no date."""
    i, ts = F.col("event_id") % 6, F.col("ts")
    forms = ["EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "dd MMM yyyy HH:mm:ss '+0530'", "EEEE 'last'"]
    written = F.lit(None).cast("string")
    for n, form in enumerate(forms):
        written = F.when(i == n, F.date_format(ts, form)).otherwise(written)
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select("event_id", F.unix_timestamp(text.feed_date(written)).alias("seconds"))


@query("guids", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'doc & ' || doc_id || ' x' ELSE 'https://n.in/' || doc_id END AS guid FROM documents")
def guids(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    raw = F.when(i == 0, "  \t ").when(i == 1, F.concat(F.lit(" doc &amp;\n "), n, F.lit("  x "))).otherwise(F.concat(F.lit("https://N.in/"), n, F.lit("?utm_source=a#top")))
    return table(spark, sf_dir, "documents").select("doc_id", urls.guid(raw).alias("guid"))


@query(
    "build_ids",
    """WITH t AS (SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) AS t FROM nation GROUP BY n_regionkey)
       SELECT n_regionkey, lower(lpad(hex(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(t) + 1), lambda i: ascii(t[i])::HUGEINT)), lambda h, c: (xor(h, c) * 16777619::HUGEINT) % 4294967296::HUGEINT)::UBIGINT), 8, '0')) AS build_id FROM t""",
)
def build_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")).select("n_regionkey", text.build_id(F.col("names")).alias("build_id"))


@query(
    "part_texts",
    r"""WITH p AS (SELECT p_partkey, p_name, p_type, lower(replace(p_name, ' ', '-')) AS slug, CASE WHEN p_partkey % 7 = 0 THEN '../' ELSE '' END || p_name || CASE WHEN p_partkey % 11 = 0 THEN '//x' ELSE '/x' END AS path FROM part)
        SELECT p_partkey, array_to_string(list_transform(string_split(slug, '-'), lambda w: upper(w[1:1]) || w[2:]), ' ') AS name, replace(p_name || '|' || p_type, '|', '\|') AS escaped, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AS safe,
               CASE WHEN length(p_name) > 12 THEN rtrim(p_name[1:9]) || '...' WHEN length(p_name) >= 10 THEN p_name ELSE 'more words' END AS bounded FROM p""",
)
def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of slugs, escaped cells, safe paths, and texts within bounds."""
    p = table(spark, sf_dir, "part")
    path = F.concat(F.when(F.col("p_partkey") % 7 == 0, "../").otherwise(""), "p_name", F.when(F.col("p_partkey") % 11 == 0, "//x").otherwise("/x"))
    return p.select(
        "p_partkey", text.slug_to_name(F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("name"), text.escape_pipes(F.concat("p_name", F.lit("|"), "p_type")).alias("escaped"),
        text.safe_relative_name(path).alias("safe"), text.bounded(F.col("p_name"), 10, 12, "more words").alias("bounded"),
    )


@query(
    "source_features",
    f"""WITH t AS (SELECT l_orderkey, list_sort(list(DISTINCT (['official', 'publisher', 'research', 'aggregator'])[s_nationkey % 4 + 1])) AS kinds FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey)
        SELECT l_orderkey, CASE WHEN list_contains(kinds, 'official') THEN 1.0 WHEN list_contains(kinds, 'research') THEN 0.9 WHEN list_contains(kinds, 'publisher') THEN 0.8 ELSE 0.6 END::DOUBLE AS tier,
               CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 1.0 ELSE 0.8 END ELSE CASE WHEN l_orderkey % 2 = 0 THEN 0.6 ELSE 0.35 END END::DOUBLE AS relevance,
               coalesce(map({sql_list(list(K.TOPIC_WEIGHTS))}, {list(K.TOPIC_WEIGHTS.values())})[({sql_list([*K.TOPIC_WEIGHTS, "other"])})[l_orderkey % {len(K.TOPIC_WEIGHTS) + 1} + 1]], 0.7)::DOUBLE AS weight FROM t""",
)
def source_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best kind of a story's sources, relevance by region and title, and the topic's weight."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("official", "publisher", "research", "aggregator")]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.collect_set(kind).alias("kinds"))
    region = F.array(F.when(F.col("l_orderkey") % 3 == 0, "india").otherwise("europe"))
    tokens = text.title_tokens(F.when(F.col("l_orderkey") % 2 == 0, "Markets in India rise").otherwise("Markets rise"))
    names = [*K.TOPIC_WEIGHTS, "other"]
    topic = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("l_orderkey") % len(names) + 1).cast("int"))
    return t.select("l_orderkey", R.source_tier(F.col("kinds")).alias("tier"), F.round(R.india_relevance(tokens, region), 6).alias("relevance"), R.topic_weight(topic).alias("weight"))


# --- factual support --------------------------------------------------------------------------------------------------


def claims_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stories with two items: what they say is in the items or not, by the order's number."""
    k, n = F.col("o_orderkey"), (F.col("o_custkey") + 100).cast("string")
    first = (F.col("o_custkey") + 100 + (k % 3 == 0).cast("int"))
    opinion = F.when(k % 7 == 0, "Opinion: ").otherwise("")
    said = lambda x: F.concat(opinion, F.lit("Ministry reports "), x.cast("string"), F.lit(" cases"))
    item = lambda x, d: F.struct(F.lit("desk").alias("source_id"), said(x).alias("title"), F.lit(d).cast("string").alias("description"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), k.cast("string")).alias("story_id"), F.concat(F.lit("ministry reports "), n, F.lit(" cases")).alias("headline"), F.lit("update").alias("deck"), F.array(F.lit("said on monday")).alias("whatChanged"),
        F.concat(F.lit("noted by "), F.when(k % 4 == 0, "WHO").otherwise("NATO")).alias("whyItMatters"), none.alias("background"), none.alias("uncertainty"), F.array(F.when(k % 6 == 0, "other").otherwise("desk")).alias("sourceIds"),
        F.when(k % 2 == 1, "reporting").otherwise("opinion").alias("reportingType"), F.when(k % 16 == 0, "disputed").otherwise("single-source").alias("confidence"),
        F.array(F.lit("desk")).alias("sources"), F.array(item(first, "seen by NATO"), item(first + F.when(k % 8 == 0, 5).otherwise(0), None)).alias("items"),
    )


_CLAIMS_SQL = """found AS (
        SELECT 'c' || o_orderkey AS story_id, 'fact/number-containment' AS rule_id, 'blocking' AS severity, (o_custkey + 100)::VARCHAR AS ungrounded FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT 'c' || o_orderkey, 'fact/entity-containment', 'blocking', 'WHO' FROM orders WHERE o_orderkey % 4 = 0
        UNION ALL SELECT 'c' || o_orderkey, 'fact/date-containment', 'warning', 'monday' FROM orders WHERE strftime(o_orderdate + INTERVAL 330 MINUTE, '%A') <> 'Monday'
        UNION ALL SELECT 'c' || o_orderkey, 'fact/source-attribution', 'blocking', 'other' FROM orders WHERE o_orderkey % 6 = 0
        UNION ALL SELECT 'c' || o_orderkey, 'fact/editorial-alignment', 'blocking', '' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 2 = 1
        UNION ALL SELECT 'c' || o_orderkey, 'fact/uncertainty-on-conflict', 'blocking', '' FROM orders WHERE o_orderkey % 8 = 0 AND o_orderkey % 16 <> 0)"""


def _claim_rule(rule: str) -> None:
    @query("fact_" + rule.split("/")[1].replace("-", "_"), f"WITH {_CLAIMS_SQL} SELECT story_id, severity, ungrounded FROM found WHERE rule_id = '{rule}'")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = N.factual_findings(claims_of(spark, sf_dir), [rule])
        return found.select("story_id", "severity", F.array_join("ungrounded", ",").alias("ungrounded"))


for _name in ("number-containment", "entity-containment", "date-containment", "source-attribution", "editorial-alignment", "uncertainty-on-conflict"):
    _claim_rule(f"fact/{_name}")


@query(
    "factual_metrics",
    f"""WITH {_CLAIMS_SQL} SELECT s.story_id, count(rule_id) FILTER (severity = 'blocking') AS blocking, count(rule_id) FILTER (severity = 'warning') AS warnings, count(rule_id) FILTER (ungrounded <> '') AS ungrounded,
        CASE WHEN count(*) FILTER (rule_id = 'fact/source-attribution') > 0 THEN 0 ELSE 1 END::INT AS attribution_score FROM (SELECT 'c' || o_orderkey AS story_id FROM orders) s LEFT JOIN found f USING (story_id) GROUP BY s.story_id""",
)
def factual_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = claims_of(spark, sf_dir)
    m = N.factual_metrics(stories, N.factual_findings(stories))
    return m.select("story_id", F.col("blocking").cast("long").alias("blocking"), F.col("warnings").cast("long").alias("warnings"), F.col("ungrounded").cast("long").alias("ungrounded"), F.col("attribution_score").cast("int").alias("attribution_score"))


# --- lifecycle --------------------------------------------------------------------------------------------------------

_NOW = "2026-08-01T00:00:00Z"


@query("publish_drafts", f"WITH {BASE_SQL} SELECT file, 'published' AS status, count(*) AS reviewed, '{_NOW}' AS updated FROM stories WHERE status = 'draft' GROUP BY file")
def publish_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = editions_of(spark, sf_dir).filter("status = 'draft'").withColumn("editionVersion", F.lit(1)).withColumn("correctionNotes", F.array().cast(f"array<{N.NOTE}>"))
    out = L.publish(drafts, _NOW)
    return out.select("file", "status", F.size(F.filter("stories", lambda s: s["reviewed"] & (s["updatedAt"] == _NOW))).cast("long").alias("reviewed"), F.col("updatedAt").alias("updated"))


_MINUTES_SQL = f"""SELECT file, greatest(1, least(60, ceil(sum(words) / {K.WORDS_PER_MINUTE})))::INT AS minutes FROM (
    SELECT file, slot, words, row_number() OVER (PARTITION BY file, slot < {K.CORE_STORIES} ORDER BY words DESC, id) AS r FROM (SELECT *, {_WORDS_OF_STORY} AS words FROM stories)) WHERE slot < {K.CORE_STORIES} OR r <= {K.POOLED_VISIBLE} GROUP BY file"""


@query("edition_minutes", f"WITH {BASE_SQL} {_MINUTES_SQL}")
def edition_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editions_of(spark, sf_dir).select("file", L.minutes(F.col("stories"), F.col("coreStoryIds")).alias("minutes"))


@query(
    "correct_editions",
    f"""WITH {BASE_SQL}, first AS (SELECT file, min_by(id, pos) AS story FROM stories WHERE status <> 'draft' GROUP BY file)
        SELECT file, 'corrected' AS status, (version + 1)::INT AS version, (SELECT count(*) FROM notes n WHERE n.file = e.file) + 1 AS notes, 'corr-' || story || '-v' || (version + 1) AS note, 'New headline' AS headline FROM editions e JOIN first USING (file)""",
)
def correct_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first story of each published edition gets another headline; file stands for the date, which days share."""
    editions = editions_of(spark, sf_dir).filter("status <> 'draft'").withColumn("date", F.col("file"))
    fixes = editions.select("date", F.col("stories")[0]["id"].alias("storyId"), F.lit("fixed").alias("summary"), F.lit(None).cast("string").alias("detail"), F.lit("New headline").alias("headline"))
    out = L.correct(editions, fixes, _NOW)
    return out.select("file", "status", F.col("editionVersion").alias("version"), F.size("correctionNotes").cast("long").alias("notes"), F.element_at("correctionNotes", -1)["id"].alias("note"), F.col("stories")[0]["headline"].alias("headline"))


@query("withdraw_editions", f"WITH {BASE_SQL} SELECT file, CASE WHEN status = 'published' AND g % 2 = 0 THEN 'draft' ELSE status END AS status, count(*) FILTER (reviewed AND NOT (status = 'published' AND g % 2 = 0)) AS reviewed FROM stories GROUP BY file, g, status")
def withdraw_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    editions = editions_of(spark, sf_dir).withColumn("date", F.col("file"))
    gone = editions.filter(F.regexp_extract("file", r"^e(\d+)", 1).cast("long") % 2 == 0).agg(F.collect_list("date").alias("withdrawn"))
    out = L.withdraw(editions, gone)
    return out.select("file", "status", F.size(F.filter("stories", lambda s: s["reviewed"])).cast("long").alias("reviewed"))


@query("staged_index", f"WITH {BASE_SQL} SELECT 1 AS version, 'published' AS content, max(date) AS latest, count(DISTINCT date)::INT AS editions FROM editions WHERE status = 'published'")
def staged_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = editions_of(spark, sf_dir).select("file", "date", F.lit(0).alias("blocking"), F.lit(0).alias("warnings"), (F.col("status") == "published").alias("publishable"))
    index = L.staged_index(L.staging_plan(reports))
    ok = index.crossJoin(L.index_problems(index).agg(F.count("*").alias("bad"))).filter("bad = 0")  # one row
    return ok.select(F.col("schemaVersion").alias("version"), F.col("contentSet").alias("content"), "latest", F.size("editions").alias("editions"))


@query("precache_plan", "SELECT name, CASE WHEN k % 7 = 0 THEN 'refuse' ELSE 'cache' END AS action FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN '../' WHEN p_partkey % 3 = 0 THEN 'content/' ELSE '' END || p_partkey || '.js' AS name FROM part) WHERE name NOT LIKE 'content/%' AND name <> '1.js'")
def precache_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    names = table(spark, sf_dir, "part").select(F.concat(F.when(k % 7 == 0, "../").when(k % 3 == 0, "content/").otherwise(""), k.cast("string"), F.lit(".js")).alias("name"))
    return L.precache(names, ["1.js"])


@query("cache_removals", "SELECT DISTINCT 'edition-' || strftime(o_orderdate, '%Y-%m-%d') AS name FROM orders WHERE o_orderstatus <> 'F' AND strftime(o_orderdate, '%Y-%m-%d') NOT IN (SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderstatus = 'F')")
def cache_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caches with the engine's prefix that no kept edition names; others are let alone."""
    name = F.concat(F.lit("edition-"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("name")
    orders = table(spark, sf_dir, "orders")
    existing = orders.select(name).unionByName(orders.select(F.concat(F.lit("other-"), F.col("o_orderkey").cast("string")).alias("name")))
    return L.prefixed_removals(existing, orders.filter("o_orderstatus = 'F'").select(name), "edition-")


@query(
    "system_status",
    f"""WITH {BASE_SQL} SELECT (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS registry_blocking, count(*) AS n, count(*) FILTER (status = 'published') AS publishable, count(*) FILTER (version = 3) AS blocked,
        CASE WHEN count(*) FILTER (status = 'published') = 0 THEN 'offline' WHEN (SELECT count(*) FROM supplier WHERE s_acctbal < 0) > 0 THEN 'degraded' WHEN count(*) FILTER (version = 3) > 0 THEN 'warning' ELSE 'healthy' END AS status FROM editions""",
)
def system_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") < 0, "blocking").otherwise("warning").alias("severity"))
    reports = editions_of(spark, sf_dir).select("file", "date", (F.col("editionVersion") == 3).cast("int").alias("blocking"), F.lit(0).alias("warnings"), (F.col("status") == "published").alias("publishable"))
    out = L.system_status(registry, reports, L.staged_index(L.staging_plan(reports)))
    return out.select("registry_blocking", "n", "publishable", "blocked", "status")


@query(
    "health_rollup",
    f"""WITH last AS (SELECT max(ts) AS now FROM events), f AS (SELECT user_id, max(ts) AS seen, max(value) AS slow, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id)
        SELECT count(*) FILTER (s = 'healthy') AS healthy, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s = 'failing') AS failing
        FROM (SELECT CASE WHEN failed THEN 'failing' WHEN slow * 100 > {K.SLOW_MS} OR now - seen > INTERVAL 72 HOURS THEN 'warning' ELSE 'healthy' END AS s FROM f, last)""",
)
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from broadsheet.catalogue import source_health

    return N.health_rollup(source_health(spark, sf_dir))


_GOLDEN = ["prompt", "fallback", "golden", "trap"]


@query("golden_metrics", "SELECT " + ", ".join(f"coalesce(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) FILTER (event_id % 4 = {k}), 1.0) AS {n}_rate" for k, n in enumerate(_GOLDEN)) + " FROM events")
def golden_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in _GOLDEN]), (F.col("event_id") % 4 + 1).cast("int"))
    return U.golden_metrics(table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), (F.col("event_type") != "error").alias("passed")))


@query(
    "composition_diagnostics",
    """WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS edition, CASE WHEN o_orderkey % 9 < 2 THEN 'selected_core' WHEN o_orderkey % 9 < 5 THEN 'selected_topic_pool' ELSE 'rejected' END AS decision, o_custkey % 5 AS p, o_orderkey % 3 AS t FROM orders)
       SELECT edition, count(*) AS total_evaluated, count(*) FILTER (decision = 'selected_core') AS core_count, count(*) FILTER (decision = 'selected_topic_pool') AS pool_count, count(DISTINCT p) FILTER (decision = 'selected_core') AS publishers_in_core,
              count(*) FILTER (decision = 'selected_core' AND t = 0) AS core_sports FROM c GROUP BY edition""",
)
def composition_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    decision = F.when(k % 9 < 2, "selected_core").when(k % 9 < 5, "selected_topic_pool").otherwise("rejected")
    composed = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("edition"), decision.alias("decision"), (F.col("o_custkey") % 5).cast("string").alias("primary_source_id"), F.when(k % 3 == 0, "sports").otherwise("india").alias("topic"))
    return R.diagnostics(composed).select("edition", "total_evaluated", "core_count", "pool_count", "publishers_in_core", "core_sports")


# --- reader -----------------------------------------------------------------------------------------------------------


@query("core_lists", f"WITH {BASE_SQL} SELECT file, (row_number() OVER (PARTITION BY file ORDER BY slot) - 1)::INT AS position, id AS story_id FROM core")
def core_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.core_list(editions_of(spark, sf_dir).withColumn("date", F.col("file"))).select(F.col("date").alias("file"), "position", "story_id")


@query("pool_lists", f"WITH {BASE_SQL} SELECT file, topic AS interest, (row_number() OVER (PARTITION BY file, topic ORDER BY slot) - 1)::INT AS position, id AS story_id FROM stories WHERE slot >= {K.CORE_STORIES}")
def pool_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pools_of(editions_of(spark, sf_dir).withColumn("date", F.col("file"))).select(F.col("date").alias("file"), "interest", "position", "story_id")


@query(
    "reader_notices",
    f"""WITH t AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN ts::DATE < (SELECT max(ts)::DATE FROM events) THEN 'stale' ELSE 'current' END ELSE 'archived' END AS fresh, CASE WHEN event_id % 2 = 0 THEN 'cache' ELSE 'network' END AS source FROM events)
        SELECT event_id, fresh, CASE {" ".join(f"WHEN fresh = '{f}' AND source = '{s}' THEN '{w.replace(chr(39), chr(39) * 2)}'" for f, s, w in V.NOTICES)} END AS notice FROM t""",
)
def reader_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = F.broadcast(events.agg(F.to_date(F.max("ts")).alias("today")))  # one row
    t = events.crossJoin(last).select("event_id", V.freshness(F.when(F.col("event_id") % 3 == 0, "latest").otherwise("edition"), F.to_date("ts"), F.col("today")).alias("fresh"))
    return t.select("event_id", "fresh", V.notice(F.col("fresh"), F.when(F.col("event_id") % 2 == 0, "cache").otherwise("network")).alias("notice"))


@query(
    "reader_routes",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'latest' WHEN 1 THEN 'edition' ELSE 'unknown' END AS kind, CASE WHEN event_id % 4 = 1 THEN strftime(ts, '%Y-%m-%d') END AS date, CASE event_id % 3 WHEN 0 THEN 'usable' WHEN 1 THEN 'foreign' ELSE 'replaceable' END AS state,
              CASE WHEN event_id % 5 = 1 THEN 'single source' ELSE (event_id % 5) || ' sources' END AS label FROM events""",
)
def reader_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of readers, the kind of their stored state, and labels of source counts."""
    i = F.col("event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    path = F.when(i % 4 == 0, "/").when(i % 4 == 1, F.concat(F.lit("/editions/"), day, F.lit("/"))).when(i % 4 == 2, F.concat(F.lit("/stories/"), day)).otherwise("/editions/2026-02-31")
    state = F.when(i % 3 == 0, '{"schemaVersion": 1}').when(i % 3 == 1, '{"schemaVersion": 7, "x": []}').otherwise("{no json")
    r = table(spark, sf_dir, "events").select("event_id", V.route(path).alias("r"), V.state_kind(state).alias("state"), V.source_count_label(i % 5).alias("label"))
    return r.select("event_id", "r.kind", "r.date", "state", "label")


@query(
    "reader_choices",
    f"""WITH c AS (SELECT user_id, arg_max(event_id, event_id) AS e FROM events GROUP BY user_id)
        SELECT user_id AS reader_id, array_to_string(list_sort([t for t in list_distinct([({sql_list([*K.INTEREST_TOPICS, 'unknown'])})[e % {len(K.INTEREST_TOPICS) + 1} + 1], ({sql_list(K.INTEREST_TOPICS)})[e % {len(K.INTEREST_TOPICS)} + 1]]) if t <> 'unknown']), ',') AS interests,
               CASE e % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'dark' ELSE 'system' END AS theme FROM c""",
)
def reader_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader's last choice: known interests, sorted, and a theme."""
    e = F.col("event_id")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (e % len(xs) + 1).cast("int"))
    choices = table(spark, sf_dir, "events").select(F.col("user_id").alias("reader_id"), e.alias("at"), F.array(pick([*K.INTEREST_TOPICS, "unknown"]), pick(K.INTEREST_TOPICS)).alias("interests"), pick(["light", "dark", "blue"]).alias("theme"))
    return V.last_choice(choices).select("reader_id", F.array_join("interests", ",").alias("interests"), "theme")




# --- feeds ------------------------------------------------------------------------------------------------------------

_RSS = "<rss><channel><item><guid>r-{i}</guid><title><![CDATA[ Title {i} ]]></title><dc:creator>Ann &amp; Bo</dc:creator><description>d</description><link>https://n.in/{i}</link><pubDate>x</pubDate></item><item><link>https://n.in/{i}/b</link><title>Second</title></item></channel></rss>"
_ATOM = "<feed><entry><id>a-{i}</id><title type='text'>Title {i}</title><link rel=\"self\" href=\"https://n.in/self\"/><link href='https://n.in/{i}' rel='alternate'/><updated>u</updated><author><name>N</name></author><summary>s</summary></entry><entry><title>Second</title><link href=\"https://n.in/{i}/b\"/><published>p</published></entry></feed>"
_JSON = '{"items": [{"id": "j-{i}", "title": "Title {i}", "content_text": "c", "author": {"name": "N"}, "url": "https://n.in/{i}", "date_published": "p"}, {"url": "https://n.in/{i}/b", "title": "Second"}]}'


@query(
    "feed_scan",
    """WITH e AS (SELECT event_id AS i, event_id % 3 AS k, unnest([0, 1]) AS n FROM events)
       SELECT i AS event_id, n::INT AS item_ordinal, CASE WHEN n = 1 THEN 'https://n.in/' || i || '/b' ELSE (['r-', 'a-', 'j-'])[k + 1] || i END AS guid, CASE WHEN n = 1 THEN 'Second' ELSE 'Title ' || i END AS title,
              CASE WHEN n = 0 THEN (['Ann & Bo', 'N', 'N'])[k + 1] END AS author, CASE WHEN n = 0 THEN (['d', 's', 'c'])[k + 1] END AS description, 'https://n.in/' || i || CASE WHEN n = 1 THEN '/b' ELSE '' END AS link,
              CASE WHEN n = 0 THEN (['x', 'u', 'p'])[k + 1] WHEN k = 1 THEN 'p' END AS published_at, CASE WHEN n = 0 AND k = 1 THEN 'u' END AS updated_at FROM e""",
)
def feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of three formats, two items each, and the raw items that are read from them."""
    i = F.col("event_id")
    filled = lambda body: F.replace(F.lit(body), F.lit("{i}"), i.cast("string"))
    body = F.when(i % 3 == 0, filled(_RSS)).when(i % 3 == 1, filled(_ATOM)).otherwise(filled(_JSON))
    kind = F.when(i % 3 == 0, "text/xml").when(i % 3 == 1, "application/atom+xml").otherwise("application/json")
    items = feeds.parse_feeds(table(spark, sf_dir, "events").select(i.cast("string").alias("source_id"), kind.alias("content_type"), body.alias("body")))
    return items.select(F.col("source_id").cast("long").alias("event_id"), "item_ordinal", *feeds.FIELDS)


@query(
    "model_answers",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'malformed' ELSE 'cites other sources' END AS problem, CASE WHEN event_id % 3 <> 1 THEN 'Head ' || event_id END AS headline FROM events""",
)
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model with and without a code fence: usable, no JSON, or citing what it wasn't given."""
    i = F.col("event_id")
    said = F.replace(F.replace(F.lit('{"headline": "Head {i}", "whatChanged": [{"sentence": "x", "sourceIds": ["{s}"]}]}'), F.lit("{i}"), i.cast("string")), F.lit("{s}"), F.when(i % 3 == 0, "a").otherwise("b"))
    raw = F.when(i % 3 == 1, "no answer").when(i % 2 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said)
    return table(spark, sf_dir, "events").select("event_id", U.parse_answer(raw, F.array(F.lit("a"))).alias("r")).select("event_id", "r.problem", F.col("r.answer.headline").alias("headline"))


@query(
    "edition_texts",
    f"""WITH {BASE_SQL}, found AS (SELECT file, 'warning url/https-only: ' || id AS line FROM sources WHERE url LIKE 'http://%')
        SELECT file, string_agg(line, chr(10) ORDER BY line) AS report FROM found GROUP BY file""",
)
def edition_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one rule as a text a file."""
    from broadsheet.sources.documents import text_report

    rule = next(r for r in N.EDITION_RULES if r.id == "url/https-only")
    found = rule.find(Tables(spark, sf_dir))
    return text_report(found.withColumn("rule_id", F.lit(rule.id)).withColumn("severity", F.lit(rule.severity)))
