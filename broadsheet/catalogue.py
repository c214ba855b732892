"""Queries of the news engine by name, with their DuckDB counterparts.

Tables play the engine's roles: documents are raw items (source, first line as title, the rest as description), pages are
links and bodies, events are fetches and readers' acts, orders and line items are stories and their citations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.functions import constants as K
from broadsheet.functions import facts, text, urls
from broadsheet.operators import clusters as C
from broadsheet.operators import findings as N
from broadsheet.operators import items as I
from broadsheet.operators import lifecycle as L
from broadsheet.operators import ranking as R
from broadsheet.operators import reader as V
from broadsheet.operators import summaries as U
from broadsheet.plans import draft as D
from broadsheet.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: The flagship: the draft of each day's edition, from raw documents to composed candidates.
FLAGSHIP = "draft_candidates"

# --- documents as items ----------------------------------------------------------------------------------------------

EPOCH = "2026-01-01 00:00:00"


def items_of(spark: SparkSession, sf_dir: str, title_cap: int | None = None, description_cap: int | None = None) -> DataFrame:
    """Documents as normal items, whole or cut as feeds are; one an hour over 30 days, again and again."""
    cut = lambda t, cap: t if cap is None else text.truncated(t, cap)
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    title = cut(F.split_part(body, F.lit("\n"), F.lit(1)), title_cap)
    rest = cut(F.when(F.instr(body, "\n") > 0, F.expr("substring(coalesce(text, ''), instr(coalesce(text, ''), '\n') + 1)")).otherwise(F.lit("")), description_cap)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.pmod("doc_id", F.lit(720)) * 3600)
    base = docs.select("doc_id", F.col("source").alias("source_id"), F.col("doc_id").alias("item_ordinal"), title.alias("title"), rest.alias("description"), "lang", "n_chars", at.alias("published_at"))
    hashed = base.withColumn("content_hash", text.content_hash(F.col("title"), F.col("description")))
    return hashed.withColumn("guid", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).withColumn("url", F.lit(None).cast("string"))


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, cut as normalised feed items are."""
    return items_of(spark, sf_dir, K.TITLE_CAP, K.DESCRIPTION_CAP)


_ITEMS_SQL = """
    docs AS (
        SELECT doc_id, source AS source_id, lang, n_chars, coalesce(text, '') AS body, epoch_ms(make_timestamp(2026, 1, 1, 0, 0, 0)) + (doc_id % 720) * 3600000 AS at_ms FROM documents
    ), items AS (
        SELECT *, split_part(body, chr(10), 1) AS title, CASE WHEN contains(body, chr(10)) THEN substring(body, strpos(body, chr(10)) + 1) ELSE '' END AS description
        FROM docs
    )"""

_S = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}]"


def _clean_sql(title: str) -> str:
    t = f"regexp_replace({title}, '^{_S}+|{_S}+$', '', 'g')"
    for label in K.LEADING_LABELS:
        t = f"regexp_replace(regexp_replace({t}, '{label}', '', 'i'), '^{_S}+|{_S}+$', '', 'g')"
    return f"regexp_replace(regexp_replace({t}, '{K.TRAILING_PUBLISHERS}', '', 'i'), '^{_S}+|{_S}+$', '', 'g')"


def _normalized_sql(title: str) -> str:
    t = f"lower({_clean_sql(title)})"
    for _ in range(2):
        t = f"regexp_replace({t}, '([0-9]),([0-9])', '\\1\\2', 'g')"
    t = f"replace({t}, '%', ' percent ')"
    for short, full in (("pts", "points"), ("cr", "crore"), ("lac", "lakh"), ("govt", "government")):
        t = f"regexp_replace({t}, '\\b{short}\\b', '{full}', 'g')"
    t = f"regexp_replace({t}, '[^A-Za-z0-9_.\\s\\x{{a0}}-]', ' ', 'g')"
    return f"trim(regexp_replace({t}, '{_S}+', ' ', 'g'))"


_NUMBER_SQL = r"^[0-9]+(\.[0-9]+)?$"
_TOKENS_SQL = (
    _ITEMS_SQL
    + f"""
    , norms AS (SELECT *, {_normalized_sql("title")} AS normalized FROM items
    ), parts AS (
        SELECT *, list_filter(
            list_transform(list_filter(string_split(normalized, ' '), lambda w: w <> ''), lambda w: regexp_replace(w, '^[.-]+|[.-]+$', '', 'g')),
            lambda t: regexp_matches(t, '{_NUMBER_SQL}') OR (length(t) >= 2 AND NOT list_contains({sql_list(K.TITLE_STOP_WORDS)}, t))) AS significant FROM norms
    ), uniq AS (
        SELECT *, list_filter(significant, lambda t, i: list_position(significant, t) = i) AS unigrams,
               CASE WHEN len(significant) < 2 THEN [] ELSE list_transform(range(2, len(significant) + 1), lambda i: significant[i - 1] || ' ' || significant[i]) END AS pairs FROM parts
    ), tokens AS (
        SELECT *, list_filter(pairs, lambda t, i: list_position(pairs, t) = i) AS bigrams, list_filter(unigrams, lambda t: regexp_matches(t, '{_NUMBER_SQL}')) AS numbers FROM uniq
    )"""
)


@query(
    "title_tokens",
    f"WITH {_TOKENS_SQL} SELECT doc_id, normalized, array_to_string(unigrams, ' ') AS unigrams, array_to_string(bigrams, '|') AS bigrams, array_to_string(numbers, ' ') AS numbers FROM tokens",
)
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = items_of(spark, sf_dir).select("doc_id", text.title_tokens(F.col("title")).alias("t"))
    return t.select("doc_id", "t.normalized", F.array_join("t.unigrams", " ").alias("unigrams"), F.array_join("t.bigrams", "|").alias("bigrams"), F.array_join("t.numbers", " ").alias("numbers"))


@query("title_token_df", f"WITH {_TOKENS_SQL} SELECT token, count(*) AS n_items FROM (SELECT unnest(unigrams) AS token FROM tokens) GROUP BY token")
def title_token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = items_of(spark, sf_dir).select(F.explode(text.title_tokens(F.col("title"))["unigrams"]).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n_items"))


_EDITORIAL_SQL = f"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND NOT list_contains({sql_list(K.EDITORIAL_STOP_WORDS)}, w))"


@query("editorial_tokens", f"SELECT doc_id, len(list_distinct({_EDITORIAL_SQL}))::INT AS n_tokens, array_to_string(list_sort(list_distinct({_EDITORIAL_SQL})), ' ') AS tokens FROM documents")
def editorial_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.editorial_tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.array_join(F.array_sort(tokens), " ").alias("tokens"))


@query(
    "word_counts",
    rf"""SELECT doc_id, len(list_filter(ws, lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')))::INT AS rule_words, len(list_filter(ws, lambda w: w <> ''))::INT AS visible_words
         FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{_S}+') AS ws FROM documents)""",
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.rule_word_count(body).alias("rule_words"), text.visible_word_count(body).alias("visible_words"))


@query(
    "content_hash_groups",
    f"""WITH {_ITEMS_SQL}, bytes AS (SELECT doc_id, lower(title) || chr(31) || description AS t FROM items),
        texts AS (SELECT t, min(doc_id) AS first_doc, count(*) AS n_items FROM bytes GROUP BY t),
        hashed AS (SELECT *, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, len(d) + 1, 2), lambda i: ((strpos('0123456789ABCDEF', d[i]) - 1) * 16 + strpos('0123456789ABCDEF', d[i + 1]) - 1)::HUGEINT)),
            lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM (SELECT *, string_split(hex(encode(t)), '') AS d FROM texts))
        SELECT lower(lpad(hex(h::UHUGEINT), 16, '0')) AS content_hash, first_doc, n_items FROM hashed""",
)
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of(spark, sf_dir).groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_items"))


@query(
    "exact_duplicate_links",
    f"WITH {_ITEMS_SQL} SELECT doc_id, first AS first_doc, 'content-hash' AS reason FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(title), description) AS first FROM items) WHERE first <> doc_id",
)
def exact_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each duplicate tied to the first item of its content; pairs are not expanded."""
    items = items_of(spark, sf_dir).select("doc_id", "content_hash")
    first = items.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"))
    return items.join(first, "content_hash").filter("doc_id <> first_doc").select("doc_id", "first_doc", F.lit("content-hash").alias("reason"))


_SIMILARITY_SQL = f"""
    uni AS (SELECT *, CASE WHEN na + nb = 0 THEN 1.0 ELSE 2.0 * common / (na + nb) END AS dice, CASE WHEN least(na, nb) = 0 THEN 0.0 ELSE common / least(na, nb) END AS over,
            CASE WHEN pa + pb = 0 THEN 1.0 ELSE 2.0 * pairs / (pa + pb) END AS bidice FROM measured
    ), scored AS (
        SELECT *, CASE WHEN pa > 0 AND pb > 0 THEN greatest({K.UNIGRAM_FLOOR} * (0.5 * dice + 0.5 * over), {K.UNIGRAM_SHARE} * (0.5 * dice + 0.5 * over) + {K.BIGRAM_SHARE} * bidice)
                       ELSE 0.5 * dice + 0.5 * over END AS score FROM uni
    )"""


@query(
    "near_dup_pairs",
    f"""WITH {_TOKENS_SQL}, measured AS (
        SELECT a.doc_id AS a, b.doc_id AS b, len(a.unigrams) AS na, len(b.unigrams) AS nb, len(a.bigrams) AS pa, len(b.bigrams) AS pb,
               len(list_intersect(a.unigrams, b.unigrams)) AS common, len(list_intersect(a.bigrams, b.bigrams)) AS pairs
        FROM tokens a JOIN tokens b ON a.doc_id < b.doc_id AND abs(a.at_ms - b.at_ms) <= {K.NEAR_HOURS} * 3600000
        WHERE (lower(a.title) <> lower(b.title) OR a.description <> b.description)
          AND NOT (len(a.numbers) > 0 AND len(b.numbers) > 0 AND len(list_intersect(a.numbers, b.numbers)) = 0)
        ), {_SIMILARITY_SQL}
        SELECT a, b, round(score, 6) AS score, common::INT AS common FROM scored WHERE common >= least({K.NEAR_TOKENS}, na, nb) AND score >= {K.NEAR_SCORE} AND NOT (na = 0 AND nb = 0)""",
)
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = C.with_tokens(items_of(spark, sf_dir)).withColumn("node", F.col("doc_id"))
    return C.near_pairs(items, bare=False).select("a", "b", F.round("score", 6).alias("score"), "common")


def _keyed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose ids repeat in their source, as feeds that reuse them do."""
    items = items_of(spark, sf_dir)
    return items.withColumn("guid", F.concat_ws("-", "lang", F.pmod("n_chars", F.lit(97)).cast("string"))).withColumn("url", F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("https://"), "source_id", F.lit("/"), F.pmod("n_chars", F.lit(89)).cast("string"))))


@query(
    "dedup_first_wins",
    f"""WITH RECURSIVE {_ITEMS_SQL}, keyed AS (
        SELECT source_id, doc_id, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) AS r,
               ['guid:' || lang || '-' || (n_chars % 97), CASE WHEN n_chars % 3 = 0 THEN 'url:' || source_id || (n_chars % 89) ELSE 'hash:' || lower(title) || chr(31) || description END] AS keys FROM items
        ), fold AS (
            SELECT source_id, doc_id, r, true AS kept, keys AS seen FROM keyed WHERE r = 1
            UNION ALL
            SELECT k.source_id, k.doc_id, k.r, NOT list_has_any(f.seen, k.keys), CASE WHEN list_has_any(f.seen, k.keys) THEN f.seen ELSE list_concat(f.seen, k.keys) END
            FROM fold f JOIN keyed k ON k.source_id = f.source_id AND k.r = f.r + 1
        ) SELECT source_id, doc_id, kept FROM fold""",
)
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dedup_first_wins(_keyed_items(spark, sf_dir)).select("source_id", "doc_id", "kept")


@query("story_clusters")
def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of all documents; no SQL form: tests hold it against a plain sequential run."""
    return C.clusters(C.cluster_items(feed_items(spark, sf_dir))).drop("leader")




def _re2(pattern: str) -> str:
    return pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")


@query(
    "fact_numbers",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{_re2(facts.NUMBER)}'), lambda t: trim(t)))), ' ') AS numerals FROM documents""",
)
def fact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(facts.numerals(F.coalesce("text", F.lit("")))), " ").alias("numerals"))


@query(
    "fact_entities",
    f"""WITH found AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_re2(facts.ACRONYM)}') AS acronyms,
            list_transform(regexp_extract_all(coalesce(text, ''), '{_re2(facts.PHRASE)}'), lambda p: regexp_split_to_array(p, '\\s+')) AS phrases,
            regexp_extract_all(coalesce(text, ''), '{_re2(facts.PHRASE)}') AS whole FROM documents),
        named AS (SELECT doc_id, acronyms, list_filter(list_transform(range(1, len(phrases) + 1), lambda i: CASE
            WHEN list_contains({sql_list(K.COMMON_INITIAL_WORDS)}, lower(phrases[i][1])) AND len(phrases[i]) > 2 THEN array_to_string(phrases[i][2:], ' ')
            WHEN NOT list_contains({sql_list(K.COMMON_INITIAL_WORDS)}, lower(phrases[i][1])) THEN whole[i] END), lambda p: p IS NOT NULL) AS names FROM found)
        SELECT doc_id, len(list_distinct(list_concat(acronyms, names)))::INT AS n_entities, md5(array_to_string(list_sort(list_distinct(list_concat(acronyms, names))), '|')) AS entities FROM named""",
)
def fact_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.named_entities(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_entities"), F.md5(F.array_join(F.array_sort(found), "|")).alias("entities"))


@query(
    "fact_dates",
    f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '{_re2(facts.ISO_DATE)}'), list_transform(regexp_extract_all(text, '{_re2(facts.MONTH_DATE)}'), lambda d: trim(d))),
            list_filter({sql_list([*K.WEEKDAYS, *K.RELATIVE_DATES])}, lambda w: regexp_matches(lower(text), '\\b' || w || '\\b'))))), '|') AS dates FROM t""",
)
def fact_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(facts.dates(F.coalesce("text", F.lit("")))), "|").alias("dates"))


@query(
    "number_containment",
    f"""WITH said AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS token FROM benchmark),
        known AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS token FROM documents)
        SELECT item_id, token FROM said WHERE token NOT IN (SELECT token FROM known)""",
)
def number_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits that a benchmark item says and no document does."""
    digits = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0)))).alias("token")).distinct()
    return digits(table(spark, sf_dir, "benchmark"), "item_id").join(digits(table(spark, sf_dir, "documents")), "token", "left_anti").select("item_id", "token")


def _topic_sql() -> str:
    scores = [f"{{'score': 3 * len(list_intersect({sql_list(ws)}, words)) + len(list_filter(list_intersect({sql_list(ws)}, texts), lambda w: NOT list_contains(words, w))), 'first': {-k}, 'topic': '{topic}'}}" for k, (topic, ws) in enumerate(K.TOPIC_KEYWORDS.items())]
    return f"list_max([{', '.join(scores)}])"


@query(
    "topic_classify",
    f"""WITH {_TOKENS_SQL}, of_texts AS (SELECT doc_id, list_concat(unigrams, bigrams) AS words FROM tokens), best AS (SELECT doc_id, {_topic_sql().replace("texts", "words")} AS b FROM of_texts)
        SELECT doc_id, CASE WHEN b.score > 0 THEN b.topic ELSE 'india' END AS topic, b.score::INT AS score FROM best""",
)
def topic_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by title; descriptions count only where a source permits it, and none does here."""
    t = items_of(spark, sf_dir).select("doc_id", R.topic_of(F.col("title"), F.array().cast("array<string>")).alias("t"))
    return t.select("doc_id", "t.topic", F.col("t.score").cast("int").alias("score"))


def _first_line(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key), text.title_tokens(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)))["unigrams"].alias("unigrams"))


@query(
    "repetition_penalty",
    f"""WITH {_TOKENS_SQL}, recent AS (
            SELECT item_id, list_distinct(list_filter(list_transform(list_filter(string_split(n, ' '), lambda w: w <> ''), lambda w: regexp_replace(w, '^[.-]+|[.-]+$', '', 'g')),
                lambda t: regexp_matches(t, '{_NUMBER_SQL}') OR (length(t) >= 2 AND NOT list_contains({sql_list(K.TITLE_STOP_WORDS)}, t)))) AS u
            FROM (SELECT item_id, {_normalized_sql("split_part(coalesce(text, ''), chr(10), 1)")} AS n FROM benchmark)
        ), best AS (
            SELECT t.doc_id, max(CASE WHEN len(t.unigrams) + len(r.u) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(t.unigrams, r.u)) / (len(t.unigrams) + len(r.u)) END) AS d FROM tokens t CROSS JOIN recent r GROUP BY t.doc_id
        ) SELECT doc_id, round(d, 6) AS dice, round(CASE WHEN d >= 0.7 THEN 1.0 WHEN d >= 0.45 THEN (d - 0.45) / 0.25 ELSE 0.0 END, 6) AS penalty FROM best""",
)
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = items_of(spark, sf_dir).select(F.col("doc_id").alias("id"), text.title_tokens(F.col("title"))["unigrams"].alias("unigrams"))
    recent = _first_line(table(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("item_id", "title_id")
    return R.repetition(docs, recent).select(F.col("id").alias("doc_id"), F.round("dice", 6).alias("dice"), F.round("penalty", 6).alias("penalty"))


@query(
    "recency_scores",
    f"""SELECT event_id, round(CASE WHEN ts IS NULL THEN 0.5 WHEN h > 72 THEN 0.05 ELSE exp(-ln(2.0) * h / {K.HALF_LIFE_HOURS}) END, 4) AS recency
        FROM (SELECT event_id, ts, greatest(0.0, (epoch_ms((SELECT max(ts) FROM events)) - epoch_ms(ts)) / 3600000.0) AS h FROM events)""",
)
def recency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = F.broadcast(events.agg(F.max("ts").alias("last")))  # one row
    return events.crossJoin(last).select("event_id", F.round(R.recency(F.col("ts"), F.col("last")), 4).alias("recency"))


@query(
    "corroboration",
    "SELECT l_orderkey, n AS n_sources, CASE WHEN n <= 1 THEN 0.35 WHEN n = 2 THEN 0.65 WHEN n = 3 THEN 0.85 ELSE 1.0 END::DOUBLE AS corroboration FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey)",
)
def corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n_sources"))
    return n.withColumn("corroboration", R.corroboration(F.col("n_sources")))


# --- pages -----------------------------------------------------------------------------------------------------------

_DROPPED = "script style noscript template iframe object embed svg".split()


def _html_sql() -> str:
    t = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g')"
    one = "|".join(rf"<\s*{e}\b[^>]*>.*?<\s*/\s*{e}\s*>" for e in _DROPPED)
    t = f"regexp_replace({t}, '(?is){one}', '', 'g')"
    t = rf"regexp_replace({t}, '(?i)<\s*br\s*/?>|<\s*li\b[^>]*>|<\s*/\s*(?:p|div|li|h[1-6]|blockquote|pre|tr|table|section|article)\s*>', chr(10), 'g')"
    t = f"""regexp_replace({t}, '<[A-Za-z/!?](?:"[^"]*"|''[^'']*''|[^''">])*>', '', 'g')"""
    for name in ("copy", "middot", "nbsp", "lt", "gt", "quot", "amp"):
        t = f"replace({t}, '&{name};', '{K.NAMED_ENTITIES[name]}')"
    t = rf"regexp_replace({t}, '\r\n?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '[ \t\f\v\r\x{{a0}}]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


@query("html_to_text", f"SELECT page_id, md5({_html_sql()}) AS text_md5, length({_html_sql()})::INT AS n_chars FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("t"))
    return plain.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@query(
    "canonical_urls",
    r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
        p AS (SELECT page_id, split_part(u, '?', 1) AS path, CASE WHEN contains(u, '?') THEN list_filter(string_split(substring(u, strpos(u, '?') + 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^utm_')) ELSE [] END AS q FROM u)
        SELECT page_id, path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM p""",
)
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonicalize(F.col("url")).alias("canonical"))


@query(
    "host_reach",
    r"""SELECT page_id, host, CASE WHEN regexp_matches(host, '(^|\.)example\.(com|net|org)$') OR regexp_matches(host, '\.(invalid|test|example)$') THEN 'reserved-name'
        WHEN host = 'localhost' OR regexp_matches(host, '\.(localhost|local|internal|home\.arpa)$') THEN 'private-name' ELSE 'name' END AS kind
        FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM pages)""",
)
def host_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", urls.host_reach(urls.hostname(F.col("url"))).alias("h"))
    return found.select("page_id", "h.host", "h.kind")


@query(
    "address_reach",
    """WITH a AS (SELECT event_id, event_id * 2654435761 % 4294967296 AS n FROM events),
       r(lo, hi, reach, k) AS (VALUES """
    + ", ".join(f"({sum(int(p) << (24 - 8 * i) for i, p in enumerate(base.split('.')))}, {sum(int(p) << (24 - 8 * i) for i, p in enumerate(base.split('.'))) + (1 << (32 - bits)) - 1}, '{reach}', {k})" for k, (base, bits, reach) in enumerate(K.IPV4_RANGES))
    + """) SELECT event_id, coalesce(arg_min(r.reach, r.k), 'public') AS reach FROM a LEFT JOIN r ON a.n BETWEEN r.lo AND r.hi GROUP BY event_id""",
)
def address_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses derived from event numbers, spread over the whole range."""
    n = F.expr("event_id * 2654435761L % 4294967296L")
    part = lambda k: F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string")
    return table(spark, sf_dir, "events").select("event_id", urls.ipv4_reach(F.concat_ws(".", part(24), part(16), part(8), part(0))).alias("reach"))


@query("markup_flag", "SELECT page_id, " + " OR ".join(f"regexp_matches(coalesce(html, ''), '{p}')" for p in K.MARKUP) + " AS has_markup FROM pages")
def markup_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.has_markup(F.coalesce("html", F.lit(""))).alias("has_markup"))


@query("hard_news_flag", f"SELECT doc_id, regexp_matches(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), '\\b(?:{'|'.join(K.HARD_NEWS_TERMS)})s?\\b') AS hard_news FROM documents")
def hard_news_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.is_hard_news(F.coalesce("text", F.lit(""))).alias("hard_news"))


# --- orders as stories -----------------------------------------------------------------------------------------------


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates of monthly editions: the customer's nation is the publisher, the priority and segment the topic."""
    topics = F.array(*[F.lit(t) for t in K.TOPIC_WEIGHTS])
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    topic = F.element_at(topics, (F.pmod(F.col("o_orderkey"), F.lit(8)) + 1).cast("int"))
    return orders.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("edition"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("cluster_id"), topic.alias("topic"),
        F.col("c_nationkey").cast("string").alias("primary_source_id"), F.lit(1).alias("source_count"), F.col("o_totalprice").alias("composite_score"),
    )


_CANDIDATES_SQL = f"""
    cands AS (
        SELECT strftime(o_orderdate, '%Y-%m') AS edition, lpad(o_orderkey::VARCHAR, 12, '0') AS cluster_id, ({sql_list(list(K.TOPIC_WEIGHTS))})[o_orderkey % 8 + 1] AS topic,
               c_nationkey::VARCHAR AS pub, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m') ORDER BY o_totalprice DESC, lpad(o_orderkey::VARCHAR, 12, '0')) AS rank
        FROM orders JOIN customer ON o_custkey = c_custkey
    ), greedy AS (
        SELECT edition, 0::BIGINT AS rank, []::BIGINT[] AS ranks, []::VARCHAR[] AS topics, []::VARCHAR[] AS pubs FROM (SELECT DISTINCT edition FROM cands)
        UNION ALL
        SELECT g.edition, c.rank, CASE WHEN ok THEN list_append(g.ranks, c.rank) ELSE g.ranks END, CASE WHEN ok THEN list_append(g.topics, c.topic) ELSE g.topics END, CASE WHEN ok THEN list_append(g.pubs, c.pub) ELSE g.pubs END
        FROM greedy g JOIN cands c ON c.edition = g.edition AND c.rank = g.rank + 1,
             LATERAL (SELECT len(list_filter(g.topics, lambda t: t = c.topic)) < {K.PER_TOPIC} AND len(list_filter(g.pubs, lambda p: p = c.pub)) < {K.PER_PUBLISHER} AS ok) WHERE len(g.ranks) < {K.CORE_STORIES}
    ), core AS (SELECT edition, arg_max(ranks, rank) AS ranks FROM greedy GROUP BY edition)"""


@query("greedy_core", f"WITH RECURSIVE {_CANDIDATES_SQL} SELECT c.edition, c.cluster_id, c.topic, c.rank::INT AS rank FROM cands c JOIN core k ON k.edition = c.edition AND list_contains(k.ranks, c.rank)")
def greedy_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = R.compose(R.rank(candidates(spark, sf_dir)))
    return composed.filter("decision = 'selected_core'").select("edition", "cluster_id", "topic", F.col("rank").cast("int").alias("rank"))


@query(
    "topic_pools",
    f"""WITH RECURSIVE {_CANDIDATES_SQL}, rest AS (
        SELECT c.*, row_number() OVER (PARTITION BY c.edition, c.topic ORDER BY c.rank) AS place FROM cands c JOIN core k ON k.edition = c.edition AND NOT list_contains(k.ranks, c.rank) WHERE list_contains({sql_list(K.INTEREST_TOPICS)}, c.topic)
    ) SELECT edition, topic, cluster_id, place::INT AS place FROM rest WHERE place <= {K.POOL_STORIES}""",
)
def topic_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = R.compose(R.rank(candidates(spark, sf_dir))).filter("decision = 'selected_topic_pool'")
    return pooled.select("edition", "topic", "cluster_id", F.row_number().over(Window.partitionBy("edition", "topic").orderBy("rank")).cast("int").alias("place"))


@query(
    "publisher_caps",
    "SELECT o_orderdate::DATE AS edition, s_nationkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2 HAVING count(*) > 2",
)
def publisher_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers (nations) of the first cited source that lead more than two stories of a day."""
    lead = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_suppkey")
    both = table(spark, sf_dir, "orders").join(lead, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return both.groupBy(F.to_date("o_orderdate").alias("edition"), "s_nationkey").agg(F.count("*").alias("n")).filter("n > 2")


@query(
    "topic_caps",
    f"SELECT o_orderdate::DATE AS edition, o_orderpriority AS topic, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > {K.PER_TOPIC}",
)
def topic_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("edition"), F.col("o_orderpriority").alias("topic")).agg(F.count("*").alias("n")).filter(F.col("n") > K.PER_TOPIC)


@query(
    "shared_source_majority",
    f"""WITH cites AS (SELECT DISTINCT o_orderdate::DATE AS edition, l_orderkey AS story, l_suppkey AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
        sized AS (SELECT *, count(*) OVER (PARTITION BY edition, story) AS n FROM cites)
        SELECT a.edition, a.story AS a, b.story AS b, count(*) AS shared FROM sized a JOIN sized b ON a.edition = b.edition AND a.source = b.source AND a.story < b.story
        GROUP BY a.edition, a.story, b.story, a.n, b.n HAVING count(*) >= {K.SHARED_SOURCES} AND count(*) / least(a.n, b.n) >= {K.SHARED_SHARE}""",
)
def shared_source_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a day's stories that share most of their sources; stories meet by a shared source only."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("edition"))
    cites = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("edition", F.col("l_orderkey").alias("story"), F.col("l_suppkey").alias("source")).distinct()
    sizes = cites.groupBy("edition", "story").agg(F.count("*").alias("n"))
    sized = cites.join(sizes, ["edition", "story"])
    side = lambda x: sized.select("edition", "source", F.col("story").alias(x), F.col("n").alias(f"n_{x}"))
    pairs = side("a").join(side("b"), ["edition", "source"]).filter("a < b").groupBy("edition", "a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    return pairs.filter((F.col("shared") >= K.SHARED_SOURCES) & (F.col("shared") / F.least("n_a", "n_b") >= K.SHARED_SHARE)).select("edition", "a", "b", "shared")


@query(
    "orphan_refs",
    """SELECT 'part' AS kind, p_partkey AS id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)
       UNION ALL SELECT 'customer', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
       UNION ALL SELECT 'citation', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)""",
)
def orphan_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part").join(line, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    people = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    cites = line.select("l_orderkey").distinct().join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.lit("citation").alias("kind"), F.col("l_orderkey").alias("id"))
    return parts.unionByName(people).unionByName(cites)


@query(FLAGSHIP)
def draft_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to composed candidates of daily editions: tokens, clusters, features, order, greedy core and pools."""
    composed = D.compose(C.clusters(C.cluster_items(feed_items(spark, sf_dir))))
    return composed.select("edition", "rank", "cluster_id", "topic", "primary_source_id", "source_count", F.round("composite_score", 6).alias("composite_score"), "decision", "reason")


@query("draft_editions")
def draft_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to edition documents of each day and the findings on them: a row an edition."""
    editions = written(D.draft_editions(feed_items(spark, sf_dir)), "draft-editions")
    reports = D.draft_report(editions)
    return editions.join(reports.drop("file"), "date").select("date", F.size("coreStoryIds").alias("core"), F.size("stories").alias("stories"), F.size("sources").alias("sources"), "estimatedMinutes", "blocking", "warnings", "publishable")


@query("source_counts", "SELECT source, count(*) AS n_docs, count(text) AS n_texts FROM documents GROUP BY source")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("text").alias("n_texts"))


# --- events, readers and lifecycle ------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "source_health",
    f"""WITH last AS (SELECT max(ts) AS now FROM events), f AS (SELECT user_id, max(ts) AS latest_at, count(*) AS n, max(value) AS slowest, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id)
        SELECT user_id::VARCHAR AS source_id, CASE WHEN failed THEN 'failing' WHEN slowest * 100 > {K.SLOW_MS} OR now - latest_at > INTERVAL 72 HOURS THEN 'warning' ELSE 'healthy' END AS status,
               array_to_string(list_filter([CASE WHEN failed THEN 'fetch/failed' END, CASE WHEN NOT failed AND slowest * 100 > {K.SLOW_MS} THEN 'latency/high' END, CASE WHEN NOT failed AND now - latest_at > INTERVAL 72 HOURS THEN 'staleness/old' END], lambda x: x IS NOT NULL), ',') AS warnings
        FROM f, last""",
)
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sources: their slowest event is the fetch, their last event the latest item."""
    events = _events(spark, sf_dir)
    by = events.groupBy(F.col("user_id").cast("string").alias("source_id")).agg(F.max("ts").alias("latest_at"), F.count("*").alias("n_items"), F.max("value").alias("slowest"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    fetches = by.select("source_id", F.when(F.col("failed"), "failure").otherwise("success").alias("kind"), (F.col("slowest") * 100).alias("duration_ms"))
    last = F.broadcast(events.agg(F.max("ts").alias("now")))  # one row
    health = N.source_health(fetches.crossJoin(last), by.select("source_id", "n_items", "latest_at"), F.col("now"))
    return health.select("source_id", "status", F.array_join("warnings", ",").alias("warnings"))


@query(
    "editorial_day_counts",
    "SELECT (ts + INTERVAL 330 MINUTE)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def editorial_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(text.editorial_day(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"))


_SHOWN_SQL = """
    views AS (SELECT DISTINCT user_id AS reader_id, ts::DATE AS date, event_id % 7 AS story_id FROM events WHERE event_type = 'view'),
    shown AS (SELECT reader_id, date, unnest(range(0, 10)) AS story_id FROM (SELECT DISTINCT user_id AS reader_id, ts::DATE AS date FROM events))"""


@query(
    "reader_progress",
    f"""WITH {_SHOWN_SQL}, ended AS (SELECT DISTINCT user_id AS reader_id, ts::DATE AS date FROM events WHERE event_type = 'purchase')
        SELECT s.reader_id, s.date, count(v.story_id) AS viewed_count, count(*) AS total, count(v.story_id) = count(*) OR bool_or(e.reader_id IS NOT NULL) AS over
        FROM shown s LEFT JOIN views v ON v.reader_id = s.reader_id AND v.date = s.date AND v.story_id = s.story_id LEFT JOIN ended e ON e.reader_id = s.reader_id AND e.date = s.date GROUP BY s.reader_id, s.date""",
)
def reader_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten stories a reader and day; views of events mark some of them, purchases end the day."""
    events = _events(spark, sf_dir).select(F.col("user_id").alias("reader_id"), F.to_date("ts").alias("date"), "event_type", F.pmod("event_id", F.lit(7)).alias("story_id"))
    shown = events.select("reader_id", "date").distinct().withColumn("story_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    out = V.progress(shown, events.filter("event_type = 'view'"), events.filter("event_type = 'purchase'"))
    return out.select("reader_id", "date", "viewed_count", "total", "over")


@query(
    "reader_memory",
    f"""WITH v AS (SELECT user_id AS reader_id, ts::DATE AS date, list_sort(list(DISTINCT event_id)) AS stories FROM events WHERE event_type = 'view' GROUP BY 1, 2)
        SELECT reader_id, date, array_to_string(stories, ',') AS stories FROM (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY date DESC) AS r FROM v) WHERE r <= {K.KEPT_EDITIONS}""",
)
def reader_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _events(spark, sf_dir).filter("event_type = 'view'").select(F.col("user_id").alias("reader_id"), F.to_date("ts").alias("date"), F.col("event_id").alias("story_id"))
    return V.remembered(views).select("reader_id", "date", F.array_join(F.transform("stories", lambda s: s.cast("string")), ",").alias("stories"))


@query(
    "interest_pick",
    f"""WITH pools AS (SELECT o_orderdate::DATE AS date, ({sql_list(K.INTEREST_TOPICS)})[o_orderkey % 6 + 1] AS interest, o_orderkey AS story_id,
            row_number() OVER (PARTITION BY o_orderdate::DATE, o_orderkey % 6 ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders),
        readers AS (SELECT DISTINCT o_custkey AS reader_id, o_orderdate::DATE AS date, ({sql_list(K.INTEREST_TOPICS)})[o_custkey % 6 + 1] AS interest FROM orders),
        best AS (SELECT r.reader_id, r.date, p.story_id, CASE WHEN p.interest = r.interest THEN 0 ELSE 1 END AS chosen, p.position FROM readers r JOIN pools p ON p.date = r.date)
        SELECT reader_id, date, place::INT AS place, story_id FROM (SELECT *, row_number() OVER (PARTITION BY reader_id, date ORDER BY chosen, position, story_id) AS place FROM best) WHERE place <= {K.KEPT_INTERESTS}""",
)
def interest_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's orders are its pooled stories; each of its customers reads it with one interest."""
    topics = F.array(*[F.lit(t) for t in K.INTEREST_TOPICS])
    pick = lambda key: F.element_at(topics, (F.pmod(F.col(key), F.lit(6)) + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    place = F.row_number().over(Window.partitionBy("date", "interest").orderBy(F.desc("o_totalprice"), "o_orderkey")) - 1
    pools = orders.withColumn("interest", pick("o_orderkey")).withColumn("position", place).select("date", "interest", "position", F.col("o_orderkey").alias("story_id"))
    chosen = orders.select(F.col("o_custkey").alias("reader_id"), "date", pick("o_custkey").alias("interest")).distinct()
    return V.pick_pooled(pools, chosen).select("reader_id", "date", F.col("place").cast("int").alias("place"), "story_id")


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as editions: published if most orders of the day are fulfilled, else drafts."""
    by = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("*").alias("n"))
    return by.select("date", F.when(F.col("f") * 2 > F.col("n"), "published").otherwise("draft").alias("status"), (F.col("n") - F.col("f")).alias("blocking"))


_DAYS_SQL = """days AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN 2 * count(*) FILTER (o_orderstatus = 'F') > count(*) THEN 'published' ELSE 'draft' END AS status, count(*) - count(*) FILTER (o_orderstatus = 'F') AS blocking FROM orders GROUP BY 1)"""


@query(
    "rollback_plan",
    f"""WITH {_DAYS_SQL}, e AS (SELECT coalesce(list_sort(list(date)), []) AS d FROM days WHERE status = 'published'),
        t AS (SELECT d, CASE WHEN len(d) = 0 THEN 'no edition to roll back' WHEN len(d) = 1 THEN 'only one edition' END AS error FROM e)
        SELECT d[-1] AS current_latest, d[-2] AS target_date, error, CASE WHEN error IS NULL THEN d[-1] END AS withdrawn, CASE WHEN error IS NULL THEN len(d) - 1 END AS remaining FROM t""",
)
def rollback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = L.rollback_plan(_order_days(spark, sf_dir), to_previous=True)
    return plan.select("current_latest", "target_date", "error", F.array_join("withdrawn", ",").alias("withdrawn"), F.array_size("remaining").cast("long").alias("remaining"))


@query(
    "staging_plan",
    f"""WITH {_DAYS_SQL} SELECT date || '.json' AS file, date, status = 'published' AND blocking = 0 AS stage,
        CASE WHEN status = 'published' AND blocking = 0 THEN row_number() OVER (PARTITION BY status = 'published' AND blocking = 0 ORDER BY date DESC) ELSE 0 END::INT AS rank FROM days""",
)
def staging_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _order_days(spark, sf_dir).select(F.concat("date", F.lit(".json")).alias("file"), "date", "blocking", F.lit(0).alias("warnings"), ((F.col("status") == "published") & (F.col("blocking") == 0)).alias("publishable"))
    return L.staging_plan(reports).select("file", "date", "stage", F.coalesce("rank", F.lit(0)).cast("int").alias("rank"))


@query(
    "staging_removal",
    f"""WITH {_DAYS_SQL}, present AS (SELECT DISTINCT CASE WHEN o_orderkey % 11 = 0 THEN '../' ELSE '' END || strftime(o_orderdate, '%Y-%m-%d') || '.json' AS name FROM orders)
        SELECT name, CASE WHEN name LIKE '../%' THEN 'refuse' ELSE 'remove' END AS action FROM present WHERE name NOT IN (SELECT date || '.json' FROM days WHERE status = 'published')""",
)
def staging_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("o_orderkey") % 11 == 0, "../").otherwise(""), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".json"))
    present = table(spark, sf_dir, "orders").select(name.alias("name"))
    keep = _order_days(spark, sf_dir).filter("status = 'published'").select(F.concat("date", F.lit(".json")).alias("name"))
    return L.removal_plan(present, keep)


@query(
    "findings_rollup",
    f"""WITH f AS (
        SELECT 'structural/no-markup-in-text' AS rule_id, 'blocking' AS severity FROM documents WHERE {" OR ".join(f"regexp_matches(coalesce(text, ''), '{p}')" for p in K.MARKUP)}
        UNION ALL SELECT 'structural/unreviewed-story-gate', 'blocking' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
        UNION ALL SELECT 'length/deck-one-line', 'warning' FROM (SELECT regexp_split_to_array(split_part(coalesce(text, ''), chr(10), 1), '{_S}+') AS ws FROM documents) WHERE len(list_filter(ws, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) > {K.MAX_DECK_WORDS}
        ) SELECT rule_id, severity, count(*) AS n FROM f GROUP BY rule_id, severity""",
)
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules over documents as stories (labels are reviews), counted."""
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    found = lambda df, rule, severity: df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))
    markup = found(docs.filter(text.has_markup(body)), "structural/no-markup-in-text", "blocking")
    gate = found(docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti"), "structural/unreviewed-story-gate", "blocking")
    deck = found(docs.filter(text.rule_word_count(F.split_part(body, F.lit("\n"), F.lit(1))) > K.MAX_DECK_WORDS), "length/deck-one-line", "warning")
    return markup.unionByName(gate).unionByName(deck).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("conversation_prompt", "SELECT conv_id, md5(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS prompt_md5, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    prompts = U.prompt(turns, "conv_id", "turn", "role", "text")
    return prompts.join(turns.groupBy("conv_id").agg(F.count("*").alias("turns")), "conv_id").select("conv_id", F.md5("prompt").alias("prompt_md5"), "turns")


@query(
    "semantic_merge_candidates",
    f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + {K.CLUSTER_HOURS} WHERE list_cosine_similarity(a.e, b.e) >= {K.SEMANTIC_FLOOR}""",
)
def semantic_merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector an hour: pairs within the window that are alike; bands as wide as the window meet their neighbours."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).withColumn("band", F.floor(F.col("vec_id") / K.CLUSTER_HOURS))
    later = v.select(F.col("vec_id").alias("b"), F.col("e").alias("eb"), F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    pairs = v.select(F.col("vec_id").alias("a"), F.col("e").alias("ea"), "band").join(later, "band").filter((F.col("b") > F.col("a")) & (F.col("b") <= F.col("a") + K.CLUSTER_HOURS))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = dot(F.col("ea"), F.col("eb")) / F.sqrt(dot(F.col("ea"), F.col("ea")) * dot(F.col("eb"), F.col("eb")))
    return pairs.filter(cosine >= K.SEMANTIC_FLOOR).select("a", "b")


@query("edition_dates", "SELECT day, strftime(day, '%A, %-d %B %Y') AS label, n FROM (SELECT (ts + INTERVAL 330 MINUTE)::DATE AS day, count(*) AS n FROM events GROUP BY 1)")
def edition_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _events(spark, sf_dir).groupBy(text.editorial_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    return by.select("day", text.long_date(F.col("day")).alias("label"), "n")


@query(
    "update_markers",
    """WITH s AS (SELECT o_orderkey AS story_id, o_orderdate AS f, max(l_shipdate) AS u, bool_or(l_returnflag = 'R') AS noted FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
       SELECT story_id, CASE WHEN noted THEN 'Corrected' WHEN u > f THEN 'Updated' ELSE 'none' END AS marker FROM s""",
)
def update_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stories, shipping as updates, returns as corrections."""
    line = table(spark, sf_dir, "lineitem")
    dated = table(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")
    stories = dated.groupBy(day, F.col("o_orderkey").alias("story_id")).agg(F.min("o_orderdate").alias("first_published_at"), F.max("l_shipdate").alias("updated_at"))
    notes = dated.filter("l_returnflag = 'R'").select(day, F.col("o_orderkey").alias("story_id"))
    return V.update_marker(stories, notes).select("story_id", F.coalesce("marker", F.lit("none")).alias("marker"))


@query(
    "composite_rank",
    f"""WITH s AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS edition, count(DISTINCT l_suppkey) AS n, (epoch_ms((SELECT max(o_orderdate) FROM orders)) - epoch_ms(o_orderdate)) / 3600000.0 AS h FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, o_orderdate),
        f AS (SELECT *, CASE WHEN h > 72 THEN 0.05 ELSE exp(-ln(2.0) * h / {K.HALF_LIFE_HOURS}) END AS recency, CASE WHEN n <= 1 THEN 0.35 WHEN n = 2 THEN 0.65 WHEN n = 3 THEN 0.85 ELSE 1.0 END AS corr FROM s),
        c AS (SELECT *, round(0.25 * recency + 0.25 * corr + 0.15 * 0.8 + 0.2 * 0.8 + 0.15 * 0.7, 4) AS score FROM f)
        SELECT id, edition, score, row_number() OVER (PARTITION BY edition ORDER BY score DESC, n DESC, lpad(id::VARCHAR, 12, '0'))::INT AS rank FROM c""",
)
def composite_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates with suppliers as sources; features that aren't looked up have their defaults."""
    orders = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    last = F.broadcast(orders.agg(F.max("at").alias("last")))  # one row
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("source_count"))
    c = orders.join(n, F.col("o_orderkey") == F.col("l_orderkey")).crossJoin(last)
    features = {"recency": R.recency(F.col("at"), F.col("last")), "corroboration": R.corroboration(F.col("source_count")), "source_tier": R.source_tier(None), "india_relevance": F.lit(0.8), "topic_weight": R.topic_weight(F.lit("none"))}
    scored = c.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("edition"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("cluster_id"), "source_count", F.round(R.composite(features, F.lit(0.0)), 4).alias("composite_score"))
    return R.rank(scored).select(F.col("o_orderkey").alias("id"), "edition", F.col("composite_score").alias("score"), F.col("rank").cast("int").alias("rank"))


@query(
    "latest_per_source",
    "SELECT user_id, max(ts) AS latest_at, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_items FROM events GROUP BY user_id",
)
def latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = F.max(F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("l"), F.count("*").alias("n_items")).select("user_id", F.col("l.ts").alias("latest_at"), F.col("l.event_id").alias("event_id"), "n_items")
