"""Feed bodies to raw items: RSS, Atom and JSON feeds, by patterns rather than an XML parser, as malformed feeds need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["guid", "title", "author", "description", "link", "published_at", "updated_at"]
_NS = r"[\w-]+:"


def decode_feed(text: Column) -> Column:
    """Six references, the ampersand first, so that a doubly encoded one is decoded twice."""
    for name, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def trim_all(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def tag(xml: Column, name: str) -> Column:
    """What stands between the first start tag of a name, with or without prefix, and the next end tag of it; null if there
    is none or nothing in it. A CDATA section around all of it is opened."""
    after = F.get(F.split(xml, rf"(?i)<(?:{_NS})?{name}(?:\s[^>]*)?>", 2), F.lit(1))
    end = rf"(?i)</(?:{_NS})?{name}\s*>"
    inner = trim_all(F.when(after.rlike(end), F.get(F.split(after, end, 2), F.lit(0))))
    opened = F.length(inner) > 12
    section = opened & F.upper(inner).startswith("<![CDATA[") & inner.endswith("]]>")
    bare = trim_all(F.substring(inner, F.lit(10), F.length(inner) - 12))
    return decode_feed(F.when(inner != "", F.when(section, bare).otherwise(inner)))


def attributes(opening: Column) -> Column:
    """Quoted attributes of a start tag as an array of name (lower case) and value."""
    pairs = F.regexp_extract_all(opening, F.lit(r"""[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0))
    value = lambda p: F.regexp_extract(p, r"(?s)^[^=]*=\s*.(.*).$", 1)
    return F.transform(pairs, lambda p: F.struct(F.lower(F.regexp_extract(p, r"^[\w:.-]+", 0)).alias("name"), value(p).alias("value")))


def atom_link(entry: Column) -> Column:
    """The href of the first link that is an alternate, else of the first that has one, else what a link element holds."""
    links = F.transform(F.regexp_extract_all(entry, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), attributes)
    of = lambda link, name: F.get(F.filter(link, lambda a: a["name"] == name), F.lit(0))["value"]
    targets = F.filter(links, lambda x: F.coalesce(of(x, "href"), F.lit("")) != "")
    alternate = F.get(F.filter(targets, lambda x: F.lower(of(x, "rel")) == "alternate"), F.lit(0))
    return F.coalesce(decode_feed(F.trim(of(F.coalesce(alternate, F.get(targets, F.lit(0))), "href"))), tag(entry, "link"))


def feed_format(body: Column, content_type: Column) -> Column:
    kind = F.coalesce(content_type, F.lit(""))
    return (
        F.when(F.trim(body) == "", "empty")
        .when(kind.contains("json") | F.ltrim(body).startswith("{"), "json")
        .when(body.contains("<feed") | kind.contains("atom"), "atom")
        .otherwise("rss")
    )


_JSON = "struct<items:array<struct<id:string,title:string,summary:string,content_text:string,content_html:string,author:struct<name:string>,url:string,date_published:string,date_modified:string>>>"


def parse_feeds(df: DataFrame) -> DataFrame:
    """source_id, content_type, body (text) -> one row an item: source_id, item_ordinal and FIELDS.

    Each format is one projection over its own rows; unreadable JSON has no items.
    """
    df = df.withColumn("feed_format", feed_format(F.col("body"), F.col("content_type")))

    def blocks(kind: str, element: str) -> DataFrame:
        found = F.regexp_extract_all("body", F.lit(rf"(?is)<{element}(?:\s+[^>]*)?>(.*?)</{element}>"), F.lit(1))
        return df.filter(F.col("feed_format") == kind).select("source_id", F.posexplode(found).alias("item_ordinal", "x"))

    x = F.col("x")
    rss = blocks("rss", "item").select(
        "source_id", "item_ordinal",
        F.coalesce(tag(x, "guid"), tag(x, "link")).alias("guid"), tag(x, "title").alias("title"),
        F.coalesce(tag(x, "author"), tag(x, "creator")).alias("author"), F.coalesce(tag(x, "description"), tag(x, "encoded")).alias("description"),
        tag(x, "link").alias("link"), F.coalesce(tag(x, "pubDate"), tag(x, "date")).alias("published_at"), F.lit(None).cast("string").alias("updated_at"),
    )
    author = F.regexp_extract(x, r"(?is)<author(?:\s+[^>]*)?>(.*?)</author>", 1)
    atom = blocks("atom", "entry").select(
        "source_id", "item_ordinal",
        F.coalesce(tag(x, "id"), atom_link(x)).alias("guid"), tag(x, "title").alias("title"),
        F.coalesce(tag(author, "name"), tag(author, "email")).alias("author"), F.coalesce(tag(x, "summary"), tag(x, "content")).alias("description"),
        atom_link(x).alias("link"), F.coalesce(tag(x, "published"), tag(x, "updated")).alias("published_at"), tag(x, "updated").alias("updated_at"),
    )
    items = df.filter(F.col("feed_format") == "json").select("source_id", F.posexplode(F.from_json("body", _JSON)["items"]).alias("item_ordinal", "x"))
    json = items.select(
        "source_id", "item_ordinal",
        F.coalesce("x.id", "x.url").alias("guid"), "x.title", F.col("x.author.name").alias("author"),
        F.coalesce("x.summary", "x.content_text", "x.content_html").alias("description"), F.col("x.url").alias("link"),
        F.col("x.date_published").alias("published_at"), F.col("x.date_modified").alias("updated_at"),
    )
    return rss.unionByName(atom).unionByName(json)


# --- responses of feed servers ---------------------------------------------------------------------------------------

# Media types that a feed may have.
FEED_TYPES = ["application/rss+xml", "application/atom+xml", "application/xml", "text/xml", "application/json", "application/feed+json", "application/rdf+xml"]
BODY_CAP = 1 << 20


def header(headers: Column, name: str) -> Column:
    """A header whatever its case."""
    return F.element_at(F.transform_keys(headers, lambda k, _: F.lower(k)), name.lower())


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def is_retryable(status: Column) -> Column:
    return status.isin(408, 425, 429) | (status >= 500)


def response_problem(status: Column, headers: Column, body_bytes: Column) -> Column:
    """What is wrong with a response: not-modified and null aren't failures."""
    length = header(headers, "content-length")
    kind = media_type(header(headers, "content-type"))
    return (
        F.when(length.isNotNull() & ~length.rlike("^[0-9]+$"), "invalid-content-length")
        .when(length.try_cast("long") > BODY_CAP, "response-too-large")
        .when(status == 304, "not-modified")
        .when(status.between(300, 399), F.when(header(headers, "location").isNull(), "redirect-without-location").otherwise("redirect"))
        .when(~status.between(200, 299), "http-error")
        .when(kind.isNull() | (kind == ""), "missing-content-type")
        .when(~kind.isin(FEED_TYPES), "unsupported-content-type")
        .when(body_bytes > BODY_CAP, "response-too-large")
    )
