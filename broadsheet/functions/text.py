"""Scalar text functions as Column expressions; Arrow functions only where Spark has no expression (NFKC, entities, FNV)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import constants as K

_SPACE = r"(?U)\s+"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def trimmed(text: Column) -> Column:
    """Trim every kind of white space, not blanks alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII texts stay on the JVM side."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Named, decimal and hexadecimal character references, in one pass; what is unknown or no character stays."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return K.NAMED_ENTITIES.get(body.lower(), m[0])
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return m[0] if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)

    pattern = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]+);")
    return text.map(lambda t: pattern.sub(one, t) if t is not None and "&" in t else t)


def strip_tags(text: Column) -> Column:
    """Drop tags; a > in quotes doesn't close one, and an unclosed tag or quote takes the rest."""
    return F.regexp_replace(text, r"""<(?=[A-Za-z/!?])(?:"[^"]*(?:"|\z)|'[^']*(?:'|\z)|[^'">]++)*+(?:>|\z)""", "")


def html_to_text(html: Column) -> Column:
    """Markup to text: comments and unseen elements go, breaks and closing blocks become line feeds, then entities."""
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<\s*(script|style|noscript|template|iframe|object|embed|svg)\b[^>]*>.*?<\s*/\s*\1\s*>", "")
    t = F.regexp_replace(t, r"(?i)<\s*br\s*/?>|<\s*li\b[^>]*>|<\s*/\s*(?:p|div|li|h[1-6]|blockquote|pre|tr|table|section|article)\s*>", "\n")
    t = decode_entities(strip_tags(t))
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    return trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def truncated(text: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


#: Bytes of texts that are hashed side by side, padding included.
HASHED_BYTES = 1 << 26


def fnv1a64_of(texts: list[str | None]) -> list[str | None]:
    """64-bit FNV-1a of the UTF-8 bytes, 16 hex digits. Texts of like length go through together, byte by byte, as many as
    HASHED_BYTES hold."""
    out: list[str | None] = [None] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        most = max(1, 4 * len(texts[order[at]]))  # of bytes in any text from here on
        some = order[at : at + max(1, min(512, HASHED_BYTES // most))]
        at += len(some)
        data = sorted(((texts[i].encode("utf-8", "replace"), i) for i in some), key=lambda x: -len(x[0]))
        size = np.array([len(d) for d, _ in data])
        block = np.zeros((size[0], len(data)), dtype=np.uint8)
        for col, (d, _) in enumerate(data):
            block[: len(d), col] = np.frombuffer(d, dtype=np.uint8)
        h = np.full(len(data), 0xCBF29CE484222325, dtype=np.uint64)
        for k in range(size[0]):
            live = np.searchsorted(-size, -k, side="left")
            h[:live] = (h[:live] ^ block[k, :live]) * np.uint64(0x100000001B3)
        for (_, i), value in zip(data, h):
            out[i] = f"{int(value):016x}"
    return out


@F.pandas_udf(T.StringType())
def fnv1a64(text: pd.Series) -> pd.Series:
    return pd.Series(fnv1a64_of(text.tolist()), dtype=object)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over characters of the basic plane, 8 hex digits; for build ids of a list of names."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def build_id(names: Column) -> Column:
    return fnv1a32(F.array_join(F.array_sort(names), "\n"))


def content_hash(title: Column, description: Column) -> Column:
    return fnv1a64(F.concat(F.lower(title), F.lit("\u001f"), description))


def _without_labels(t: Column) -> Column:
    for label in K.LEADING_LABELS:
        t = trimmed(F.regexp_replace(t, "(?i)" + label, ""))
    return trimmed(F.regexp_replace(t, "(?i)" + K.TRAILING_PUBLISHERS, ""))


def clean_title(title: Column) -> Column:
    """Composed, without a leading label of its kind and without the publishers at its end."""
    return _without_labels(trimmed(nfkc(title)))


def _compatible() -> dict[str, str]:
    """Characters of Latin text whose compatibility form is another: spaces, ligatures, full width, fractions, numerals."""
    ranges = [(0xA0, 0x100), (0x2000, 0x2190), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)]
    both = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for lo, hi in ranges for c in range(lo, hi))
    return {c: form for c, form in both if form != c and any(x.isascii() for x in form)}


def _composing() -> str:
    """A pattern of ASCII letters with a mark that they compose with: together they are one letter, and no ASCII one."""
    letters = [chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()]
    found = []
    for mark in map(chr, range(0x300, 0x370)):
        own = "".join(x for x in letters if len(unicodedata.normalize("NFKC", x + mark)) == 1)
        if own:
            found.append(f"[{own}]{mark}")
    return "|".join(found)


_COMPATIBLE, _COMPOSING = _compatible(), _composing()
_ONE = {c: form for c, form in _COMPATIBLE.items() if len(form) == 1}
_MANY = {c: form for c, form in _COMPATIBLE.items() if len(form) > 1}


def _token_form(title: Column) -> Column:
    """What composition changes in the ASCII words of a title, without leaving the JVM; other letters don't become words.

    A form of one character is exchanged for its own; characters of longer forms are looked up only where a title has one.
    """
    table = F.create_map(*[F.lit(x) for kv in _MANY.items() for x in kv])
    longer = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    one = F.translate(title, "".join(_ONE), "".join(_ONE.values()))
    many = bound(one, lambda t: F.when(t.rlike(f"[{''.join(_MANY)}]"), longer(t)).otherwise(t))
    composed = bound(many, lambda t: F.when(t.rlike("[\u0300-\u036f]"), F.regexp_replace(t, _COMPOSING, "\u00e9")).otherwise(t))
    return F.when(title.rlike(r"[^\x00-\x7F]"), composed).otherwise(title)


def normalized_title(title: Column) -> Column:
    """Lower case, numbers without commas, a few abbreviations spelled out, ASCII words with . and - only."""
    t = F.lower(_without_labels(trimmed(_token_form(title))))
    t = F.regexp_replace(t, r"(?<=[0-9]),(?=[0-9])", "")
    t = F.replace(t, F.lit("%"), F.lit(" percent "))
    for short, full in (("pts", "points"), ("cr", "crore"), ("lac", "lakh"), ("govt", "government")):
        t = F.regexp_replace(t, rf"(?<![A-Za-z0-9_]){short}(?![A-Za-z0-9_])", full)
    t = F.regexp_replace(t, r"(?U)[^A-Za-z0-9_\s.-]", " ")
    return trimmed(F.regexp_replace(t, _SPACE, " "))


def significant_title_tokens(normalized: Column) -> Column:
    """Words with their edge dots and dashes cut off: numbers, and words of two letters or more that aren't stop words."""
    tokens = F.transform(_words(normalized), lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", ""))
    return F.filter(tokens, lambda t: t.rlike(r"^[0-9]+(?:\.[0-9]+)?$") | ((F.length(t) >= 2) & ~t.isin(K.TITLE_STOP_WORDS)))


def bigrams(tokens: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(2), F.size(tokens)), lambda i: F.concat_ws(" ", F.element_at(tokens, i - 1), F.element_at(tokens, i)))
    return F.when(F.size(tokens) >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def title_tokens(title: Column) -> Column:
    """Struct of normalized, unigrams, bigrams, numbers and significant tokens; sets keep the order of the title."""

    def struct(normalized: Column, tokens: Column) -> Column:
        return F.struct(
            title.alias("raw"),
            normalized.alias("normalized"),
            F.array_distinct(tokens).alias("unigrams"),
            bigrams(tokens).alias("bigrams"),
            F.array_distinct(F.filter(tokens, lambda t: t.rlike(r"^[0-9]+(?:\.[0-9]+)?$"))).alias("numbers"),
            tokens.alias("significant"),
        )

    return bound(normalized_title(title), lambda n: bound(significant_title_tokens(n), lambda t: struct(n, t)))


def plain_words(text: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 a blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def editorial_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain_words(text), " "), lambda w: (F.length(w) >= 3) & ~w.isin(K.EDITORIAL_STOP_WORDS)))


def rule_word_count(text: Column) -> Column:
    """Words that hold a letter or digit."""
    return F.size(F.filter(F.split(text, _SPACE), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def visible_word_count(text: Column) -> Column:
    """All runs of other than white space; a dash that stands alone counts here."""
    return F.size(F.filter(F.split(text, _SPACE), lambda w: w != ""))


def has_markup(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in K.MARKUP))


def is_hard_news(text: Column) -> Column:
    terms = "|".join(K.HARD_NEWS_TERMS)
    return plain_words(text).rlike(rf"(?<![a-z0-9])(?:{terms})s?(?![a-z0-9])")


def editorial_day(ts: Column) -> Column:
    """The calendar date in India of an instant."""
    return F.to_date(F.from_utc_timestamp(ts, K.EDITORIAL_ZONE))


def long_date(day: Column) -> Column:
    return F.date_format(day, "EEEE, d MMMM yyyy")


def long_instant(ts: Column) -> Column:
    t = F.from_utc_timestamp(ts, K.EDITORIAL_ZONE)
    return F.concat(F.date_format(t, "d MMMM yyyy, h:mm "), F.lower(F.date_format(t, "a")), F.lit(" IST"))


def hours_between(a: Column, b: Column) -> Column:
    """Null if either is null."""
    return F.abs(F.unix_millis(a) - F.unix_millis(b)) / F.lit(3600000.0)


def slug_to_name(slug: Column) -> Column:
    """Words of a slug with their first letter raised; the rest stays."""
    return F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def bounded(text: Column, least: int, most: int, fallback: str) -> Column:
    """Text within bounds: cut with dots if too long, the fallback added if too short, else the fallback alone."""
    t = trimmed(F.regexp_replace(strip_tags(nfkc(F.coalesce(text, F.lit("")))), _SPACE, " "))
    t = F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 3), r"(?U)\s+$", ""), F.lit("..."))).otherwise(t)
    longer = trimmed(F.concat(t, F.lit(" " + fallback)))
    return F.when(F.length(t) >= least, t).when(F.length(longer).between(least, most), longer).otherwise(F.lit(fallback))


def safe_relative_name(name: Column) -> Column:
    """No backslash, not absolute, and no empty, . or .. segment."""
    return (F.length(name) > 0) & ~name.contains("\\") & ~name.startswith("/") & F.forall(F.split(name, "/"), lambda s: ~s.isin("", ".", ".."))


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


_DAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+"


def feed_date(value: Column) -> Column:
    """Timestamps of feeds: ISO dates and date-times (UTC if they name no zone), and RFC 822 forms that name one; else null."""
    v = trimmed(value)
    iso_day = v.rlike(r"^\d{4}-\d{2}-\d{2}$")
    iso = v.rlike(r"^(?i)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?$")
    colon = F.regexp_replace(F.upper(v), r"([+-]\d{2}):?(\d{2})$", "$1:$2")
    zoned = F.when(v.rlike(r"(?i)(?:Z|[+-]\d{2}:?\d{2})$"), colon).otherwise(F.concat(F.upper(v), F.lit("Z")))
    zoned = F.regexp_replace(zoned, r"([T ][0-9]{2}:[0-9]{2})(Z|[+-])", "$1:00$2")
    named = F.regexp_replace(v, "(?i)" + _DAY, "")
    offsets = {"UT|UTC|GMT|Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
    for zone, offset in offsets.items():
        named = F.regexp_replace(named, rf"(?i)\s*(?<![A-Za-z])(?:{zone})$", " " + offset)
    named = F.regexp_replace(named, r"([+-]\d{2}):(\d{2})$", "$1$2")
    patterns = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMMM yyyy HH:mm:ss Z"]
    parsed = F.coalesce(*[F.try_to_timestamp(named, F.lit(p)) for p in patterns])
    zoned_text = v.rlike(r"(?i)(?:\b(?:UT|UTC|GMT|[ECMP][SD]T)\b|[+-]\d{2}:?\d{2}|Z)$")
    return (
        F.when(iso_day, F.try_to_timestamp(F.concat(v, F.lit("T00:00:00Z"))))
        .when(iso, F.try_to_timestamp(zoned))
        .when(zoned_text & ~iso_day & ~iso, parsed)
    )
