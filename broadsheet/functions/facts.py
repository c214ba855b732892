"""Numbers, names and dates in a text, as Column expressions over whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions import constants as K
from broadsheet.functions.text import bound

# What counts as a number, an acronym, a name and a date. Findings name the tokens, so these must be the format's
# own; word edges are ASCII ones.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
NUMBER = (
    r"(?i)(?:[₹$€£]\s*)?(?:[0-9]{1,3}(?:,[0-9]{2,3})+|[0-9]+)(?:\.[0-9]+)?"
    rf"(?:\s*(?:%|percent|{_L}crore{_R}|{_L}lakh{_R}|{_L}million{_R}|{_L}billion{_R})|[BMKbmk]{_R})?"
)
ACRONYM = rf"{_L}[A-Z]{{2,10}}{_R}|{_L}[A-Z][a-z]+[A-Z][A-Za-z]*{_R}"
PHRASE = rf"{_L}[A-Z][a-z]+(?:\s+(?:of|and|the|for|in|on|at)?\s*[A-Z][a-z]+)+{_R}"
_MONTH = "|".join(K.MONTHS)
MONTH_DATE = rf"(?i){_L}(?:{_MONTH})\s+[0-9]{{1,2}}(?:,\s*[0-9]{{4}})?{_R}|{_L}[0-9]{{1,2}}\s+(?:{_MONTH})(?:\s+[0-9]{{4}})?{_R}"
ISO_DATE = rf"{_L}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{_R}"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def canonical_number(token: Column) -> Column:
    """A number in its shortest decimal form: spelled ones as digits; no currency, commas, percent; what no number starts, as is."""

    def short(head: Column) -> Column:
        whole = F.regexp_replace(F.regexp_replace(head, r"^([+-]?)0*(?=[0-9])", "$1"), r"^\+", "")
        cut = bound(whole, lambda s: F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s))
        led = bound(cut, lambda s: F.when(s.startswith("."), F.concat(F.lit("0"), s)).when(s.startswith("-."), F.concat(F.lit("-0"), F.substring(s, 2, 1 << 20))).otherwise(s))
        return bound(led, lambda s: F.when(s.isin("", "-", "-0"), "0").otherwise(s))

    def plain(cleaned: Column) -> Column:
        head = F.regexp_extract(cleaned, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0)
        return bound(head, lambda h: F.when(h != "", short(h)).otherwise(cleaned))

    return bound(F.lower(F.trim(token)), lambda low: F.coalesce(spelled(low), bound(F.regexp_replace(low, r"[₹$€£,%\s]", ""), plain)))


def normalize_numbers(tokens: Column) -> Column:
    return F.transform(tokens, canonical_number)


def spelled(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.SPELLED_NUMBERS.items() for x in kv])
    return F.element_at(table, word)


def numerals(text: Column) -> Column:
    """Numbers as written, trimmed, each once."""
    return F.array_distinct(F.transform(_all(text, NUMBER), lambda t: F.trim(t)))


def numbers(text: Column) -> Column:
    """Numbers as written and their canonical forms, their bare digits, and spelled-out numbers with their digits."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: spelled(w).isNotNull())

    def both(raw: Column, bare: Column, words: Column) -> Column:
        found = F.concat(raw, normalize_numbers(raw), bare, normalize_numbers(bare), words, F.transform(words, spelled))
        return F.array_distinct(F.filter(found, lambda t: t != ""))

    digits = lambda raw: F.transform(raw, lambda t: F.regexp_replace(t, r"[^0-9.]", ""))
    return bound(numerals(text), lambda raw: bound(digits(raw), lambda bare: bound(words, lambda ws: both(raw, bare, ws))))


def named_entities(text: Column, least: int = 2) -> Column:
    """Acronyms, words with inner capitals, and capitalised phrases without a common first word."""
    acronyms = F.filter(_all(text, ACRONYM), lambda a: F.length(a) >= least)

    def named(phrase: Column) -> Column:
        starts = lambda words: F.lower(words[0]).isin(K.COMMON_INITIAL_WORDS)
        rest = lambda words: F.when(F.size(words) > 2, F.array_join(F.slice(words, 2, F.size(words)), " "))
        return bound(F.split(phrase, r"\s+"), lambda words: F.when(starts(words), rest(words)).otherwise(phrase))

    phrases = F.filter(F.transform(_all(text, PHRASE), named), lambda p: p.isNotNull() & (F.length(p) >= least))
    return F.array_distinct(F.concat(acronyms, phrases))


def dates(text: Column) -> Column:
    """ISO dates, dates with month names, weekdays and relative days, each once. Patterns with edges are only tried on texts
    that hold their words, as most hold none."""

    def found(low: Column) -> Column:
        said = F.array_compact(F.array(*[F.when(low.contains(w) & low.rlike(_L + w + _R), F.lit(w)) for w in [*K.WEEKDAYS, *K.RELATIVE_DATES]]))
        named = reduce(Column.__or__, [low.contains(m.lower()[:3]) for m in K.MONTHS])
        months = F.when(named, F.transform(_all(text, MONTH_DATE), F.trim)).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(_all(text, ISO_DATE), months, said))

    return bound(F.lower(text), found)


def fact_tokens(text: Column) -> Column:
    return F.struct(numbers(text).alias("numbers"), named_entities(text).alias("named_entities"), dates(text).alias("dates"))
