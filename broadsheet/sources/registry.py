"""Source registries as tables: what is wrong with a file or an entry is a row, never an exception."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions import urls
from broadsheet.session import written

# The fields of an entry, in order, and what some of them may say.
BASE = "id publisher siteUrl feedUrl sourceType region language active sample".split()
TERMS = "termsUrl licenseUrl termsReviewedOn termsReviewedBy permittedUse permittedUses attribution".split()
NEEDED_TO_FETCH = "termsUrl termsReviewedOn termsReviewedBy permittedUse permittedUses attribution".split()
ONE_OF = {"sourceType": ["publisher", "primary", "research", "official"], "region": ["india", "south-asia", "world"], "language": ["en"]}
USES = ["headline", "supplied-description", "generated-summary"]
LENGTHS = {"publisher": (1, 120), "termsReviewedBy": (2, 80), "permittedUse": (40, 600), "attribution": (2, 200)}
IDENTIFIER = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"


@F.pandas_udf(T.StringType())
def yaml_to_json(text: pd.Series) -> pd.Series:
    """A YAML text (JSON is YAML, too) as JSON; null if it can't be read. Dates are texts as they stand.

    JSON is read as such, which is far faster, unless it holds what YAML reads in another way.
    """
    import yaml

    class Plain(yaml.SafeLoader):
        pass

    Plain.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def same(number: str) -> float:
        if not re.fullmatch(r"-?[0-9]+\.[0-9]+(?:[eE][-+][0-9]+)?", number):
            raise ValueError(number)  # a text to YAML, as NaN is
        return float(number)

    def read(t: str) -> object:
        try:
            if '"<<"' not in t and not yaml.reader.Reader.NON_PRINTABLE.search(t):
                return json.loads(t, parse_float=same, parse_constant=same)
        except ValueError:
            pass
        return yaml.load(t, Plain)

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(read(t))
        except (yaml.YAMLError, TypeError, ValueError):
            return None

    return text.map(one)


def read_registries(spark: SparkSession, folder: str) -> DataFrame:
    """file, text of every .yaml, .yml and .json file directly in a folder."""
    raw = spark.read.text(f"{folder}/*.{{yaml,yml,json}}", wholetext=True)
    return raw.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))


def _of(entry: Column, field: str) -> Column:
    return F.try_variant_get(entry, f"$.{field}", "variant")


def _kind(entry: Column, field: str) -> Column:
    return F.schema_of_variant(_of(entry, field))


def _text(entry: Column, field: str) -> Column:
    return F.try_variant_get(entry, f"$.{field}", "string")


def _keys(value: Column) -> Column:
    return F.map_keys(F.from_json(F.to_json(value), "map<string,string>"))


def _problems(e: Column) -> Column:
    """(path, message) of all that is wrong with an entry's fields, in their order."""
    active, sample = F.try_variant_get(e, "$.active", "boolean"), F.try_variant_get(e, "$.sample", "boolean")
    told = lambda wrong, path, message: F.when(wrong, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    there = lambda f: _of(e, f).isNotNull() & (_kind(e, f) != "VOID")
    out = []
    for f in BASE:
        out.append(told(~there(f), f, "is required"))
    for f in NEEDED_TO_FETCH:
        out.append(told(F.coalesce(active, F.lit(False)) & ~there(f), f, "is required of an active source"))
    for f in [*BASE, *TERMS]:
        kind = "BOOLEAN" if f in ("active", "sample") else "ARRAY" if f == "permittedUses" else "STRING"
        out.append(told(there(f) & ~_kind(e, f).startswith(kind), f, f"must be {kind.lower()}"))
    is_text = lambda f: there(f) & (_kind(e, f) == "STRING")
    out.append(told(is_text("id") & (~_text(e, "id").rlike(IDENTIFIER) | (F.length(_text(e, "id")) > 64)), "id", "must be lowercase words joined by dashes"))
    for f, values in ONE_OF.items():
        out.append(told(is_text(f) & ~_text(e, f).isin(values), f, "must be one of " + ", ".join(values)))
    for f, (least, most) in LENGTHS.items():
        n = F.length(F.trim(_text(e, f)))
        out.append(told(is_text(f) & ~n.between(least, most), f, f"must have {least} to {most} characters"))
    out.append(told(is_text("termsReviewedBy") & _text(e, "termsReviewedBy").contains("@"), "termsReviewedBy", "must be a name, not an address"))
    out.append(told(is_text("termsReviewedOn") & (~_text(e, "termsReviewedOn").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(_text(e, "termsReviewedOn"), "yyyy-MM-dd").isNull()), "termsReviewedOn", "must be a date"))
    for f in ("siteUrl", "termsUrl", "licenseUrl", "feedUrl"):
        out.append(told(is_text(f) & (urls.canonicalize(_text(e, f)).isNull() | (F.length(_text(e, f)) > 2048)), f, "must be an http or https URL"))
    feed = _text(e, "feedUrl")
    out.append(told(is_text("feedUrl") & ~F.lower(feed).startswith("https:"), "feedUrl", "must use https"))
    out.append(told(is_text("feedUrl") & feed.rlike(r"^[A-Za-z]+://[^/?#]*@"), "feedUrl", "must not carry credentials"))
    out.append(told(is_text("feedUrl") & feed.rlike(r"^[A-Za-z]+://[^/?#]*:[0-9]+") & ~feed.rlike(r"^https://[^/?#]*:443(?:[/?#]|$)"), "feedUrl", "must not name a port"))
    out.append(told(is_text("feedUrl") & feed.contains("#"), "feedUrl", "must not carry a fragment"))
    uses = F.try_variant_get(e, "$.permittedUses", "array<string>")
    out.append(told(there("permittedUses") & ((F.size(uses) == 0) | (F.size(F.array_except(uses, F.array(*map(F.lit, USES)))) > 0)), "permittedUses", "must name permitted uses"))
    out.append(told(F.coalesce(active & sample, F.lit(False)), "sample", "a sample can't be active"))
    allowed = F.when(F.coalesce(sample, F.lit(False)), F.array(*map(F.lit, BASE))).otherwise(F.array(*map(F.lit, [*BASE, *TERMS])))
    unknown = F.transform(F.array_except(_keys(e), allowed), lambda k: F.struct(k.alias("path"), F.lit("isn't known here").alias("message")))
    return F.concat(F.array_compact(F.array(*out)), F.coalesce(unknown, F.array().cast("array<struct<path:string,message:string>>")))


def registry_scan(files: DataFrame) -> DataFrame:
    """files(file, text) -> a row an entry: file, position, source_id, entry (as JSON) and problems; and a row of position -1
    for what is wrong with a file as a whole. An unreadable file is one row with one problem."""
    doc = files.select("file", F.try_parse_json(yaml_to_json(F.col("text"))).alias("doc"))
    sources = F.try_variant_get("doc", "$.sources", "array<variant>")
    told = lambda wrong, path, message: F.when(wrong, F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    shape = F.col("doc").isNull() | ~F.schema_of_variant("doc").startswith("OBJECT")
    unknown = F.transform(F.array_except(_keys(F.col("doc")), F.array(F.lit("schemaVersion"), F.lit("sources"))), lambda k: F.struct(k.alias("path"), F.lit("isn't known here").alias("message")))
    inner = F.concat(F.array_compact(F.array(told(~F.try_variant_get("doc", "$.schemaVersion", "int").eqNullSafe(F.lit(1)), "schemaVersion", "must be 1"), told(sources.isNull(), "sources", "must be a list"))), unknown)
    whole = F.when(shape, F.array(F.struct(F.lit("").alias("path"), F.lit("must be a mapping").alias("message")))).otherwise(inner)
    tops = doc.select("file", F.lit(-1).alias("position"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("entry"), whole.alias("problems"))
    # a file is one row, its entries are looked at side by side; they are small, and Spark would put them into one task
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = doc.filter(~shape).select("file", F.posexplode(sources).alias("position", "e")).repartition(tasks, "file", "position")
    entries = each.select("file", "position", _text(F.col("e"), "id").alias("source_id"), F.to_json("e").alias("entry"), _problems(F.col("e")).alias("problems"))
    return tops.filter(F.size("problems") > 0).unionByName(entries)


def schema_findings(scan: DataFrame) -> DataFrame:
    """registry/schema and registry/no-sources findings of a scan: file, rule_id, severity, source_id, position, path, detail.
    Ids and feed URLs that repeat in a file are findings of the file."""
    scan = written(scan, "registry-scan")  # read three times
    own = scan.select("file", "position", "source_id", F.explode("problems").alias("p")).select("file", "position", "source_id", F.when(F.col("position") < 0, F.col("p.path")).otherwise(F.concat_ws(".", F.lit("sources"), "position", "p.path")).alias("path"), F.col("p.message").alias("detail"))
    entries = scan.filter("position >= 0").withColumn("feed", urls.feed_key(F.get_json_object("entry", "$.feedUrl")))
    twice = lambda c, what: entries.filter(F.col(c).isNotNull()).groupBy("file", c).agg(F.count("*").alias("n")).filter("n > 1").select("file", F.lit(-1).alias("position"), F.lit(None).cast("string").alias("source_id"), F.lit("sources").alias("path"), F.concat(F.lit(f"duplicate {what} "), c).alias("detail"))
    rows = own.unionByName(twice("source_id", "source id")).unionByName(twice("feed", "feed URL"))
    return rows.select("file", F.lit("registry/schema").alias("rule_id"), F.lit("blocking").alias("severity"), "source_id", "position", "path", "detail")


def registry_entries(scan: DataFrame) -> DataFrame:
    """The entries of files without a schema finding, as the table that rules and lookups take; of other files none."""
    bad = schema_findings(scan).select("file").distinct()
    kinds = {"active": "boolean", "sample": "boolean", "permittedUses": "array<string>"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in [*BASE, *TERMS])
    good = scan.filter("position >= 0").join(bad, "file", "left_anti")
    return good.select("file", "position", "source_id", F.from_json("entry", schema).alias("e")).select("file", "position", "source_id", "e.*")
