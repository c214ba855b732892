"""What a reader gets to see: requests against an index and the copies of editions, with why something failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.operators.reader import freshness, notice, route

#: Statuses of what isn't there, as against what can't be reached.
MISSING = [404, 410]


def copy_problem(status: Column, content_type: Column, body: Column, date: Column | None = None) -> Column:
    """Why a response is no document, in the order in which a reader finds out; null if it is one.

    network: no answer. unavailable: nothing there, or a page in its place. unreachable: another status. malformed: no JSON.
    invalid: JSON of another shape, version or date.
    """
    doc = F.try_parse_json(body)
    shaped = F.schema_of_variant(doc).startswith("OBJECT") & (F.try_variant_get(doc, "$.schemaVersion", "int") == 1)
    right = shaped if date is None else shaped & (F.try_variant_get(doc, "$.date", "string") == date)
    return (
        F.when(status.isNull() | body.isNull() & status.between(200, 299), "network")
        .when(status.isin(MISSING), "unavailable")
        .when(~status.between(200, 299), "unreachable")
        .when(F.lower(F.coalesce(content_type, F.lit(""))).startswith("text/html"), "unavailable")
        .when(doc.isNull(), "malformed")
        .when(~F.coalesce(right, F.lit(False)), "invalid")
    )


def index_of(responses: DataFrame) -> DataFrame:
    """One row from the response (status, content_type, body) for the index: problem, contentSet, latest, editions."""
    doc = F.try_parse_json("body")
    read = responses.limit(1).select(
        copy_problem(F.col("status"), F.col("content_type"), F.col("body")).alias("problem"), F.try_variant_get(doc, "$.contentSet", "string").alias("contentSet"),
        F.try_variant_get(doc, "$.latest", "string").alias("latest"), F.coalesce(F.try_variant_get(doc, "$.editions", "array<string>"), F.array().cast("array<string>")).alias("editions"),
    )
    return read.withColumn("problem", F.coalesce("problem", F.when(~F.coalesce(F.col("contentSet").isin("published", "sample"), F.lit(False)), "invalid")))


def load_states(requests: DataFrame, index: DataFrame, copies: DataFrame) -> DataFrame:
    """requests(request_id, path, today) with date, status (ready, none, failed), reason, prior_date, fresh, source, notice.

    index: the one row of index_of. copies(date, status, content_type, body, source): a row a date at most. A route that
    names nothing fails before anything is asked for, then the index, then the edition; only for the last is the newest
    other edition of the index offered. An empty index has no edition to show, which is no failure.
    """
    one = F.broadcast(index.select(F.col("problem").alias("index_problem"), "contentSet", "latest", "editions"))  # one row
    r = requests.select("request_id", "today", route(F.col("path")).alias("r")).crossJoin(one)
    r = r.withColumn("date", F.when(F.col("r.kind") == "edition", F.col("r.date")).when(F.col("r.kind") == "latest", F.col("latest")))
    known = copies.select("date", "source", copy_problem(F.col("status"), F.col("content_type"), F.col("body"), F.col("date")).alias("problem"), F.lit(True).alias("there"))
    both = r.join(known, "date", "left")
    reason = (
        F.when(F.col("r.kind") == "unknown", "unavailable")
        .when(F.col("index_problem").isNotNull(), F.col("index_problem"))
        .when(F.col("date").isNull(), F.lit(None))
        .when(F.col("there").isNull(), "unavailable")
        .otherwise(F.col("problem"))
    )
    both = both.withColumn("reason", reason)
    status = F.when(F.col("reason").isNotNull(), "failed").when(F.col("date").isNull(), "none").otherwise("ready")
    asked = (F.col("status") == "failed") & (F.col("r.kind") != "unknown") & F.col("index_problem").isNull()
    other = F.get(F.filter("editions", lambda d: d != F.col("date")), F.lit(0))
    both = both.withColumn("status", status).withColumn("fresh", F.when(F.col("status") == "ready", freshness(F.col("r.kind"), F.col("date"), F.col("today"))))
    source = F.when(F.col("status") == "ready", F.col("source"))
    return both.select("request_id", "date", "status", "reason", F.when(asked, other).alias("prior_date"), "fresh", source.alias("source"), notice(F.col("fresh"), source).alias("notice"))
