"""Edition documents and their sinks: JSON files in a folder, one a date, and the index beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.operators.findings import EDITION


def read_editions(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.json directly in a folder: file (name), corrupt (its text, if it is no JSON object) and the columns of EDITION."""
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    parsed = raw.withColumn("e", F.from_json("value", EDITION))
    return parsed.select("file", F.when(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"), F.col("value")).alias("corrupt"), "e.*")


def json_findings(editions: DataFrame) -> DataFrame:
    """Files that are no JSON: reported, and not looked at further."""
    bad = editions.filter("corrupt is not null")
    return bad.select("file", F.lit("edition/file-json").alias("rule_id"), F.lit("blocking").alias("severity"), F.lit(None).cast("string").alias("story_id"), F.lit(-1).alias("story_pos"), F.lit("not JSON").alias("detail"))


def write_editions(editions: DataFrame, folder: str) -> None:
    """One partition a date; a date written again replaces its own partition only."""
    editions.withColumn("edition_date", F.col("date")).repartition("edition_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("edition_date").json(folder)


def registry_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Entries of a source registry as a table; unknown keys and missing ids are refused."""
    names = "id publisher siteUrl feedUrl sourceType region language active sample termsUrl licenseUrl termsReviewedOn termsReviewedBy permittedUse permittedUses attribution".split()
    for e in entries:
        if unknown := set(e) - set(names):
            raise ValueError(f"unknown keys in a source: {sorted(unknown)}")
        if not e.get("id"):
            raise ValueError("a source has no id")
    kinds = {"active": "boolean", "sample": "boolean", "permittedUses": "array<string>"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], schema).withColumn("source_id", F.col("id"))


def json_report(findings: DataFrame) -> DataFrame:
    """Findings of each file as one JSON text."""
    row = F.struct("story_pos", "rule_id", "severity", "story_id", "detail")
    return findings.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("report"))


def text_report(findings: DataFrame) -> DataFrame:
    """Findings of each file as text, a line each, in their order; nothing is hidden."""
    line = F.format_string("%s %s%s: %s", "severity", "rule_id", F.coalesce(F.concat(F.lit(" ["), "story_id", F.lit("]")), F.lit("")), F.coalesce("detail", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("story_pos", "rule_id", line.alias("line"))))
    return findings.groupBy("file").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("report"))
