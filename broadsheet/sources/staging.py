"""Staged editions in versions, with a pointer that is moved last.

A run writes its editions and its index into a folder of its own version, reads them back, and only then moves the pointer,
which is one small file renamed over the old one. Readers follow the pointer: a run that dies at any moment leaves them
what was staged before. Earlier versions stay until they are swept, so a rollback is a move of the pointer, too.
"""

from __future__ import annotations

import json
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from broadsheet.operators import lifecycle
from broadsheet.session import written

POINTER = "current.json"


class NotStaged(Exception):
    """Why a run stages nothing; what was staged before stands."""


def _files(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """Hadoop's file context of a path, and the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()), p


def _point(spark: SparkSession, folder: str, pointer: dict) -> None:
    """Writes the pointer beside the old one and renames it over that in one step."""
    jvm = spark.sparkContext._jvm
    fresh = f"{folder}/.{POINTER}-{uuid.uuid4().hex}"
    fc, path = _files(spark, fresh)
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    out = fc.create(path, flags, none)
    out.write(bytearray(json.dumps(pointer), "utf-8"))
    out.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fc.rename(path, jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}"), rename)


def current(spark: SparkSession, folder: str) -> dict | None:
    """The pointer: version, and the version before it. None where nothing was staged yet."""
    fc, path = _files(spark, f"{folder}/{POINTER}")
    if not fc.util().exists(path):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/{POINTER}").collect()))


def staged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """Editions and index that the pointer names."""
    at = current(spark, folder)
    return at and (spark.read.schema(StructType.fromJson(at["schema"])).json(f"{folder}/{at['version']}/editions"), spark.read.json(f"{folder}/{at['version']}/index"))


def stage(editions: DataFrame, reports: DataFrame, folder: str, mode: str = "published") -> DataFrame:
    """Stages what lifecycle.staging_plan lets through, and returns the plan.

    A blocking finding on any edition, or a written version that isn't what the plan says, raises NotStaged before the
    pointer moves. No edition at all is a version of its own: an index that points at none.
    """
    spark = editions.sparkSession
    plan = written(lifecycle.staging_plan(reports, mode), "staging-plan")
    if blocked := plan.filter("blocking > 0").count():
        raise NotStaged(f"{blocked} editions have blocking findings")
    before = current(spark, folder)
    version = f"version-{uuid.uuid4().hex}"
    # dates that several files have: the newest place of the plan wins
    wanted = plan.filter("stage").groupBy("date").agg(F.min_by("file", "rank").alias("file"))
    out = editions.join(wanted, ["file", "date"], "left_semi")
    out.withColumn("edition_date", F.col("date")).repartition("edition_date").write.partitionBy("edition_date").json(f"{folder}/{version}/editions")
    lifecycle.staged_index(plan, mode).coalesce(1).write.json(f"{folder}/{version}/index")

    back = spark.read.schema(out.schema).json(f"{folder}/{version}/editions")
    index = spark.read.json(f"{folder}/{version}/index")
    wrong = [r["problem"] for r in lifecycle.index_problems(index).collect()] if wanted.count() else []
    listed = index.select(F.explode("editions").alias("date")) if wanted.count() else wanted.select("date")
    missing = listed.join(back.select("date"), "date", "left_anti").count() + back.select("date").join(listed, "date", "left_anti").count()
    if wrong or missing or back.count() != wanted.count():
        raise NotStaged("; ".join([*wrong, f"{missing} dates differ"]))
    _point(spark, folder, {"version": version, "before": before and before["version"], "schema": out.schema.jsonValue()})
    return plan


def restore(spark: SparkSession, folder: str, version: str | None = None) -> dict:
    """Moves the pointer back to the version before, or to one that is named; NotStaged if it isn't there whole."""
    at = current(spark, folder)
    target = version or (at and at["before"])
    fc, path = _files(spark, f"{folder}/{target}/index/_SUCCESS")
    if not target or not fc.util().exists(path):
        raise NotStaged(f"no version {target}")
    _point(spark, folder, {"version": target, "before": at["version"], "schema": at["schema"]})
    return current(spark, folder)


def roll_back(editions: DataFrame, reports: DataFrame, plan: DataFrame, folder: str) -> DataFrame:
    """Executes a lifecycle.rollback_plan: stages the editions without the withdrawn ones, as a version of its own; raises
    NotStaged where the plan holds an error. Returns the editions as they are now, withdrawn ones as drafts."""
    if error := plan.filter("error IS NOT NULL").select("error").first():
        raise NotStaged(error["error"])
    now = written(lifecycle.withdraw(editions, plan), "rolled-back")
    gone = plan.select(F.explode("withdrawn").alias("date"))
    stage(now, reports.join(gone, "date", "left_anti"), folder)
    return now


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Deletes versions that the pointer and the one before it don't name; names that no run wrote stay."""
    at = current(spark, folder)
    keep = {at["version"], at["before"]} if at else set()
    fc, path = _files(spark, folder)
    found = [s.getPath().getName() for s in fc.util().listStatus(path)]
    gone = sorted(n for n in found if n.startswith("version-") and n not in keep) if at else []
    for name in gone:
        fc.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return gone
