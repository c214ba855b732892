"""What the training-data operators share: tables, scratch tables, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as the contracts of the operators give it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where the session names none and runs in one process, a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="broadsheet-"))
        found = sc.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Later passes read the written rows, so that a lost executor costs a reread and never a different answer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a Python worker has learned for an operator (words and their ids, say), by operator: how to forget it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, forget: Callable[[], None]) -> None:
    _kept[operator] = forget


def claim(operator: str) -> None:
    """Called where an operator's task starts: workers outlive tasks, and only one operator's knowledge stays in them."""
    for other, forget in _kept.items():
        if other != operator:
            forget()


def release() -> None:
    """Called where a task ends: gives memory that it has freed back to the system, as workers stay beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def normalised(text: Column) -> Column:
    """The text with each run of white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def offsets(counts: DataFrame, key: str, by: list[str], size: str, out: str) -> DataFrame:
    """Running total of size before each row of a small table, ordered by key within by."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
