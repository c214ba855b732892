"""Queries of stories: greedy clusters and semantic merges, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.catalogue import items_of, query
from broadsheet.functions import constants as K
from broadsheet.operators import clusters as C
from broadsheet.operators import semantic as S
from broadsheet.session import table


@query("story_members")
def story_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first document of its story, its place in it and the score it joined with. The greedy order
    is too slow in SQL on whole tables (minutes for 200 rows): tests hold it against a plain run."""
    found = C.cluster_items(items_of(spark, sf_dir))
    lead = found.filter("join_ordinal = 0").select(F.col("node").alias("leader"), F.col("doc_id").alias("first"))
    return found.join(lead, "leader").select("doc_id", F.col("first").alias("leader"), "join_ordinal", F.round("join_score", 6).alias("join_score"))


class CosineProvider:
    """A stand-in for a language model: as sure as two vectors are alike, and without an answer for some pairs."""

    name = "cosine"

    def evaluate(self, a: dict, b: dict) -> tuple[bool, float, str | None]:
        if (a["vec_id"] + b["vec_id"]) % 11 == 0:
            raise TimeoutError("no answer")
        x, y = a["e"], b["e"]
        dot = lambda p, q: math.fsum(s * t for s, t in zip(p, q))
        return True, 0.5 + dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)), None


@query(
    "semantic_merge",
    f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), decided AS (
            SELECT a.vec_id AS i, b.vec_id AS j, a.label + 1 AS si, b.label + 1 AS sj, 0.5 + list_cosine_similarity(a.e, b.e) AS confidence
            FROM v a JOIN v b ON b.vec_id < a.vec_id AND b.vec_id >= a.vec_id - {K.CLUSTER_HOURS} WHERE (a.vec_id + b.vec_id) % 11 <> 0
        ), pairs AS (SELECT *, row_number() OVER (ORDER BY i DESC, j DESC) AS r FROM decided WHERE confidence >= {K.SEMANTIC_FLOOR}
        ), fold AS (
            SELECT 0::BIGINT AS r, []::STRUCT(i BIGINT, j BIGINT, sj INT, confidence DOUBLE)[] AS taken
            UNION ALL
            SELECT p.r, CASE WHEN len(list_filter(f.taken, lambda t: t.j = p.i OR t.j = p.j)) = 0
                              AND p.si + p.sj + coalesce(list_sum(list_transform(list_filter(f.taken, lambda t: t.i = p.i), lambda t: t.sj)), 0) <= {K.CLUSTER_SIZE}
                             THEN list_append(f.taken, struct_pack(i := p.i, j := p.j, sj := p.sj, confidence := p.confidence)) ELSE f.taken END
            FROM fold f JOIN pairs p ON p.r = f.r + 1
        ), merged AS (SELECT unnest(taken) AS t FROM (SELECT taken FROM fold ORDER BY r DESC LIMIT 1))
        SELECT t.j AS vec_id, t.i AS into_id, round(t.confidence, 6) AS confidence FROM merged""",
)
def semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as clusters, one an hour, of one to ten items; pairs within the window go to a provider that may fail."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("leader"), (F.col("label") + 1).alias("size"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    found = v.withColumn("primary_at", F.timestamp_seconds(F.col("leader") * 3600))
    found = found.select("leader", "size", "primary_at", S.order_key(F.col("primary_at"), F.lit(1), F.lpad(F.col("leader").cast("string"), 12, "0")).alias("key"))
    views = v.select("leader", F.struct(F.col("leader").alias("vec_id"), "e").alias("view"))
    taken = S.absorptions(found, S.window_pairs(found), CosineProvider(), views)
    return taken.select(F.col("leader").alias("vec_id"), F.col("into").alias("into_id"), F.round("confidence", 6).alias("confidence"))
