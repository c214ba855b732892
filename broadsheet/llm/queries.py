"""The operators of this subpackage as queries over the given tables, with SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import exact_dedup, html_text, jaccard_join, language_id, lm_scoring, mixing, nearest, packing, quality, resampling, sharding, source_audit, token_counts
from broadsheet.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    placed = sharding.shuffle_into_shards(sized, "size", shards=8)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "component_sets")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the same package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = token_counts.token_report(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return report.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language_id.learn(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs, filters)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(quality.with_label(docs.filter(~language_id.held_out()), table(spark, sf_dir, "labels")))
    return quality.classify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "score", "predicted")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_nearest": op5_nearest,
    "op6_packing": op6_packing,
    "op7_html_text": op7_html_text,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_quality": op11_quality,
    "op12_resampling": op12_resampling,
    "op13_source_audit": op13_source_audit,
}

ORACLE = {
    "op4_lm_scoring": r"""
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
        ), each AS (
            SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words)
        ), c1 AS (SELECT w, count(*) AS n FROM each GROUP BY w),
        c2 AS (SELECT v, w, count(*) AS n FROM each WHERE v IS NOT NULL GROUP BY v, w),
        total AS (SELECT count(*) AS n FROM each),
        scores AS (
            SELECT e.doc_id, sum(CASE WHEN e.v IS NULL THEN ln(a.n / t.n) WHEN c2.n >= 2 THEN ln(c2.n / b.n) ELSE ln(0.4 * a.n / t.n) END) AS s
            FROM each e CROSS JOIN total t JOIN c1 a ON a.w = e.w LEFT JOIN c1 b ON b.w = e.v LEFT JOIN c2 ON c2.v = e.v AND c2.w = e.w
            GROUP BY e.doc_id
        )
        SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, round(coalesce(s.s, 0), 4) AS log_score, round(s.s / nullif(len(w.ws), 0), 4) AS mean_log_score
        FROM words w LEFT JOIN scores s USING (doc_id)
    """,
    "op3_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM texts WINDOW same AS (PARTITION BY norm)
    """,
    "op12_resampling": r"""
        WITH tab AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) x(i)
        ), words AS (
            SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
            UNION ALL
            SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
        ), each AS (SELECT side, doc_id, unnest(ws) AS w FROM words),
        counts AS (SELECT side, doc_id, w, count(*) AS n FROM each GROUP BY ALL),
        bytes AS (
            SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counts)
        ), codes AS (
            SELECT w, list_transform(range(0, len(h) // 2), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM bytes
        ), hashed AS (
            SELECT w, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM codes CROSS JOIN tab
        ), own AS (
            SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM counts JOIN hashed USING (w) GROUP BY bucket
        ), totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM own),
        gains AS (
            SELECT bucket, floor(1000 * ln(((coalesce(o.t, 0) + 1)::DOUBLE * (totals.s + 10000)) / ((coalesce(o.s, 0) + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS gain FROM own o CROSS JOIN totals
        ), sums AS (
            SELECT doc_id, sum(n * gain)::BIGINT AS total, sum(n)::BIGINT AS n FROM counts JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, coalesce(s.n, 0) AS n_features, CASE WHEN s.n IS NULL THEN 0 ELSE (s.total - ((s.total % s.n) + s.n) % s.n) // s.n END AS weight
            FROM documents LEFT JOIN sums s USING (doc_id)
        ), noisy AS (
            SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS among FROM noisy
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= among * 10 // 100 THEN place END AS rank FROM placed
    """,
    "op13_source_audit": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), each AS (SELECT id, lang, source, unnest(ws) AS term FROM docs),
        kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
        own AS (SELECT lang, source, term, count(*) AS n FROM each JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (
            SELECT g.lang, g.source, coalesce(o.n, 0) AS n, coalesce(v.v, 0) AS v
            FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM own GROUP BY ALL) o USING (lang, source)
            LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) v USING (lang)
        ), cells AS (
            SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (g.n + g.v)::HUGEINT AS p
            FROM groups g JOIN kept k USING (lang) LEFT JOIN own o USING (lang, source, term)
        ), language AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(t.total) + any_value(t.v))::HUGEINT AS q
            FROM own JOIN (SELECT lang, sum(n) AS total, any_value(v) AS v FROM groups GROUP BY lang) t USING (lang) GROUP BY lang, term
        ), found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
                FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT c.lang, c.source, 'term', c.term, (((c.p - l.q) * (c.p - l.q)) // l.q)::BIGINT FROM cells c JOIN language l USING (lang, term) WHERE c.n > 0 AND c.p > l.q
        )
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 200
    """,
}
