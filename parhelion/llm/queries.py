"""The driver's queries for this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from parhelion.llm import decontaminate, language, licenses, line_dedup, neardup, packing, secrets, sharding, topk, toxicity
from parhelion.session import ship, table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, name)


def op1_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))


def op2_sharding(spark, sf_dir):
    out = sharding.shard_rows(_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score_documents(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").cast("long").alias("n_offending"), "worst_start", "worst_end")


def op4_decontamination(spark, sf_dir):
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_simhash_near_dedup(spark, sf_dir):
    out = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    out = language.identify(docs, language.fit_language(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_secret_scan(spark, sf_dir):
    out = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_license_scan(spark, sf_dir):
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive")


def op9_exact_topk(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_packing(spark, sf_dir):
    out = packing.pack(_table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path())
    return out.drop("hilbert_key")


def queries() -> dict:
    ops = [op1_line_dedup, op2_sharding, op3_toxicity, op4_decontamination, op5_simhash_near_dedup, op6_language_id, op7_secret_scan, op8_license_scan, op9_exact_topk, op10_packing]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    gram = "list_distinct(list_transform(range(1, greatest(len(w) - {k} + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + {k} - 1), ' ')))"
    return {
        "op4_decontamination": f"""
            WITH d AS (SELECT doc_id, {words} AS w FROM documents),
            i AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
            g AS (SELECT item_id, least(5, len(w)) AS k, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {gram.format(k=5)} END AS s FROM i WHERE len(w) > 0),
            want AS (SELECT item_id, k, len(s) AS n, unnest(s) AS s FROM g),
            have AS (SELECT DISTINCT doc_id, k, s FROM (
                SELECT doc_id, 5 AS k, unnest({gram.format(k=5)}) AS s FROM d WHERE len(w) >= 5
                UNION ALL SELECT doc_id, 4, unnest({gram.format(k=4)}) FROM d WHERE len(w) >= 4
                UNION ALL SELECT doc_id, 3, unnest({gram.format(k=3)}) FROM d WHERE len(w) >= 3
                UNION ALL SELECT doc_id, 2, unnest({gram.format(k=2)}) FROM d WHERE len(w) >= 2
                UNION ALL SELECT doc_id, 1, unnest(w) FROM d) WHERE k IN (SELECT k FROM want))
            SELECT doc_id, item_id, count(*) AS shared, CAST(n AS BIGINT) AS shingles, CAST(count(*) AS DOUBLE) / n AS containment
            FROM want JOIN have USING (k, s) GROUP BY doc_id, item_id, n HAVING count(*) * 10 >= n * 8""",
        "op9_exact_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
    }
