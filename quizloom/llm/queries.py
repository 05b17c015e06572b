"""The queries of this subpackage: thin wrappers that derive the columns asked for from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .common import held_out, remainder, table
from .conversations import damaged, repair
from .exact_top_k import exact_top_k
from .jaccard_join import similarity_join
from .language import identify
from .main_text import extract
from .near_duplicates import near_duplicates
from .packing import pack
from .posting_lists import nearest
from .quality import THRESHOLD as GOOD
from .quality import fit_quality, quality_score
from .secrets import scan, train
from .toxicity import THRESHOLD as TOXIC
from .toxicity import fit_toxicity, toxicity_score
from .whitening import whiten


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))

    def listed(only_base: bool):
        spans = F.filter("spans", lambda s: s["kind"] != "crf") if only_base else F.col("spans")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex", "crf")]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(True), 256).alias("base_sha256"), listed(False).alias("spans"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), 20).withColumnRenamed("id", "vec_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), quality_score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(table(spark, sf_dir, "documents"), digests=True)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), toxicity_score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, remainder("doc_id", 3) != 1)
    return found.select(F.col("id").alias("doc_id"), held_out("id", 3, 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = exact_top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)
    return found.withColumnRenamed("id", "vec_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_secrets": op2_secrets,
    "op3_packing": op3_packing,
    "op4_posting_lists": op4_posting_lists,
    "op5_quality": op5_quality,
    "op6_main_text": op6_main_text,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_whitening": op11_whitening,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_conversation_repair": op13_conversation_repair,
}



def shifted(value: int) -> int:
    """Four steps of the CRC-32 register (reflected polynomial)."""
    for _ in range(4):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


#: SQL of CRC-32: what a byte x makes of the register c, half a byte at a time.
NIBBLES = str([shifted(i) for i in range(16)])
CRC_HALF = f"xor(xor(c, x) >> 4, {NIBBLES}[(xor(c, x) & 15) + 1])"
CRC_BYTE = f"xor(({CRC_HALF}) >> 4, {NIBBLES}[(({CRC_HALF}) & 15) + 1])"
#: SQL of the ways of a conversation's repair after insertions.
OPENED = "SELECT ways.conv_id, ways.i, t.after, ways.way.cost + t.cost AS cost, ways.way.audit || t.audit AS audit, ways.way.said || t.said AS said FROM ways JOIN inserted AS t ON t.state = ways.state"

ORACLE_SQL: dict[str, str] = {
    "op10_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op13_conversation_repair": rf"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        kinds AS (SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: {CRC_BYTE}), 4294967295) % 20 AS kind FROM keyed),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM kinds, range(2) AS copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM placed),
        faults AS (
            SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two,
                CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM numbered),
        sums AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
        inserted(state, after, cost, audit, said) AS (VALUES ('', '', 0, '', ''), ('', 'u', 2, 'I', 'user:' || chr(10)), ('', 'a', 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('s', 's', 0, '', ''),
            ('s', 'u', 2, 'I', 'user:' || chr(10)), ('s', 'a', 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), ('u', 'u', 0, '', ''), ('u', 'a', 2, 'I', 'assistant:' || chr(10)), ('a', 'a', 0, '', ''), ('a', 'u', 2, 'I', 'user:' || chr(10))),
        kept(state, after) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
        named(state, after, role) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
        ways AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS state, {{'cost': 0, 'audit': '', 'said': ''}} AS way FROM sums
            UNION ALL
            SELECT conv_id, any_value(i), state, min(way) FROM (
                SELECT f.conv_id, f.i, w.after AS state, {{'cost': w.cost + 3, 'audit': w.audit || 'D', 'said': w.said}} AS way FROM ({OPENED}) AS w JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
                UNION ALL
                SELECT f.conv_id, f.i, k.after, {{'cost': w.cost + CAST(f.fault = 3 AS INTEGER), 'audit': w.audit || 'K', 'said': w.said || f.role || ':' || f.text || chr(10)}}
                FROM ({OPENED}) AS w JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 AND f.fault IN (0, 3) JOIN kept AS k ON k.state = w.after AND k.after = f.initial
                UNION ALL
                SELECT f.conv_id, f.i, k.after, {{'cost': w.cost + 2 + CAST(f.fault = 3 AS INTEGER), 'audit': w.audit || 'R', 'said': w.said || k.role || ':' || f.text || chr(10)}}
                FROM ({OPENED}) AS w JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 AND f.fault IN (0, 3) JOIN named AS k ON k.state = w.after) AS steps
            GROUP BY conv_id, state),
        ends AS (
            SELECT w.conv_id, min({{'cost': w.cost, 'audit': w.audit, 'said': w.said}}) AS way FROM ({OPENED}) AS w JOIN sums ON sums.conv_id IS NOT DISTINCT FROM w.conv_id AND sums.n = w.i WHERE w.after IN ('', 'a') GROUP BY w.conv_id)
        SELECT c.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
            CAST(coalesce(e.way.cost, 0) AS BIGINT) AS cost, coalesce(e.way.audit, '') AS audit, sha256(coalesce(left(e.way.said, greatest(length(e.way.said) - 1, 0)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN sums AS s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends AS e ON e.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
