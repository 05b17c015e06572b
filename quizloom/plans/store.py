"""Queries of versions, edits, exports, pages and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import export as E
from ..operators import retrieval as R
from ..operators import versions as V
from ..sources import derived as S
from .registry import query

FIELDS = ("task", "options", "correct_answer", "difficulty")
DIFFERS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in FIELDS) + "], lambda x: x IS NOT NULL), ',')"


def diff_sql(key: str, extra: str, a: str = "v1", b: str = "v2") -> str:
    return f"""WITH {S.VERSIONS}{extra}, j AS (SELECT coalesce(a.{key}, b.{key}) AS {key}, a.{key} IS NOT NULL AS is_old, b.{key} IS NOT NULL AS is_new, {DIFFERS} AS fields FROM {a} a FULL OUTER JOIN {b} b ON a.{key} = b.{key}),
    c AS (SELECT {key}, CASE WHEN NOT is_old THEN 'added' WHEN NOT is_new THEN 'removed' WHEN fields <> '' THEN 'changed' END AS change, CASE WHEN is_old AND is_new THEN fields END AS fields FROM j) SELECT * FROM c WHERE change IS NOT NULL"""


@query("j03_version_diff_by_id", diff_sql("question_id", ""))
def j03(spark, d):
    return V.diff(*S.versions(spark, d)).select("question_id", "change", "fields")


PLACED = """, p1 AS (SELECT *, row_number() OVER (PARTITION BY correct_answer ORDER BY question_id) - 1 AS n FROM v1), p2 AS (SELECT *, row_number() OVER (PARTITION BY correct_answer ORDER BY question_id) - 1 AS n FROM v2),
    k1 AS (SELECT *, correct_answer || ':' || lpad(CAST(n AS VARCHAR), 5, '0') AS place FROM p1), k2 AS (SELECT *, correct_answer || ':' || lpad(CAST(n AS VARCHAR), 5, '0') AS place FROM p2)"""


@query("j04_version_diff_by_pos", diff_sql("place", PLACED, "k1", "k2"))
def j04(spark, d):
    return V.diff_by_position(*S.versions(spark, d), "correct_answer").select("place", "change", "fields")


@query("w02_position_ids", "WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part) SELECT p_partkey, p_brand || ':' || lpad(CAST(n AS VARCHAR), 5, '0') AS question_id FROM p")
def w02(spark, d):
    return V.position_ids(S.table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "question_id")


def headers(spark, d):
    sets = S.datasets(spark, d)
    return sets.select("dataset_id", (F.col("number") % 3 + 1).alias("current_version"))


HEADERS = S.DATASETS + ", headers AS (SELECT dataset_id, number % 3 + 1 AS current_version FROM datasets), fresh AS (SELECT doc_id AS question_id, source AS dataset_id FROM documents WHERE doc_id % 10 = 1)"


def fresh(spark, d):
    return S.table(spark, d, "documents").filter("doc_id % 10 = 1").select(F.col("doc_id").alias("question_id"), F.col("source").alias("dataset_id"))


@query("m02_new_version", f"WITH {HEADERS} SELECT question_id, dataset_id, current_version + 1 AS version FROM fresh JOIN headers USING (dataset_id)")
def m02(spark, d):
    return V.new_version(headers(spark, d), fresh(spark, d))[0].select("question_id", "dataset_id", "version")


@query("m02_new_headers", f"WITH {HEADERS} SELECT dataset_id, current_version + CAST(dataset_id IN (SELECT dataset_id FROM fresh) AS INTEGER) AS current_version FROM headers")
def m02_headers(spark, d):
    return V.new_version(headers(spark, d), fresh(spark, d))[1]


@query("m03_append", f"WITH {HEADERS} SELECT question_id, dataset_id, current_version AS version FROM fresh JOIN headers USING (dataset_id)")
def m03(spark, d):
    return V.append_current(headers(spark, d), fresh(spark, d)).select("question_id", "dataset_id", "version")


@query("m04_metadata_merge", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, c_mktsegment AS b, CASE WHEN c_custkey % 2 = 0 THEN 'added' END AS c FROM customer")
def m04(spark, d):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), "c_mktsegment")
    patch = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("added")))
    merged = V.merge_metadata(old, patch)
    return S.table(spark, d, "customer").select("c_custkey", *[F.try_element_at(merged, F.lit(k)).alias(k) for k in "abc"])


@query("m05_replace_chunks", "SELECT doc_id, source, 0 AS version FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 3) UNION ALL SELECT doc_id, source, 1 FROM documents WHERE doc_id % 50 = 3")
def m05(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "source")
    return V.replace_by_key(docs.withColumn("version", F.lit(0)), docs.filter("doc_id % 50 = 3").withColumn("version", F.lit(1)), "source")


@query("p16_overlay_edits", f"WITH {S.VERSIONS} SELECT a.question_id, coalesce(b.task, a.task) AS task, coalesce(b.difficulty, a.difficulty) AS difficulty, a.options FROM v1 a LEFT JOIN v2 b ON a.question_id = b.question_id")
def p16(spark, d):
    old, new = S.versions(spark, d)
    return V.overlay(old, new.select("question_id", "task", "difficulty")).select("question_id", "task", "difficulty", "options")


@query("p15_real_edits", f"WITH {S.VERSIONS} SELECT b.question_id, b.task FROM v2 b JOIN v1 a ON a.question_id = b.question_id WHERE a.task IS DISTINCT FROM b.task OR a.difficulty IS DISTINCT FROM b.difficulty")
def p15(spark, d):
    old, new = S.versions(spark, d)
    return V.real_edits(old, new.select("question_id", "task", "difficulty")).select("question_id", "task")


@query("p22_save_normalised", f"WITH {S.QUESTIONS} SELECT question_id, nullif(trim(difficulty), '') AS difficulty, provocativeness, 'expert' AS edited_by, 3 AS source_version FROM questions")
def p22(spark, d):
    found = S.questions(spark, d).withColumn("correct_answer", F.lit(1))
    return V.normalised_for_save(found, "expert", F.lit("2024-01-01"), F.lit(3)).select("question_id", "difficulty", "provocativeness", "edited_by", "source_version")


@query("j05_requested_version", f"WITH {HEADERS}, v AS (SELECT doc_id AS question_id, source AS dataset_id, doc_id % 3 + 1 AS version FROM documents) SELECT question_id, dataset_id, version FROM v JOIN headers USING (dataset_id) WHERE version = current_version")
def j05(spark, d):
    stored = S.table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("source").alias("dataset_id"), (F.col("doc_id") % 3 + 1).alias("version"))
    return V.requested(headers(spark, d), stored).select("question_id", "dataset_id", "version")


LABELS = r"""c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN '' ELSE CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN replace(c_mktsegment, 'U', 'Ü') ELSE c_mktsegment END
        || CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '00' ELSE '' END || (c_custkey % 13) || '-b' || (c_custkey * 7 % 110) END AS label FROM customer),
    k AS (SELECT *, CASE WHEN label <> '' THEN list_transform(regexp_extract_all(label, '\d+|\D'), lambda u: {'kind': CASE WHEN regexp_matches(u, '^\d') THEN 1 WHEN regexp_matches(u, '^\p{L}') THEN 2 ELSE 0 END,
        'size': CASE WHEN regexp_matches(u, '^\d') THEN length(CAST(CAST(u AS HUGEINT) AS VARCHAR)) ELSE 0 END, 'text': CASE WHEN regexp_matches(u, '^\d') THEN CAST(CAST(u AS HUGEINT) AS VARCHAR) ELSE strip_accents(lower(u)) END}) END AS key FROM c)"""


@query("o06_nulls_natural_sort", f"WITH {LABELS} SELECT c_custkey, label, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY key DESC NULLS FIRST) AS INTEGER) AS place FROM k ORDER BY key DESC NULLS FIRST, c_custkey")
def o06(spark, d):
    """All customers by a label in descending natural order, with their place within their nation."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    word = F.when(key % 4 == 0, F.lower(segment)).when(key % 4 == 1, F.replace(segment, F.lit("U"), F.lit("Ü"))).otherwise(segment)
    label = F.concat(word, F.when(key % 5 == 0, " ").otherwise(""), F.when(key % 3 == 0, "00").otherwise(""), (key % 13).cast("string"), F.lit("-b"), (key * 7 % 110).cast("string"))
    rows = S.table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(key % 9 == 0, None).when(key % 50 == 1, "").otherwise(label).alias("label"))
    order = E.natural_order("label", ascending=False)
    return rows.withColumn("place", F.rank().over(Window.partitionBy("c_nationkey").orderBy(*order))).orderBy(*order, F.asc("c_custkey")).drop("c_nationkey")


@query("o07_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 25 OFFSET 50")
def o07(spark, d):
    return E.page(S.table(spark, d, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 3, 25)


@query("o07_pages_of_queues", "WITH p AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) SELECT c_custkey, CAST(ceil(k / 8.0) AS INTEGER) AS page FROM p")
def o07_pages(spark, d):
    return E.numbered_pages(S.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"], 8).select("c_custkey", "page")


@query("o04_datasets_by_creation", f"WITH {S.DATASETS} SELECT dataset_id, CAST(created_on AS VARCHAR) AS day FROM datasets ORDER BY created_on DESC, dataset_id")
def o04(spark, d):
    return S.datasets(spark, d).orderBy(F.desc("created_on"), "dataset_id").select("dataset_id", F.col("created_on").cast("string").alias("day"))


@query("p12_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_type), 'steel')")
def p12(spark, d):
    rows = S.table(spark, d, "part")
    return E.search(rows, " 1 ", ["p_name"]).select("p_partkey").union(E.search(rows, "STEEL", ["p_type"]).select("p_partkey")).distinct()


@query("p10_export_columns", "SELECT p_partkey AS \"Part\", p_name AS \"Name\", p_size FROM part")
def p10(spark, d):
    return E.export_columns(S.table(spark, d, "part").select("p_name", "p_size", "p_partkey"), ["p_partkey", "p_name"], {"p_partkey": "Part", "p_name": "Name"})


@query("m16_json_cells", "SELECT p_partkey, '[\"' || p_brand || '\",' || CAST(p_size AS VARCHAR) || ']' AS cell FROM part".replace("|| ',' ||", "||").replace("\",'", "\",\"'").replace("|| ']'", "|| '\"]'"))
def m16(spark, d):
    return E.cells(S.table(spark, d, "part").select("p_partkey", F.array("p_brand", F.col("p_size").cast("string")).alias("cell")))


@query("o09_cosine_topk", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS c FROM embeddings, q)
    SELECT vec_id FROM s ORDER BY round(c, 9) DESC, vec_id LIMIT 5""")
def o09(spark, d):
    rows = S.table(spark, d, "embeddings")
    one = rows.filter("vec_id = 0").select("embedding").first()[0]
    return R.cosine_top(rows, one).select("vec_id")
