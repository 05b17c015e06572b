"""Queries of the smaller functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assistant as A
from ..operators import gate as G
from ..operators import outline as O
from ..operators import questions as Q
from ..operators import stats as ST
from ..operators import tasks as K
from ..sinks.files import csv_cell, upsert
from ..sources import derived as S
from .registry import query


@query("w06_item_resets", "WITH i AS (SELECT o_custkey AS doc_id, o_orderkey AS item_no, o_orderkey % 4 + 1 AS number FROM orders), s AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY item_no) AS b FROM i) SELECT doc_id, item_no, CAST(coalesce(number = 1 AND b > 1, FALSE) AS INTEGER) AS reset FROM s")
def w06(spark, d):
    items = S.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("item_no"), (F.col("o_orderkey") % 4 + 1).alias("number"))
    return O.number_resets(items).select("doc_id", "item_no", F.col("reset").cast("int"))


@query("w08_best_heading", "SELECT l_orderkey AS doc_id, l_suppkey AS paragraph_no, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS level, max(l_quantity) AS confidence FROM lineitem GROUP BY 1, 2")
def w08(spark, d):
    return O.best_headings(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("paragraph_no"), F.col("l_linenumber").alias("level"), F.col("l_quantity").alias("confidence")))


@query("w09_next_line", f"""WITH {S.LINES}, m AS (SELECT doc_id, line_no, CASE line_no % 7 WHEN 0 THEN 'Общие положения' WHEN 2 THEN 'Права и обязанности' WHEN 3 THEN '' WHEN 4 THEN 'Прочие условия' WHEN 5 THEN 'Глава ' || line_no || '. О' WHEN 6 THEN 'Подраздел 2. О' ELSE line END AS line FROM lines),
    k AS (SELECT *, lead(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM m)
    SELECT doc_id, line_no, CASE WHEN starts_with(line, '|') THEN NULL WHEN regexp_matches(line, '^(?i)[IVXLCDM]+\\.\\s+.+$') THEN 1 WHEN line_no % 7 = 5 THEN 1 WHEN line_no % 7 = 6 THEN 2
        WHEN line_no % 7 IN (0, 2, 4) AND following <> '' AND (line_no + 1) % 7 NOT IN (5, 6) AND NOT regexp_matches(following, '^(?i)[IVXLCDM]+\\.\\s+.+$') THEN 2 END AS level FROM k""")
def w09(spark, d):
    k, line = F.col("line_no") % 7, F.col("line")
    made = F.when(k == 0, "Общие положения").when(k == 2, "Права и обязанности").when(k == 3, "").when(k == 4, "Прочие условия").when(k == 5, F.concat(F.lit("Глава "), F.col("line_no").cast("string"), F.lit(". О"))).when(k == 6, "Подраздел 2. О").otherwise(line)
    rows = S.lines(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), made.alias("line"))
    following = F.lead(T.strip(F.col("line"))).over(O.in_document("line_no"))
    return rows.withColumn("following", following).select("doc_id", "line_no", O.consultant_level(F.col("line"), F.col("following")).alias("level"))


@query("f10_inline_items", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '1) ' || p_brand || '|2) ' || p_type ELSE '' END AS items FROM part")
def f10(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("1) "), "p_brand", F.lit("; 2) "), "p_type", F.lit(";"))).otherwise(F.concat(F.lit("1) "), "p_brand"))
    return S.table(spark, d, "part").select("p_partkey", F.array_join(O.inline_items(text), "|").alias("items"))


@query("f11_letter_items", "SELECT p_partkey, 'а) ' || p_brand || chr(10) || 'more|б) ' || p_type AS items FROM part")
def f11(spark, d):
    text = F.concat(F.lit("before\nа) "), "p_brand", F.lit("\nmore\nб) "), "p_type", F.lit(" "))
    return S.table(spark, d, "part").select("p_partkey", F.array_join(O.letter_items(text), "|").alias("items"))


@query("f16_combined_text", "SELECT p_partkey, concat_ws(chr(10) || chr(10), nullif(concat_ws(' > ', CASE WHEN p_partkey % 2 = 0 THEN p_brand END, CASE WHEN p_partkey % 3 = 0 THEN p_type END), ''), CASE WHEN p_partkey % 5 <> 0 THEN p_name END) AS text FROM part")
def f16(spark, d):
    key, blank = F.col("p_partkey"), F.lit("")
    return S.table(spark, d, "part").select("p_partkey", O.combined(F.when(key % 2 == 0, F.col("p_brand")).otherwise(blank), F.when(key % 3 == 0, F.col("p_type")), F.when(key % 5 != 0, F.col("p_name")).otherwise(blank)).alias("text"))


@query("f19_language_instruction", "SELECT doc_id, 'Write the question in ' || CASE doc_id % 4 WHEN 1 THEN 'Belarusian.' WHEN 2 THEN 'Tajik.' ELSE 'Russian.' END AS words FROM documents")
def f19(spark, d):
    k = F.col("doc_id") % 4
    return S.table(spark, d, "documents").select("doc_id", A.language_instruction(F.when(k == 1, "be").when(k == 2, "tg").when(k == 3, "xx").otherwise("ru")).alias("words"))


WORDS = "regexp_replace(substr(text, 1, 40), '[^A-Za-zÀ-ÿ ]', '', 'g')"


def words():
    """The letters and spaces of the first forty characters of a text."""
    return F.regexp_replace(F.substring("text", 1, 40), "[^A-Za-zÀ-ÿ ]", "")


@query("f21_parse_gate_answer", f"""SELECT doc_id, CASE WHEN n_chars % 7 = 6 THEN NULL ELSE CAST(n_chars % 2 AS INTEGER) END AS c1, CASE WHEN n_chars % 7 = 6 THEN NULL WHEN n_chars % 7 = 3 THEN 0 ELSE 1 END AS c2,
    CASE WHEN n_chars % 7 = 6 THEN NULL ELSE (n_chars % 10) / 10.0::DOUBLE END AS confidence,
    CASE WHEN n_chars % 7 = 6 THEN NULL WHEN n_chars % 7 = 3 THEN '' WHEN n_chars % 7 IN (1, 5) THEN 'it''s "' || {WORDS} || '"' ELSE 'it''s ' || {WORDS} END AS reasoning FROM documents""")
def f21(spark, d):
    kind, one, sure = F.col("n_chars") % 7, (F.col("n_chars") % 2).cast("string"), ((F.col("n_chars") % 10) / 10).cast("string")
    strict = F.concat(F.lit('{"c1_chunk_informative": ['), one, F.lit('], "c1_confidence": '), sure, F.lit(', "c1_reasoning": "it\'s '), words(), F.lit('", "c2_chunk_reference_clarity": true}'))
    python = F.concat(F.lit("{'c1_chunk_informative': ("), one, F.lit(",), 'c1_confidence': "), sure, F.lit(", 'c1_reasoning': 'it\\'s \""), words(), F.lit("\"', 'c2_chunk_reference_clarity': True, 'c3_chunk_multi_suitability': None,}"))
    double = F.concat(F.lit("{'c1_chunk_informative': "), one, F.lit(", 'c1_confidence': '"), sure, F.lit("', 'c1_reasoning': \"it's "), words(), F.lit("\", 'c2_chunk_reference_clarity': [1]}"))
    bare = F.concat(F.lit("{'c1_chunk_informative': ["), one, F.lit("], 'c1_confidence': "), sure, F.lit(", 'c2_chunk_reference_clarity': [0, 1]}"))
    fenced = F.when(kind == 0, F.concat(F.lit("```json\n"), strict, F.lit("\n```"))).when(kind == 5, F.concat(F.lit("```\n"), python, F.lit("```")))
    raw = F.coalesce(fenced, F.when(kind == 1, python).when(kind == 2, F.concat(F.lit("Sure: "), double, F.lit(" as asked"))).when(kind == 3, bare).when(kind == 6, words()).otherwise(strict))
    got = G.parse_answer(raw)
    return S.table(spark, d, "documents").select("doc_id", got["c1_chunk_informative"].alias("c1"), got["c2_chunk_reference_clarity"].alias("c2"), got["c1_confidence"].alias("confidence"), got["c1_reasoning"].alias("reasoning"))


@query("f37_python_literals", f"""SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN {WORDS} || '''s' WHEN 1 THEN 'say ''' || {WORDS} || ''' or "' || lang || '"' WHEN 2 THEN lang END AS a,
    CASE WHEN n_chars % 4 < 3 THEN CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END END AS flag, CASE WHEN n_chars % 4 < 3 THEN CAST(n_chars AS VARCHAR) END AS number FROM (SELECT * REPLACE (coalesce(lang, '') AS lang) FROM documents)""")
def f37(spark, d):
    kind, n, lang = F.col("n_chars") % 4, F.col("n_chars").cast("string"), F.coalesce("lang", F.lit(""))
    flag = F.when(F.col("n_chars") % 2 == 0, "True").otherwise("False")
    nested = F.concat(F.lit(", 'deep': {'list': [None, ("), n, F.lit(", 'x'), ], 'f': "), flag, F.lit("}}"))
    apostrophe = F.concat(F.lit("{'a': \""), words(), F.lit("'s\""), nested)
    escaped = F.concat(F.lit("{'a': 'say \\'"), words(), F.lit("\\' or \""), lang, F.lit("\"'"), nested)
    strict = F.concat(F.lit('{"a": "'), lang, F.lit('", "deep": {"list": [null, ['), n, F.lit(', "x"]], "f": '), F.lower(flag), F.lit("}}"))
    json = T.literal_python(F.when(kind == 0, apostrophe).when(kind == 1, escaped).when(kind == 2, strict).otherwise(F.concat(F.lit("{'a': '"), words(), F.lit("'"))))
    return S.table(spark, d, "documents").select("doc_id", F.get_json_object(json, "$.a").alias("a"), F.get_json_object(json, "$.deep.f").alias("flag"), F.get_json_object(json, "$.deep.list[1][0]").alias("number"))


@query("f38_breakdown_lines", "SELECT doc_id, 'c3: ' || CAST(1 + doc_id % 2 AS VARCHAR) || '/2' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '  - why ' || doc_id ELSE '' END AS lines FROM documents")
def f38(spark, d):
    scores = F.array(F.lit(1), (F.col("doc_id") % 2).cast("int"))
    return S.table(spark, d, "documents").select("doc_id", ST.breakdown_lines(F.lit("c3"), scores, F.array(F.lit("good"), F.concat(F.lit("why "), F.col("doc_id").cast("string")))).alias("lines"))


@query("f42_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders")
def f42(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return S.table(spark, d, "orders").select("o_orderkey", T.day(iso).alias("day"), F.translate(F.substring(iso, 1, 19), "T", " ").alias("stamp"))


@query("f43_pipeline_modes", "SELECT doc_id, CAST(doc_id % 3 <> 0 AS INTEGER) AS gate, CAST(doc_id % 3 = 2 AS INTEGER) AS refine FROM documents")
def f43(spark, d):
    mode = F.element_at(F.array(F.lit("generator_validator"), F.lit("generator_validator_gate"), F.lit(" Full ")), (F.col("doc_id") % 3 + 1).cast("int"))
    gate, refine = G.modes(mode)
    return S.table(spark, d, "documents").select("doc_id", gate.cast("int").alias("gate"), refine.cast("int").alias("refine"))


@query("f44_names", "SELECT doc_id, source || '__full' AS run, 'queue_' || doc_id || '_' || lang AS queue, substr(md5(text), 1, 8) AS short_id FROM documents")
def f44(spark, d):
    return S.table(spark, d, "documents").select("doc_id", ST.run_name(F.col("source"), F.lit("full")).alias("run"), ST.queue_name(F.col("doc_id"), F.col("lang")).alias("queue"), F.substring(F.md5("text"), 1, 8).alias("short_id"))


@query("f46_salvage_json", "SELECT doc_id, 'law' || doc_id AS type, 0.75::DOUBLE AS confidence FROM documents")
def f46(spark, d):
    raw = F.concat(F.lit('Sure:\n```json\n{"type": "law'), F.col("doc_id").cast("string"), F.lit('", "confidence": 0.75, "tags": [1, 2,],}\n``` done'))
    got = F.from_json(T.salvage_json(raw), "type string, confidence double")
    return S.table(spark, d, "documents").select("doc_id", got["type"].alias("type"), got["confidence"].alias("confidence"))


@query("f47_prompts", "SELECT p_partkey, 'Q: ' || p_name || ' S: {' || p_brand || '}' AS prompt, '{{' || p_type || '}}' AS escaped FROM part")
def f47(spark, d):
    from ..sources.files import filled

    source = F.concat(F.lit("{"), "p_brand", F.lit("}"))
    return S.table(spark, d, "part").select("p_partkey", filled(F.lit("Q: {question} S: {source}"), source, F.col("p_name")).alias("prompt"), T.escape_braces(F.concat(F.lit("{"), "p_type", F.lit("}"))).alias("escaped"))


@query("f49_object_ids", "SELECT p_partkey, 'x' || p_partkey AS id FROM part")
def f49(spark, d):
    raw = F.concat(F.lit("x"), F.col("p_partkey").cast("string"))
    return S.table(spark, d, "part").select("p_partkey", T.object_id(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"$oid": "'), raw, F.lit('"}'))).otherwise(raw)).alias("id"))


@query("p07_first_text", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_name ELSE p_type END AS text FROM part")
def p07(spark, d):
    k = F.col("p_partkey") % 3
    return S.table(spark, d, "part").select("p_partkey", O.first_text(F.when(k == 0, F.col("p_brand")).otherwise(""), F.when(k == 1, F.col("p_name")), F.col("p_type")).alias("text"))


@query("o10_categories", "SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, label")
def o10(spark, d):
    return ST.by_count(ST.value_counts(S.table(spark, d, "part").select(F.col("p_brand").alias("label")), "label"))


@query("o08_preview", f"WITH {S.LINES} SELECT doc_id, line_no FROM lines WHERE line_no < 3 ORDER BY doc_id, line_no LIMIT 50")
def o08(spark, d):
    return S.lines(spark, d).select("doc_id", F.col("line_no").cast("long").alias("line_no")).filter("line_no < 3").orderBy("doc_id", "line_no").limit(50)


@query("m13_upsert_users", "SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 3 = 0 THEN 'expert' ELSE 'viewer' END AS role FROM supplier")
def m13(spark, d):
    users = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.lit("viewer").alias("role"))
    return upsert(users, users.filter("user_id % 3 = 0").withColumn("role", F.lit("expert")), "user_id")


@query("m15_csv_cells", "SELECT p_partkey, '\"say \"\"' || p_brand || '\"\", ok\"' AS cell FROM part")
def m15(spark, d):
    return S.table(spark, d, "part").select("p_partkey", csv_cell(F.concat(F.lit('say "'), "p_brand", F.lit('", ok'))).alias("cell"))


@query("a28_batches_by_dataset", f"WITH {S.TASKS} SELECT dataset_id, count(*) AS n FROM (SELECT * FROM tasks WHERE status = 'pending' ORDER BY priority DESC, created_at, task_id LIMIT 50) GROUP BY dataset_id")
def a28(spark, d):
    return K.pending_top(S.tasks(spark, d), 50).groupBy("dataset_id").agg(F.count("*").alias("n"))


def gate_by_rule(batch):
    return ['{"c1_chunk_informative": [%d], "c2_chunk_reference_clarity": %d, "c3_chunk_multi_suitability": %d}' % (d % 5 != 0, d % 7 != 0, d % 3 != 0) for d in batch["doc_id"]]


def question_by_rule(batch):
    return ["no json" if d % 11 == 0 else '{"task": "What of %d?", "outputs": "1", "option_1": "a"}' % d for d in batch["doc_id"]]


def direct_sql(kind: str) -> str:
    from .records import loop_sql

    first, second, third = G.REASONS
    reason = f"CASE WHEN doc_id % 5 = 0 THEN '{first}' WHEN doc_id % 7 = 0 THEN '{second}' " + (f"WHEN doc_id % 3 = 0 THEN '{third}' " if kind == "multi" else "") + "END"
    return f"""SELECT d.doc_id, '{kind}' AS question_type, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN d.doc_id % 11 = 0 THEN 'failed' ELSE 'question' END AS outcome, reason,
        CASE WHEN reason IS NULL AND d.doc_id % 11 <> 0 THEN 'What of ' || d.doc_id || '?' END AS task, CASE WHEN reason IS NULL AND d.doc_id % 11 <> 0 THEN l.total END AS total,
        CASE WHEN reason IS NULL AND d.doc_id % 11 <> 0 THEN l.passed END AS passed, CASE WHEN reason IS NULL AND d.doc_id % 11 <> 0 THEN l.retry_count END AS retry_count
        FROM (SELECT doc_id, {reason} AS reason FROM documents) d JOIN ({loop_sql(kind, "documents")}) l USING (doc_id)"""


@query("p24_direct_rows", direct_sql("open") + " UNION ALL " + direct_sql("multi"))
def p24(spark, d):
    """Gate, generation and validation of every document and type in one go, rejected and failed ones included."""
    from .records import validation_by_rule

    found = A.assistant(S.table(spark, d, "documents").select("doc_id", "text"), ["open", "multi"], gate=gate_by_rule, generate=question_by_rule, validate=validation_by_rule)
    return found.withColumn("reason", F.when(F.col("outcome") == "rejected", F.col("detail"))).select("doc_id", "question_type", "outcome", "reason", "task", "total", "passed", "retry_count")


def type_by_length(batch):
    """A stand-in for a model: by the titles' length a fenced answer, one with a comma too many, or none that parses."""
    answers = ('```json\n{"type": "law", "confidence": 0.75}\n```', 'It is {"type": "order", "confidence": 0.5,}', "no idea")
    return [answers[len(t) % 3] for t in batch["titles"]]


@query("l08_document_types", f"""WITH {S.OUTLINE_LINES}, t AS (SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM outline_lines WHERE regexp_replace(title, '\\s', '', 'g') <> ''),
    g AS (SELECT doc_id, length(string_agg(title, chr(10) ORDER BY k)) % 3 AS r FROM t WHERE k <= 50 GROUP BY doc_id)
    SELECT doc_id, CASE r WHEN 0 THEN 'law' WHEN 1 THEN 'order' ELSE 'unknown' END AS type, CASE r WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM g""")
def l08(spark, d):
    from .documents import node_rows

    return A.document_types(O.all_titles(node_rows(spark, d)), type_by_length)


@query("l10_final_json", "SELECT p_partkey, '{\"task\":\"' || p_name || '\",\"size\":' || p_size || '}' AS final FROM part")
def l10(spark, d):
    rows = S.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("task"), F.col("p_size").alias("size"))
    return rows.select("p_partkey", Q.output_json(rows, ["task", "size"]).alias("final"))


