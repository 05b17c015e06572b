"""Queries of gates, scores, questions and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as E
from ..operators import gate as G
from ..operators import questions as Q
from ..operators import scoring as P
from ..operators import stats as A
from ..sources import derived as S
from .registry import query

PRIMES = {"c1_question": 3, "c2_outputs": 5, "c2_options": 11, "c3_outputs": 13, "c4_logic": 17, "c5_phrase": 19}
TYPES = ["open", "one", "multi"]
REASON = "CASE WHEN c1 <> 1 THEN 'chunk_not_informative' WHEN c2 <> 1 THEN 'chunk_not_self_contained' WHEN {multi} AND c3 <> 1 THEN 'chunk_not_suitable_for_multi' END"


def bits(name: str):
    n, p = len(P.WEIGHTS[name]), PRIMES[name]
    return F.array(*[((F.col("doc_id") * p + i) % 7 != 0).cast("int") for i in range(n)])


def bit_sql(name: str, i: int) -> str:
    return f"CAST((doc_id * {PRIMES[name]} + {i}) % 7 <> 0 AS INTEGER)"


def weighted_sql(kind: str) -> str:
    parts = " + ".join(f"{bit_sql(b, i)} * {float(w)}::DOUBLE" for b in P.BLOCKS[kind] for i, w in enumerate(P.WEIGHTS[b]))
    critical = " * ".join(bit_sql(b, i) for b in P.BLOCKS[kind] for i in P.CRITICAL[b])
    return f"WITH t AS (SELECT doc_id, ({parts}) * ({critical}) AS total FROM documents) SELECT doc_id, total, CAST(total >= {P.THRESHOLDS[kind]} AS INTEGER) AS passed FROM t"


def weighted(kind: str):
    def run(spark, d):
        total = P.weighted_total({b: bits(b) for b in P.BLOCKS[kind]}, kind)
        return S.table(spark, d, "documents").select("doc_id", total.alias("total")).withColumn("passed", (F.col("total") >= P.THRESHOLDS[kind]).cast("int"))

    return run


for _kind in TYPES:
    query(f"a24_weighted_score_{_kind}", weighted_sql(_kind))(weighted(_kind))


@query("a23_block_sums", "SELECT doc_id, CAST(" + " + ".join(bit_sql("c1_question", i) for i in range(5)) + " AS VARCHAR) || '/5' AS c1, CAST(" + " + ".join(bit_sql("c4_logic", i) for i in range(4)) + " AS VARCHAR) || '/4' AS c4 FROM documents")
def a23(spark, d):
    blocks = P.breakdown(F.create_map(F.lit("c1"), bits("c1_question"), F.lit("c4"), bits("c4_logic")))
    return S.table(spark, d, "documents").select("doc_id", blocks["c1"].alias("c1"), blocks["c4"].alias("c4"))


@query("f40_issue_lines", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {bit_sql('c1_question', i)} = 0 THEN '- [c1][{i + 1}] score 0 — r{i}' END" for i in range(5)) + "], lambda x: x IS NOT NULL), chr(10)) AS issues FROM documents")
def f40(spark, d):
    return S.table(spark, d, "documents").select("doc_id", P.issues(F.lit("c1"), bits("c1_question"), F.array(*[F.lit(f"r{i}") for i in range(5)])).alias("issues"))


@query("f25_parse_score_lines", """SELECT doc_id, CASE WHEN n_chars % 3 = 2 THEN CAST(n_chars % 2 AS VARCHAR) || '100' ELSE CAST(n_chars % 2 AS VARCHAR) || CAST((n_chars // 2) % 2 AS VARCHAR) || CASE WHEN n_chars % 5 = 0 THEN '0' ELSE '1' END || '0' END AS scores,
    CASE WHEN n_chars % 3 = 2 THEN '|||' ELSE 'first ' || lang || '||' || CASE WHEN n_chars % 5 = 0 THEN '' ELSE 'third' END || '|' END AS reasons FROM (SELECT * REPLACE (coalesce(lang, '') AS lang) FROM documents)""")
def f25(spark, d):
    n, lang = F.col("n_chars"), F.coalesce("lang", F.lit(""))
    lines = F.concat(F.lit("Answer:\n1. "), (n % 2).cast("string"), F.lit(" — first "), lang, F.lit("\n\n"), (F.floor(n / 2) % 2).cast("string"), F.when(n % 5 == 0, "").otherwise("\n1 — third"))
    loose = F.concat(F.lit("c"), (n % 2).cast("string"), F.lit(" of 10, a1b and 21 or x0y; 2024 0.\nso "), lang, F.lit("."))  # no line ends in a score
    scores, reasons = P.parse_score_lines(F.when(n % 3 == 2, loose).otherwise(lines), 4)
    return S.table(spark, d, "documents").select("doc_id", F.array_join(F.transform(scores, lambda s: s.cast("string")), "").alias("scores"), F.array_join(reasons, "|").alias("reasons"))


@query("f26_score_pair", f"""WITH {S.QUESTIONS} SELECT question_id, TRY_CAST(split_part(validation_score, '/', 1) AS DOUBLE) AS total, TRY_CAST(nullif(split_part(validation_score, '/', 2), '') AS DOUBLE) AS top FROM questions WHERE validation_score <> 'N/A'
    UNION ALL SELECT question_id, NULL, NULL FROM questions WHERE validation_score = 'N/A'""")
def f26(spark, d):
    total, top = P.score_pair(F.col("validation_score"))
    return S.questions(spark, d).select("question_id", total.alias("total"), top.alias("top"))


@query("f29_score_or_largest", f"""WITH {S.QUESTIONS} SELECT question_id, CASE WHEN validation_score <> 'N/A' THEN CAST(split_part(validation_score, '/', 1) AS DOUBLE) END AS total,
    CAST(CASE WHEN question_type = 'open' THEN 16.0 ELSE 20.5 END AS DOUBLE) AS top FROM questions""")
def f29(spark, d):
    total, top = P.score_pair_or_largest(F.col("validation_score"), F.col("question_type"))
    return S.questions(spark, d).select("question_id", total.alias("total"), top.alias("top"))


@query("f27_to_bool", f"WITH {S.QUESTIONS} SELECT question_id, CASE validation_passed WHEN 'True' THEN 1 WHEN 'False' THEN 0 END AS flag FROM questions")
def f27(spark, d):
    return S.questions(spark, d).select("question_id", P.to_bool(F.concat(F.lit("\t"), "validation_passed", F.lit(" "))).cast("int").alias("flag"))


PARSED = f"""{S.QUESTIONS}, parsed AS (SELECT *, CASE WHEN validation_passed = 'True' THEN 1 WHEN validation_passed = 'False' THEN 0 ELSE CAST(score >= threshold AS INTEGER) END AS passed
    FROM (SELECT *, CASE WHEN validation_score <> 'N/A' THEN CAST(split_part(validation_score, '/', 1) AS DOUBLE) END AS score, TRY_CAST(validation_threshold AS DOUBLE) AS threshold FROM questions))"""


@query("f28_is_passed", f"WITH {PARSED} SELECT question_id, passed FROM parsed")
def f28(spark, d):
    return A.parsed(S.questions(spark, d)).select("question_id", F.col("passed").cast("int"))


@query("f39_retries", f"WITH {S.QUESTIONS} SELECT question_id, coalesce(TRY_CAST(retry_count AS INTEGER), 0) AS retries FROM questions")
def f39(spark, d):
    return S.questions(spark, d).select("question_id", P.retries(F.col("retry_count")).alias("retries"))


@query("f22_gate_decision", f"WITH {S.CHUNK_GATE}, r AS (SELECT chunk_id, {REASON.format(multi='TRUE')} AS rejection_reason FROM chunk_gate) SELECT chunk_id, CAST(rejection_reason IS NULL AS INTEGER) AS passed, rejection_reason FROM r")
def f22(spark, d):
    return G.decide(S.chunk_gate(spark, d), "multi").select("chunk_id", F.col("passed").cast("int"), "rejection_reason")


TYPES_OK = "CASE WHEN c1 = 1 AND c2 = 1 THEN CASE WHEN c3 = 1 THEN ['open', 'one', 'multi'] ELSE ['open', 'one'] END ELSE [] END"


@query("f24_types_ok", f"WITH {S.CHUNK_GATE} SELECT chunk_id, array_to_string({TYPES_OK}, ',') AS types_ok FROM chunk_gate")
def f24(spark, d):
    ok = G.allowed_types(F.col("c1"), F.col("c2"), F.col("c3"), F.array(*map(F.lit, TYPES)))
    return S.chunk_gate(spark, d).select("chunk_id", F.array_join(ok, ",").alias("types_ok"))


@query("u04_types_intersect", f"WITH {S.CHUNK_GATE} SELECT chunk_id, array_to_string(list_filter(['multi', 'open'], lambda t: list_contains({TYPES_OK}, t)), ',') AS types FROM chunk_gate")
def u04(spark, d):
    ok = G.allowed_types(F.col("c1"), F.col("c2"), F.col("c3"), F.array(*map(F.lit, TYPES)))
    return S.chunk_gate(spark, d).select("chunk_id", F.array_join(F.array_intersect(F.array(F.lit("multi"), F.lit("open")), ok), ",").alias("types"))


@query("a20_rejection_summary", f"WITH {S.CHUNK_GATE}, r AS (SELECT {REASON.format(multi='TRUE')} AS reason FROM chunk_gate) SELECT reason, count(*) AS chunks FROM r WHERE reason IS NOT NULL GROUP BY reason")
def a20(spark, d):
    return G.rejection_summary(G.decide(S.chunk_gate(spark, d), "multi"))


@query("a20_rejection_text", f"""WITH {S.CHUNK_GATE}, r AS (SELECT {REASON.format(multi='TRUE')} AS reason FROM chunk_gate), c AS (SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason)
    SELECT string_agg(reason || ': ' || n, ', ' ORDER BY reason) AS summary FROM c""")
def a20_text(spark, d):
    return G.summary_text(G.rejection_summary(G.decide(S.chunk_gate(spark, d), "multi")))


@query("j10_chunk_audit", f"""WITH {S.CHUNK_GATE}, r AS (SELECT chunk_id, {REASON.format(multi='TRUE')} AS reason, labelled FROM chunk_gate)
    SELECT chunk_id, CAST(reason IS NULL AS INTEGER) AS gate_passed, CASE WHEN reason IS NOT NULL THEN CASE WHEN labelled THEN reason ELSE 'not_selected_for_generation' END END AS reason FROM r""")
def j10(spark, d):
    gate = G.decide(S.chunk_gate(spark, d), "multi")
    found = G.audit(S.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id")), gate.filter("passed").select("chunk_id"), gate.filter("labelled"))
    return found.select("chunk_id", F.col("gate_passed").cast("int"), "reason")


@query("j11_plan_tasks", f"WITH {S.CHUNK_GATE} SELECT dataset_id, chunk_id, unnest({TYPES_OK}) AS question_type FROM chunk_gate")
def j11(spark, d):
    return G.plan_tasks(S.chunk_gate(spark, d), TYPES)


@query("j12_chunk_types", "SELECT doc_id AS chunk_id, unnest(['open', 'one', 'multi']) AS question_type FROM documents")
def j12(spark, d):
    return S.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.explode(F.array(*map(F.lit, TYPES))).alias("question_type"))


@query("a21_planned_counts", f"""WITH {S.CHUNK_GATE}, t AS (SELECT dataset_id, len({TYPES_OK}) AS n FROM chunk_gate)
    SELECT dataset_id, CAST(sum(n) AS BIGINT) AS planned, count(*) FILTER (n > 0) AS passed, count(*) FILTER (n = 0) AS rejected FROM t GROUP BY dataset_id""")
def a21(spark, d):
    return G.planned_counts(S.chunk_gate(spark, d), TYPES)


STATS = f"""{PARSED}, {S.DATASETS}, per_set AS (SELECT dataset_id, count(*) AS total_questions, round(CAST(100.0 AS DOUBLE) * avg(passed), 6) AS validation_rate FROM parsed GROUP BY dataset_id),
    stats AS (SELECT *, CASE WHEN status = 'completed' THEN 100.0::DOUBLE WHEN expected > 0 THEN least(round(100.0::DOUBLE * total_questions / expected, 1), 100.0::DOUBLE) ELSE 0.0::DOUBLE END AS progress_pct
        FROM (SELECT d.*, coalesce(b.total_questions, 0) AS total_questions, validation_rate, CASE WHEN coalesce(nullif(chunks_passed_gate, 0), total_chunks, 0) > 0
            THEN coalesce(nullif(chunks_passed_gate, 0), total_chunks) * greatest(question_types, 1) ELSE coalesce(b.total_questions, 0) END AS expected FROM datasets d LEFT JOIN per_set b USING (dataset_id)))"""


def stats(spark, d):
    return A.dataset_stats(S.datasets(spark, d), S.questions(spark, d))


@query("a06_dataset_stats", f"WITH {STATS} SELECT dataset_id, status, total_questions, validation_rate, expected, progress_pct FROM stats")
def a06(spark, d):
    return stats(spark, d).select("dataset_id", "status", "total_questions", "validation_rate", "expected", "progress_pct")


@query("a07_overall", f"""WITH {STATS} SELECT count(*) AS datasets, CAST(sum(total_questions) AS BIGINT) AS questions, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'processing') AS processing,
    round(avg(progress_pct), 6) AS mean_progress, (SELECT round(CAST(100.0 AS DOUBLE) * avg(passed), 6) FROM parsed) AS validation_rate FROM stats""")
def a07(spark, d):
    return A.overall(stats(spark, d), S.questions(spark, d))


@query("a08_expected", f"WITH {S.DATASETS} SELECT dataset_id, coalesce(nullif(expected_questions, 0), coalesce(nullif(chunks_passed_gate, 0), total_chunks) * greatest(question_types, 1)) AS expected FROM datasets")
def a08(spark, d):
    sets = S.datasets(spark, d).withColumn("total_questions", F.lit(0))
    return sets.select("dataset_id", A.expected(sets, stored=True).alias("expected"))


@query("a09_progress", f"""WITH {S.DATASETS} SELECT dataset_id, CASE WHEN status = 'completed' THEN 100.0::DOUBLE WHEN total_chunks > 0 THEN least(round(100.0::DOUBLE * long_n / total_chunks, 1), 100.0::DOUBLE) ELSE 0.0::DOUBLE END AS progress_pct
    FROM datasets JOIN (SELECT source AS dataset_id, sum(CAST(n_chars >= 1000 AS INTEGER)) AS long_n FROM documents GROUP BY source) USING (dataset_id)""")
def a09(spark, d):
    long = S.table(spark, d, "documents").groupBy(F.col("source").alias("dataset_id")).agg(F.sum((F.col("n_chars") >= 1000).cast("long")).alias("long_n"))
    return S.datasets(spark, d).join(long, "dataset_id").select("dataset_id", A.progress(F.col("status"), F.col("long_n"), F.col("total_chunks")).alias("progress_pct"))


@query("a11_dataset_status_counts", f"WITH {S.DATASETS} SELECT status, count(*) AS n FROM datasets GROUP BY status")
def a11(spark, d):
    return A.value_counts(S.datasets(spark, d), "status")


@query("a12_type_dist", f"WITH {S.QUESTIONS} SELECT CASE question_type WHEN 'open' THEN 'Open answer' WHEN 'one' THEN 'Single choice' WHEN 'multi' THEN 'Multiple choice' ELSE 'Unknown' END AS label, count(*) AS n FROM questions GROUP BY 1")
def a12(spark, d):
    return A.type_distribution(S.questions(spark, d))


LEVELS = "(VALUES ('1', '{}'), ('2', '{}'), ('3', '{}')) AS l(level, label)"


@query("a13_level_dist_reindexed", f"WITH {S.QUESTIONS} SELECT level, label, count(question_id) AS n FROM {LEVELS.format('Easy', 'Medium', 'Hard')} LEFT JOIN questions ON trim(difficulty) = level GROUP BY level, label")
def a13(spark, d):
    return A.level_distribution(S.questions(spark, d), "difficulty", A.DIFFICULTY_LABELS)


@query("a14_levels_present", f"WITH {S.QUESTIONS} SELECT label, count(*) AS n, CAST(level AS INTEGER) AS place FROM questions JOIN {LEVELS.format('Low', 'Medium', 'High')} ON provocativeness = level GROUP BY label, level")
def a14(spark, d):
    return A.present_levels(S.questions(spark, d), "provocativeness")


@query("a15_score_hist", f"WITH {PARSED} SELECT score, count(*) AS n FROM parsed WHERE score IS NOT NULL GROUP BY score")
def a15(spark, d):
    return A.score_histogram(S.questions(spark, d))


@query("a16_floor_hist", f"WITH {PARSED} SELECT CAST(floor(score) AS BIGINT) AS bucket, count(*) AS n FROM parsed WHERE score IS NOT NULL GROUP BY 1")
def a16(spark, d):
    return A.floor_histogram(S.questions(spark, d))


@query("a17_dense_hist", f"""WITH {PARSED}, h AS (SELECT CAST(floor(score) AS BIGINT) AS bucket, count(*) AS n FROM parsed WHERE score IS NOT NULL GROUP BY 1)
    SELECT b.bucket AS bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(lo, hi + 1)) AS bucket FROM (SELECT min(bucket) AS lo, max(bucket) AS hi FROM h)) b LEFT JOIN h ON h.bucket = b.bucket""")
def a17(spark, d):
    return A.dense_histogram(S.questions(spark, d))


@query("a18_threshold_rate", f"WITH {PARSED} SELECT printf('%.1f', threshold) AS threshold, count(*) AS n, count(*) FILTER (passed = 1) AS passed, round(CAST(100.0 AS DOUBLE) * avg(passed), 6) AS rate FROM parsed WHERE threshold IS NOT NULL AND passed IS NOT NULL GROUP BY 1")
def a18(spark, d):
    return A.threshold_rates(S.questions(spark, d))


@query("a19_timeline", f"WITH {STATS} SELECT CAST(created_on AS VARCHAR) AS day, count(*) AS datasets, CAST(sum(total_questions) AS BIGINT) AS questions FROM stats GROUP BY 1")
def a19(spark, d):
    return A.timeline(stats(spark, d))


@query("p25_status_shares", f"WITH {S.DATASETS}, c AS (SELECT status, count(*) AS n FROM datasets GROUP BY status) SELECT status, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM c), 6) AS share FROM c")
def p25(spark, d):
    return E.shares(A.value_counts(S.datasets(spark, d), "status"))


@query("j06_dataset_chunk_counts", f"WITH {S.CHUNK_GATE} SELECT dataset_id, count(*) AS chunks, count(*) FILTER (c1 = 1 AND c2 = 1) AS valid FROM chunk_gate GROUP BY dataset_id")
def j06(spark, d):
    good = (F.col("c1") == 1) & (F.col("c2") == 1)
    return S.chunk_gate(spark, d).groupBy("dataset_id").agg(F.count("*").alias("chunks"), F.count_if(good).alias("valid"))


@query("j01_question_chunk", f"WITH {S.QUESTIONS}, {S.CHUNK_GATE} SELECT question_id, q.chunk_id AS chunk_id, c.n_chars AS chunk_n_chars, c.c1 AS chunk_c1 FROM questions q LEFT JOIN chunk_gate c ON CAST(q.chunk_id AS BIGINT) = c.chunk_id")
def j01(spark, d):
    return E.question_chunks(S.questions(spark, d), S.chunk_gate(spark, d)).select("question_id", "chunk_id", "chunk_n_chars", "chunk_c1")


@query("j02_extended_export", f"""WITH {S.QUESTIONS}, {S.CHUNK_GATE}, picked AS (SELECT * FROM questions WHERE question_id % 4 <> 0 AND question_id // 3 % 6 <> 0)
    SELECT question_id, coalesce(q.chunk_id, CAST(c.chunk_id AS VARCHAR)) AS chunk_id, question_type, c.c1 AS chunk_c1, c.c2 AS chunk_c2, c.c3 AS chunk_c3 FROM picked q FULL OUTER JOIN chunk_gate c ON CAST(q.chunk_id AS BIGINT) = c.chunk_id""")
def j02(spark, d):
    some = S.questions(spark, d).filter("question_id % 4 <> 0 AND floor(question_id / 3) % 6 <> 0")  # leaves chunks without questions
    found = E.question_chunks(some, S.chunk_gate(spark, d), "full_outer")
    return found.select("question_id", "chunk_id", "question_type", "chunk_c1", "chunk_c2", "chunk_c3").orderBy(*E.export_order())


@query("j14_chunks_without_question", f"WITH {S.QUESTIONS}, {S.CHUNK_GATE} SELECT chunk_id, dataset_id FROM chunk_gate WHERE chunk_id NOT IN (SELECT CAST(chunk_id AS BIGINT) FROM questions WHERE question_id % 2 = 1)")
def j14(spark, d):
    return E.chunks_without_questions(S.questions(spark, d).filter("question_id % 2 = 1"), S.chunk_gate(spark, d)).select("chunk_id", "dataset_id")


@query("a27_questions_by_chunk", f"WITH {S.QUESTIONS} SELECT chunk_id, count(*) AS n, string_agg(question_type, ',' ORDER BY question_type) AS types FROM questions GROUP BY chunk_id")
def a27(spark, d):
    found = Q.by_chunk(S.questions(spark, d))
    return found.select("chunk_id", F.size("questions").cast("long").alias("n"), F.array_join(F.transform("questions", lambda q: q["question_type"]), ",").alias("types"))


def part_options():
    words = F.split("p_name", " ")
    return F.map_from_entries(F.transform(words, lambda w, i: F.struct((F.size(words) - i).cast("string").alias("key"), F.when(i == 1, "None").otherwise(w).alias("value"))))


@query("f30_norm_options", r"""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), e AS (SELECT p_partkey, unnest(w) AS v, unnest(range(len(w))) AS i, len(w) AS n FROM w)
    SELECT p_partkey, coalesce(string_agg(CAST(n - i AS VARCHAR) || ': ' || v, chr(10) ORDER BY CAST(n - i AS VARCHAR)) FILTER (i <> 1), '') AS options FROM e GROUP BY p_partkey""")
def f30(spark, d):
    return S.table(spark, d, "part").select("p_partkey", Q.options_text(part_options()).alias("options"))


@query("f31_parse_options", "SELECT p_partkey, p_brand AS a, 'x:' || p_type AS b, 2 AS n FROM part")
def f31(spark, d):
    text = F.concat(F.lit("a: old\nno colon\n a : "), "p_brand", F.lit("\nb: x:"), "p_type", F.lit("\n: nothing"))
    options = Q.parse_options(text)
    return S.table(spark, d, "part").select("p_partkey", options["a"].alias("a"), options["b"].alias("b"), F.size(options).alias("n"))


@query("f32_numbered_options", r"""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), e AS (SELECT p_partkey, unnest(w) AS v, unnest(range(len(w))) AS i, len(w) AS n FROM w),
    o AS (SELECT p_partkey, v, row_number() OVER (PARTITION BY p_partkey ORDER BY CAST(n - i AS VARCHAR)) AS k FROM e WHERE i <> 1)
    SELECT p_partkey, string_agg(CAST(k AS VARCHAR) || '. ' || v, chr(10) ORDER BY k) AS options FROM o GROUP BY p_partkey UNION ALL SELECT p_partkey, '—' FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM o)""")
def f32(spark, d):
    return S.table(spark, d, "part").select("p_partkey", Q.numbered_list(part_options()).alias("options"))


@query("f34_shuffle_options", """WITH o AS (SELECT p_partkey, unnest([p_brand, p_type, 'x', 'y']) AS v, unnest(range(4)) AS i FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY md5('7/' || p_partkey || '/' || i)) AS k FROM o), c AS (SELECT p_partkey, v FROM o WHERE i IN (0, 2))
    SELECT p_partkey, string_agg(v, '|' ORDER BY k) AS options, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER ((p_partkey, v) IN (SELECT p_partkey, v FROM c)) AS correct FROM r GROUP BY p_partkey""")
def f34(spark, d):
    options, places = Q.shuffled(F.array("p_brand", "p_type", F.lit("x"), F.lit("y")), F.lit("1, 3"), F.col("p_partkey"), 7)
    return S.table(spark, d, "part").select("p_partkey", F.array_join(options, "|").alias("options"), places.alias("correct"))


@query("p09_flatten_questions", "SELECT p_partkey AS chunk_id, 'multi' AS question_type, p_name AS task, CASE WHEN p_partkey % 2 = 0 THEN '1: ' || p_brand || chr(10) || '3: ' || p_type ELSE '3: ' || p_type END AS options, CAST(p_size AS VARCHAR) AS correct_answer FROM part")
def p09(spark, d):
    key = F.col("p_partkey")
    wide = S.table(spark, d, "part").select(
        key.alias("chunk_id"), F.col("p_name").alias("task"), F.col("p_size").alias("outputs"), F.when(key % 2 == 0, F.col("p_brand")).alias("option_1"), F.lit("None").alias("option_2"), F.col("p_type").alias("option_3"), F.lit(" ").alias("option_4"),
    )
    return Q.flatten(wide, F.lit("multi")).withColumn("options", Q.options_text(F.col("options")))


@query("p17_first_failure", "SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'length' WHEN lang <> 'en' THEN 'language' END AS failure, CASE WHEN length(text) > 5000 THEN 'exceed' END AS too_long FROM documents")
def p17(spark, d):
    checks = [("length", F.col("n_chars") <= 5000), ("language", F.col("lang") == "en")]
    return S.table(spark, d, "documents").select("doc_id", Q.first_failure(checks).alias("failure"), Q.too_long(F.col("text"), 5000).alias("too_long"))


def rule_bits(kind: str, attempt: str) -> str:
    """A total by the stand-in's rule, in SQL: the bit of a block's place hangs on the document, the attempt, the block and the place."""
    bit = lambda name, i: f"CAST((doc_id * 7 + {attempt} * 29 + {len(name)} * 11 + {i} * 3) % 13 <> 0 AS INTEGER)"
    weights = " + ".join(f"{w} * {bit(name, i)}" for name in P.BLOCKS[kind] for i, w in enumerate(P.WEIGHTS[name]))
    critical = ", ".join(bit(name, i) for name in P.BLOCKS[kind] for i in P.CRITICAL[name])
    return f"CAST(({weights}) * least({critical}) AS DOUBLE)"


def validation_by_rule(block: str, n: int):
    def run(batch):
        return ["\n".join(f"{int((d * 7 + a * 29 + len(block) * 11 + i * 3) % 13 != 0)} — {block}" for i in range(n)) for d, a in zip(batch["doc_id"], batch["retry_count"])]

    return run


def loop_sql(kind: str, rows: str) -> str:
    """Total, passing and attempts of the rows (doc_id) of a type: the first attempt that passes, or the last."""
    tries = ", ".join(f"{rule_bits(kind, str(a))} AS t{a}" for a in range(3))
    least = P.THRESHOLDS[kind]
    return f"""SELECT doc_id, CASE WHEN t0 >= {least} THEN t0 WHEN t1 >= {least} THEN t1 ELSE t2 END AS total, t0 >= {least} OR t1 >= {least} OR t2 >= {least} AS passed,
        CASE WHEN t0 >= {least} THEN 0 WHEN t1 >= {least} THEN 1 ELSE 2 END AS retry_count FROM (SELECT doc_id, {tries} FROM {rows})"""


@query("l05_validate_refine_loop", loop_sql("open", "documents"))
def l05(spark, d):
    from ..operators.scorers import validate_and_refine

    found = validate_and_refine(S.table(spark, d, "documents").select("doc_id", "text", F.lit("open").alias("question_type")), scorer=validation_by_rule)
    return found.select("doc_id", "total", "passed", "retry_count")
