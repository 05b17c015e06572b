
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: ten queues, datasets by customer, a status for each order with some failed, cancelled and unknown."""
    key = F.col("o_orderkey")
    status = (
        F.when(key % 101 == 0, "archived").when(key % 13 == 0, "failed").when(key % 17 == 0, "cancelled")
        .when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("task_id"), (F.col("o_custkey") % 10).alias("queue_id"), F.col("o_custkey").alias("dataset_id"), status.alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("created_at"), (key % 4).cast("int").alias("attempts"),
        (key % 7).alias("generation_model"), (F.col("o_custkey") % 7).alias("validation_model"),
        F.when(key % 13 == 0, F.concat(F.lit("error "), F.repeat(key.cast("string"), 20))).alias("error"),
    )


TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_custkey % 10 AS queue_id, o_custkey AS dataset_id,
    CASE WHEN o_orderkey % 101 = 0 THEN 'archived' WHEN o_orderkey % 13 = 0 THEN 'failed' WHEN o_orderkey % 17 = 0 THEN 'cancelled'
         WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'processing' END AS status,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, o_orderdate AS created_at, CAST(o_orderkey % 4 AS INTEGER) AS attempts,
    o_orderkey % 7 AS generation_model, o_custkey % 7 AS validation_model,
    CASE WHEN o_orderkey % 13 = 0 THEN 'error ' || repeat(CAST(o_orderkey AS VARCHAR), 20) END AS error FROM orders)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents, numbered from 0."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = """lines AS (SELECT doc_id, lang, source, unnest(range(len(l))) AS line_no, unnest(l) AS line
    FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents))"""


def outline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents under headings made by their number: each 9th of level 1, each 3rd of level 2, others text."""
    level = F.when(F.col("line_no") % 9 == 0, 1).when(F.col("line_no") % 3 == 0, 2)
    return lines(spark, sf_dir).select("doc_id", "line_no", level.alias("level"), F.col("line").alias("title"))


OUTLINE_LINES = LINES + """, outline_lines AS (SELECT doc_id, line_no,
    CASE WHEN line_no % 9 = 0 THEN 1 WHEN line_no % 3 = 0 THEN 2 END AS level, line AS title FROM lines)"""


def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node rows of documents: a root with the article lines of its content, and a node for each line. Its level and what becomes
    title and content go by the line's length and number: empty nodes, articles, items of three forms, parts of sentences, plain ones."""
    found = lines(spark, sf_dir)
    n, i, line = F.length("line"), F.col("line_no"), F.col("line")
    digit = lambda k: (1 + i % k).cast("string")
    head = F.left(line, F.lit(20))
    forms = [
        (F.lit(""), F.lit("")), (F.concat(F.lit("Статья "), digit(9)), F.lit("")), (F.concat(digit(5), F.lit(". "), head), F.expr("substring(line, 21, 200)")),
        (F.concat(digit(3), F.lit(") "), head), F.when(i % 2 == 0, F.concat(F.lit("2) "), F.expr("substring(line, 21, 15)"), F.lit("; 3) last"))).otherwise("")), (F.concat(F.lower(F.left(line, F.lit(30))), F.lit(",")), F.lit("")), (F.lit(""), line),
        (F.left(line, F.lit(40)), F.concat(F.lit("see: 1) "), F.left(line, F.lit(10)), F.lit("; 2) "), F.expr("substring(line, 11, 10)"), F.lit(";"), F.when(i % 3 == 0, "\nafter").otherwise(""))),
        (F.concat(F.lit("Глава "), digit(7), F.lit(". "), F.left(line, F.lit(15))), F.lit("")), (F.lit(""), F.concat(F.lit("1) a;\n2) b;\n"), head)), (F.left(line, F.lit(60)), F.expr("substring(line, 61)")),
    ]
    kind = ((n + i) % 10).cast("int")
    pick = lambda side: F.coalesce(*[F.when(kind == k, f[side]) for k, f in enumerate(forms)])
    nodes = found.select("doc_id", (i + 1).cast("int").alias("node_no"), (1 + (n * 7 + i) % 4).cast("int").alias("level"), pick(0).alias("title"), pick(1).alias("content"))
    first = F.concat(F.left("text", F.lit(25)), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("\n\nСтатья 1\n\n"), F.expr("substring(text, 26, 40)"), F.lit("\nСТАТЬЯ 2 \nстатья 33 о\nСтатья 4"))).otherwise(""))
    roots = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("node_no"), F.lit(0).alias("level"), F.lit("").alias("title"), first.alias("content"))
    return nodes.unionByName(roots)


OUTLINE_NODES = LINES + """, outline_nodes AS (
    SELECT doc_id, CAST(line_no + 1 AS INTEGER) AS node_no, CAST(1 + (length(line) * 7 + line_no) % 4 AS INTEGER) AS level,
        CASE (length(line) + line_no) % 10 WHEN 1 THEN 'Статья ' || (1 + line_no % 9) WHEN 2 THEN (1 + line_no % 5) || '. ' || left(line, 20) WHEN 3 THEN (1 + line_no % 3) || ') ' || left(line, 20) WHEN 4 THEN lower(left(line, 30)) || ','
            WHEN 6 THEN left(line, 40) WHEN 7 THEN 'Глава ' || (1 + line_no % 7) || '. ' || left(line, 15) WHEN 9 THEN left(line, 60) ELSE '' END AS title,
        CASE (length(line) + line_no) % 10 WHEN 2 THEN substr(line, 21, 200) WHEN 3 THEN CASE WHEN line_no % 2 = 0 THEN '2) ' || substr(line, 21, 15) || '; 3) last' ELSE '' END WHEN 5 THEN line
            WHEN 6 THEN 'see: 1) ' || left(line, 10) || '; 2) ' || substr(line, 11, 10) || ';' || CASE WHEN line_no % 3 = 0 THEN chr(10) || 'after' ELSE '' END
            WHEN 8 THEN '1) a;' || chr(10) || '2) b;' || chr(10) || left(line, 20) WHEN 9 THEN substr(line, 61) ELSE '' END AS content FROM lines
    UNION ALL SELECT doc_id, 0, 0, '', left(text, 25) || CASE WHEN doc_id % 3 > 0 THEN chr(10) || chr(10) || 'Статья 1' || chr(10) || chr(10) || substr(text, 26, 40) || chr(10) || 'СТАТЬЯ 2 ' || chr(10) || 'статья 33 о' || chr(10) || 'Статья 4' ELSE '' END FROM documents),
    tree AS (SELECT *, CASE WHEN level > 0 THEN greatest(l0, CASE WHEN level > 1 THEN l1 END, CASE WHEN level > 2 THEN l2 END, CASE WHEN level > 3 THEN l3 END) END AS parent_no FROM (
        SELECT *, max(CASE level WHEN 0 THEN node_no END) OVER w AS l0, max(CASE level WHEN 1 THEN node_no END) OVER w AS l1, max(CASE level WHEN 2 THEN node_no END) OVER w AS l2, max(CASE level WHEN 3 THEN node_no END) OVER w AS l3
        FROM outline_nodes WINDOW w AS (PARTITION BY doc_id ORDER BY node_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents of which each 4th from the 2nd on begins a numbered item `n. ` and each 8th from the 7th on reads `n.m. `."""
    n = F.floor(F.col("line_no") / 4).cast("string")
    line = F.when(F.col("line_no") % 4 == 1, F.concat(n, F.lit(". "), "line")).when(F.col("line_no") % 8 == 6, F.concat(n, F.lit(".1. "), "line")).otherwise(F.col("line"))
    return lines(spark, sf_dir).select("doc_id", "line_no", line.alias("line"))


ITEM_LINES = LINES + """, item_lines AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 1 THEN CAST(line_no // 4 AS VARCHAR) || '. ' || line
    WHEN line_no % 8 = 6 THEN CAST(line_no // 4 AS VARCHAR) || '.1. ' || line ELSE line END AS line FROM lines)"""


def chunk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with the three gate scores; an unlabelled document has 0 for the first two (NULL-safe reject)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = docs.join(labels, "doc_id", "left")
    return found.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("dataset_id"), "text", "n_chars", F.coalesce(F.col("quality").cast("int"), F.lit(0)).alias("c1"),
        F.coalesce((1 - F.col("toxic")).cast("int"), F.lit(0)).alias("c2"), (F.col("n_chars") >= 1000).cast("int").alias("c3"), F.col("quality").isNotNull().alias("labelled"),
    )


CHUNK_GATE = """chunk_gate AS (SELECT d.doc_id AS chunk_id, d.source AS dataset_id, d.text, d.n_chars, CAST(coalesce(quality, 0) AS INTEGER) AS c1,
    CAST(coalesce(1 - toxic, 0) AS INTEGER) AS c2, CAST(d.n_chars >= 1000 AS INTEGER) AS c3, quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question of each type for each document: score text, threshold, flag, levels; every 19th has no parsable score, every 11th a blank difficulty."""
    docs = table(spark, sf_dir, "documents")
    kinds = docs.select("doc_id", "source", F.posexplode(F.array(F.lit("open"), F.lit("one"), F.lit("multi"))).alias("k", "question_type"))
    key = F.col("doc_id") * 3 + F.col("k")
    half = (F.col("doc_id") * 7 + F.col("k") * 5) % 33
    top = F.when(F.col("k") == 0, 16.0).otherwise(20.5)
    total = F.least(half / 2.0, top)
    threshold = F.when(F.col("k") == 0, 14.0).otherwise(18.0)
    one = lambda x: F.format_number(x, 1)
    return kinds.select(
        key.alias("question_id"), F.col("source").alias("dataset_id"), (F.col("doc_id") + F.when(key % 23 == 0, 1_000_000_000).otherwise(0)).cast("string").alias("chunk_id"), "question_type",
        F.when(key % 19 == 0, "N/A").otherwise(F.concat(one(total), F.lit("/"), one(top))).alias("validation_score"),
        F.when(key % 19 == 0, "N/A").otherwise(one(threshold)).alias("validation_threshold"),
        F.when(key % 5 == 0, "N/A").when(total >= threshold, "True").otherwise("False").alias("validation_passed"),
        (1 + F.col("doc_id") % 3).cast("string").alias("provocativeness"), F.when(key % 11 == 0, " ").otherwise((1 + (F.col("doc_id") * 7 + F.col("k")) % 2).cast("string")).alias("difficulty"),
        F.when(key % 29 == 0, "n").otherwise((key % 3).cast("string")).alias("retry_count"), F.concat(F.lit("task "), key.cast("string")).alias("task"),
    )


QUESTIONS = """questions AS (SELECT doc_id * 3 + k AS question_id, source AS dataset_id, CAST(doc_id + CASE WHEN (doc_id * 3 + k) % 23 = 0 THEN 1000000000 ELSE 0 END AS VARCHAR) AS chunk_id, question_type,
    CASE WHEN (doc_id * 3 + k) % 19 = 0 THEN 'N/A' ELSE printf('%.1f/%.1f', total, top) END AS validation_score,
    CASE WHEN (doc_id * 3 + k) % 19 = 0 THEN 'N/A' ELSE printf('%.1f', threshold) END AS validation_threshold,
    CASE WHEN (doc_id * 3 + k) % 5 = 0 THEN 'N/A' WHEN total >= threshold THEN 'True' ELSE 'False' END AS validation_passed,
    CAST(1 + doc_id % 3 AS VARCHAR) AS provocativeness, CASE WHEN (doc_id * 3 + k) % 11 = 0 THEN ' ' ELSE CAST(1 + (doc_id * 7 + k) % 2 AS VARCHAR) END AS difficulty,
    CASE WHEN (doc_id * 3 + k) % 29 = 0 THEN 'n' ELSE CAST((doc_id * 3 + k) % 3 AS VARCHAR) END AS retry_count, 'task ' || (doc_id * 3 + k) AS task
    FROM (SELECT *, least(((doc_id * 7 + k * 5) % 33) / CAST(2.0 AS DOUBLE), top) AS total FROM (SELECT doc_id, source, k, t AS question_type, CAST(CASE WHEN k = 0 THEN 16.0 ELSE 20.5 END AS DOUBLE) AS top,
        CAST(CASE WHEN k = 0 THEN 14.0 ELSE 18.0 END AS DOUBLE) AS threshold FROM documents, (VALUES (0, 'open'), (1, 'one'), (2, 'multi')) AS kinds(k, t))))"""


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset for each source: number, status, question types, counts known or not, creation day."""
    docs = table(spark, sf_dir, "documents")
    n = F.substring("dataset_id", 4, 10).cast("long")
    by = docs.groupBy(F.col("source").alias("dataset_id")).agg(F.count("*").alias("total_chunks"), F.sum((F.col("n_chars") >= 1000).cast("long")).alias("long_chunks"))
    status = F.element_at(F.array(*map(F.lit, ("completed", "processing", "failed", "created"))), (n % 4 + 1).cast("int"))
    return by.select(
        "dataset_id", n.alias("number"), status.alias("status"), "total_chunks", F.when(n % 5 == 0, 0).when(n % 7 == 0, None).otherwise(F.col("long_chunks")).alias("chunks_passed_gate"),
        (n % 4).cast("int").alias("question_types"), F.when(n % 6 == 0, F.col("total_chunks") * 2).alias("expected_questions"),
        F.date_add(F.lit("2024-01-01").cast("date"), (n / 3).cast("int")).alias("created_on"),
    )


DATASETS = """datasets AS (SELECT dataset_id, number, ['completed', 'processing', 'failed', 'created'][number % 4 + 1] AS status, total_chunks,
    CASE WHEN number % 5 = 0 THEN 0 WHEN number % 7 = 0 THEN NULL ELSE long_chunks END AS chunks_passed_gate, CAST(number % 4 AS INTEGER) AS question_types,
    CASE WHEN number % 6 = 0 THEN total_chunks * 2 END AS expected_questions, CAST(DATE '2024-01-01' + CAST(number // 3 AS INTEGER) AS DATE) AS created_on
    FROM (SELECT source AS dataset_id, CAST(substr(source, 4) AS BIGINT) AS number, count(*) AS total_chunks, CAST(sum(CAST(n_chars >= 1000 AS INTEGER)) AS BIGINT) AS long_chunks FROM documents GROUP BY source))"""


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of tasks: sixty-four of each user's are one task; the type gives the status."""
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type").isin("view", "click"), "processing").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("task_id"), "ts", status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"))


TASK_EVENTS = """task_events AS (SELECT event_id, user_id AS task_id, ts, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing'
    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, CAST(event_id % 4 AS INTEGER) AS attempts FROM events)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a dataset from parts: the second changes each 5th, drops each 11th and adds a shifted copy of each 17th."""
    key = F.col("p_partkey")
    first = table(spark, sf_dir, "part").select(key.alias("question_id"), F.col("p_name").alias("task"), F.col("p_brand").alias("options"), F.col("p_type").alias("correct_answer"), F.col("p_size").cast("string").alias("difficulty"))
    q = F.col("question_id")
    changed = first.filter(q % 11 != 0).withColumns({
        "task": F.when(q % 5 == 0, F.concat("task", F.lit(" (edited)"))).otherwise(F.col("task")),
        "difficulty": F.when(q % 10 == 0, None).otherwise(F.col("difficulty")),
    })
    added = first.filter(q % 17 == 0).withColumn("question_id", q + 1_000_000)
    return first, changed.unionByName(added)


VERSIONS = """v1 AS (SELECT p_partkey AS question_id, p_name AS task, p_brand AS options, p_type AS correct_answer, CAST(p_size AS VARCHAR) AS difficulty FROM part),
    v2 AS (SELECT question_id, CASE WHEN question_id % 5 = 0 THEN task || ' (edited)' ELSE task END AS task, options, correct_answer, CASE WHEN question_id % 10 = 0 THEN NULL ELSE difficulty END AS difficulty
        FROM v1 WHERE question_id % 11 <> 0 UNION ALL SELECT question_id + 1000000, task, options, correct_answer, difficulty FROM v1 WHERE question_id % 17 = 0)"""
