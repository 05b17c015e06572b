"""Queries of queues, tasks and their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tasks as O
from ..sources import derived as S
from .registry import query

COUNTS = """count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'completed') AS completed,
    count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled"""
NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def health(spark, models: int = 6):
    return spark.range(models).select(F.col("id").alias("model_id"), (F.col("id") % 3 != 0).alias("healthy"))


HEALTH = "health AS (SELECT range AS model_id, range % 3 <> 0 AS healthy FROM range(6))"
STATUS_LIST = "('pending', 'processing', 'completed', 'failed', 'cancelled')"


@query("a01_queue_status_counts", f"WITH {S.TASKS} SELECT queue_id, {COUNTS}, count(*) FILTER (status IN {STATUS_LIST}) AS task_count FROM tasks GROUP BY queue_id")
def a01(spark, d):
    return O.status_counts(S.tasks(spark, d))


@query("a02_queue_recount", f"WITH {S.TASKS} SELECT queue_id, count(*) AS task_count, {COUNTS} FROM tasks GROUP BY queue_id")
def a02(spark, d):
    return O.recount(S.tasks(spark, d))


@query("a03_needs_recount", f"""WITH {S.TASKS}, q AS (SELECT queue_id, count(*) FILTER (queue_id % 3 <> 0) AS task_count, {COUNTS} FROM tasks GROUP BY queue_id)
    SELECT queue_id, CAST(coalesce(task_count, 0) = 0 OR pending + processing + completed + failed + cancelled = 0 AS INTEGER) AS needs_recount FROM q""")
def a03(spark, d):
    counts = O.recount(S.tasks(spark, d)).withColumn("task_count", F.when(F.col("queue_id") % 3 != 0, F.col("task_count")))
    return O.needs_recount(counts).select("queue_id", F.col("needs_recount").cast("int"))


@query("a04_task_progress", f"""WITH {S.TASKS}, c AS (SELECT dataset_id, count(*) AS total, {COUNTS} FROM tasks GROUP BY dataset_id)
    SELECT *, CASE WHEN total = 0 THEN 'no_tasks' WHEN pending + processing > 0 THEN 'in_progress' WHEN completed > 0 AND failed = 0 THEN 'completed' WHEN failed > 0 THEN 'completed_with_failures' ELSE 'unknown' END AS state,
        round(100.0::DOUBLE * completed / total, 1) AS progress_pct FROM c""")
def a04(spark, d):
    return O.task_progress(S.tasks(spark, d))


@query("a10_reconcile", f"""WITH {S.TASKS} SELECT dataset_id, 'completed' AS status, CAST(count(*) FILTER (status = 'completed') AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) AS success_rate
    FROM tasks GROUP BY dataset_id HAVING count(*) FILTER (status IN ('pending', 'processing')) = 0""")
def a10(spark, d):
    return O.reconciled(S.tasks(spark, d))


@query("a22_status_totals", f"WITH {S.TASKS} SELECT s.status AS status, count(task_id) AS tasks FROM (VALUES ('pending'), ('processing'), ('completed'), ('failed'), ('cancelled')) AS s(status) LEFT JOIN tasks t ON t.status = s.status GROUP BY s.status")
def a22(spark, d):
    return O.status_totals(S.tasks(spark, d))


@query("a25_models_in_queue", f"""WITH {S.TASKS}, {HEALTH}, used AS (SELECT queue_id, generation_model AS model_id FROM tasks UNION SELECT queue_id, validation_model FROM tasks)
    SELECT queue_id, count(*) AS models, count(*) FILTER (NOT healthy) AS down FROM used LEFT JOIN health USING (model_id) GROUP BY queue_id""")
def a25(spark, d):
    return O.models_in_use(S.tasks(spark, d), health(spark))


def label(name):
    return f"CAST({name} AS VARCHAR) || CASE WHEN {name[0]}.healthy IS FALSE THEN ' ⚠' ELSE '' END".replace(f"{name[0]}.healthy", f"{name}_h.healthy")


@query("j09_task_model_health", f"""WITH {S.TASKS}, {HEALTH} SELECT task_id, status, {label("generation_model")} AS generation_model_label, {label("validation_model")} AS validation_model_label,
    CASE WHEN status = 'failed' THEN CASE WHEN length(error) > 100 THEN substr(error, 1, 100) || '...' ELSE error END END AS error_text
    FROM tasks LEFT JOIN health generation_model_h ON generation_model = generation_model_h.model_id LEFT JOIN health validation_model_h ON validation_model = validation_model_h.model_id""")
def j09(spark, d):
    return O.task_rows(S.tasks(spark, d), health(spark))


@query("o01_pending_topk", f"WITH {S.TASKS} SELECT task_id, priority, strftime(created_at, '%Y-%m-%d') AS created_on FROM tasks WHERE status = 'pending' ORDER BY priority DESC, created_at, task_id LIMIT 10")
def o01(spark, d):
    return O.pending_top(S.tasks(spark, d)).select("task_id", "priority", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


@query("o02_queue_tasks", f"WITH {S.TASKS} SELECT task_id, status FROM tasks WHERE queue_id = 3 ORDER BY created_at, task_id LIMIT 100")
def o02(spark, d):
    return O.tasks_of(S.tasks(spark, d), 3).select("task_id", "status")


@query("p01_failed_tasks", f"WITH {S.TASKS} SELECT task_id, queue_id, error FROM tasks WHERE status = 'failed'")
def p01(spark, d):
    return S.tasks(spark, d).filter("status = 'failed'").select("task_id", "queue_id", "error")


@query("p18_active_generation", f"""WITH {S.TASKS}, {S.DATASETS} SELECT dataset_id FROM datasets WHERE status = 'processing'
    AND number IN (SELECT dataset_id FROM tasks WHERE status IN ('pending', 'processing')) ORDER BY dataset_id LIMIT 1""")
def p18(spark, d):
    sets = S.datasets(spark, d).withColumnRenamed("dataset_id", "name").withColumnRenamed("number", "dataset_id")
    return O.active_generation(sets, S.tasks(spark, d)).orderBy("name").limit(1).select(F.col("name").alias("dataset_id"))


@query("p19_has_active_work", f"WITH {S.TASKS} SELECT CAST(count(*) > 0 AS INTEGER) AS active FROM tasks WHERE status IN ('pending', 'processing')")
def p19(spark, d):
    return O.has_active_work(O.status_counts(S.tasks(spark, d))).select(F.col("active").cast("int"))


LATEST = f"{S.TASK_EVENTS}, latest AS (SELECT task_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(status, (ts, event_id)) AS status, arg_max(attempts, (ts, event_id)) AS attempts FROM task_events GROUP BY task_id)"


@query("m09_latest_status", f"WITH {LATEST} SELECT task_id, event_id, status, attempts FROM latest")
def m09(spark, d):
    return O.latest(S.task_events(spark, d)).select("task_id", "event_id", "status", "attempts")


@query("p03_stuck_tasks", f"WITH {LATEST} SELECT task_id, event_id, attempts FROM latest WHERE status = 'processing' AND ts < {NOW} - INTERVAL 15 MINUTES")
def p03(spark, d):
    return O.stuck(O.latest(S.task_events(spark, d)), F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select("task_id", "event_id", "attempts")


@query("x03_recover_stuck", f"""WITH {LATEST} SELECT task_id, CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, attempts + 1 AS attempts,
    CASE WHEN attempts + 1 >= 3 THEN 'Force-failed after ' || (attempts + 1) || ' attempts' END AS error FROM latest WHERE status = 'processing' AND ts < {NOW} - INTERVAL 15 MINUTES""")
def x03(spark, d):
    return O.recover(O.stuck(O.latest(S.task_events(spark, d)), F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")))).select("task_id", "status", "attempts", "error")


@query("x06_invalid_transitions", f"""WITH {S.TASK_EVENTS}, s AS (SELECT task_id, event_id, lag(status) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS before, status FROM task_events)
    SELECT task_id, event_id, before, status FROM s WHERE before IS NOT NULL AND before || '>' || status NOT IN ('pending>processing', 'processing>completed', 'processing>failed', 'processing>pending', 'failed>pending', 'processing>processing')""")
def x06(spark, d):
    return O.invalid_transitions(S.task_events(spark, d))


@query("x08_progress_by_day", f"WITH {S.TASK_EVENTS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS done FROM task_events WHERE status = 'completed' GROUP BY 1")
def x08(spark, d):
    """By the stream itself, over all events there are."""
    from ..streaming.fold import progress

    start = F.to_utc_timestamp("window.start", spark.conf.get("spark.sql.session.timeZone"))
    return progress(spark, d).select(F.to_date(start).cast("string").alias("day"), "done")


@query("m10_retry_failed", f"WITH {S.TASKS} SELECT task_id, CASE WHEN status = 'failed' AND queue_id = 4 THEN 'pending' ELSE status END AS status, CASE WHEN NOT (status = 'failed' AND queue_id = 4) THEN error END AS error FROM tasks")
def m10(spark, d):
    return O.retry_failed(S.tasks(spark, d), 4).select("task_id", "status", "error")


@query("m11_retry_all", f"""WITH {S.TASKS}, sets AS (SELECT c_custkey AS dataset_id, CASE WHEN c_custkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM customer)
    SELECT dataset_id, CASE WHEN dataset_id IN (SELECT dataset_id FROM tasks WHERE status = 'failed') THEN 'processing' ELSE status END AS status FROM sets""")
def m11(spark, d):
    key = F.col("c_custkey")
    sets = S.table(spark, d, "customer").select(key.alias("dataset_id"), F.when(key % 2 == 0, "completed").otherwise("failed").alias("status"))
    return O.reopened(sets, S.tasks(spark, d)).select("dataset_id", "status")


@query("m06_cascade_delete", f"WITH {S.TASKS} SELECT task_id, queue_id FROM tasks WHERE queue_id NOT IN (2, 5)")
def m06(spark, d):
    gone = spark.createDataFrame([(2,), (5,)], "queue_id long")
    return O.cascade_delete(S.tasks(spark, d), gone, "queue_id").select("task_id", "queue_id")


@query("m08_enqueue", """SELECT s_suppkey AS task_id, 'pending' AS status, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS INTEGER) ELSE 0 END AS priority, 'full' AS pipeline_mode, 0 AS pre_validated, 0 AS attempts FROM supplier""")
def m08(spark, d):
    asked = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("task_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("int")).alias("priority"))
    return O.enqueue(asked, F.lit("2024-01-01").cast("timestamp_ntz")).select("task_id", "status", "priority", "pipeline_mode", F.col("chunk_pre_validated").cast("int").alias("pre_validated"), "attempts")


@query("m07_new_queues", "SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def m07(spark, d):
    taken = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "name string")
    return O.new_queues(taken, S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")))


@query("a29_distinct_datasets", f"WITH {S.TASKS} SELECT DISTINCT dataset_id FROM tasks WHERE status = 'failed'")
def a29(spark, d):
    return S.tasks(spark, d).filter("status = 'failed'").select("dataset_id").distinct()


@query("u02_models_union", f"WITH {S.TASKS} SELECT generation_model AS model_id FROM tasks UNION SELECT validation_model FROM tasks")
def u02(spark, d):
    t = S.tasks(spark, d)
    return t.select(F.col("generation_model").alias("model_id")).union(t.select("validation_model")).distinct()


@query("u03_models_added", f"WITH {S.TASKS} SELECT generation_model AS model_id FROM tasks EXCEPT SELECT validation_model FROM tasks WHERE validation_model > 2")
def u03(spark, d):
    t = S.tasks(spark, d)
    used = t.filter("validation_model > 2").select("validation_model")
    return t.select(F.col("generation_model").alias("model_id")).distinct().subtract(used.distinct())  # a row for each model is joined, not one for each task


@query("j15_registry_merge", """WITH fixed AS (SELECT DISTINCT s_nationkey AS model_id, 'fixed' AS source FROM supplier), probed AS (SELECT DISTINCT c_nationkey + 5 AS model_id, 'probed' AS source FROM customer)
    SELECT coalesce(p.model_id, f.model_id) AS model_id, coalesce(p.source, f.source) AS listed, coalesce(f.source, p.source) AS looked_up FROM fixed f FULL OUTER JOIN probed p ON f.model_id = p.model_id""")
def j15(spark, d):
    from ..sources.files import merged_registry

    fixed = S.table(spark, d, "supplier").select(F.col("s_nationkey").alias("model_id"), F.lit("fixed").alias("source")).distinct()
    probed = S.table(spark, d, "customer").select((F.col("c_nationkey") + 5).alias("model_id"), F.lit("probed").alias("source")).distinct()
    return merged_registry(fixed, probed)


STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
ARRIVED = f"""arrived AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id AS task_id, {STATUS_SQL} AS status, CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 3 END AS INTEGER) AS attempts,
    user_id * 100 + day(ts) AS day_task, user_id * 10 + day(ts) // 4 AS dataset_id, (day(ts) - 1) // 8 + CASE WHEN event_id % 29 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS file FROM events)"""


@query("x02_recovery_by_timer", f"""WITH {ARRIVED}, marks AS (SELECT file, max(max(us) // 1000) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 17 * 86400000 AS mark FROM arrived GROUP BY file),
    kept AS (SELECT a.* FROM arrived a JOIN marks m USING (file) WHERE mark IS NULL OR us > mark * 1000), horizon AS (SELECT (max(us) // 1000 - 17 * 86400000) * 1000 AS h FROM arrived),
    steps AS (SELECT *, status = 'processing' AND coalesce(lead(us) OVER w > us + 900000000, TRUE) AND us + 900000000 < h AS stuck, count(attempts) OVER w AS part FROM kept, horizon WINDOW w AS (PARTITION BY task_id ORDER BY us, event_id)),
    counted AS (SELECT *, coalesce(max(attempts) OVER (PARTITION BY task_id, part), 0) + coalesce(sum(CAST(stuck AS INTEGER)) OVER (PARTITION BY task_id, part ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tried FROM steps WHERE us < h)
    SELECT task_id, us, event_id, status, CAST(tried AS INTEGER) AS attempts, 0 AS recovered FROM counted
    UNION ALL SELECT task_id, us + 900000000, NULL, CASE WHEN tried + 1 >= 3 THEN 'failed' ELSE 'pending' END, CAST(tried + 1 AS INTEGER), 1 FROM counted WHERE stuck""")
def x02(spark, d):
    from ..streaming.fold import recovered_log

    return recovered_log(spark, d).select("task_id", F.unix_micros("at").alias("us"), "event_id", "status", "attempts", F.col("recovered").cast("int").alias("recovered"))


@query("x07_completion_by_batch", f"""WITH {ARRIVED}, files AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS batch FROM (SELECT DISTINCT file FROM arrived)),
    known AS (SELECT f.file, f.batch, a.dataset_id, a.day_task, arg_max(a.status, (a.us, a.event_id)) AS status FROM files f JOIN arrived a ON a.file <= f.file GROUP BY 1, 2, 3, 4),
    touched AS (SELECT DISTINCT file, dataset_id FROM (SELECT a.file, a.dataset_id, a.us, a.event_id, max(CASE WHEN p.us IS NOT NULL THEN (p.us, p.event_id) END) AS before FROM arrived a LEFT JOIN arrived p ON p.day_task = a.day_task AND p.file < a.file GROUP BY 1, 2, 3, 4) WHERE before IS NULL OR (us, event_id) > before)
    SELECT k.batch, k.dataset_id, count(*) AS total, count(*) FILTER (status IN ('pending', 'processing')) AS open, count(*) FILTER (status = 'completed') AS done,
        CASE WHEN count(*) FILTER (status IN ('pending', 'processing')) = 0 THEN 'completed' ELSE 'processing' END AS status, CASE WHEN count(*) FILTER (status IN ('pending', 'processing')) = 0 THEN count(*) FILTER (status = 'completed') || '/' || count(*) END AS success_rate
    FROM known k JOIN touched t ON t.file = k.file AND t.dataset_id = k.dataset_id GROUP BY k.batch, k.dataset_id""")
def x07(spark, d):
    from ..streaming.fold import completed_by_batch

    return completed_by_batch(spark, d).withColumn("batch", F.col("batch").cast("long"))


@query("x01_stream_task_fold", f"WITH {LATEST} SELECT task_id, event_id, status, attempts FROM latest")
def x01(spark, d):
    from ..streaming.fold import folded

    return folded(spark, d).select("task_id", "event_id", "status", "attempts")
