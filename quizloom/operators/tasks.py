"""Queues and tasks: counts by status, progress, top-k, recovery and bulk updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The statuses of tasks.
STATUSES = ("pending", "processing", "completed", "failed", "cancelled")
#: Statuses of work that is not over.
ACTIVE = ("pending", "processing")
MAX_ATTEMPTS = 3


def by_status() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]


def status_counts(tasks: DataFrame, key: str = "queue_id") -> DataFrame:
    """Per key the tasks of each known status; task_count is their sum, other statuses are left out."""
    return tasks.groupBy(key).agg(*by_status()).withColumn("task_count", sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0])))


def recount(tasks: DataFrame, key: str = "queue_id") -> DataFrame:
    """As status_counts, but task_count is that of all tasks, whatever their status."""
    return tasks.groupBy(key).agg(F.count("*").alias("task_count"), *by_status())


def needs_recount(counts: DataFrame) -> DataFrame:
    """Flags the rows whose stored counters are missing or all zero."""
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in STATUSES), F.lit(0))
    return counts.withColumn("needs_recount", (F.coalesce("task_count", F.lit(0)) == 0) | (total == 0))


def status_totals(tasks: DataFrame) -> DataFrame:
    """(status, tasks) over all queues, a row for each known status."""
    totals = tasks.agg(*by_status())
    pairs = ", ".join(f"'{s}', {s}" for s in STATUSES)
    return totals.selectExpr(f"stack({len(STATUSES)}, {pairs}) AS (status, tasks)")


def progress_status() -> Column:
    """The state of a set of tasks from its counts; the first rule that holds decides."""
    open_tasks = F.col("pending") + F.col("processing")
    return (
        F.when(F.col("total") == 0, "no_tasks").when(open_tasks > 0, "in_progress").when((F.col("completed") > 0) & (F.col("failed") == 0), "completed")
        .when(F.col("failed") > 0, "completed_with_failures").otherwise("unknown")
    )


def task_progress(tasks: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Per key all counts, the state and the completed share in percent, one decimal, half up."""
    counts = tasks.groupBy(key).agg(F.count("*").alias("total"), *by_status())
    return counts.withColumns({"state": progress_status(), "progress_pct": F.round(100.0 * F.col("completed") / F.col("total"), 1)})


def pending_top(tasks: DataFrame, limit: int = 10) -> DataFrame:
    """The next tasks to run: highest priority first, then oldest, then smallest id."""
    return tasks.filter(F.col("status") == "pending").orderBy(F.desc("priority"), "created_at", "task_id").limit(limit)


def tasks_of(tasks: DataFrame, value: int, key: str = "queue_id", limit: int = 100) -> DataFrame:
    """A queue's first tasks by creation."""
    return tasks.filter(F.col(key) == value).orderBy("created_at", "task_id").limit(limit)


def latest(events: DataFrame, key: str = "task_id") -> DataFrame:
    """Folds a log of changes to the last row of each task, the larger event_id among equal times."""
    last = F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct("ts", "event_id"))
    return events.groupBy(key).agg(last.alias("last")).select(key, "last.*")


def stuck(tasks: DataFrame, now: Column, minutes: int = 15, updated: str = "ts") -> DataFrame:
    """Tasks in processing that were not touched for more than so many minutes before now."""
    return tasks.filter((F.col("status") == "processing") & (F.col(updated) < now - F.expr(f"INTERVAL {minutes} MINUTES")))


def recover(tasks: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """One more attempt for each stuck task: pending again, or failed for good when the attempts reach the most."""
    tried = F.coalesce("attempts", F.lit(0)) + 1
    over = tried >= most
    error = F.when(over, F.concat(F.lit("Force-failed after "), tried.cast("string"), F.lit(" attempts")))
    return tasks.withColumns({"status": F.when(over, "failed").otherwise("pending"), "attempts": tried, "error": error})


def reconciled(tasks: DataFrame, key: str = "dataset_id") -> DataFrame:
    """The datasets that have tasks, none of them open: status completed and the completed of all as `c/t`."""
    counts = tasks.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*ACTIVE)).alias("open"), F.count_if(F.col("status") == "completed").alias("done"))
    return counts.filter("open = 0").select(key, F.lit("completed").alias("status"), F.concat_ws("/", F.col("done").cast("string"), F.col("total").cast("string")).alias("success_rate"))


def retry_failed(tasks: DataFrame, queue: int | None = None) -> DataFrame:
    """All tasks; the failed ones, of one queue if given, are pending again without their error. Attempts stay."""
    again = F.col("status") == "failed"
    again = again if queue is None else again & (F.col("queue_id") == queue)
    return tasks.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "error": F.when(~again, F.col("error"))})


def reopened(datasets: DataFrame, tasks: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Datasets that own failed tasks go back to processing when these are retried."""
    owners = tasks.filter(F.col("status") == "failed").select(key).distinct().withColumn("__owner", F.lit(True))
    return datasets.join(owners, key, "left").withColumn("status", F.when(F.col("__owner"), "processing").otherwise(F.col("status"))).drop("__owner")


#: The changes of status that are allowed.
TRANSITIONS = ("pending>processing", "processing>completed", "processing>failed", "processing>pending", "failed>pending", "processing>processing")


def invalid_transitions(events: DataFrame) -> DataFrame:
    """Changes that no rule allows: (task_id, event_id, before, status)."""
    order = Window.partitionBy("task_id").orderBy("ts", "event_id")
    steps = events.withColumn("before", F.lag("status").over(order)).filter(F.col("before").isNotNull())
    return steps.filter(~F.concat_ws(">", "before", "status").isin(*TRANSITIONS)).select("task_id", "event_id", "before", "status")


def models_in_use(tasks: DataFrame, health: DataFrame, key: str = "queue_id") -> DataFrame:
    """Per key the distinct models of its tasks and how many of them are down; a model of unknown health counts as up."""
    used = tasks.select(key, F.explode(F.array("generation_model", "validation_model")).alias("model_id")).distinct()
    known = used.join(health, "model_id", "left")
    return known.groupBy(key).agg(F.count("*").alias("models"), F.count_if(~F.col("healthy")).alias("down"))


def task_rows(tasks: DataFrame, health: DataFrame) -> DataFrame:
    """Tasks as listed: models with a mark when down, the error cut at 100 characters and only for failed ones."""
    out = tasks
    for name in ("generation_model", "validation_model"):
        known = health.select(F.col("model_id").alias(name), F.col("healthy").alias(f"{name}_up"))
        label = F.concat(F.col(name).cast("string"), F.when(F.col(f"{name}_up"), "").otherwise(" ⚠"))
        out = out.join(known, name, "left").withColumn(f"{name}_label", F.when(F.col(f"{name}_up").isNull(), F.col(name).cast("string")).otherwise(label))
    cut = F.when(F.length("error") > 100, F.concat(F.substring("error", 1, 100), F.lit("..."))).otherwise(F.col("error"))
    return out.select("task_id", "status", "generation_model_label", "validation_model_label", F.when(F.col("status") == "failed", cut).alias("error_text"))


def has_active_work(counts: DataFrame) -> DataFrame:
    """One row: whether any queue has open tasks."""
    return counts.agg(F.coalesce(F.bool_or((F.col("pending") + F.col("processing")) > 0), F.lit(False)).alias("active"))


def active_generation(datasets: DataFrame, tasks: DataFrame, key: str = "dataset_id") -> DataFrame:
    """The datasets in processing that own an open task; the first by id is the active one."""
    return datasets.filter(F.col("status") == "processing").join(tasks.filter(F.col("status").isin(*ACTIVE)), key, "left_semi")


def enqueue(requests: DataFrame, now: Column) -> DataFrame:
    """New tasks with the defaults of what a request leaves open."""
    given = set(requests.columns)

    def default(name: str, value: Column) -> Column:
        return F.coalesce(F.col(name), value) if name in given else value

    return requests.withColumns({
        "status": F.lit("pending"), "priority": default("priority", F.lit(0)), "pipeline_mode": default("pipeline_mode", F.lit("full")),
        "chunk_pre_validated": default("chunk_pre_validated", F.lit(False)), "attempts": F.lit(0), "created_at": now, "updated_at": now,
    })


def new_queues(queues: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted queues whose name is not taken."""
    return wanted.dropDuplicates(["name"]).join(queues.select("name"), "name", "left_anti")


def cascade_delete(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The children whose parent is not among those that go."""
    return children.join(gone.select(key), key, "left_anti")
