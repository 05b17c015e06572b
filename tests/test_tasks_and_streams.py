import datetime as dt

from pyspark.sql import functions as F

from quizloom.operators import tasks as O
from quizloom.streaming import fold


def test_recovery(spark):
    rows = spark.createDataFrame([("t1", 0), ("t2", 1), ("poison", 2)], "task_id string, attempts int").withColumns({"status": F.lit("processing"), "error": F.lit(None).cast("string")})
    got = {r["task_id"]: (r["status"], r["attempts"], r["error"]) for r in O.recover(rows).collect()}
    assert got["t1"] == ("pending", 1, None) and got["t2"] == ("pending", 2, None)
    assert got["poison"][:2] == ("failed", 3) and "Force-failed" in got["poison"][2]


def test_progress_states(spark):
    rows = [(1, "completed"), (1, "cancelled"), (2, "cancelled"), (3, "failed"), (3, "completed"), (4, "pending"), (4, "failed")]
    got = {r["dataset_id"]: (r["state"], r["progress_pct"]) for r in O.task_progress(spark.createDataFrame(rows, "dataset_id int, status string")).collect()}
    assert got == {1: ("completed", 50.0), 2: ("unknown", 0.0), 3: ("completed_with_failures", 50.0), 4: ("in_progress", 0.0)}


def test_defaults_of_new_tasks(spark):
    row = O.enqueue(spark.createDataFrame([(1, None), (2, "generator_validator")], "chunk int, pipeline_mode string"), F.current_timestamp()).orderBy("chunk").collect()
    assert [r["pipeline_mode"] for r in row] == ["full", "generator_validator"] and {r["status"] for r in row} == {"pending"}


def events(spark, rows, path):
    start = dt.datetime(2024, 1, 1)
    data = [(i, task, start + dt.timedelta(minutes=m), status) for i, (task, m, status) in enumerate(rows)]
    spark.createDataFrame(data, "event_id long, task_id long, ts timestamp, status string").coalesce(1).write.mode("append").parquet(path)


def collected(spark, stream, folder, mode="append"):
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    fold.run_to_end(stream, spark, folder, write, mode)
    return spark.read.parquet(f"{folder}/out")


def test_recovery_in_the_stream(spark, tmp_path):
    """A task without heartbeat comes back by the clock, three times and then no more; heartbeats and late events count by their own time."""
    path = f"{tmp_path}/events"
    events(spark, [(1, 0, "processing"), (2, 1, "processing"), (3, 0, "processing")], path)
    events(spark, [(2, 5, "completed"), (3, 10, "processing"), (3, 20, "processing"), (9, 22, "pending")], path)
    events(spark, [(3, 2, "processing"), (1, 30, "processing"), (9, 90, "pending")], path)
    events(spark, [(1, 61, "processing"), (9, 200, "pending")], path)
    events(spark, [(1, 100, "processing"), (9, 400, "pending")], path)
    got = collected(spark, fold.with_recovery(fold.event_stream(spark, path), late="30 minutes"), str(tmp_path)).filter("recovered").orderBy("task_id", "at").collect()
    start = dt.datetime(2024, 1, 1)
    told = [(r["task_id"], round((r["at"] - start).total_seconds() / 60), r["status"], r["attempts"]) for r in got]
    # the event of minute 100 comes when the watermark stands at 170 and is left out
    assert told == [(1, 15, "pending", 1), (1, 45, "pending", 2), (1, 76, "failed", 3), (3, 35, "pending", 1)]


def test_completion_goes_on_after_a_restart(spark, tmp_path):
    path, folder = f"{tmp_path}/events", str(tmp_path)

    def arrive(rows):
        start = dt.datetime(2024, 1, 1)
        data = [(i, task, dataset, start + dt.timedelta(minutes=m), status) for i, (task, dataset, m, status) in enumerate(rows)]
        spark.createDataFrame(data, "event_id long, task_id long, dataset_id long, ts timestamp, status string").coalesce(1).write.mode("append").parquet(path)

    def run():
        fold.run_to_end(fold.openings(fold.event_stream(spark, path)), spark, folder, fold.keep_counts(folder), "update")
        return {(r["batch"], r["dataset_id"]): (r["total"], r["open"], r["done"], r["success_rate"]) for r in fold.completions(spark, folder).collect()}

    arrive([(1, 7, 0, "processing"), (2, 7, 0, "pending"), (3, 8, 0, "failed")])
    first = run()
    assert first == {(0, 7): (2, 2, 0, None), (0, 8): (1, 0, 0, "0/1")}
    arrive([(1, 7, 5, "completed")])
    arrive([(2, 7, 9, "failed"), (1, 7, 1, "pending"), (3, 8, 4, "pending")])  # that of minute 1 is older than what is known
    assert run() == first | {(1, 7): (2, 1, 1, None), (2, 7): (2, 0, 1, "1/2"), (2, 8): (1, 1, 0, None)}
    assert run() == first | {(1, 7): (2, 1, 1, None), (2, 7): (2, 0, 1, "1/2"), (2, 8): (1, 1, 0, None)}


def test_completed_by_window(spark, tmp_path):
    path = f"{tmp_path}/events"
    events(spark, [(1, 0, "completed"), (2, 30, "completed"), (3, 2000, "completed")], path)
    stream = fold.generated_so_far(fold.event_stream(spark, path)).writeStream.format("memory").queryName("done").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert sorted(r["done"] for r in spark.table("done").collect()) == [1, 2]
