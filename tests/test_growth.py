"""What holds on larger tables: results that do not hang on the order of rows, and what a task, a batch or a shuffle has to hold."""

import pandas as pd
from pyspark.sql import functions as F

from quizloom.operators import scorers as R
from quizloom.operators import versions as V
from quizloom.plans import catalogue
from quizloom.sources import files as D
from quizloom.streaming import fold as S

DIR = "/root/testdata/sf0.001"


def test_places_of_repeated_ids_are_fixed(spark):
    rows = [("d", 1, "b"), ("d", 1, "a"), ("d", 1, None), ("d", 0, "z")]
    for given in (rows, rows[::-1]):
        got = V.position_ids(spark.createDataFrame(given, "dataset string, question_id long, task string").coalesce(1), "dataset", "question_id").collect()
        assert [r["task"] for r in sorted(got, key=lambda r: r["question_id"])] == ["z", None, "a", "b"]
    many = spark.range(100_001).select(F.lit("d").alias("dataset"), F.col("id").alias("at"))
    assert V.position_ids(many, "dataset", "at").select("question_id").distinct().count() == 100_001


def plan_of(spark, name):
    return catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_models_are_distinct_before_they_are_compared(spark):
    assert plan_of(spark, "u03_models_added").count("Aggregate") == 2  # a row for each model of either side, on small tables joined by a broadcast


def test_characters_of_pages_are_never_rows(spark):
    for name in ("s03_superscript_digits", "f03_footnotes_at_words"):
        plan = plan_of(spark, name)
        assert "Window" not in plan and plan.count("Generate") == plan.count("posexplode(split(text"), plan
    chars = [("a b", 12.0, 12.0), ("1", 11.0, 6.0), ("2", 11.0, 6.0), ("x", 12.0, 12.0), ("3", 12.0, 12.0), ("y", 32.0, 12.0), ("4", 30.0, 6.0), (None, 32.0, 12.0)]
    rows = [(7, 0, n, c, 20.0 * (n > 4), bottom - 3.0 * (size < 12), size) for n, (c, bottom, size) in enumerate(chars)][::-1]
    found = D.superscript_runs(spark.createDataFrame(rows, "doc_id long, page long, n long, char string, top double, bottom double, size double"))
    assert sorted(map(tuple, found.collect())) == [(7, 0, 0, 2, "a b", "12"), (7, 0, 1, 2, "y", "4")]


def test_scorers_see_few_rows_at_a_time_and_share_a_worker(spark):
    def sized(batch):
        return [f"{{'level': {min(3, 1 + len(batch) // R.ASKED)}}}" if len(batch) <= R.ASKED else ValueError(f"{len(batch)} rows")] * len(batch)

    rows = spark.range(1500).coalesce(1).select(F.col("id").alias("doc_id"))
    found = R.assessed(rows, {"provocativeness": sized, "difficulty": lambda batch: ["3"] * len(batch)})
    assert found.columns == ["doc_id", "provocativeness", "provocativeness_error", "difficulty", "difficulty_error"]
    assert found.filter("provocativeness_error IS NOT NULL").count() == 0 and found.filter("difficulty_error = 'no level'").count() == 1500
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_nodes_of_a_document_go_to_python_as_one_row(spark):
    plan = catalogue.QUERIES["t12_outline_chunks"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_levels_of_trees_are_not_written_one_by_one(spark, monkeypatch):
    writes, plain = [], D.kept
    monkeypatch.setattr(D, "kept", lambda rows: writes.append(1) or plain(rows))
    deep = '{"level": 39, "title": "t39"}'
    for level in range(38, -1, -1):
        deep = f'{{"level": {level}, "title": "t{level}", "children": [{deep}, null]}}'
    trees = spark.createDataFrame([("a", deep), ("b", '{"title": "x", "children": [1, {"level": "2", "content": "c"}]}'), ("c", "{")], "path string, value string")
    found = {}
    for r in D.tree_nodes(trees).orderBy("id", "node_no").collect():
        found.setdefault(r["id"], []).append((r["node_no"], r["level"], r["title"], r["content"]))
    assert found["a"] == [(i, i, f"t{i}", "") for i in range(40)] + [(i, None, "", "") for i in range(40, 79)]
    assert found["b"] == [(0, None, "x", ""), (1, None, "", ""), (2, 2, "", "c")] and set(found) == {"a", "b"}
    assert len(writes) == 3


class Kept:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_tasks_of_a_group_share_a_state():
    counted = S.Openings()
    counted.known = Kept()
    frame = lambda *rows: pd.DataFrame(rows, columns=["dataset_id", "task_id", "at_us", "event_id", "status"])
    told = lambda *rows: sorted(map(tuple, next(counted.handleInputRows(None, iter([frame(*rows)]), None)).values.tolist()))
    assert told((1, 1, 5, 1, "pending"), (1, 2, 5, 2, "completed"), (2, 3, 5, 3, "failed"), (1, 1, 4, 0, "completed")) == [(1, 2, 1, 1), (2, 1, 0, 0)]
    assert told((1, 1, 9, 4, "completed"), (2, 3, 5, 3, "failed"), (2, 3, 1, 9, "pending")) == [(1, 0, -1, 1)]  # what is known or older changes nothing


def test_states_are_few_for_many_tasks(spark):
    assert S.in_groups(spark.range(5000), "id", 8).select("part").distinct().count() == 8
