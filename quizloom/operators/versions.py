"""Versions of datasets: writing them as appended facts, edits, and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields that differences are told by.
FIELDS = ("task", "options", "correct_answer", "provocativeness", "difficulty", "question_type")


def position_ids(questions: DataFrame, dataset: str, order: str) -> DataFrame:
    """Ids `dataset:00000` by position, for questions that have none; the position is within the dataset. Rows of one place in the
    order stand by their other columns, so that all runs give the same; positions of more than five digits are written whole."""
    place = F.row_number().over(Window.partitionBy(dataset).orderBy(order, *[c for c in questions.columns if c not in (dataset, order)])) - 1
    return questions.withColumn("question_id", F.format_string("%s:%05d", F.col(dataset), place))


def differences(fields: list[str]) -> Column:
    """The names of the fields whose texts differ, NULL being equal to NULL only, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"old_{f}").cast("string").eqNullSafe(F.col(f"new_{f}").cast("string")), F.lit(f)) for f in fields])), ",")


def diff(old: DataFrame, new: DataFrame, key: str = "question_id") -> DataFrame:
    """Added, removed and changed rows by key; of changed ones the fields. A full outer join on the key."""
    fields = [f for f in FIELDS if f in old.columns and f in new.columns]
    a = old.select(key, F.lit(True).alias("__old"), *[F.col(f).alias(f"old_{f}") for f in fields])
    b = new.select(key, F.lit(True).alias("__new"), *[F.col(f).alias(f"new_{f}") for f in fields])
    found = a.join(b, key, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(differences(fields) != "", "changed")
    values = [c for f in fields for c in (f"old_{f}", f"new_{f}")]
    return found.select(key, change.alias("change"), F.when(F.col("__old") & F.col("__new"), differences(fields)).alias("fields"), *values).filter("change IS NOT NULL")


def diff_by_position(old: DataFrame, new: DataFrame, dataset: str, order: str = "question_id") -> DataFrame:
    """As diff, for versions without ids: rows of the same place within their dataset are compared."""
    a, b = (position_ids(v, dataset, order).withColumnRenamed("question_id", "place") for v in (old, new))
    return diff(a, b, "place")


def new_version(headers: DataFrame, questions: DataFrame, dataset: str = "dataset_id") -> tuple[DataFrame, DataFrame]:
    """The questions as rows of the next version, and headers that point to it; versions written before stay as they are."""
    touched = questions.select(dataset).distinct()
    raised = headers.join(touched.withColumn("__touched", F.lit(1)), dataset, "left")
    after = raised.withColumn("current_version", F.col("current_version") + F.coalesce("__touched", F.lit(0))).drop("__touched")
    return questions.join(headers.select(dataset, (F.col("current_version") + 1).alias("version")), dataset), after


def append_current(headers: DataFrame, questions: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """The questions as rows of their dataset's current version; counts are derived, never stored."""
    return questions.join(headers.select(dataset, F.col("current_version").alias("version")), dataset)


def merge_metadata(old: Column, patch: Column) -> Column:
    """A shallow merge of maps: entries of the patch win."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.when(patch.isNull(), old).when(old.isNull(), patch).otherwise(F.map_concat(kept, patch))


def replace_by_key(stored: DataFrame, new: DataFrame, key: str = "dataset_id") -> DataFrame:
    """All stored rows of the keys that occur among the new ones are replaced by these."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def overlay(base: DataFrame, edits: DataFrame, key: str = "question_id") -> DataFrame:
    """Rows with the fields of an edit where there is one for the row; NULL in an edit means not edited."""
    fields = [c for c in edits.columns if c != key]
    found = base.join(edits.select(key, *[F.col(c).alias(f"__{c}") for c in fields]), key, "left")
    return found.withColumns({c: F.coalesce(f"__{c}", c) for c in fields}).select(*base.columns)


def real_edits(base: DataFrame, edits: DataFrame, key: str = "question_id") -> DataFrame:
    """The edits in which some field differs, as text, from the row's."""
    fields = [c for c in edits.columns if c != key]
    same = base.select(key, *[F.col(c).cast("string").alias(f"__{c}") for c in fields])
    differs = None
    for c in fields:
        one = ~F.col(c).cast("string").eqNullSafe(F.col(f"__{c}"))
        differs = one if differs is None else differs | one
    return edits.join(same, key).filter(differs).select(*edits.columns)


def normalised_for_save(questions: DataFrame, editor: str, now: Column, version: Column) -> DataFrame:
    """Scalars as text, a blank difficulty as NULL, the level from its older name, and who edited what and when."""
    def text(c):
        return F.col(c).cast("string")

    level = F.coalesce(text("sensitivity_level"), text("provocativeness")) if "sensitivity_level" in questions.columns else text("provocativeness")
    return questions.withColumns({
        "task": text("task"), "correct_answer": text("correct_answer"), "difficulty": F.nullif(F.trim(text("difficulty")), F.lit("")),
        "provocativeness": level, "edited_by": F.lit(editor), "edited_at": now, "source_version": version,
    })


def requested(headers: DataFrame, versions: DataFrame, version: int | None = None) -> DataFrame:
    """The rows of the version asked for, or of each dataset's current one."""
    wanted = headers.select("dataset_id", (F.lit(version) if version is not None else F.col("current_version")).alias("version"))
    return versions.join(wanted, ["dataset_id", "version"])
