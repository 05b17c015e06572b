"""Question records: options as maps and texts, flattening of generated ones, and shuffles that can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def real_options(options: Column) -> Column:
    """A map without the entries that are empty or say None."""
    return F.map_filter(options, lambda _, v: v.isNotNull() & (F.trim(v) != "") & (v != "None"))


def options_text(options: Column) -> Column:
    """Lines `k: v` in order of the keys."""
    entries = F.array_sort(F.map_entries(real_options(options)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def parse_options(text: Column) -> Column:
    """The map of lines `k: v`, cut at the first colon; lines without one and empty keys are passed over, later keys win."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s.rlike(r"^\s*[^:\s][^:]*:"))
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(s, r"^[^:]*:(.*)$", 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def numbered_list(options: Column) -> Column:
    """Lines `1. v` of the options in order of the keys; a dash if there are none."""
    entries = F.array_sort(F.map_entries(real_options(options)))
    lines = F.transform(entries, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["value"]))
    return F.when(F.size(lines) == 0, "—").otherwise(F.array_join(lines, "\n"))


def wide_options(rows: DataFrame, most: int = 9) -> Column:
    """The map 1..9 of the columns option_1 .. option_9 that say something."""
    parts = [F.struct(F.lit(str(i)).alias("key"), F.col(f"option_{i}").cast("string").alias("value")) for i in range(1, most + 1) if f"option_{i}" in rows.columns]
    return real_options(F.map_from_entries(F.array(*parts)))


def flatten(generated: DataFrame, question_type: Column) -> DataFrame:
    """Generated wide questions as records: options as a map, everything else as text."""
    return generated.select(
        "chunk_id", question_type.alias("question_type"), F.col("task").cast("string").alias("task"), wide_options(generated).alias("options"), F.col("outputs").cast("string").alias("correct_answer"),
    )


def shuffled(options: Column, correct: Column, key: Column, seed: int = 0) -> tuple[Column, Column]:
    """Options in the order of the MD5 of seed, key and place, and the places of the correct ones in it.

    options is an array of texts, correct the places, from 1 and joined by commas, of the right ones. As options are
    matched by text, equal texts are all right or all wrong.
    """
    keyed = F.transform(options, lambda v, i: F.struct(F.md5(F.concat_ws("/", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i"), v.alias("v")))
    order = F.transform(F.array_sort(keyed), lambda x: x["v"])
    right = F.transform(F.filter(F.split(correct, r"\s*,\s*"), lambda c: c.rlike(r"^\s*\d+\s*$")), lambda c: F.get(options, F.trim(c).cast("int") - 1))
    places = F.filter(F.transform(order, lambda v, i: F.when(F.array_contains(right, v), i + 1)), lambda p: p.isNotNull())
    return order, F.array_join(F.transform(places, lambda p: p.cast("string")), ",")


def output_json(rows: DataFrame, columns: list[str]) -> Column:
    """The final document of a question as JSON text."""
    return F.to_json(F.struct(*columns))


def by_chunk(questions: DataFrame) -> DataFrame:
    """Per chunk its questions as a list; a chunk has a question of each type, so that lists are short."""
    return questions.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("question_type", "task"))).alias("questions"))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, NULL if all hold."""
    return F.coalesce(*[F.when(~holds, F.lit(name)) for name, holds in checks])


def too_long(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, "exceed")
