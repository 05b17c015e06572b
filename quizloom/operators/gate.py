"""The chunk gate: parsing of answers, decisions, summaries and the plan of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CRITERIA = ("c1_chunk_informative", "c2_chunk_reference_clarity", "c3_chunk_multi_suitability")
REASONS = ("chunk_not_informative", "chunk_not_self_contained", "chunk_not_suitable_for_multi")
NOT_SELECTED = "not_selected_for_generation"


def rejection_reason(c1: Column, c2: Column, c3: Column, question_type: Column) -> Column:
    """NULL for a chunk that passes; the third score counts for questions of several answers only."""
    return F.when(c1 != 1, REASONS[0]).when(c2 != 1, REASONS[1]).when((question_type == "multi") & (c3 != 1), REASONS[2])


def allowed_types(c1: Column, c2: Column, c3: Column, types: Column) -> Column:
    """Of the types asked for, in their order, those that the scores allow; none if the chunk itself fails."""
    kept = F.filter(types, lambda t: (t != "multi") | (c3 == 1))
    return F.when((c1 == 1) & (c2 == 1), kept).otherwise(F.array().cast("array<string>"))


def score(value: Column) -> Column:
    """A score as 0 or 1 from JSON text: a number, a boolean, a string, or a list, of which the first entry counts."""
    bare = F.lower(F.regexp_replace(value, r'^[\[\s"]+|[\]\s"].*$', ""))
    head = F.trim(F.split(bare, ",")[0])
    return F.when(head.isin("1", "1.0", "true"), 1).otherwise(0)


def parse_answer(raw: Column) -> Column:
    """The struct of an answer: fences around it go; it is read as JSON or as a literal of Python, first whole, then from its first to
    its last brace, and at last with single quotes made double ones. Scores become 0 or 1, a missing confidence 0, a missing
    reasoning the empty text. NULL if nothing parses."""
    opened = F.regexp_replace(T.strip(raw), r"^```(?:json)?\s*", "")
    cleaned = T.strip(F.regexp_replace(opened, r"\s*```$", ""))
    fields = ", ".join(f"{c} STRING, {c[:2]}_reasoning STRING, {c[:2]}_confidence STRING" for c in CRITERIA)

    def read(text: Column) -> Column:
        inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
        swapped = F.replace(inner, F.lit("'"), F.lit('"'))
        return F.coalesce(T.literal_python(text), T.literal_python(inner), F.when(F.try_parse_json(swapped).isNotNull(), swapped))

    def scored(got: Column) -> Column:
        parts = []
        for c in CRITERIA:
            parts += [
                score(F.coalesce(got[c], F.lit("0"))).alias(c),
                F.coalesce(got[f"{c[:2]}_reasoning"], F.lit("")).alias(f"{c[:2]}_reasoning"),
                F.coalesce(F.expr("1.0D") * got[f"{c[:2]}_confidence"].try_cast("double"), F.lit(0.0)).alias(f"{c[:2]}_confidence"),
            ]
        return F.when(got.isNotNull(), F.struct(*parts))

    json = T.bound(cleaned, read)
    return T.bound(F.when(json.startswith("{"), F.from_json(json, fields, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})), scored)


def decide(chunks: DataFrame, question_type: str) -> DataFrame:
    reason = rejection_reason(F.col("c1"), F.col("c2"), F.col("c3"), F.lit(question_type))
    return chunks.withColumns({"passed": reason.isNull(), "rejection_reason": reason})


def rejection_summary(decided: DataFrame) -> DataFrame:
    """(reason, chunks) of those that do not pass; a missing reason is `unknown`."""
    return decided.filter(~F.col("passed")).groupBy(F.coalesce("rejection_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("chunks"))


def summary_text(summary: DataFrame) -> DataFrame:
    """One row: `reason: n` in order of the reasons, joined by commas. The reasons are few by definition."""
    entries = F.array_sort(F.collect_list(F.struct("reason", "chunks")))
    return summary.agg(F.array_join(F.transform(entries, lambda e: F.concat(e["reason"], F.lit(": "), e["chunks"].cast("string"))), ", ").alias("summary"))


def plan_tasks(chunks: DataFrame, types: list[str]) -> DataFrame:
    """A task for each chunk and type that it allows."""
    found = chunks.withColumn("types_ok", allowed_types(F.col("c1"), F.col("c2"), F.col("c3"), F.array(*map(F.lit, types))))
    return found.select("dataset_id", "chunk_id", F.explode("types_ok").alias("question_type"))


def planned_counts(chunks: DataFrame, types: list[str]) -> DataFrame:
    """Per dataset the planned tasks and the chunks that pass or are rejected."""
    n = F.size(allowed_types(F.col("c1"), F.col("c2"), F.col("c3"), F.array(*map(F.lit, types))))
    return chunks.groupBy("dataset_id").agg(F.sum(n).alias("planned"), F.count_if(n > 0).alias("passed"), F.count_if(n == 0).alias("rejected"))


def audit(extracted: DataFrame, valid: DataFrame, gate: DataFrame) -> DataFrame:
    """All extracted chunks with their gate result: passed if valid, else the reason, by default that they were not selected."""
    chosen = valid.select("chunk_id", F.lit(True).alias("__valid"))
    found = extracted.join(chosen, "chunk_id", "left").join(gate.select("chunk_id", "rejection_reason"), "chunk_id", "left")
    passed = F.coalesce("__valid", F.lit(False))
    reason = F.when(~passed, F.coalesce("rejection_reason", F.lit(NOT_SELECTED)))
    return found.select(*extracted.columns, passed.alias("gate_passed"), reason.alias("reason"))


def modes(mode: Column) -> tuple[Column, Column]:
    """Whether a pipeline mode has the gate, and the refinement; an unknown mode is an error."""
    known = F.coalesce(F.lower(F.trim(mode)), F.lit("full"))
    checked = F.when(known.isin("generator_validator", "generator_validator_gate", "full"), known).otherwise(F.raise_error(F.concat(F.lit("unknown pipeline mode: "), known)))
    return checked != "generator_validator", checked == "full"
