"""The graph of a chunk's way to a question: gate, generation, levels, validation and refinement, as stages over rows.

Filters stand between the stages as materialised columns, so that no scorer is called for a row that an earlier stage
has ended: a rejected chunk ends without a question, a failed generation with its error.
"""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import kept
from . import gate as G
from . import scorers as R
from .questions import wide_options

#: Fixed instructions for the language of a question.
INSTRUCTIONS = {"ru": "Write the question in Russian.", "be": "Write the question in Belarusian.", "tg": "Write the question in Tajik."}


def language_instruction(language: Column) -> Column:
    found = None
    for code, words in INSTRUCTIONS.items():
        found = F.when(language == code, words) if found is None else found.when(language == code, words)
    return found.otherwise(INSTRUCTIONS["ru"])


def stub_gate(batch: pd.DataFrame) -> list[str]:
    """A deterministic stand-in: a fenced answer by the text's checksum."""
    out = []
    for text in batch["text"].fillna(""):
        seed = zlib.crc32(text.encode())
        bits = [int(seed % k != 0) for k in (5, 7, 3)]
        out.append("```json\n" + json.dumps({c: [b] for c, b in zip(G.CRITERIA, bits)} | {"c1_reasoning": "by checksum", "c1_confidence": 0.5}) + "\n```")
    return out


def stub_question(batch: pd.DataFrame) -> list[str]:
    out = []
    for doc_id, kind in zip(batch["doc_id"], batch["question_type"]):
        options = {} if kind == "open" else {f"option_{i}": f"answer {i}" for i in range(1, 5)} | {"option_5": "None"}
        out.append(json.dumps({"task": f"What follows from {doc_id}?", "outputs": "1" if kind == "one" else "1,3" if kind == "multi" else "a text"} | options))
    return out


def gated(rows: DataFrame, scorer: R.Scorer = stub_gate) -> DataFrame:
    """Rows with passed and reason; an answer that does not parse rejects the chunk."""
    found = R.scored(rows, scorer, "__answer").withColumn("__gate", G.parse_answer(F.col("__answer")))
    c1, c2, c3 = (F.coalesce(F.col(f"__gate.{c}"), F.lit(0)) for c in G.CRITERIA)
    reason = F.when(F.col("__gate").isNull(), "unparsable_answer").otherwise(G.rejection_reason(c1, c2, c3, F.col("question_type")))
    return found.withColumns({"reason": reason, "gate_passed": reason.isNull()}).drop("__answer", "__gate", "error")


def generated(rows: DataFrame, scorer: R.Scorer = stub_question) -> DataFrame:
    """Rows with task, options as a map, and the correct answer; what fails has an error and no task."""
    names = ["task", "outputs", *[f"option_{i}" for i in range(1, 10)]]
    found = R.scored(rows, scorer, "__answer")
    found = found.withColumn("__q", F.from_json("__answer", ", ".join(f"{n} string" for n in names)))
    wide = found.select(*rows.columns, "error", *[F.col(f"__q.{n}").alias(n) for n in names])
    error = F.when(F.col("task").isNull(), F.coalesce("error", F.lit("unparsable answer")))
    return wide.select(*rows.columns, "task", wide_options(wide).alias("options"), F.col("outputs").alias("correct_answer"), error.alias("error"))


def assistant(chunks: DataFrame, types: list[str], mode: str = "full", gate: R.Scorer = stub_gate, generate: R.Scorer = stub_question, validate=R.stub_validation) -> DataFrame:
    """A row for each chunk and type: rejected ones with the reason, others with the question, its levels and its validation.

    chunks has doc_id and text. The mode tells whether there is a gate and whether failed questions are refined.
    """
    rows = chunks.select("doc_id", "text", F.explode(F.array(*map(F.lit, types))).alias("question_type"))
    if mode == "generator_validator":
        judged = rows.withColumns({"reason": F.lit(None).cast("string"), "gate_passed": F.lit(True)})
    elif mode in ("generator_validator_gate", "full"):
        judged = kept(gated(rows, gate))
    else:
        raise ValueError(f"unknown pipeline mode: {mode}")
    rejected = judged.filter("NOT gate_passed").select("doc_id", "question_type", F.lit("rejected").alias("outcome"), F.col("reason").alias("detail"))
    made = kept(generated(judged.filter("gate_passed").select("doc_id", "text", "question_type"), generate))
    failed = made.filter("error IS NOT NULL").select("doc_id", "question_type", F.lit("failed").alias("outcome"), F.col("error").alias("detail"))
    out = rejected.unionByName(failed).withColumns({"task": F.lit(None).cast("string"), "total": F.lit(None).cast("double"), "passed": F.lit(None).cast("boolean"), "retry_count": F.lit(None).cast("int")})
    for kind in types:
        good = made.filter((F.col("question_type") == kind) & F.col("error").isNull())
        scored = R.validate_and_refine(good.select("doc_id", "text", "question_type", "task"), kind, mode, validate, carry=("task",))
        done = scored.select("doc_id", "question_type", F.lit("question").alias("outcome"), F.lit(None).cast("string").alias("detail"), "task", "total", "passed", "retry_count")
        out = out.unionByName(done)
    return out


def document_types(titles: DataFrame, scorer: R.Scorer | None = None) -> DataFrame:
    """(doc_id, type, confidence) from a document's first titles; without a scorer, or where its answer does not parse, unknown."""
    if scorer is None:
        return titles.select("doc_id", F.lit("unknown").alias("type"), F.lit(0.0).alias("confidence"))
    from ..functions.text import salvage_json

    found = R.scored(titles, scorer, "__answer").withColumn("__t", F.from_json(salvage_json(F.col("__answer")), "type string, confidence double"))
    return found.select("doc_id", F.coalesce("__t.type", F.lit("unknown")).alias("type"), F.coalesce("__t.confidence", F.lit(0.0)).alias("confidence"))
