"""Scorers, where a language model would be called, and the bounded loop of validation and refinement.

A scorer is a function from a batch of rows to as many texts. It runs within mapInArrow, so that Spark deals the calls
out; what comes back is text, and everything about it is parsed and decided by column expressions.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sinks.shared import kept
from . import scoring as P

Scorer = Callable[[pd.DataFrame], list]

MAX_RETRIES = 2
#: Rows that a scorer is asked for at a time; only so many are ever objects of Python.
ASKED = 256


class TimeoutInScorer(Exception):
    """The only failure after which a scorer is asked again."""


def asked(batch: pd.DataFrame, scorer: Scorer, retries: int) -> tuple[list, list, list]:
    """Per row a scorer's answer or None, what went wrong, and how often it was asked. Rows that time out are asked again, alone; a
    scorer may give an exception for a row in place of an answer, and one that it raises counts for all rows it was asked for."""
    answers, errors, times = [None] * len(batch), [None] * len(batch), [0] * len(batch)
    todo = list(range(len(batch)))
    for _ in range(retries + 1):
        if not todo:
            break
        try:
            got = list(scorer(batch.iloc[todo]))
        except Exception as e:  # noqa: BLE001  any failure of a model is a value, not the job's
            got = [e] * len(todo)
        for at, said in zip(todo, got):
            times[at] += 1
            failed = isinstance(said, Exception)
            answers[at] = None if failed else said
            errors[at] = None if not failed else f"timeout: {said}" if isinstance(said, TimeoutInScorer) else str(said)
        todo = [at for at, said in zip(todo, got) if isinstance(said, TimeoutInScorer)]
    return answers, errors, times


def scored(rows: DataFrame, scorer: Scorer | dict[str, Scorer], column: str = "answer", retries: int = 2, attempts: str | None = None, apart: bool = False) -> DataFrame:
    """Rows with the scorer's text in a column and, where it failed for good, its words in `error`; with `attempts` also how often a
    row was asked about. Several scorers, by their columns, are asked one after the other for each batch, in one pass, by one Python worker;
    the first error counts, or `<column>_error` has each one's if they are to be kept apart."""
    scorers = scorer if isinstance(scorer, dict) else {column: scorer}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ASKED):
                part = whole.slice(first, ASKED)
                batch, made, errors, times = part.to_pandas(), {}, [None] * part.num_rows, [0] * part.num_rows
                for name, one in scorers.items():
                    answers, wrong, calls = asked(batch, one, retries)
                    made[name] = pa.array([a if a is None else str(a) for a in answers], pa.string())
                    if apart:
                        made[f"{name}_error"] = pa.array(wrong, pa.string())
                    errors = [a if a is not None else b for a, b in zip(errors, wrong)]
                    times = [a + b for a, b in zip(times, calls)]
                made = dict(zip(part.schema.names, part.columns)) | made | {"error": pa.array(errors, pa.string())} | ({attempts: pa.array(times, pa.int32())} if attempts else {})
                yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    counted = f", `{attempts}` int" if attempts else ""
    return rows.mapInArrow(run, f"{kinds}, {', '.join(f'`{c}` string' for one in scorers for c in ((one, f'{one}_error') if apart else (one,)))}, error string{counted}")


def stub_validation(block: str, n: int, salt: int = 0) -> Scorer:
    """A deterministic stand-in: lines of scores by a checksum of id, block and attempt."""

    def run(batch: pd.DataFrame) -> list[str]:
        out = []
        for doc_id, attempt in zip(batch["doc_id"], batch["retry_count"]):
            seed = zlib.crc32(f"{doc_id}/{block}/{attempt}/{salt}".encode())
            out.append("\n".join(f"{int((seed >> i) % 8 != 0)} — {block} {i + 1}" for i in range(n)))
        return out

    return run


#: The assessments of a question and the least and largest level of each.
LEVELS = {"provocativeness": (1, 3), "difficulty": (1, 3)}


def stub_level(column: str) -> Scorer:
    """A deterministic stand-in: the answer of a model that assesses a question, by a checksum of its id."""

    def run(batch: pd.DataFrame) -> list[str]:
        return [json.dumps({"level": zlib.crc32(f"{column}/{doc_id}".encode()) % 3 + 1, "why": "a stand-in"}) for doc_id in batch["doc_id"]]

    return run


def assessed(rows: DataFrame, scorers: dict[str, Scorer], bounds: dict[str, tuple[int, int]] = LEVELS) -> DataFrame:
    """Rows with a level for each scorer's column, from answers such as {"level": 2}, and what went wrong, in `<column>_error`: the
    scorer's failure, an answer without a whole number, or a level out of bounds, for each of which the level is NULL."""
    out = scored(rows, {f"__{column}": scorer for column, scorer in scorers.items()}, apart=True).drop("error")
    for column in scorers:
        low, high = bounds[column]
        error, level = F.col(f"__{column}_error"), F.get_json_object(T.literal_python(F.col(f"__{column}")), "$.level").try_cast("int")
        good = level.between(low, high)
        wrong = F.when(error.isNotNull(), error).when(level.isNull(), "no level").when(~good, F.concat(F.lit("level out of bounds: "), level.cast("string")))
        out = out.withColumns({column: F.when(good, level), f"{column}_error": wrong}).drop(f"__{column}", f"__{column}_error")
    return out


def validated(questions: DataFrame, question_type: str = "open", scorer=stub_validation) -> DataFrame:
    """One pass of validation: a call for each block, scores by line, the weighted total and whether it passes."""
    sizes = {name: len(P.WEIGHTS[name]) for name in P.BLOCKS[question_type]}
    out = scored(questions, {f"answer_{name}": scorer(name, n) for name, n in sizes.items()}).drop("error")
    blocks = {name: P.parse_score_lines(F.col(f"answer_{name}"), n)[0] for name, n in sizes.items()}
    out = out.withColumn("total", P.weighted_total(blocks, question_type))
    return out.withColumn("passed", F.col("total") >= P.THRESHOLDS[question_type]).drop(*[f"answer_{b}" for b in blocks])


def validate_and_refine(questions: DataFrame, question_type: str = "open", mode: str = "full", scorer=stub_validation, levels: dict[str, Scorer] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Validates all, then refines and validates again those that fail, at most MAX_RETRIES times and in full mode only.

    Levels are assessed once, by a scorer for each, and not again after a refinement. Each pass is a filter, the scorers, and a union; what the
    scorers of a pass said is written, so that none is asked again for it, whatever becomes of the executors.
    Columns to carry go through, so that rows of one id stay apart.
    """
    todo = assessed(questions.withColumn("retry_count", F.lit(0)), levels or {name: stub_level(name) for name in LEVELS})
    columns = ["doc_id", "question_type", "retry_count", "provocativeness", "difficulty", "total", "passed", *carry]
    tried = kept(validated(todo, question_type, scorer))
    if mode != "full":
        return tried.select(*columns)
    done = tried.filter("passed")
    for attempt in range(1, MAX_RETRIES + 1):
        failed = tried.filter("NOT passed").drop("total", "passed").withColumn("retry_count", F.lit(attempt))
        tried = kept(validated(failed, question_type, scorer))
        done = done.unionByName(tried if attempt == MAX_RETRIES else tried.filter("passed"))
    return done.select(*columns)


def rephrased(questions: DataFrame, scorer: Scorer) -> DataFrame:
    """Tasks in other words; where the scorer fails, as they were."""
    return scored(questions, scorer, "__new").withColumn("task", F.coalesce("__new", "task")).drop("__new", "error")
