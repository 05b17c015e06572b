"""Scores of questions: blocks of zeros and ones, weights, critical criteria, and texts that hold scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of each block, its critical criteria by place, and thresholds and largest totals by question type.
WEIGHTS = {
    "c1_question": (0.5, 1, 1, 1, 1),
    "c2_outputs": (0.5, 1, 1, 1, 1, 1),
    "c2_options": (1, 0.5, 0.5, 1, 1, 1, 1, 1, 1),
    "c3_outputs": (1, 1),
    "c4_logic": (1, 1, 1, 1),
    "c5_phrase": (1, 1),
}
CRITICAL = {"c1_question": (1, 4), "c2_outputs": (1, 2), "c2_options": (3, 4, 7), "c3_outputs": (0, 1), "c4_logic": (), "c5_phrase": ()}
BLOCKS = {
    "open": ("c1_question", "c2_outputs", "c4_logic", "c5_phrase"),
    "one": ("c1_question", "c2_options", "c3_outputs", "c4_logic", "c5_phrase"),
    "multi": ("c1_question", "c2_options", "c3_outputs", "c4_logic", "c5_phrase"),
}
THRESHOLDS = {"open": 14.0, "one": 18.0, "multi": 18.0}
LARGEST = {"open": 16.0, "one": 20.5, "multi": 20.5}


def weighted_total(blocks: dict[str, Column], question_type: str) -> Column:
    """The weighted sum of all blocks' scores, times the product of the critical ones. Each block is an array of 0 and 1;
    a missing entry counts 0."""
    parts, critical = [], []
    for name in BLOCKS[question_type]:
        bits = blocks[name]
        parts += [F.coalesce(F.get(bits, F.lit(i)), F.lit(0)) * F.lit(float(w)) for i, w in enumerate(WEIGHTS[name])]
        critical += [F.coalesce(F.get(bits, F.lit(i)), F.lit(0)) for i in CRITICAL[name]]
    return reduce(lambda a, b: a + b, parts) * reduce(lambda a, b: F.least(a, b), critical, F.lit(1))


def parse_score_lines(text: Column, n: int) -> tuple[Column, Column]:
    """Scores and justifications of the first n lines that end in a 0 or 1, after which a dash and words may follow.

    Without such a line the digits 0 and 1 of the text that stand next to no other digit are taken. What is missing counts 0, without words.
    """
    pattern = r"([01])\s*(?:—\s*(.*))?$"
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s.rlike(pattern))
    digits = F.regexp_extract_all(text, F.lit(r"(?<!\d)([01])(?!\d)"))
    scores = F.when(F.size(lines) > 0, F.transform(lines, lambda s: F.regexp_extract(s, pattern, 1))).otherwise(digits)
    words = F.transform(lines, lambda s: F.regexp_extract(s, pattern, 2))
    padded = F.slice(F.concat(F.transform(scores, lambda s: s.cast("int")), F.array_repeat(F.lit(0), n)), 1, n)
    return padded, F.slice(F.concat(words, F.array_repeat(F.lit(""), n)), 1, n)


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def score_pair(text: Column) -> tuple[Column, Column]:
    """Total and largest total of `a/b`; both NULL unless there are exactly two numbers."""
    parts = F.split(text, "/")
    a, b = number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))
    good = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    return F.when(good, a), F.when(good, b)


def score_pair_or_largest(text: Column, question_type: Column) -> tuple[Column, Column]:
    """As score_pair; a missing largest total is that of the question type."""
    total, top = score_pair(text)
    return total, F.coalesce(top, F.when(question_type == "open", LARGEST["open"]).when(question_type.isin("one", "multi"), LARGEST["one"]))


def to_bool(text: Column) -> Column:
    """True, false, or NULL for any other word."""
    word = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(word.isin("true", "passed", "yes", "1"), True).when(word.isin("false", "failed", "no", "0"), False)


def is_passed(flag: Column, score: Column, threshold: Column) -> Column:
    """The flag if it says something, else whether the total reaches the threshold, else NULL."""
    total, _ = score_pair(score)
    return F.coalesce(to_bool(flag), total >= number(threshold))


def breakdown(blocks: Column) -> Column:
    """For a map of block to scores: map of block to `x/n`."""
    return F.transform_values(blocks, lambda _, s: F.concat_ws("/", F.aggregate(s, F.lit(0), lambda a, x: a + x).cast("string"), F.size(s).cast("string")))


def issues(block: Column, scores: Column, reasons: Column) -> Column:
    """Lines `- [block][i] score 0 — reason` of the zeros of a block, counted from 1."""
    numbered = F.transform(F.arrays_zip(scores.alias("s"), reasons.alias("r")), lambda x, i: F.struct(x["s"].alias("s"), x["r"].alias("r"), (i + 1).alias("i")))
    zeros = F.filter(numbered, lambda x: x["s"] == 0)
    return F.array_join(F.transform(zeros, lambda x: F.concat(F.lit("- ["), block, F.lit("]["), x["i"].cast("string"), F.lit("] score 0 — "), F.coalesce(x["r"], F.lit("")))), "\n")


def retries(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))
