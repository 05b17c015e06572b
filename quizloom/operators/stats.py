"""Statistics of datasets and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import is_passed, number, score_pair

#: Fixed labels.
TYPE_LABELS = {"open": "Open answer", "one": "Single choice", "multi": "Multiple choice"}
LEVEL_LABELS = {"1": "Low", "2": "Medium", "3": "High"}
DIFFICULTY_LABELS = {"1": "Easy", "2": "Medium", "3": "Hard"}


def labels(mapping: dict[str, str], column: Column, other: Column | None = None) -> Column:
    found = None
    for key, label in mapping.items():
        found = F.when(column == key, label) if found is None else found.when(column == key, label)
    return found if other is None else found.otherwise(other)


def parsed(questions: DataFrame) -> DataFrame:
    """Questions with score, largest score, threshold and the three-valued flag as typed columns."""
    total, top = score_pair(F.col("validation_score"))
    return questions.withColumns({
        "score": total, "top_score": top, "threshold": number(F.col("validation_threshold")),
        "passed": is_passed(F.col("validation_passed"), F.col("validation_score"), F.col("validation_threshold")),
    })


def rate(passed: str = "passed") -> Column:
    """Percent of the known flags that are true."""
    return F.round(100.0 * F.avg(F.col(passed).cast("int")), 6)


def expected(datasets: DataFrame, stored: bool = False) -> Column:
    """Questions to expect: chunks past the gate, or all chunks if none are known, times the types, one at least. With
    stored, a count written with the dataset comes first."""
    chunks = F.coalesce(F.nullif(F.col("chunks_passed_gate"), F.lit(0)), F.col("total_chunks"), F.lit(0))
    formula = F.when(chunks > 0, chunks * F.greatest(F.coalesce("question_types", F.lit(0)), F.lit(1))).otherwise(F.coalesce("total_questions", F.lit(0)))
    return F.coalesce(F.nullif(F.col("expected_questions"), F.lit(0)), formula) if stored else formula


def progress(status: Column, generated: Column, wanted: Column) -> Column:
    """Percent done, one decimal, at most 100; a completed dataset is done."""
    return F.when(status == "completed", 100.0).when(wanted > 0, F.least(F.round(100.0 * generated / wanted, 1), F.lit(100.0))).otherwise(0.0)


def dataset_stats(datasets: DataFrame, questions: DataFrame, stored: bool = False) -> DataFrame:
    """Per dataset: questions, rate of passed ones, expected questions, progress. One pass over the questions."""
    by = parsed(questions).groupBy("dataset_id").agg(F.count("*").alias("total_questions"), rate().alias("validation_rate"))
    found = datasets.join(by, "dataset_id", "left").withColumn("total_questions", F.coalesce("total_questions", F.lit(0)))
    found = found.withColumn("expected", expected(found, stored))
    return found.withColumn("progress_pct", progress(F.col("status"), F.col("total_questions"), F.col("expected")))


def overall(stats: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: datasets, questions, states, mean progress, and the rate over all questions (not the mean of rates)."""
    one = stats.agg(F.count("*").alias("datasets"), F.sum("total_questions").alias("questions"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "processing").alias("processing"), F.round(F.avg("progress_pct"), 6).alias("mean_progress"))
    return one.withColumn("validation_rate", parsed(questions).agg(rate().alias("r")).scalar())


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def type_distribution(questions: DataFrame) -> DataFrame:
    return questions.groupBy(labels(TYPE_LABELS, F.col("question_type"), F.lit("Unknown")).alias("label")).agg(F.count("*").alias("n"))


def level_distribution(questions: DataFrame, column: str, names: dict[str, str] = LEVEL_LABELS) -> DataFrame:
    """Counts over the fixed levels, 0 where there are none; other values are left out."""
    domain = questions.sparkSession.createDataFrame(list(names.items()), "level string, label string")
    counts = questions.groupBy(F.trim(column).alias("level")).agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, "level", "left").select("level", "label", F.coalesce("n", F.lit(0)).alias("n"))


def present_levels(questions: DataFrame, column: str, names: dict[str, str] = LEVEL_LABELS) -> DataFrame:
    """Labels that occur, blanks left out, with their place in the fixed order; unknown labels come after."""
    word = F.trim(column)
    order = list(dict.fromkeys(names.values()))
    label = labels(names, word, word)
    counts = questions.filter(word.isNotNull() & (word != "")).groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("label"))
    return counts.select("label", "n", F.when(place == 0, len(order) + 1).otherwise(place).cast("int").alias("place"))


def score_histogram(questions: DataFrame) -> DataFrame:
    return parsed(questions).filter("score IS NOT NULL").groupBy("score").agg(F.count("*").alias("n"))


def floor_histogram(questions: DataFrame) -> DataFrame:
    return parsed(questions).filter("score IS NOT NULL").groupBy(F.floor("score").alias("bucket")).agg(F.count("*").alias("n"))


def dense_histogram(questions: DataFrame) -> DataFrame:
    """Whole scores from the least to the largest, those that do not occur with 0."""
    counts = floor_histogram(questions)
    bins = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(F.explode(F.sequence("a", "b")).alias("bucket"))
    return bins.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def threshold_rates(questions: DataFrame) -> DataFrame:
    """Per threshold, written with one decimal: questions with a known flag, passed ones, rate."""
    known = parsed(questions).filter("threshold IS NOT NULL AND passed IS NOT NULL")
    return known.groupBy(F.format_number("threshold", 1).alias("threshold")).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), rate().alias("rate"))


def timeline(stats: DataFrame) -> DataFrame:
    """Per day of creation the datasets and their questions."""
    return stats.groupBy(F.col("created_on").cast("string").alias("day")).agg(F.count("*").alias("datasets"), F.sum("total_questions").alias("questions"))


def chunk_sizes(chunks: DataFrame, key: str, text: str = "chunk_text") -> DataFrame:
    """Sizes of chunks: number, least, largest, mean, median, counts by class."""
    n = F.length(text)
    return chunks.groupBy(key).agg(
        F.count("*").alias("chunks"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.round(F.avg(n), 6).alias("mean_len"), F.median(n).alias("median_len"),
        F.count_if(n < 500).alias("under_500"), F.count_if((n >= 500) & (n < 1000)).alias("under_1000"), F.count_if((n >= 1000) & (n < 2000)).alias("under_2000"), F.count_if(n >= 2000).alias("from_2000"),
    )


def by_count(counts: DataFrame, label: str = "label") -> DataFrame:
    """Categories by count, largest first, then by name."""
    return counts.orderBy(F.desc("n"), label)


def run_name(name: Column, mode: Column) -> Column:
    return F.concat_ws("__", name, mode)


def queue_name(number: Column, stamp: Column) -> Column:
    return F.format_string("queue_%d_%s", number, stamp)


def breakdown_lines(block: Column, scores: Column, reasons: Column) -> Column:
    """`block: x/n`, and for each score of 0 a line with its reason."""
    head = F.concat(block, F.lit(": "), F.aggregate(scores, F.lit(0), lambda a, x: a + x).cast("string"), F.lit("/"), F.size(scores).cast("string"))
    pairs = F.zip_with(scores, reasons, lambda s, r: F.when(s == 0, F.concat(F.lit("  - "), F.coalesce(r, F.lit("")))))
    return F.concat_ws("\n", head, F.nullif(F.array_join(F.array_compact(pairs), "\n"), F.lit("")))
