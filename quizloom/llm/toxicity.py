"""Toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .labelled import labelled_sample

#: Labelled rows of each label that the log-odds are estimated on, at most.
FIT_ROWS = {0: 8000, 1: 4000}
THRESHOLD = 0.5
#: Weight of the prior, as a share of all tokens; least z-score, log-odds and contexts of a unit; forms that a stem must have.
PRIOR, LEAST_Z, LEAST_ODDS, LEAST_CONTEXTS, LEAST_FORMS = 0.05, 3.0, 1.5, 8, 3
STEMS = (4, 5, 6)
#: What a token outside the lexicon takes from a segment, and the usual constant of extreme values of segment scores.
DRIFT, K = 0.25, 0.1
#: A passage is significant if by chance a text of its length has one of such a score with no more than this probability.
SIGNIFICANT = 0.01

WORD = re.compile(r"\w+")


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    slope: float = 1.0
    offset: float = 0.0

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(position, log-odds) of the tokens that the lexicon holds, as a word or else by their longest stem."""
        own, stems = self.words, self.stems
        found = [i for i, w in enumerate(words) if w in own or w[:4] in stems or w[:5] in stems or w[:6] in stems]
        out = []
        for i in found:
            w = words[i]
            score = own.get(w)
            for n in sorted(STEMS, reverse=True):
                score = stems.get(w[:n]) if score is None and len(w) > n else score
            if score is not None:
                out.append((i, score))
        return out

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (first word, last word, score), by the linear-time scan: each hit's run begins at a
        cumulative score and reaches another; it joins the last run that begins lower, if that one reaches less far."""
        runs: list[tuple[int, int, float, float, int]] = []  # first, last, begins, reaches, the run before that begins lower
        total, after = 0.0, 0
        for i, score in self.hits(words):
            total -= DRIFT * (i - after)
            begins, total, after = total, total + score, i + 1
            first, reaches = i, total
            while True:
                j = len(runs) - 1
                while j >= 0 and runs[j][2] >= begins:
                    j = runs[j][4]
                if j < 0 or runs[j][3] >= reaches:
                    runs.append((first, i, begins, reaches, j))
                    break
                first, begins = runs[j][0], runs[j][2]
                del runs[j:]
        return [(a, b, reaches - begins) for a, b, begins, reaches, _ in runs]

    def normal(self, score: float, length: int) -> float:
        """A segment's score in units in which the largest of a text by chance has the standard extreme-value law."""
        return self.scale * score - math.log(max(K * length, 1.0))

    def statistic(self, text: str | None) -> float:
        """The largest normalised score, raised by what other significant segments have beyond the bound of significance; -5 without hits."""
        words = WORD.findall((text or "").lower())
        scores = sorted((self.normal(s, len(words)) for _, _, s in self.segments(words)), reverse=True)
        if not scores:
            return -5.0
        bound = -math.log(-math.log1p(-SIGNIFICANT))
        return min(max(scores[0] + sum(s - bound for s in scores[1:] if s > bound), -5.0), 30.0)

    def probability(self, statistic: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * statistic + self.offset, -30.0), 30.0)))

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """The significant passages: start and end in characters, score, and the probability of one by chance."""
        spans = [m.span() for m in WORD.finditer((text or "").lower())]
        words = [(text or "").lower()[a:b] for a, b in spans]
        found = [(spans[a][0], spans[b][1], s, -math.expm1(-math.exp(-self.normal(s, len(words))))) for a, b, s in self.segments(words)]
        return [x for x in found if x[3] <= SIGNIFICANT]


def contexts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct (word, word before, label, fold); copies and near copies of a text add few."""
    for batch in batches:
        seen = set()
        for text, label, fold in zip(batch["text"], batch["label"], batch["fold"]):
            words = WORD.findall(text.lower())
            seen.update((w, zlib.crc32(before.encode("utf-8", "surrogatepass")), label, fold) for before, w in zip(["", *words], words))
        yield pd.DataFrame(list(seen), columns=["word", "before", "label", "fold"])


def unit_counts(sample: DataFrame) -> DataFrame:
    """(word, t, c) and the same of each of two folds: the distinct words before it in toxic and in clean texts."""
    found = sample.select("text", "label", "fold").mapInPandas(contexts, "word string, before long, label int, fold int")
    each = found.groupBy("word", "before", "label").agg(F.max((F.col("fold") == 0).cast("int")).alias("in0"), F.max((F.col("fold") == 1).cast("int")).alias("in1"))
    sums = [F.sum(n * (F.col("label") if name[0] == "t" else 1 - F.col("label"))).alias(name) for name, n in (("t", F.lit(1)), ("c", F.lit(1)), ("t0", F.col("in0")), ("c0", F.col("in0")), ("t1", F.col("in1")), ("c1", F.col("in1")))]
    return cut(each.groupBy("word").agg(*sums))


def lexicon(counts: DataFrame, fold: str = "", most: int | None = None) -> list:
    """Units, words or stems (marked by an asterisk), whose log-odds between the labels, with a Dirichlet prior from both, stand out.

    A unit counts once for each distinct word before it, so that what is common to many copies of one toxic text does
    not stand out. All units that stand out in the bounded sample are taken, or the `most` that do so most.
    """
    counts = counts.select("word", F.col(f"t{fold}").alias("toxic"), F.col(f"c{fold}").alias("clean"))
    stems = F.transform(F.array(*map(F.lit, STEMS)), lambda n: F.when(F.length("word") > n, F.concat(F.substring(F.col("word"), F.lit(1), n), F.lit("*"))))
    units = counts.select(F.explode(F.array_append(F.array_compact(stems), F.col("word"))).alias("unit"), "toxic", "clean")
    units = units.groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.sum(F.signum(F.col("toxic") + F.col("clean"))).alias("forms"))
    nt, nc = map(F.lit, counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first())
    t, c = F.col("t"), F.col("c")
    prior, weight = F.lit(PRIOR) * (t + c), F.lit(PRIOR) * (nt + nc)
    odds = F.log((t + prior) / (nt + weight - t - prior)) - F.log((c + prior) / (nc + weight - c - prior))
    z = odds / F.sqrt(1 / (t + prior) + 1 / (c + prior))
    enough = (F.col("t") >= LEAST_CONTEXTS) & (~F.col("unit").endswith("*") | (F.col("forms") >= LEAST_FORMS))
    scored = units.filter(enough).select("unit", "t", "c", nc.alias("nc"), odds.alias("odds"), z.alias("z"))
    found = scored.filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "unit")
    return (found if most is None else found.limit(most)).collect()


def from_lexicon(found: list) -> ToxicityModel:
    model = ToxicityModel(slope=1.0, offset=-25.0)
    if found:
        model.words = {r["unit"]: r["odds"] for r in found if not r["unit"].endswith("*")}
        model.stems = {r["unit"][:-1]: r["odds"] for r in found if r["unit"].endswith("*")}
        frequency = (sum(r["c"] for r in found) + 0.5) / (found[0]["nc"] + 1.0)
        model.scale = extreme_value_scale(float(np.mean([r["odds"] for r in found])), min(frequency, 0.02))
    return model


def extreme_value_scale(odds: float, frequency: float) -> float:
    """The positive root of frequency * exp(scale * odds) + (1 - frequency) * exp(-scale * DRIFT) = 1."""
    low, high = 1e-9, 1.0
    value = lambda s: frequency * math.exp(min(s * odds, 600)) + (1 - frequency) * math.exp(-s * DRIFT) - 1
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, rows: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_units: int | None = None
) -> ToxicityModel:
    """Estimates the lexicon on a bounded sample of labelled rows. The calibration is fitted to statistics that each half of the
    sample gets from the other half's lexicon; only where a half has no lexicon of its own, the whole one stands in.

    Without toxic rows, or without units that stand out, every text scores the least.
    """
    fold = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2)).cast("int").alias("fold")
    sample = cut(labelled_sample(docs, labels, label_col, FIT_ROWS, rows, id_col, text_col).select("id", "text", "label", fold))
    counts = unit_counts(sample)
    found = lexicon(counts, most=most_units)
    model = from_lexicon(found)
    if not found:
        return model
    halves = [from_lexicon(lexicon(counts, str(f), most_units) or found) for f in (0, 1)]
    shared = sample.sparkSession.sparkContext.broadcast(halves)

    @F.pandas_udf("double")
    def statistics(texts: pd.Series, folds: pd.Series) -> pd.Series:
        return pd.Series([shared.value[1 - f].statistic(t) for t, f in zip(texts, folds)], dtype=float)

    got = sample.select("id", "label", statistics("text", "fold").alias("x")).toPandas().sort_values("id")
    model.slope, model.offset = logistic(got["x"].to_numpy(float), got["label"].to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both labels weighing alike, with a small penalty."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    design, theta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * len(y) * theta * (1e-2, 1e-4)
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge * len(y) * np.diag((1e-2, 1e-4))
        step = np.linalg.solve(hessian, gradient)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def toxicity_score(text: Column, model: ToxicityModel, spark) -> Column:
    """The calibrated score, 0 to 1, of each whole text; NULL and empty texts score as a text without any hit. Equal texts, as
    in repeated rows, have equal scores; no other column, so no NULL id or clashing name, is looked at; texts of any length count whole."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.probability(m.statistic(t)) for t in texts], dtype=float)

    return score(text)


def toxic_passages(text: Column, model: ToxicityModel, spark) -> Column:
    """The significant passages of each text, in order: start, end (code points), score and p_value; none of NULL."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,end:int,score:double,p_value:double>>")
    def passages(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "score": s, "p_value": p} for a, b, s, p in shared.value.passages(t)] for t in texts], dtype=object)

    return passages(text)


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are and whatever their names, whose score is below the threshold; repeated rows
    each stay or go, and no rows give no rows."""
    return docs.filter(toxicity_score(F.col(text_col), model, docs.sparkSession) < threshold)
