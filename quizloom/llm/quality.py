"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .labelled import labelled_sample

#: Labelled rows of each label that the model is fitted on, at most.
FIT_ROWS = {0: 8000, 1: 8000}
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 60, 0.1, 5.0

FEATURES = (
    "log_bytes log_words word_length upper digits symbols other_bytes spaces lines_log repeated_lines distinct_words follows_itself top_word "
    "line_upper_max line_symbols_max line_digits_max bad_line_share line_length_max stops commas short_words long_words".split()
)

#: Kinds of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 symbol, 5 white space.
KIND = np.zeros(256, np.int64)
for _kind, _bytes in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"), (5, b" \t\n\r\x0b\x0c")):
    KIND[list(_bytes)] = _kind


def features(text: str | None) -> np.ndarray:
    """What the whole text looks like; an empty text or NULL has zeros."""
    out = np.zeros(len(FEATURES), np.float32)
    words = (text or "").split()
    if not words:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = KIND[data]
    count = np.bincount(kinds, minlength=6)
    n, letters = len(data), max(1, count[1] + count[2] + count[0])
    tally: dict[str, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    lines = [x for x in text.split("\n") if x]
    breaks = np.flatnonzero(data == 10)
    starts = np.append(0, breaks + 1)
    starts = starts[starts < n]
    sizes = np.diff(np.append(starts, n))
    by_line = np.stack([np.add.reduceat((kinds == k).astype(np.int32), starts) for k in (0, 1, 2, 3, 4)]).astype(float)
    real = sizes >= 20
    if not real.any():
        real = sizes >= 0
    upper = by_line[2] / np.maximum(1, by_line[:3].sum(axis=0))
    symbols, digits = by_line[4] / np.maximum(1, sizes), by_line[3] / np.maximum(1, sizes)
    bad = real & ((upper > 0.5) | (symbols > 0.12))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[:] = (
        np.log1p(n), np.log1p(len(words)), lengths.mean(), count[2] / letters, count[3] / n, count[4] / n, count[0] / n, count[5] / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), len(tally) / len(words), sum(map(eq, words, words[1:])) / len(words), max(tally.values()) / len(words),
        upper[real].max(), symbols[real].max(), digits[real].max(), sizes[bad].sum() / n, np.log1p(sizes.max()),
        text.count(".") / len(words), text.count(",") / len(words), (lengths <= 2).mean(), (lengths >= 15).mean(),
    )
    return out


@dataclass
class Gam:
    """Lookup tables: of each feature, and of some pairs of features on coarser bins. A score is a sum of entries."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for column, edges, table in zip(x.T, self.edges, self.tables):
            total += table[np.searchsorted(edges, column, side="right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def quantile_edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of a run of bins, and its place."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A regression tree of a few leaves over ordered bins, written out as a table."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(cuts)
        if gain <= 0 or at == 0:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    table = np.zeros(len(g))
    for a, b in parts:
        table[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return table


def shallow_pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut along one feature, then the best one along the other on either side; its gain and its table."""
    best = (-1.0, np.zeros(g.shape))
    for turn in (False, True):
        gt, ht = (g.T, h.T) if turn else (g, h)
        gain, at = best_cut(gt.sum(axis=1), ht.sum(axis=1))
        table = np.zeros(gt.shape)
        for rows in (slice(0, at), slice(at, None)):
            gs, hs = gt[rows].sum(axis=0), ht[rows].sum(axis=0)
            more, cut_at = best_cut(gs, hs)
            gain += more
            for columns in (slice(0, cut_at), slice(cut_at, None)):
                table[rows, columns] = gs[columns].sum() / (hs[columns].sum() + RIDGE)
        if gain > best[0]:
            best = gain, table.T if turn else table
    return best


def fit_gam(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> Gam:
    """Cyclic boosting: round by round, each feature in turn gets one shallow tree at a small rate; then, on what is left,
    the pairs whose trees gain most do so. With one label only, or none, the score is the share of label 1 (0.5 if none).
    The base is the log-odds of the weighted rows: trees are fitted on the rows as they are, and the difference of the
    two log-odds is added at the end, so that scores do not depend on how many rows of each label were sampled."""
    share = y.mean() if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return Gam(float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    model = Gam(float(np.log(share / (1 - share))))
    bins = []
    for column in x.T:
        model.edges.append(quantile_edges(column, BINS))
        model.pair_edges.append(quantile_edges(column, PAIR_BINS))
        model.tables.append(np.zeros(len(model.edges[-1]) + 1))
        bins.append(np.searchsorted(model.edges[-1], column, side="right"))
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, at in enumerate(bins):
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            size = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size))
            model.tables[j] += step
            total += step[at]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T)]
    shapes = [len(e) + 1 for e in model.pair_edges]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        at, size = coarse[i] * shapes[j] + coarse[j], shapes[i] * shapes[j]
        return np.bincount(at, y - p, size).reshape(shapes[i], shapes[j]), np.bincount(at, p * (1 - p), size).reshape(shapes[i], shapes[j])

    gains = [(shallow_pair_tree(*sums(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)]
    model.pairs = [(i, j, np.zeros((shapes[i], shapes[j]))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            step = RATE * shallow_pair_tree(*sums(i, j))[1]
            table += step
            total += step[coarse[i], coarse[j]]
    if weights is not None:
        true = np.average(y, weights=weights)
        model.base += float(np.log(true / (1 - true)) - np.log(share / (1 - share)))
    return model


@F.pandas_udf(ArrayType(FloatType()))
def feature_array(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """Fits the model on a bounded sample of labelled rows; their features, not their texts, are brought to the driver."""
    sample = labelled_sample(docs, labels, label_col, FIT_ROWS, rows, id_col, text_col)
    got = sample.select("id", "label", "weight", feature_array("text").alias("x")).toPandas().sort_values("id")
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit_gam(x.astype(np.float64), got["label"].to_numpy(float), got["weight"].to_numpy(float))


def quality_score(text: Column, model: Gam, spark) -> Column:
    """The score, 0 to 1, of each whole text. NULL and empty texts score as a text without any features. Equal texts, as in
    repeated rows, have equal scores; no other column, so no NULL id or clashing name, is looked at; texts of any length count whole."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(shared.value.score(np.stack([features(t) for t in texts]).astype(np.float64)))

    return score(text)


def keep_good(docs: DataFrame, model: Gam, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are and whatever their names, whose score is at least the threshold; repeated rows
    each stay or go, and no rows give no rows."""
    return docs.filter(quality_score(F.col(text_col), model, docs.sparkSession) >= threshold)
