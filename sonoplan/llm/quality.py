"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree at a time on one feature's bins (then on a pair's grid of bins)
and adds its leaves to that feature's lookup table, so a text is scored by summing one table entry per
feature and per pair. Training happens on the driver from a bounded sample of labelled rows
(``max_rows``, default TRAIN_ROWS); scoring is one scalar Arrow function over the scan, without a shuffle.

Defined results: null and empty texts have all features 0 and get a score; null or unlabelled rows are
scored alike; repeated rows are scored each; labels that are null take no part; with no training
row the score is 0.5, with one class it is close to that class; other columns, whatever their names,
are never read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes

#: Most labelled rows that training collects; a bound on driver memory (about 15 doubles a row).
TRAIN_ROWS = 20_000
#: A document with a score from here on is predicted to be of quality 1.
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "symbols", "exclamations", "pipes", "upper", "digits", "stops", "mean_word", "distinct_words",
    "repeated_neighbours", "newlines", "repeated_lines", "top_word", "non_ascii", "log_words",
)


def _class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_UPPER = _class_table(bytes(range(65, 91)))
_LETTER = _UPPER + _class_table(bytes(range(97, 123)))
_DIGIT = _class_table(bytes(range(48, 58)))
_STOP = _class_table(b".,;:?")
_BANG = _class_table(b"!")
_PIPE = _class_table(b"|")
_SYMBOL = _class_table(b"#$%&*@^~<>{}[]=+_\\/")
_SPACE = _class_table(b" \t\n\r\x0b\x0c")
_NEWLINE = _class_table(b"\n")
_HIGH = np.zeros(256, np.int64)
_HIGH[128:] = 1


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, over the whole text."""
    raw, starts = text_bytes(column)
    out = np.zeros((len(starts) - 1, len(FEATURES)))
    for i, j in slices(starts):
        part = raw[starts[i] : starts[j]]
        at = starts[i : j + 1] - starts[i]
        n = np.diff(at)

        def count(kind: np.ndarray, part=part, at=at) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(kind[part])))
            return np.diff(total[at]).astype(float)

        letters = np.maximum(count(_LETTER), 1)
        solid = np.maximum(n - count(_SPACE), 1)
        lines = count(_NEWLINE)
        rows = np.zeros((j - i, len(FEATURES)))
        rows[:, 0] = np.log1p(n)
        rows[:, 1] = count(_SYMBOL) / solid
        rows[:, 2] = count(_BANG) / solid
        rows[:, 3] = count(_PIPE) / solid
        rows[:, 4] = count(_UPPER) / letters
        rows[:, 5] = count(_DIGIT) / solid
        rows[:, 6] = count(_STOP) / solid
        rows[:, 10] = lines / np.maximum(n, 1)
        rows[:, 13] = count(_HIGH) / solid
        whole = part.tobytes()
        for k in range(j - i):
            text = whole[at[k] : at[k + 1]]
            words = text.split()
            if not words:
                continue
            seen = Counter(words)
            n_words = len(words)
            rows[k, 7] = solid[k] / n_words
            rows[k, 8] = len(seen) / n_words
            rows[k, 9] = sum(map(eq, words, words[1:])) / n_words
            rows[k, 12] = max(seen.values()) / n_words
            rows[k, 14] = np.log1p(n_words)
            if lines[k]:
                split = [x for x in text.split(b"\n") if x.strip()]
                rows[k, 11] = 1 - len(set(split)) / max(len(split), 1)
        out[i:j] = rows
    return out


@dataclass
class Model:
    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: lookups and additions only."""
        s = np.full(len(x), self.intercept)
        for f, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            s += values[np.searchsorted(edge, x[:, f], side="right")]
        for (a, b), (ea, eb), values in zip(self.pairs, self.pair_edges, self.pair_tables, strict=True):
            s += values[np.searchsorted(ea, x[:, a], side="right"), np.searchsorted(eb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - g.sum() ** 2 / (h.sum() + lam)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, lam: float, leaves: int) -> np.ndarray:
    """Leaf values, spread over the bins, of a tree of so many leaves that is grown best first."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        best = max(((*_best_cut(g[a:b], h[a:b], lam), a, b) for a, b in runs), key=lambda t: t[0])
        if best[0] <= 1e-9:
            break
        _, k, a, b = best
        runs.remove((a, b))
        runs += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree of depth 2 on a pair's grid: one cut of a, then one of b on each side."""
    best, out = 0.0, np.zeros_like(g)
    whole = g.sum() ** 2 / (h.sum() + lam)
    gr, hr = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    for k in range(1, g.shape[0]):
        value, sides = -whole, []
        for gs, hs in ((gr[k - 1], hr[k - 1]), (gr[-1] - gr[k - 1], hr[-1] - hr[k - 1])):
            gain, cut = _best_cut(gs, hs, lam)
            value += gain + gs.sum() ** 2 / (hs.sum() + lam)
            sides.append((gs, hs, cut))
        if value > best:
            best = value
            out = np.zeros_like(g)
            for rows, (gs, hs, cut) in zip((slice(0, k), slice(k, None)), sides, strict=True):
                for cols in (slice(0, cut), slice(cut, None)):
                    if cut or cols.start:
                        out[rows, cols] = gs[cols].sum() / (hs[cols].sum() + lam)
                    else:
                        out[rows] = gs.sum() / (hs.sum() + lam)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, grid: int = 8, n_pairs: int = 6, pair_rounds: int = 40, leaves: int = 4, lam: float = 1.0) -> Model:
    """Cyclic boosting: main effects first, then the pairs whose grid trees gain most on what is left."""
    n_features = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if len(y) == 0:
        return Model([np.zeros(0)] * n_features, 0.0, [np.zeros(1)] * n_features)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model([_edges(x[:, f], bins) for f in range(n_features)], float(np.log(share / (1 - share))), [])
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    s = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f in range(n_features):
            p = 1 / (1 + np.exp(-s))
            n = len(model.tables[f])
            if n > 1:
                step = rate * _tree(np.bincount(at[f], y - p, n), np.bincount(at[f], p * (1 - p), n), lam, leaves)
                model.tables[f] += step
                s += step[at[f]]
    p = 1 / (1 + np.exp(-s))
    coarse = [_edges(x[:, f], grid) for f in range(n_features)]
    cell = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    shape = lambda a, b: (len(coarse[a]) + 1, len(coarse[b]) + 1)
    place = lambda a, b: cell[a] * shape(a, b)[1] + cell[b]

    def sums(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = shape(a, b)
        where = place(a, b)
        return np.bincount(where, y - p, rows * cols).reshape(rows, cols), np.bincount(where, p * (1 - p), rows * cols).reshape(rows, cols)

    gains = sorted(((_grid_tree(*sums(a, b, p), lam)[0], a, b) for a in range(n_features) for b in range(a + 1, n_features)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:n_pairs] if gain > 0]
    model.pair_edges = [(coarse[a], coarse[b]) for a, b in model.pairs]
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-s))
            step = rate * _grid_tree(*sums(a, b, p), lam)[1]
            model.pair_tables[k] += step
            s += step.ravel()[place(a, b)]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most max_rows labelled rows that are not held out, taken in the order of a hash of doc_id."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(max_rows)
        .withColumn("_of", F.monotonically_increasing_id())
    )
    of_text = _features_udf()
    rows = (
        docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
        .join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
        .select("_y", "_of", of_text("_text").alias("x"))
        .groupBy("_of", "_y")  # one row a label, so never more than max_rows; of several texts of its document the least by features
        .agg(F.min("x").alias("x"))
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y = (rows["_y"].to_numpy(dtype=float) > 0).astype(float) if len(rows) else np.zeros(0)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)  # the model does not depend on the order of arrival
    return fit(x[order], y[order])


def _features_udf():
    @F.arrow_udf("array<double>")
    def of_text(column: pa.Array) -> pa.Array:
        values = features(column)
        return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), values.ravel())

    return of_text


def score(model: Model, text: Column) -> Column:
    """Probability of quality 1 for each whole text."""

    @F.arrow_udf("double")
    def of_text(column: pa.Array) -> pa.Array:
        return pa.array(model.score(features(column)))

    return of_text(text)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model, F.col("text")).alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts to be of quality 1, unchanged."""
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(F.struct(*docs.columns).alias("row"), score(model, F.col("text")).alias("score"))
    return scored.where(F.col("score") >= THRESHOLD).select("row.*")
