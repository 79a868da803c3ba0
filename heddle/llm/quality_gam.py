"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins; boosting goes through the features in turn and adds a shallow tree over one
feature's bins to that feature's lookup table, then does the same over the grids of the strongest pairs.  A score is the
sum of one table entry per feature and per pair, looked up for whole columns at once.

The model is fitted on the driver, on at most max_rows labelled documents (the smallest hashes of their ids), which is a
parameter; features and scores cover all documents.  Defined results: null and blank texts have all features 0 and are
scored like others; a document without id counts as held out.  Labels that are null or of unknown documents are not
learned from; several labels of one document count by their mean; of several rows
with one id the one with the least features is learned from.  Without labels every score is 0.5.  Rows are scored
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import small_batches, stage

FEATURES = ["log_words", "word_length", "distinct_words", "same_neighbours", "upper", "digits", "symbols", "pipes", "shouts", "stops", "commas", "line_ends", "repeated_lines", "beyond_ascii", "shapes"]


def features(text: str | None) -> list[float]:
    w = text.split() if text else []
    if not w:
        return [0.0] * len(FEATURES)
    n, chars = len(w), len(text)
    bytes_ = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    count = lambda s: float(bytes_[list(s.encode())].sum())
    upper, lower = float(bytes_[65:91].sum()), float(bytes_[97:123].sum())
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(n)),
        (chars - n) / n,
        len(set(w)) / n,
        sum(map(eq, w, w[1:])) / n,
        upper / max(1.0, upper + lower),
        float(bytes_[48:58].sum()) / chars,
        count("#*$%&<>=@^~") / n,
        count("|") / n,
        count("!?") / n,
        count(".") / n,
        count(",") / n,
        count("\n") / n,
        1 - len(set(lines)) / len(lines),
        float(bytes_[128:192].sum()) / chars,
        sum(map(str.isalpha, w)) / n,
    ]


class AdditiveModel:
    """Lookup tables over binned features and pairs of them."""

    def __init__(self, n_bins: int = 24, rounds: int = 120, rate: float = 0.15, n_pairs: int = 6, pair_bins: int = 6, pair_rounds: int = 40):
        self.n_bins, self.rounds, self.rate, self.n_pairs, self.pair_bins, self.pair_rounds = n_bins, rounds, rate, n_pairs, pair_bins, pair_rounds

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        d = x.shape[1]
        q = np.linspace(0, 1, self.n_bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], q)) for j in range(d)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.pair_bins + 1)[1:-1])) for j in range(d)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        bins = self.bins(x, self.cuts)
        p = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for j in range(d):
                step = self.tree(bins[:, j], len(self.tables[j]), y, f)
                self.tables[j] += step
                f += step[bins[:, j]]
        # The pairs whose grids explain most of what is left.
        grid = self.bins(x, self.coarse)
        g, h = self.slopes(y, f)
        gain = []
        for a in range(d):
            for b in range(a + 1, d):
                cell, n = grid[:, a] * (len(self.coarse[b]) + 1) + grid[:, b], (len(self.coarse[a]) + 1) * (len(self.coarse[b]) + 1)
                gain.append((float((np.bincount(cell, g, n) ** 2 / (np.bincount(cell, h, n) + 5)).sum()), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(gain, reverse=True)[: self.n_pairs]]
        self.pair_tables = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)) for a, b in self.pairs]
        for _ in range(self.pair_rounds):
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                step = self.pair_tree(grid[:, a], grid[:, b], table.shape, y, f)
                table += step
                f += step[grid[:, a], grid[:, b]]
        return self

    @staticmethod
    def bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)

    @staticmethod
    def slopes(y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    @staticmethod
    def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Gain and place of the best cut of consecutive bins."""
        if len(g) < 2:
            return 0.0, 0
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + 5) + (g.sum() - a) ** 2 / (h.sum() - b + 5) - g.sum() ** 2 / (h.sum() + 5)
        i = int(np.argmax(gain))
        return float(gain[i]), i + 1

    def tree(self, bins: np.ndarray, n: int, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        """A tree of two levels over the bins, as steps of the table."""
        g, h = self.slopes(y, f)
        g, h = np.bincount(bins, g, n), np.bincount(bins, h, n)
        parts = [(0, n)]
        for _ in range(2):
            parts, whole = [], parts
            for a, b in whole:
                c = self.best_cut(g[a:b], h[a:b])[1]
                parts.extend([(a, a + c), (a + c, b)] if c else [(a, b)])
        step = np.zeros(n)
        for a, b in parts:
            step[a:b] = self.rate * g[a:b].sum() / (h[a:b].sum() + 5)
        return step

    def pair_tree(self, a: np.ndarray, b: np.ndarray, shape: tuple[int, int], y: np.ndarray, f: np.ndarray) -> np.ndarray:
        """A tree of one cut of the first feature and, on each side, one of the second."""
        g, h = self.slopes(y, f)
        cell, n = a * shape[1] + b, shape[0] * shape[1]
        g, h = np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape)
        cut = self.best_cut(g.sum(axis=1), h.sum(axis=1))[1]
        step = np.zeros(shape)
        for rows in (slice(0, cut), slice(cut, shape[0])) if cut else (slice(0, shape[0]),):
            c = self.best_cut(g[rows].sum(axis=0), h[rows].sum(axis=0))[1]
            for cols in (slice(0, c), slice(c, shape[1])) if c else (slice(0, shape[1]),):
                step[rows, cols] = self.rate * g[rows, cols].sum() / (h[rows, cols].sum() + 5)
        return step

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        bins, grid = self.bins(x, self.cuts), self.bins(x, self.coarse)
        f = self.intercept + sum(t[bins[:, j]] for j, t in enumerate(self.tables))
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            f = f + t[grid[:, a], grid[:, b]]
        return 1 / (1 + np.exp(-f))


def feature_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and the features (array<double>) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], names=["id", "x"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, x array<double>")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, folds: int = 5, max_rows: int = 20_000) -> DataFrame:
    """id_col, held_out, score, predicted for every row of docs; learns from labels whose crc32(id) mod folds is not 0."""
    rows = stage(feature_rows(docs, id_col, text), "gam-features")
    fold = F.coalesce(F.crc32(F.col("id").cast("string")) % folds, F.lit(0))
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("double").alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y"))
    learn = rows.filter(fold != 0).join(known, "id").groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    n = learn.count()
    if n > max_rows:  # a hash lets through a few more than the bound, whatever the number of tasks
        learn = learn.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 1.1 * max_rows / n + 1e-3)))
    learn = learn.orderBy(F.xxhash64("id"), "id").limit(max_rows).select("x", "y").toPandas()
    model = AdditiveModel().fit(np.array(learn["x"].tolist()), (learn["y"].to_numpy() >= 0.5).astype(float)) if len(learn) else None
    # The model (tables of a few hundred entries) travels with the function.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    out = rows.select("id", (fold == 0).alias("held_out"), "x").mapInArrow(run, "id bigint, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
