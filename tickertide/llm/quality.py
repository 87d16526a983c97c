"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickertide.llm.common import label_sample, remainder, word_slices

# The fit uses at most so many labelled documents; scoring and statistics cover all.
FIT_ROWS = 50_000
# Rows scored at once.
SOLVE_ROWS = 512
THRESHOLD = 0.7
# Kinds of bytes: other, lower case, upper case, digit, blank, line end, and single marks.
MARKS = "!|%*#$&.,?<>{}"
_KIND = np.zeros(256, dtype=np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[32, 9]], _KIND[[10, 13]] = 4, 5
for _i, _c in enumerate(MARKS):
    _KIND[ord(_c)] = 6 + _i
_KINDS = 6 + len(MARKS)
FEATURES = [
    "log_words",
    "log_word_bytes",
    "distinct_words",
    "top_word",
    "log_line_words",
    "distinct_lines",
    "upper",
    "digits",
    "non_ascii",
    "stops",
    "shouts",
    "bars",
    "symbols",
    "brackets",
]


def _most_and_distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Count of the most frequent value and number of distinct values of each row."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    most, distinct = np.zeros(rows), np.zeros(rows)
    if len(r):
        first = np.ones(len(r), dtype=bool)
        first[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(first)
        runs = np.diff(np.append(at, len(r)))
        np.maximum.at(most, r[at], runs)
        distinct += np.bincount(r[at], minlength=rows)
    return most, distinct


def document_statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for every text: logarithms of sizes, square roots of shares.

    Statistics are of the whole text.  A null or empty text has zero sizes and shares.
    """
    out = []
    for w in word_slices(texts):
        n_bytes = np.diff(w.offsets)
        owner = np.repeat(np.arange(w.rows), n_bytes)
        kinds = np.bincount(owner * _KINDS + _KIND[w.raw], minlength=w.rows * _KINDS)
        kinds = kinds.reshape(w.rows, _KINDS).astype(float)
        words = w.counts().astype(float)
        h = w.hashes()
        most, distinct = _most_and_distinct(w.doc, h, w.rows)
        # Lines: runs of words without a line end between them.
        ends = np.concatenate([[0], np.cumsum(_KIND[w.raw] == 5)])
        line = ends[w.starts]
        n_lines, lines_apart = np.zeros(w.rows), np.zeros(w.rows)
        if len(line):
            new = np.ones(len(line), dtype=bool)
            new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
            at = np.flatnonzero(new)
            spread = h * (np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h)))) + 1).astype(np.uint64)
            sums = np.add.reduceat(spread, at)
            n_lines = np.bincount(w.doc[at], minlength=w.rows).astype(float)
            _, lines_apart = _most_and_distinct(w.doc[at], sums, w.rows)
        letters = np.bincount(w.doc, weights=w.ends - w.starts, minlength=w.rows)
        size = np.maximum(n_bytes, 1)

        def share(*marks: str, kinds: np.ndarray = kinds, size: np.ndarray = size) -> np.ndarray:
            return np.sqrt(sum(kinds[:, 6 + MARKS.index(m)] for m in marks) / size)

        out.append(
            np.column_stack(
                [
                    np.log1p(words),
                    np.log1p(letters / np.maximum(words, 1)),
                    distinct / np.maximum(words, 1),
                    np.sqrt(most / np.maximum(words, 1)),
                    np.log1p(words / np.maximum(n_lines, 1)),
                    lines_apart / np.maximum(n_lines, 1),
                    np.sqrt(kinds[:, 2] / size),
                    np.sqrt(kinds[:, 3] / size),
                    np.sqrt((kinds[:, 0]) / size),
                    share(".", ",", "?"),
                    share("!"),
                    share("|"),
                    share("%", "*", "#", "$", "&"),
                    share("<", ">", "{", "}"),
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Class means, Cholesky factors of the shrunk covariances, and the scale of the score."""

    centre: np.ndarray
    spread: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        z = (x - self.centre) / self.spread
        dens = np.empty((2, len(z)))
        # Blocks that stay below the size from which the solver starts threads of its own.
        for lo in range(0, len(z), SOLVE_ROWS):
            part = z[lo : lo + SOLVE_ROWS]
            for k, (mean, factor, log_det) in enumerate(zip(self.means, self.factors, self.log_dets, strict=True)):
                y = np.linalg.solve(factor, (part - mean).T)
                dens[k, lo : lo + len(part)] = -0.5 * (y * y).sum(axis=0) - log_det
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * _squash(self.margin(x)) + self.offset)


def _squash(m: np.ndarray) -> np.ndarray:
    """Keeps far outliers from deciding the calibration."""
    return np.sign(m) * np.log1p(np.abs(m))


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(t, -500, 500)))


def _calibrate(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic slope and offset of the squashed margin, with a small ridge (Newton steps)."""
    x = np.column_stack([_squash(m), np.ones(len(m))])
    w = np.array([1.0, 0.0])
    ridge = np.diag([1.0, 1e-3])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + ridge @ (w - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge
        move = np.linalg.solve(hess, g)
        w -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def fit_discriminant(x: np.ndarray, y: np.ndarray, shrink: float = 0.1) -> Discriminant:
    """``shrink`` mixes each class covariance with its mean variance on the diagonal.

    A class without rows takes the mean and spread of all rows, so a table without labels
    gives every text the same score.
    """
    d = len(FEATURES)
    if not len(x):
        x, y = np.zeros((1, d)), np.zeros(1)
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = (x - centre) / spread
    means, factors, dets = [], [], []
    for k in (0, 1):
        own = z[y == k] if (y == k).any() else z
        mean = own.mean(axis=0)
        cov = (own - mean).T @ (own - mean) / max(len(own), 1)
        cov = (1 - shrink) * cov + (shrink * max(np.trace(cov) / d, 1e-3)) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(factor)
        dets.append(float(np.log(np.diag(factor)).sum()))
    model = Discriminant(centre, spread, means, factors, dets, 1.0, 0.0)
    model.slope, model.offset = _calibrate(model.margin(x), y)
    return model


def train_quality(
    docs: DataFrame, labels: DataFrame, learnable: Column | None = None, rows: int = FIT_ROWS
) -> Discriminant:
    """Fits on at most ``rows`` labelled documents (chosen by a hash of the id) that are learnable.

    By default those whose crc32(doc_id as text) mod 4 is not 2.  Statistics are computed in
    the tasks; only they reach the driver.  Null labels and ids are left out; of repeated label
    rows one counts.
    """
    learnable = remainder("doc_id", 4) != 2 if learnable is None else learnable
    stats = F.arrow_udf(_statistics, "array<double>")
    got = (
        label_sample(docs, labels, "quality", learnable, rows)
        .select(F.col("quality"), stats("text").alias("x"), F.xxhash64("doc_id").alias("k"))
        .orderBy("k", "quality", "x")
        .limit(2 * rows)
        .toArrow()
    )
    x = np.array(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return fit_discriminant(x, np.array(got["quality"]).astype(float))


def _statistics(texts: pa.Array) -> pa.Array:
    x = document_statistics(texts)
    offsets = pa.array(np.arange(len(x) + 1) * len(FEATURES), type=pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))


def quality_score(model: Discriminant) -> callable:
    """A column function: text -> score between 0 and 1, higher for better texts.

    Null and empty texts are scored as texts without words.
    """

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(document_statistics(texts)))

    return F.arrow_udf(score, "double")
