"""Quality scores by a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of standardised, transformed statistics; the covariance is shrunk towards a
multiple of the identity. The score is the logistic function of the difference of the classes' log densities
(Mahalanobis distances through Cholesky factors that are computed once) and log priors.

Means and covariances are sums over all labelled training rows. Defined results: a null text counts as empty, and an
empty one has all statistics zero; labels that are null or neither 0 nor 1 are not learned from; a document with
several labels is learned from once for each; with fewer than two classes every score is 0.5 (none learned) or the
learned class's; repeated rows are all scored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATISTICS = ("words", "word_length", "word_length_spread", "distinct_words", "top_word", "repeated_neighbours", "capitals",
              "digits", "stops", "symbols", "other_bytes", "distinct_lines", "line_words", "short_words", "letters", "distinct_pairs")
#: Weight of the identity in each class's covariance.
SHRINKAGE = 0.1

_BYTE_CLASS = np.zeros(256, dtype=np.int64)
for _name, _bytes in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", (32, *range(9, 14))),
                      ("stop", b".,;:'"), ("high", range(128, 256))):
    _BYTE_CLASS[list(_bytes)] = {"upper": 1, "lower": 2, "digit": 3, "space": 4, "stop": 5, "high": 6}[_name]


def _share(part: float, whole: float) -> float:
    """Square root of a share: spreads small shares, which are near zero for most texts."""
    return math.sqrt(part / whole) if whole else 0.0


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_BYTE_CLASS[np.frombuffer(data, np.uint8)], minlength=7)
    lengths = np.fromiter(map(len, words), np.float64, n)
    seen = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    letters = int(kinds[1] + kinds[2] + kinds[6])
    solid = len(data) - int(kinds[4])
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(n), math.log1p(lengths.mean()), math.log1p(lengths.std()), math.log(len(seen) / n) / math.log(n + 1),
        _share(seen.most_common(1)[0][1], n + 4), _share(sum(map(bytes.__eq__, words, words[1:])), n),
        _share(int(kinds[1]), letters), _share(int(kinds[3]), solid), _share(int(kinds[5]), solid), _share(int(kinds[0]), solid),
        _share(int(kinds[6]), solid), _share(len(set(lines)), len(lines)), math.log1p(n / len(lines)),
        _share(float((lengths <= 2).sum()), n), _share(letters, solid), _share(pairs, max(n - 1, 1))]


def with_statistics(df: DataFrame, text_col: str = "text", name: str = "statistics") -> DataFrame:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return df.withColumn(name, of(F.coalesce(F.col(text_col), F.lit(""))))


@dataclass(frozen=True)
class Discriminant:
    """Per class the mean, the inverse Cholesky factor of the covariance, half its log determinant, and the log prior."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[int, ...]
    means: np.ndarray
    inverse_factors: np.ndarray
    log_determinants: np.ndarray
    log_priors: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if len(self.classes) < 2:
            return np.full(len(rows), float(self.classes[0]) if self.classes else 0.5)
        z = (rows - self.centre) / self.scale
        log_density = [prior - half - 0.5 * (((z - mean) @ factor.T) ** 2).sum(axis=1) for mean, factor, half, prior in
                       zip(self.means, self.inverse_factors, self.log_determinants, self.log_priors)]
        difference = np.clip(log_density[1] - log_density[0], -700, 700)
        return 1 / (1 + np.exp(-difference))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of 1, x and x x' by class, as rows (class, place, value)."""
    p = len(STATISTICS)
    sums = {0: np.zeros(1 + p + p * p), 1: np.zeros(1 + p + p * p)}
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        rows = batch.column(1).flatten().to_numpy().reshape(-1, p)
        for c in sums:
            x = rows[labels == c]
            sums[c] += np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
    values = np.concatenate([sums[0], sums[1]])
    each = len(values) // 2
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], each), pa.int32()), pa.array(np.tile(np.arange(each), 2), pa.int32()),
                                      pa.array(values)], names=["label", "place", "value"])


def fit(labelled: DataFrame, label_col: str = "quality", name: str = "statistics", shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fits on all rows of `labelled` whose label is 0 or 1."""
    p = len(STATISTICS)
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(label_col).cast("int").alias("label"), name)
    totals = np.zeros((2, 1 + p + p * p))
    for r in rows.mapInArrow(_moments, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        totals[r["label"], r["place"]] = r["value"]
    n = totals[:, 0]
    classes = tuple(c for c in (0, 1) if n[c] > 0)
    everything = totals.sum(axis=0)
    centre = everything[1:1 + p] / max(everything[0], 1)
    spread = np.sqrt(np.maximum(np.diag(everything[1 + p:].reshape(p, p)) / max(everything[0], 1) - centre ** 2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means, factors, halves = [], [], []
    for c in classes:
        mean = totals[c, 1:1 + p] / n[c]
        cov = (totals[c, 1 + p:].reshape(p, p) / n[c] - np.outer(mean, mean)) / np.outer(scale, scale)
        size = max(np.trace(cov) / p, 1e-3)
        factor = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * size * np.eye(p))
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(factor))
        halves.append(np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, classes, np.array(means), np.array(factors), np.array(halves),
                        np.log([n[c] / max(n.sum(), 1) for c in classes]))


def with_scores(df: DataFrame, model: Discriminant, name: str = "statistics") -> DataFrame:
    """`df` with `score` (0 to 1, higher: class 1 likelier) and `predicted` (1 from 0.5 on)."""

    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist(), dtype=np.float64).reshape(-1, len(STATISTICS))))

    return df.withColumn("score", of(F.col(name))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
