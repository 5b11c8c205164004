"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed n-gram counts (two and three bytes of the lower-cased text, everything but letters
as space), damped, weighted by inverse document frequency and normalised. Each language has a few centroids found by
spherical k-means; the language of the centroid with the highest cosine wins. A text farther from it than texts of
that language and length are is marked as rejected: the limits come from the cosines of each half of a language's sample
to centroids of the other half, by the number of different n-grams.

Document frequencies cover all training rows. Centroids are fitted on at most `SAMPLE` training rows a language, those
whose id and text hash lowest, for every language that occurs.

Defined results: a null text or one without a letter has language `und`, score 0 and is rejected, even if no language
could be learned; equal cosines go to the first language in alphabetical order; equal texts have equal results; rows
with null language are predicted but never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import LOWEST, own_name
from fleetline.session import staged

DIMENSIONS, CENTROIDS, SAMPLE, ROUNDS = 4096, 3, 1000, 12
#: A text is rejected below this quantile of the shares that held-out texts of its language reach of the cosine usual
#: for their number of n-grams, but never at more than `STRICTEST` of it: few rows say little about the rare ones.
REJECT_QUANTILE, STRICTEST = 0.005, 0.5
#: Held-out rows of one length at least, and the numbers of n-grams (powers of two) for which a limit is kept.
LENGTH_ROWS, LENGTHS = 20, np.arange(13.0)
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_LETTERS_ONLY = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def counts(text: str) -> np.ndarray:
    """Counts of hashed byte pairs and triples."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY), np.uint8).astype(np.uint32)
    if len(raw) < 2:
        return np.bincount(raw, minlength=DIMENSIONS)
    pairs = raw[:-1] | raw[1:] << np.uint32(8)
    triples = pairs[:-1] | raw[2:] << np.uint32(16)
    hashed = (np.concatenate((pairs | np.uint32(1 << 24), triples)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
    return np.bincount(hashed, minlength=DIMENSIONS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """A unit row for each text: damped counts times inverse document frequency."""
    rows = np.empty((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        rows[i] = counts(text)
    rows = np.log1p(rows) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Centroids:
    """The fitted model: a language, a unit vector and rejection limits, one for each of `LENGTHS`, for each centroid."""

    languages: tuple[str, ...]
    idf: np.ndarray
    vectors: np.ndarray
    limits: np.ndarray

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest centroid, its cosine, and whether that is too low, for each text."""
        rows = vectors(texts, self.idf)
        cosines = rows @ self.vectors.T
        best = cosines.argmax(axis=1)
        cosine = cosines[np.arange(len(texts)), best]
        length = np.log2(np.maximum((rows > 0).sum(axis=1), 1))
        low = np.minimum(length.astype(int), len(LENGTHS) - 2)
        share = length - low
        return best, cosine, cosine < self.limits[best, low] * (1 - share) + self.limits[best, low + 1] * share


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit rows and each row's centroid. Starts from rows far from each other."""
    mean = rows.mean(axis=0)
    chosen = [int((rows @ mean).argmax())]
    nearest = rows @ rows[chosen[0]]
    for _ in range(1, min(k, len(rows))):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centres = rows[chosen].copy()
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                total = rows[own == c].sum(axis=0)
                centres[c] = total / max(np.linalg.norm(total), 1e-12)
    return centres, (rows @ centres.T).argmax(axis=1)


def rejection_limits(rows: np.ndarray) -> np.ndarray:
    """Least cosine of a text of the language whose unit rows these are, for each of `LENGTHS`.

    Each half of the rows is held out from the centroids that it is compared with. The usual cosine of a length is the
    median of rows of about that length; below the shortest it falls with the square root of the number of n-grams.
    """
    cosines, halves = np.ones(len(rows)), (np.arange(len(rows)) % 2 == 0, np.arange(len(rows)) % 2 == 1)
    for held, others in (halves, halves[::-1]):
        if held.any() and others.any():
            cosines[held] = (rows[held] @ spherical_kmeans(rows[others], CENTROIDS)[0].T).max(axis=1)
    length = np.log2(np.maximum((rows > 0).sum(axis=1), 1))
    parts = np.array_split(np.argsort(length, kind="stable"), max(len(rows) // LENGTH_ROWS, 1))
    known, usual = (np.array([np.median(v[p]) for p in parts]) for v in (length, cosines))

    def expected(at: np.ndarray) -> np.ndarray:
        return np.interp(at, known, usual) * np.sqrt(2.0 ** np.minimum(at - known[0], 0))

    shares = cosines / np.maximum(expected(length), 1e-12)
    return expected(LENGTHS) * np.clip(np.quantile(shares, REJECT_QUANTILE), 0, STRICTEST)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (feature, documents that have it); feature -1 counts all documents."""
    seen, total = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if has_letter(text):
                seen += counts(text) > 0
                total += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.append(total, seen))], names=["feature", "n"])


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Learns from rows with text and language; others are left out here."""
    rows = training.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    frequent = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = dict(frequent)
    total = found.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([found.get(i, 0) for i in range(DIMENSIONS)]))).astype(np.float32) + np.float32(0.05)
    # Keys are uniform 64-bit hashes, so a share of the distinct rows is a share of the range of keys. Twice the sample is
    # taken, and cut to the lowest keys where it is clustered.
    share = F.least(F.lit(2.0 * SAMPLE) / F.approx_count_distinct("key"), F.lit(1.0))
    # Written, so its size is known and texts are not shuffled to join it.
    bounds = staged(rows.groupBy("lang").agg(F.when(share >= 1, F.lit(-1 - LOWEST)).otherwise(
        (F.lit(float(LOWEST)) + share * 2.0 ** 64).cast("long")).alias("bound")), "bounds")

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in part.sort_values("key")["text"][:SAMPLE] if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "centre": [], "low": []})
        units = vectors(texts, idf)
        centres, _ = spherical_kmeans(units, CENTROIDS)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": [c.tobytes() for c in centres],
                             "low": [rejection_limits(units).tobytes()] * len(centres)})

    sample = rows.join(bounds, "lang").filter("key <= bound").select("key", "text", "lang").dropDuplicates(["lang", "key"])
    learned = sample.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, low binary").collect()
    learned.sort(key=lambda r: (r["lang"], bytes(r["centre"])))
    return Centroids(tuple(r["lang"] for r in learned), idf,
                     np.array([np.frombuffer(r["centre"], np.float32) for r in learned]).reshape(-1, DIMENSIONS),
                     np.array([np.frombuffer(r["low"]) for r in learned]).reshape(-1, len(LENGTHS)))


def predict(model: Centroids, text: Column) -> Column:
    """A struct (lang_pred, score, rejected) for a text column; every text is read whole."""
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        langs, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if model.languages else []
        for at in range(0, len(known), 256):
            part = known[at:at + 256]
            for i, b, c, far in zip(part, *model.nearest([texts.iloc[i] for i in part])):
                langs[i], scores[i], rejected[i] = model.languages[b], min(max(float(c), 0.0), 1.0), far
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})

    return of(text)


def identify(df: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """`df` with lang_pred, score and rejected; columns of those names are replaced."""
    name = own_name(df, "_language")
    return df.withColumn(name, predict(model, F.col(text_col))).withColumns(
        {c: F.col(f"{name}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(name)
