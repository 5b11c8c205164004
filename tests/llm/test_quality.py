"""Quality scores: the discriminant against densities by hand, held-out accuracy, and edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from fleetline.llm import quality, queries


def test_scores_are_log_density_differences(spark):
    rng = np.random.default_rng(1)
    p = len(quality.STATISTICS)
    x = np.vstack([rng.normal(0, 1, (300, p)) @ rng.normal(0, 0.4, (p, p)) + 1, rng.normal(0, 0.5, (500, p))])
    y = [0] * 300 + [1] * 500
    df = spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x)] + [(None, [0.0] * p), (2, [9.0] * p)], "quality int, statistics array<double>")
    model = quality.fit(df)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    logs = []
    for c, n in ((0, 300), (1, 500)):
        own = z[np.array(y) == c]
        cov = np.cov(own.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.trace(cov) / p * np.eye(p)
        d = z - own.mean(axis=0)
        logs.append(math.log(n / 800) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700))), atol=1e-8)


def test_held_out_scores_order_the_classes(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.queries()["op3_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    out = [(r["score"], r["quality"]) for r in rows if r["held_out"]]
    pairs = [(a > b) + 0.5 * (a == b) for a, p in out if p == 1 for b, q in out if q == 0]
    assert sum(pairs) / len(pairs) > 0.97
    assert queries.queries()["op3_quality"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_nulls_empty_long_texts_and_no_labels(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a" * 300_000), (5, "x " * 100_000), (5, "x " * 100_000)], "doc_id long, text string")
    measured = quality.with_statistics(df.withColumn("score", df.doc_id))
    none = quality.fit(measured.selectExpr("CAST(NULL AS INT) quality", "statistics"))
    assert {r["score"] for r in quality.with_scores(measured, none).collect()} == {0.5}
    one = quality.fit(measured.selectExpr("1 AS quality", "statistics"))
    assert {r["predicted"] for r in quality.with_scores(measured, one).collect()} == {1}
    both = quality.with_scores(measured, quality.fit(measured.selectExpr("int(doc_id % 2) AS quality", "statistics"))).collect()
    assert len(both) == 6 and all(0 <= r["score"] <= 1 for r in both)
    assert quality.with_scores(measured.limit(0), one).count() == 0


def plain_statistics(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    if not words:
        return [0.0] * 16
    n, solid, lines = len(words), sum(map(len, words)), [x for x in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0d]", x)]

    def found(pattern):
        return sum(map(len, re.findall(pattern, data)))

    upper, lower, digits, stops, high = map(found, (rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb"[.,;:']", rb"[\x80-\xff]"))
    letters = upper + lower + high
    mean = sum(map(len, words)) / n
    spread = math.sqrt(sum((len(w) - mean) ** 2 for w in words) / n)

    def root(a, b):
        return math.sqrt(a / b) if b else 0.0

    neighbours = [(a, b) for a, b in zip(words, words[1:])]
    return [math.log(1 + n), math.log(1 + mean), math.log(1 + spread), math.log(len(set(words)) / n) / math.log(n + 1),
            root(max(Counter(words).values()), n + 4), root(sum(a == b for a, b in neighbours), n), root(upper, letters),
            root(digits, solid), root(stops, solid), root(solid - letters - digits - stops, solid), root(high, solid),
            root(len(set(lines)), len(lines)), math.log(1 + n / len(lines)), root(sum(len(w) <= 2 for w in words), n),
            root(letters, solid), root(len(set(neighbours)), max(n - 1, 1))]


def test_whole_table_equals_a_plain_fit(spark):
    """Statistics, fit and scores of all documents, computed anew without the module."""
    sf = "/root/testdata/sf0.01"
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect():
        if r["quality"] in (0, 1):
            labels[r["doc_id"]].append(r["quality"])
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in docs]
    x = np.array([plain_statistics(r["text"]) for r in docs])
    learned = [(i, q) for i, r in enumerate(docs) if not held[i] for q in labels[r["doc_id"]]]
    rows, y = x[[i for i, _ in learned]], np.array([q for _, q in learned])
    scale = np.where(rows.std(axis=0) > 1e-9, rows.std(axis=0), 1.0)
    z, all_z, logs = (rows - rows.mean(axis=0)) / scale, (x - rows.mean(axis=0)) / scale, []
    for c in (0, 1):
        own = z[y == c]
        cov = np.cov(own.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.trace(cov) / 16 * np.eye(16)
        d = all_z - own.mean(axis=0)
        logs.append(math.log(len(own) / len(y)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    expected = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))
    out = {r["doc_id"]: r for r in queries.queries()["op3_quality"](spark, sf).collect()}
    assert len(out) == len(docs)
    for r, h, score in zip(docs, held, expected):
        got = out[r["doc_id"]]
        assert got["held_out"] == h and abs(got["score"] - score) < 1e-6, (r["doc_id"], got["score"], score)
        assert got["predicted"] == (got["score"] >= 0.5)
