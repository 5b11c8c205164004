"""Language identification: nearest centroid by hand, held-out accuracy, rejection, and edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fleetline.llm import language_id as lid
from fleetline.llm import queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.queries()["op5_language"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def small(spark):
    rows = [(i, t, lang, 0) for i, (t, lang) in enumerate(
        [("the cat and the dog went to the house " * 3 + str(i), "en") for i in range(30)]
        + [("der hund und die katze gehen nach hause " * 3 + str(i), "de") for i in range(30)])]
    return spark.createDataFrame(rows + [(900, None, "en", 0), (901, "no label", None, 0)], "doc_id long, text string, lang string, score int")


def test_model_is_the_nearest_centroid(spark):
    model = lid.fit(small(spark))
    texts = ["the dog", "die katze und der hund", "house"]
    units = lid.vectors(texts, model.idf)
    best, cosine, _ = model.nearest(texts)
    for i in range(len(texts)):
        by_hand = [float(np.dot(units[i], c)) for c in model.vectors]
        assert int(np.argmax(by_hand)) == best[i] and abs(max(by_hand) - cosine[i]) < 1e-5
    assert [model.languages[b] for b in best[:2]] == ["en", "de"]


def test_defined_results(spark):
    model = lid.fit(small(spark))
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "the house " * 40_000), (5, "жук лежит на боку у реки и ждёт утра" * 20), (4, "the house " * 40_000)]
    df = spark.createDataFrame(odd, "doc_id long, text string")
    out = {r["doc_id"]: r for r in lid.identify(df, model).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["rejected"] and out[i]["score"] == 0 for i in (1, 2, 3))
    assert out[4]["lang_pred"] == "en" and not out[4]["rejected"] and out[5]["rejected"] and out[5]["lang_pred"] != "und"
    assert lid.identify(df.limit(0), model).count() == 0
    nothing = lid.fit(small(spark).limit(0))
    assert {r["lang_pred"] for r in lid.identify(df, nothing).collect()} == {"und"}


def test_repeated_rows_do_not_crowd_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lid, "SAMPLE", 10)
    same = spark.createDataFrame([(None, "the same text again and again", "en", 0)] * 500, "doc_id long, text string, lang string, score int")
    model = lid.fit(small(spark).unionByName(same))
    assert set(model.languages) == {"en", "de"}


def test_a_language_that_was_not_learned_is_rejected(spark):
    """Leaving out one language at a time: its rows are rejected, clean rows of the others are kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("lang IS NOT NULL").cache()
    rows = [r for r in docs.collect() if lid.has_letter(r["text"])]
    for left in ("de", "en", "fr"):
        model = lid.fit(docs.filter(f"lang <> '{left}' AND doc_id % 2 = 0"))
        foreign = model.nearest([r["text"] for r in rows if r["lang"] == left])[2]
        own = model.nearest([r["text"] for r in rows if r["lang"] != left and r["doc_id"] % 2])[2]
        assert foreign.mean() > 0.9 and own.mean() < 0.02, (left, foreign.mean(), own.mean())


def test_limits_do_not_swing_with_one_outlier():
    """A row alone in its cluster sets no limit for all."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijkl"), 4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(5, 80))) for _ in range(200)]
    idf = np.ones(lid.DIMENSIONS, np.float32)
    with_one, without = (lid.rejection_limits(lid.vectors(t, idf)) for t in (texts + ["zzz qqq xxx www " * 9], texts))
    assert np.abs(with_one - without).max() < 0.05


def test_every_language_is_learned(spark):
    """However many there are, also those of one row."""
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"x{i}") for i in range(300)]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {f"x{i}" for i in range(300)}


def plain_counts(text):
    """Hashed pairs and triples of the lower-cased bytes, all but letters as space."""
    raw = [b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode()]
    if len(raw) < 2:
        return Counter(raw)
    grams = Counter((1 << 24) + a + 256 * b for a, b in zip(raw, raw[1:]))
    grams += Counter(a + 256 * b + 65536 * c for a, b, c in zip(raw, raw[1:], raw[2:]))
    out = Counter()
    for gram, n in grams.items():
        out[gram * 0x9E3779B1 % 2**32 >> 20] += n
    return out


def plain_clusters(rows):
    """Three unit centroids: starts far from each other, twelve rounds."""
    starts = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(starts) < min(3, len(rows)):
        starts.append(int(np.argmin(np.max(rows @ rows[starts].T, axis=1))))
    centres = rows[starts]
    for _ in range(12):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = [rows[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]
        centres = np.array([v / np.linalg.norm(v) for v in sums])
    return centres


def test_whole_table_equals_a_plain_fit(spark):
    """Counts, document frequencies, centroids and cosines of all documents, computed anew without the module."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("key"))
    docs = docs.orderBy("key").collect()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs]
    known = [r["text"] is not None and any(c.isalpha() for c in r["text"]) for r in docs]
    counted = [plain_counts(r["text"]) if k else Counter() for r, k in zip(docs, known)]
    training = [i for i, r in enumerate(docs) if known[i] and not held[i] and r["lang"] is not None]
    having = Counter(feature for i in training for feature in counted[i])
    idf = np.array([math.log((1 + len(training)) / (1 + having[j])) + 0.05 for j in range(4096)])
    units = np.zeros((len(docs), 4096))
    for i, grams in enumerate(counted):
        for feature, n in grams.items():
            units[i, feature] = math.log(1 + n) * idf[feature]
    units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)
    langs = sorted({docs[i]["lang"] for i in training})
    assert max(Counter(docs[i]["lang"] for i in training).values()) <= lid.SAMPLE  # so the plain fit takes all rows as well
    centres = {lang: plain_clusters(units[[i for i in training if docs[i]["lang"] == lang]]) for lang in langs}
    out = {r["doc_id"]: r for r in queries.queries()["op5_language"](spark, sf).collect()}
    assert len(out) == len(docs)
    for i, r in enumerate(docs):
        got = out[r["doc_id"]]
        assert got["held_out"] == held[i]
        if not known[i]:
            assert (got["lang_pred"], got["score"]) == ("und", 0)
            continue
        nearest = {lang: float((units[i] @ c.T).max()) for lang, c in centres.items()}
        assert abs(got["score"] - max(max(nearest.values()), 0)) < 1e-4
        assert nearest[got["lang_pred"]] > max(nearest.values()) - 1e-4
