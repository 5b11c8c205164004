"""Groups against all pairs on whole sets, the posterior bounds, and groups that are hard for a hub."""

import random

import numpy as np
import pytest

from fleetline.llm import minhash as m
from fleetline.llm import queries

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def plain_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(docs):
    """Rows (doc_id, n_shingles, component_id, kept) by comparing all sets that share a shingle."""
    sets, holders, parent = [plain_set(t) for _, t in docs], {}, list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for gram in s:
            for j in holders.get(gram, ()):
                shared[j] = shared.get(j, 0) + 1
            holders.setdefault(gram, []).append(i)
        for j, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                parent[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return [(key, len(sets[i]), least.get(top(i)), key == least.get(top(i))) for i, (key, _) in enumerate(docs)]


def found(df, **options):
    return sorted((tuple(r) for r in m.near_duplicates(df, **options).select(*COLUMNS).collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op12_minhash"](spark, sf_dir)
    assert tuple(got.columns) == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(plain(docs))


def prose(rng, n, vocabulary=20_000):
    return [f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(n)]


def edited(rng, words, kind, share):
    n, k = len(words), max(1, round(len(words) * share))
    if kind == "words":
        out = list(words)
        for i in rng.sample(range(n), max(1, k // 3)):
            out[i] = f"x{rng.random()}"
        return out
    run = [f"x{rng.random()}" for _ in range(k)]
    at = rng.randrange(n)
    return {"append": words + run, "cut": words[:n - k], "insert": words[:at] + run + words[at:]}[kind]


@pytest.mark.parametrize("crowd", [m.CROWD, 16])
def test_copies_of_every_kind_and_a_shared_passage(spark, crowd):
    """Hundreds of copies of one text that are often less alike to each other, and texts that share three fifths."""
    rng = random.Random(11)
    docs, licence = [], prose(rng, 150)
    base = prose(rng, 200)
    for i in range(220):
        docs.append(" ".join(edited(rng, base, ("words", "append", "cut", "insert")[i % 4], rng.uniform(0.01, 0.16))))
    for _ in range(250):
        docs.append(" ".join(prose(rng, 40) + licence + prose(rng, 40)))
    for _ in range(80):
        words = prose(rng, rng.randrange(5, 300))
        docs += [" ".join(words), " ".join(edited(rng, words, rng.choice(("words", "append", "cut", "insert")), rng.uniform(0.02, 0.2)))]
    rows = [(i, t) for i, t in enumerate(rng.sample(docs, len(docs)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(plain(rows), key=str)
    assert len({r[2] for r in want}) < len(rows) - 200
    assert found(df, crowd=crowd) == want


def test_candidates_stay_linear_where_a_passage_is_shared():
    """2,000 texts of similarity 0.6 in one bucket: hardly a pair is left to verify."""
    rng = np.random.default_rng(1)
    middle = rng.integers(0, 2, 512)
    rows = np.where(rng.random((2000, 512)) < 0.775, middle, rng.integers(0, 2, (2000, 512)))
    bits = np.packbits(rows.astype(np.uint8), axis=1).view(np.uint64)
    least = m.least_agreeing(85)
    assert sum(map(len, m._hub_pairs(np.arange(2000), bits, least))) < 2000
    same = np.repeat(bits[:1], 2000, axis=0)
    assert sum(map(len, m._hub_pairs(np.arange(2000), same, least))) == 1999


def test_posterior_bounds_keep_pairs_at_the_similarity():
    least, rng = m.least_agreeing(85), np.random.default_rng(2)
    assert list(least) == sorted(least) and len(least) == 8
    for alike, low, high in ((0.85, 0.999, 1.0), (0.95, 0.9999, 1.0), (0.5, 0.0, 0.001)):
        agree = (rng.random((20_000, 8, 64)) < (1 + alike) / 2).sum(axis=2).cumsum(axis=1)
        assert low <= (agree >= np.array(least)).all(axis=1).mean() <= high


def test_pairs_at_the_similarity_meet_in_a_band():
    rng, met = random.Random(4), 0
    for _ in range(300):
        words = [f"v{rng.random()}" for _ in range(230)]
        a, b = m.shingles(" ".join(words)), m.shingles(" ".join(words[:196]))
        assert 0.849 < len(a & b) / len(a | b) < 0.852
        met += bool(set(m.bands(m.least_hashes(a)).tolist()) & set(m.bands(m.least_hashes(b)).tolist()))
    assert met >= 299


def test_nulls_blanks_short_long_texts_repeats_clashing_names_and_no_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (2, "one"), (9, "one two"), (10, "ONE\ttwo "), (11, "two one"), (None, "one two"),
            (12, long), (3, long + " more"), (12, long), (13, "é É"), (14, "É é"), (None, "alone here now"), (15, "a b c"), (16, "a  b\x0bc")]
    given = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, node long, digest string, Hash string")
    assert found(given) == sorted(plain(docs), key=str)
    assert m.near_duplicates(given.limit(0)).count() == 0
    assert m.near_duplicates(given.filter("doc_id = 5")).first().asDict() == {"doc_id": 5, "n_shingles": 0, "component_id": 5, "kept": True}
