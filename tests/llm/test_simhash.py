"""SimHash groups against fingerprints by hand and all pairs, and the search's guarantees."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from fleetline.llm import queries
from fleetline.llm import simhash as s


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(marks, radius=4):
    """(id, mark) rows to {id: smallest id}, by comparing all distinct marks."""
    distinct = sorted({m for _, m in marks})
    parent = {m: m for m in distinct}

    def top(m):
        while parent[m] != m:
            m = parent[m]
        return m

    values = np.array(distinct, dtype=np.uint64)
    for i, m in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= radius):
            parent[top(distinct[i + 1 + int(j)])] = top(m)
    least = defaultdict(lambda: None)
    for i, m in marks:
        if i is not None:
            least[top(m)] = i if least[top(m)] is None else min(i, least[top(m)])
    return [(i, f"{m:016x}", least[top(m)]) for i, m in marks]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain_groups([(r["doc_id"], plain_fingerprint(r["text"])) for r in docs])
    got = queries.queries()["op1_simhash"](spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def crowd_of_marks(rng, n):
    """A dense cluster, chains of close marks, and strangers."""
    centre = rng.getrandbits(64)
    marks = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(n)]
    at = rng.getrandbits(64)
    for _ in range(40):
        at ^= sum(1 << b for b in rng.sample(range(64), 4))
        marks.append(at)
    return marks + [rng.getrandbits(64) for _ in range(n)]


@pytest.mark.parametrize("crowd", [50, 8192])
def test_links_connect_what_all_pairs_connect(spark, crowd):
    marks = [(i, m) for i, m in enumerate(crowd_of_marks(random.Random(5), 200))]
    df = spark.createDataFrame([(i, s.signed(m)) for i, m in marks], "id long, mark long")
    got = {r["id"]: r["component_id"] for r in s.label_marks(df, crowd=crowd).collect()}
    assert got == {i: c for i, _, c in plain_groups(marks)}


@pytest.mark.parametrize("masks", [s.correlated_parts(np.zeros((64, 64)), m) for m in (3, 5)])
def test_every_allocation_finds_all_close_pairs(spark, masks):
    rng = random.Random(len(masks))
    shares = np.array([rng.uniform(0.2, 0.8) for _ in range(64)])
    _, thresholds = s.allocate([rng.random() * 1e6 for _ in masks], shares, masks, 10_000, 4)
    assert sum(thresholds) == 4 - len(masks) + 1 and sorted(sum((s._bits_of(m) for m in masks), [])) == list(range(64))
    marks = [(i, m) for i, m in enumerate(crowd_of_marks(rng, 60))]
    df = spark.createDataFrame([(s.signed(m),) for _, m in marks], "mark long").distinct()
    links = [(r["a"], r["b"]) for r in s.near_links(df, s.Plan(masks, thresholds)).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in links)
    parent = {m: m for _, m in marks}

    def top(m):
        while parent[m] != m:
            m = parent[m]
        return m

    for a, b in links:
        parent[top(a & (2**64 - 1))] = top(b & (2**64 - 1))
    by_top = defaultdict(set)
    for i, m in marks:
        by_top[top(m)].add(i)
    want = defaultdict(set)
    for i, _, c in plain_groups(marks):
        want[c].add(i)
    assert sorted(map(sorted, by_top.values())) == sorted(map(sorted, want.values()))


def test_spanning_links_are_a_minimum_spanning_forest():
    rows = np.unique(np.array(crowd_of_marks(random.Random(1), 150), dtype=np.uint64))
    every = []
    for i in range(len(rows)):
        for j in range(i):
            near = int(np.bitwise_count(rows[i] ^ rows[j]))
            if near <= 4:
                every.append((near, i, j))
    parent, least, n = list(range(len(rows))), 0, 0

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for w, i, j in sorted(every):
        if top(i) != top(j):
            parent[top(i)] = top(j)
            least, n = least + w, n + 1
    got = s.spanning_links(rows, 4)
    assert len(got) == n and int(np.bitwise_count(got[:, 0] ^ got[:, 1]).sum()) == least


@pytest.mark.parametrize("crowd", [60, 8192])
def test_one_row_of_each_group_stays(spark, crowd):
    """Hundreds of lightly edited copies, whose fingerprints are linked or not as all pairs say."""
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}{d}" for a in "bcdfgh" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]
    texts = []
    for copies in (400, 150, 3, 1):
        base = [rng.choice(vocabulary) for _ in range(400)]
        for _ in range(copies):
            words = base[:]
            for at in rng.sample(range(len(words)), rng.randint(0, 2)):
                words[at] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rows = [(i, t, i % 7) for i, t in enumerate(rng.sample(texts, len(texts)))]
    df = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, mark int").repartition(3)
    want = sorted({c for _, _, c in plain_groups([(i, plain_fingerprint(t)) for i, t, _ in rows])})
    out = s.drop_near_duplicates(df, crowd=crowd)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == want and len(want) < len(rows) // 2


def test_nulls_blanks_long_texts_repeats_and_no_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(5, None, 1), (3, " \t\n", 1), (None, "", 1), (9, long, 2), (9, long, 2), (8, long + " tail", 2),
            (None, "all alone here now", 3), (7, "Two Words", 4), (2, "two  words", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in s.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (9, 8), (9, 8), (8, 8), (None, None), (7, 2), (2, 2)], key=str)
    assert s.near_duplicates(df.limit(0)).count() == 0
    kept = s.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r[0] for r in kept.collect()), key=str) == [2, 3, 8, None]
    clash = df.selectExpr("doc_id", "text", "mark", "mark AS _hash", "mark AS _Copies", "mark AS _kept_id")
    assert s.drop_near_duplicates(clash).count() == 4 and s.drop_near_duplicates(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "one text", k) for k in (3, 1, 2)], "doc_id long, text string, mark int")
    assert [tuple(r) for r in s.drop_near_duplicates(same).collect()] == [(1, "one text", 1)]
