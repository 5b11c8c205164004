"""Benchmark copies against every window by hand, and edge cases."""

import pickle
import random
import time
import tracemalloc
from collections import Counter

import numpy as np

from fleetline.llm import decontaminate as d
from fleetline.llm import queries


def plain(text, items):
    """Best similarity of each item over all windows of its length, without fingerprints."""
    words, out = d.words_of(text), {}
    for item_id, item in items:
        own = d.words_of(item)
        if not own or not words:
            continue
        size = min(5, len(own))
        count = Counter(tuple(own[i:i + size]) for i in range(len(own) - size + 1))
        if not count.keys() & {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}:
            continue  # every window has similarity zero
        best = 0.0
        for s in range(max(1, len(words) - len(own) + 1)):
            part = words[s:s + len(own)]
            best = max(best, d.similarity(Counter(tuple(part[i:i + size]) for i in range(len(part) - size + 1)), count))
        if best >= 0.8:
            out[item_id] = max(best, out.get(item_id, 0))
    return sorted(out.items())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted((r["doc_id"], i, round(s, 9)) for r in docs for i, s in plain(r["text"], items))
    got = sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in queries.queries()["op4_decontamination"](spark, sf_dir).collect())
    assert got == want and got


def test_edited_copies():
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcdefghijkl") * rng.randint(1, 9) + str(rng.randint(0, 60)) for _ in range(rng.randint(2, 60)))) for k in range(60)]
    benchmark = d.Benchmark(items)
    for k, item in items:
        for edits in range(4):
            words = d.words_of(item)
            for _ in range(edits):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice(([], ["new"], [words[at], "more"]))or [words[at]]
            text = " ".join(["x"] * rng.randint(0, 20) + words + ["y"] * rng.randint(0, 20))
            assert benchmark.matches(text) == plain(text, items)


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    marks = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.permutation(64)[:rng.integers(0, 40)]) for _ in range(4000)], dtype=np.uint64)
    assert (d.near(marks, marks ^ flips, 20) == (np.bitwise_count(flips) <= 20)).all() and sum(d.thresholds(20)) == 13


def test_many_items_are_listed_by_their_shingles():
    """30,000 items of ten words that share a shingle with one other at most: a text meets those that it holds."""
    rng = np.random.default_rng(3)
    words = [f"v{k}" for k in range(50_000)]
    items = [(k, " ".join(words[i] for i in row)) for k, row in enumerate(rng.integers(0, 50_000, (30_000, 10)).tolist())]
    tracemalloc.start()
    benchmark = d.Benchmark(items)
    filler = [words[i] for i in rng.integers(0, 50_000, 3000)]
    text = " ".join(filler[:1500]) + " " + items[77][1] + " " + " ".join(filler[1500:]) + " " + items[9][1]
    start = time.perf_counter()
    assert [i for i, _ in benchmark.matches(text)] == [77, 9]
    assert time.perf_counter() - start < 2 and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    assert len(pickle.dumps(benchmark)) < 12 << 20


def test_items_that_share_shingles_and_long_texts():
    rng = random.Random(6)
    items = [(f"i{k}", " ".join(["which", "of", "these", "is", "the"] + [f"q{rng.randrange(30)}" for _ in range(rng.randrange(1, 9))])) for k in range(80)]
    benchmark = d.Benchmark(items)
    for _ in range(30):
        text = " ".join(rng.choice([t for _, t in items] + ["x y z"]) for _ in range(8))
        assert benchmark.matches(text) == plain(text, items)
    long = "a b " * 40_000 + items[3][1] + " c d" * 40_000
    assert dict(benchmark.matches(long))["i3"] == 1.0


def test_nulls_blocks_clashing_names_and_no_rows(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, passage.upper()), (5, "hi there")], "item_id long, text string")
    rows = [(1, None, 0), (2, "", 0), (3, f"Look: {passage.title()}!!", 0), (3, f"Look: {passage.title()}!!", 0), (None, "hi, THERE", 0),
            (6, "one two three four five six", 0), (7, ("word " * 50_000) + passage, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    want = sorted([(3, 1), (3, 4), (3, 1), (3, 4), (None, 5), (7, 1), (7, 4)], key=str)
    for words in (10**6, 8):
        got = d.contaminated(df, items, block_words=words).select("doc_id", "item_id").collect()
        assert sorted(map(tuple, got), key=str) == want
    kept = d.drop_contaminated(df, items)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 6]
    named = d.contaminated(df, items.selectExpr("concat('item ', item_id) item_id", "text")).select("item_id").distinct().collect()
    assert sorted(r[0] for r in named) == ["item 1", "item 4", "item 5"]
    assert d.contaminated(df.limit(0), items).count() == 0 and d.contaminated(df, items.limit(0)).count() == 0
