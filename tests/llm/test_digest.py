"""Digests against plain Python over whole lists, and their edge cases."""

import hashlib
from collections import Counter

from fleetline.llm import digest as d
from fleetline.llm import queries


def plain_digest(data: bytes) -> str:
    """The definition, a byte at a time."""
    import math

    counts = Counter()
    for a, b, c in zip(data, data[1:], data[2:]):
        counts[((a | b << 8 | c << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 23] += 1
    ordered = sorted(counts.get(i, 0) for i in range(512))
    q = [ordered[512 * k // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(counts.get(i, 0) > x for x in q) for i in range(512)]
    head = [min(255, 1 + int(math.log(len(data)) * 10)) if data else 0] + [x * 255 // q[2] if q[2] else 0 for x in q[:2]]
    return bytes(head + [codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, 512, 4)]).hex()


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        follow, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[:len(t) - half] + follow[:half]
        a, b, c = (plain_digest(x.encode()) for x in (t, edited, follow))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, d.likeness(a, b), d.likeness(a, c)))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op9_fingerprints"](spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_many_buckets_find_the_same_neighbours(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(d, "ordered_buckets", lambda df, i, h: ordered(df, i, h, 7))
    from fleetline.llm.common import ordered_buckets as ordered

    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = d.digest_and_neighbours(df).collect()
    assert sorted(map(tuple, got), key=str) == expected([tuple(r) for r in df.collect()])


def test_nulls_short_texts_single_row_and_no_rows(spark):
    df = spark.createDataFrame([(3, None, 1), (None, "ab", 1), (7, "x" * 50_000, 1), (9, "", 1)], "doc_id long, text string, bucket int")
    got = d.digest_and_neighbours(df).collect()
    assert sorted(map(tuple, got), key=str) == expected([(r[0], r[1]) for r in df.collect()])
    assert d.digest_and_neighbours(df.limit(0)).count() == 0
    one = d.digest_and_neighbours(df.filter("doc_id = 7")).collect()[0]
    assert one["near_next"] == 1.0


def test_repeated_rows_are_all_returned(spark):
    df = spark.createDataFrame([(1, "same text")] * 2500 + [(2, "other")] * 3, "doc_id long, text string")
    assert d.digest_and_neighbours(df).groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 2500), (2, 3)]


def test_likeness_follows_the_edit():
    words = [f"word{i * 37 % 101}" for i in range(400)]
    base = " ".join(words)
    near = " ".join(words[:380] + ["new"] * 20)
    far = " ".join(f"other{i * 53 % 97}" for i in range(400))
    marks = [d.digest(t.encode()) for t in (base, near, far)]
    assert d.likeness(marks[0], marks[0]) == 1.0
    assert 1.0 > d.likeness(marks[0], marks[1]) > d.likeness(marks[0], marks[2]) >= 0.0
