"""Personal data: base spans against the plain patterns, EM and the classifier on known cases."""

import hashlib
import random
import re
import time

import numpy as np

from fleetline.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            n = len(re.sub(r"[^0-9]", "", m.group()))
            if (kind == "email" or kind == "ip" and all(re.fullmatch("0*(1?[0-9]?[0-9]|2[0-4][0-9]|25[0-5])", p) for p in m.group().split("."))
                    or kind == "card" and 16 <= n <= 19 and pii.luhn(re.sub(r"[^0-9]", "", m.group())) or kind == "phone" and 8 <= n <= 15):
                out.append((kind, *m.span()))
    return out


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    parts = ["a@b.c", "x.y+z@d-e.fg.h", "@", "a@b", "+", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (555) 123-4567", "+12", "+44.20.7946.0958", " ", " ", ".", "-", "é", "0", "99", "a", "%", "(", "\n", "0000001.0002.3.4", "b.c+d@e.f"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_spans_of_long_runs_take_linear_time():
    assert pii.base_spans("1" * 300_000 + " " + "a" * 300_000 + "@" * 1000) == []


def test_parts_of_any_length_are_compared():
    text = "0" * 5000 + "1.2.3.4 and 1.2.3." + "9" * 5000
    assert pii.base_spans(text) == plain_spans(text) == [("ip", 0, 5007)]


def test_many_spans_take_linear_time():
    start = time.perf_counter()
    found = pii.candidates("+1 (555) 123-4567 or 555 123-4567, " * 150_000)
    assert len(found) == 300_000 and sum(c[3] for c in found) == 150_000
    assert time.perf_counter() - start < 60


def test_taken_stretches():
    rng = random.Random(9)
    for _ in range(500):
        spans = [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        merged = pii._merged(spans)
        assert {i for s, e in merged for i in range(s, e)} == {i for s, e in spans for i in range(s, e)}
        assert all(a[1] <= b[0] for a, b in zip(merged, merged[1:]))


def test_whole_table(spark, sf_dir):
    docs = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    rows = queries.queries()["op8_pii"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        base = plain_spans(docs[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        listed = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(listed) <= set(spans)
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    accuracy = np.array([0.95, 0.9, 0.8, 0.6, 0.85])
    right = rng.random((4000, 5)) < accuracy
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((4000, 5)) < 0.2] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, for_, false_ = pii.reliabilities(patterns, counts.astype(float))
    assert np.abs((for_ + 1 - false_) / 2 - accuracy).max() < 0.06
    index = {tuple(p): q for p, q in zip(patterns, posterior)}
    assert np.mean([(index[tuple(v)] > 0.5) == t for v, t in zip(votes, truth)]) > 0.95


def test_added_spans_and_redaction(spark):
    plain = [(i, f"Call me at +1 (555) 010-{1000 + i} or mail u{i}@example.com today", 0) for i in range(40)]
    decoys = [(100 + i, f"order 1234 5678 9012 34{10 + i} and version {i}.2.3", 0) for i in range(40)]
    special = [(200, "phone +1 (555) 010-2000 10.0.0.1 end", 0), (201, None, 0), (202, "", 0), (203, "nothing here", 0)]
    df = spark.createDataFrame(plain + decoys + special, "doc_id long, text string, spans int")
    marked = pii.with_candidates(df)
    model = pii.fit(marked)
    found = {r["doc_id"]: r["found"] for r in pii.with_spans(marked, model, spans="found").collect()}
    assert {s["kind"] for s in found[200]} == {"phone", "ip"}  # the base pattern runs into the address and is dropped
    assert all(s["base"] for i in range(40) for s in found[100 + i])
    out = {r["doc_id"]: r["text"] for r in pii.redact(df, model=model).collect()}
    assert out[0] == "Call me at [PHONE] or mail [EMAIL] today" and out[201] is None and out[203] == "nothing here"
    assert pii.redact(df, model=model).columns == df.columns
    empty = pii.with_candidates(df.limit(0))
    assert pii.with_spans(empty, pii.fit(empty), spans="found").count() == 0
