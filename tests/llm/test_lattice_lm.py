"""Lattice scores against enumerated segmentations, counts against plain Python, and edge cases."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fleetline.llm import lattice_lm as m
from fleetline.llm import queries

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(data, pieces):
    for cuts in itertools.product((0, 1), repeat=len(data) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(data)]
        parts = [data[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in pieces for p in parts):
            yield parts


@pytest.mark.parametrize("short", [64, 0])
def test_sums_over_all_segmentations(monkeypatch, short):
    monkeypatch.setattr(m, "SHORT", short)
    rng = np.random.default_rng(0)
    pieces = sorted([b" ", b" a", b" ab", b"a", b"b", b"ab", b"ba", b"abb", b"c"])
    logs = np.log(rng.dirichlet(np.ones(len(pieces))))
    table, words = dict(zip(pieces, logs)), [b"a", b"ab", b"abba", b"cabab", b"bbbb", b"abbab", b"a"]
    lattice = m.Lattice(pieces, logs)
    expected = Counter()
    for word, got in zip(words, lattice.log_probabilities(words)):
        ways = [(parts, sum(table[p] for p in parts)) for parts in segmentations(b" " + word, table)]
        whole = np.logaddexp.reduce([s for _, s in ways])
        assert abs(got - whole) < 1e-9
        for parts, s in ways:
            for p in parts:
                expected[p] += math.exp(s - whole)
    assert np.allclose(lattice.expected_pieces(words, np.ones(len(words))), [expected[p] for p in pieces])


def test_whole_table(spark, sf_dir):
    docs = dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()))
    lowered = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for i, t in docs.items()}
    tokens = {i: [*t.encode().split(), None] for i, t in lowered.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, kinds = counts.total(), len(counts)
    rows = queries.queries()["op6_lattice_lm"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    texts = sum(not h for h in held.values())
    words = sorted({w for ws in tokens.values() for w in ws if w})
    model = m.train_pieces(spark.createDataFrame([(bytearray(w), counts[w]) for w in words], "word binary, c long"), texts, VOCABULARY)
    piece = dict(zip(words, m.Lattice(model.pieces, model.logs).log_probabilities(words)))
    left = m.DISCOUNT * (kinds - 1) + 0.5
    score = {w: math.log10((max(counts[w] - m.DISCOUNT, 0) + left * model.word_factor() * math.exp(p)) / (total + 1)) for w, p in piece.items()}
    score[None], piece[None] = math.log10((texts + 0.5) / (total + 1)), model.end_log
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), total)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isclose(r["score"], sum(score[w] for w in own), rel_tol=1e-6)
        assert math.isclose(r["piece_score"], sum(piece[w] for w in own) / math.log(10), rel_tol=1e-6)


def test_words_form_a_distribution():
    """All words over one letter, up to a length beyond which little is left."""
    pieces = sorted([b" ", b" a", b"a", b"aa"])
    logs = np.log(np.array([0.1, 0.3, 0.2, 0.2]))
    model = m.Pieces(pieces, logs, math.log(0.2))
    sums = np.exp(m.Lattice(pieces, logs).log_probabilities([b"a" * n for n in range(0, 60)])) * model.word_factor()
    # The vocabulary here also spells the empty word.
    assert abs(sums.sum() - 1) < 1e-3


def test_nulls_long_words_repeats_and_no_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "x" * 5000, 0), (4, "Ünïcode 語 \U0001f600", 0), (4, "Ünïcode 語 \U0001f600", 0), (None, "THE the The", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    from pyspark.sql import functions as F

    train = F.coalesce(F.col("doc_id") != 3, F.lit(True))
    out = m.score_documents(df, train, VOCABULARY, head_words=2).collect()
    assert len(out) == 6 and all(math.isfinite(r["score"]) and r["score"] < 0 and math.isfinite(r["piece_score"]) for r in out)
    assert [(r["n_tokens"], r["n_known"]) for r in sorted(out, key=lambda r: str(r["doc_id"]))] == [(1, 1), (1, 1), (2, 1), (4, 4), (4, 4), (4, 4)]
    none = m.score_documents(df, F.lit(False), VOCABULARY).collect()
    assert {r["n_known"] for r in none} == {0} and {r["train_tokens"] for r in none} == {0} and all(math.isfinite(r["score"]) for r in none)
    assert m.score_documents(df.limit(0), train, VOCABULARY).count() == 0
