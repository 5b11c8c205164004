"""Packed sequences against the tokenizer and against the rules of a packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetline.llm import packing, queries

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(VOCABULARY)
    found.encode_special_tokens = True
    return found


def test_whole_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    coded = tokenizer.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False)
    ids = {r["doc_id"]: [*c.ids, 2] for r, c in zip(docs, coded)}
    rows = queries.queries()["op7_packing"](spark, sf_dir).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(part)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        assert [(s, n) for _, s, n in sorted(pieces)] == packing.cut(len(ids[doc]), 1024)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= 1.04 * -(-total // 1024)


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_chunks_give_the_same_ids_as_whole_texts(tokenizer, ranks):
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "  x ", " a b\nc", "\n\n a\n b  \t c ", "<|endoftext|> hi", "don't 's 'LL a's 12 3a",
             "\x1c a\x1cb c", "a b   c", "é​ü x", "x\u0085y z", "a \nb", "a  b", "日本 語 text", "퟿ \U0001f600 !"]
    encoder = packing.ChunkEncoder(VOCABULARY, ranks)
    for _ in range(2):
        for text in texts:
            got = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
            assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_batches_of_random_texts_give_the_ids_of_whole_texts(tokenizer, ranks):
    rng, white = random.Random(7), [c for c in map(chr, range(0x3001)) if c.isspace()]
    spaced = [f"a {c}{d}b" for c in [*white, "\u180e", "\u200b", "\ufeff", ""] for d in ("", " ", "\n", c)]
    parts = ["a", "the", "\u00e9t\u00e9", "'s", "12", "!?", "\u65e5", "x" * 70, "\U0001f600", "", "", "\n", "\t", " ", "\u00a0", "\x1c"]
    words = [" ".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(600)]
    glued = ["".join(rng.choice([*parts, " "]) for _ in range(12)) for _ in range(600)]
    texts = spaced + words + glued + [" ".join(rng.choices(parts[:9], k=30)) for _ in range(200)]
    encoder, rows = packing.ChunkEncoder(VOCABULARY, ranks), pa.array(texts)
    got = [ids for at in range(0, len(texts), 97) for ids in encoder.encode_all(rows.slice(at, 97))]
    assert len(got) == len(texts) and encoder.known
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.encode_all(rows.slice(3, 0)) == []


def test_chunks_that_are_not_remembered_are_encoded_together():
    encoder, calls = packing.ChunkEncoder(VOCABULARY, RANKS), []
    encode = encoder.encode_chunk
    encoder.encode_chunk = lambda chunk: calls.append(chunk) or encode(chunk)
    encoder.encode(" ".join(f"word{i}," for i in range(1000)))
    assert len(calls) <= 3


def test_white_space_without_end(spark, tokenizer):
    texts = ["one two two", "a" + " " * 1_000_000 + "b", "x y" + "\n" * 1_000_000 + "z", "last two"]
    encoder = packing.ChunkEncoder(VOCABULARY, RANKS)
    for text, ids in zip(texts, encoder.encode_all(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = packing.pack_documents(df, VOCABULARY, RANKS)
    assert packed.agg({"length": "sum"}).first()[0] == sum(
        len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts)


def test_remembered_chunks_stay_few_and_short(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_CHUNKS", 5)
    encoder = packing.ChunkEncoder(VOCABULARY, RANKS)
    text = " ".join(["z" * 100] * 2 + [f"w{i % 40}" for i in range(200)])
    for _ in range(2):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) == 5 and max(map(len, encoder.known)) < 10


def test_stretches_hold_all_rows_and_little_text(monkeypatch):
    monkeypatch.setattr(packing, "BATCH_BYTES", 100)
    sizes = [0, 30, 30, 60, 500, 10, 0, 99, 100, 1]
    found = list(packing._stretches(pa.array(["x" * n for n in sizes])))
    assert [row for i, j in found for row in range(i, j)] == list(range(len(sizes)))
    # Beside the first text of a stretch, which may be long.
    assert all(sum(sizes[i + 1:j]) <= 100 for i, j in found)
    assert [j - i for i, j in packing._stretches(pa.array([], pa.string()))] == [0]


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = packing.OpenSequences(10, 2)
    assert bins.place(6) == (0, 0, [])
    assert bins.place(7) == (1, 0, [])
    assert bins.place(3) == (1, 7, [1])
    assert bins.place(8) == (2, 0, [])
    assert bins.place(9) == (3, 0, [2])
    assert bins.place(4) == (0, 6, [0])


def test_round_trip_nulls_long_texts_and_no_rows(spark, tokenizer):
    rows = [(1, None, 0), (None, "", 0), (2, "word " * 30_000, 0), (2, "again", 0), (2, "again", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    packed = packing.pack_documents(df, VOCABULARY, RANKS).collect()
    assert sum(r["length"] for r in packed) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    long = sorted((r["start"], r["ids"]) for r in packed if r["doc_id"] == 2 and (r["piece"] or r["length"] > 10))
    assert tokenizer.decode(np.frombuffer(b"".join(i for _, i in long), "<u4").tolist()[:-1]) == rows[2][1]
    assert packing.pack_documents(df.limit(0), VOCABULARY, RANKS).count() == 0


def test_sequences_hold_their_pieces_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    packed = packing.pack_documents(docs, VOCABULARY, RANKS).cache()
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        at = 4 * r["offset"]
        assert whole[r["sequence_id"]][at:at + 4 * r["length"]] == bytes(r["ids"])
