"""Language-model scores from a subword lattice.

The pieces of an existing vocabulary are the words of a unigram model. A text's probability is the sum over all its
segmentations into pieces of the product of the pieces' probabilities, times that of the end. Pieces never reach over
a word's start, so the sum is a product over words, and each distinct word is summed once by a forward recursion in
log space. The existing scores weight the segmentations at first; expectation-maximisation over the counts of all
training words then learns the weights, with the existing ones as prior (`piece_score` is the sum of this lattice).

`score` adds one arc to each word of the training texts: the whole word, by its discounted count. What the discounts
leave goes to the lattice of pieces, normalised over words, so the model is a distribution over texts. Without these
arcs a memoryless piece model spells every frequent word anew and scores below the word unigram.

Words are runs of other characters than space and 0x09-0x0D, A-Z lowered; each text ends with one end token. For
comparison every text also has the score of a smoothed word unigram (`base_score`).

Counts cover all training texts and are shuffled by word. The most frequent words' scores, `HEAD_WORDS` at most, go to
every task; all other words of a text are joined with the word table.

Defined results: a null text counts as empty and scores its end token; words with characters outside the vocabulary
are spelled in bytes, so every text has a probability; a null id counts as empty text in the fold and is scored like
any row; with nothing to learn from, the existing scores stand and no token is known; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import worker_held
from fleetline.session import staged

ROUNDS = 3
#: Taken off each training word's count for the lattice of pieces.
DISCOUNT = 0.75
#: Words whose scores every task holds; the others are joined.
HEAD_WORDS = 1 << 17
#: Distinct words that a task counts before it hands them on.
COUNTED_WORDS = 400_000
#: Weight of the existing scores against the corpus, in pieces.
PRIOR = 1000.0
#: Words up to this many bytes are summed together in arrays.
SHORT = 64
#: Per word: the smoothed unigram, the model with whole-word arcs, the lattice of pieces alone (log10).
SCORES = ("base", "log", "piece")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


# ---- vocabulary and lattice ----

def existing_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a leading space marks a word's start) and their probabilities from the file's scores.

    Log probabilities are used as they are; whole-number scores are ranks, whose probabilities follow Zipf's law.
    Pieces that cannot occur in lowered words are left out, and every byte is a piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece == piece.lower() and b" " not in piece[1:]:
            found[piece] = model.get_score(i)
    pieces = sorted(found)
    scores = np.array([found[p] for p in pieces])
    weights = 1 / (2.7 - scores) if (scores == np.round(scores)).all() else np.exp(scores)
    table = dict(zip(pieces, weights))
    for byte in range(256):
        table.setdefault(bytes((byte,)), weights.min() / 10)
    pieces = sorted(table)
    weights = np.array([table[p] for p in pieces])
    return pieces, weights / weights.sum()


class Trie:
    """Pieces as a table of steps from state to state; a worker makes it once for each vocabulary."""

    def __init__(self, pieces: list[bytes]):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces))
        children: list[dict[int, int]] = [{}, {}]  # state 0 is dead, 1 the root
        piece_at = [-1, -1]
        for i, piece in enumerate(pieces):
            state = 1
            for byte in piece:
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    piece_at.append(-1)
                state = children[state][byte]
            piece_at[state] = i
        used = sorted({b for c in children for b in c})
        self.kind = np.zeros(256, dtype=np.int64)
        self.kind[used] = np.arange(len(used))
        self.step = np.zeros((len(children), len(used)), dtype=np.int32)
        for state, following in enumerate(children):
            for byte, to in following.items():
                self.step[state, self.kind[byte]] = to
        self.piece_at = np.array(piece_at)


class Lattice:
    """Sums over all segmentations of words, for piece log probabilities (natural)."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        key = hashlib.sha1(b"".join(b"%d:%s" % (len(p), p) for p in pieces)).hexdigest()
        self.logs, self.trie = logs, worker_held(f"trie {key}", lambda: Trie(pieces))

    def _arcs(self, kinds: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of every piece that occurs, for words of one length as rows of byte kinds."""
        arcs, width, trie = [], kinds.shape[1], self.trie
        for start in range(width):
            rows, state = np.arange(len(kinds)), np.ones(len(kinds), dtype=np.int64)
            for end in range(start, min(width, start + trie.longest)):
                state = trie.step[state, kinds[rows, end]]
                alive = state > 0
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                piece = trie.piece_at[state]
                whole = piece >= 0
                if whole.any():
                    arcs.append((start, end + 1, rows[whole], piece[whole]))
        return arcs

    def _same_length(self, words: list[bytes]) -> tuple[np.ndarray, list, np.ndarray]:
        raw = np.frombuffer(b"".join(b" " + w for w in words), np.uint8).reshape(len(words), -1)
        arcs = self._arcs(self.trie.kind[raw])
        forward = np.full((raw.shape[1] + 1, len(words)), -np.inf)
        forward[0] = 0
        for start, end, rows, piece in arcs:
            forward[end, rows] = np.logaddexp(forward[end, rows], forward[start, rows] + self.logs[piece])
        return forward[-1], arcs, forward

    def _long(self, word: bytes) -> tuple[float, list, list[float]]:
        """One word of any length; arcs as (start, end, piece)."""
        data, arcs = b" " + word, []
        forward = [0.0] + [-math.inf] * len(data)
        for start in range(len(data)):
            for end in range(start + 1, min(len(data), start + self.trie.longest) + 1):
                piece = self.trie.index.get(data[start:end])
                if piece is not None:
                    arcs.append((start, end, piece))
                    forward[end] = float(np.logaddexp(forward[end], forward[start] + self.logs[piece]))
        return forward[-1], arcs, forward

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for rows, part in _by_length(words):
            if len(part[0]) > SHORT:
                out[rows] = [self._long(w)[0] for w in part]
            else:
                out[rows] = self._same_length(part)[0]
        return out

    def expected_pieces(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations of all words, each word `counts` times."""
        total = np.zeros(len(self.logs))
        for rows, part in _by_length(words):
            if len(part[0]) > SHORT:
                for row, word in zip(rows, part):
                    whole, arcs, forward = self._long(word)
                    backward = [-math.inf] * (len(forward) - 1) + [0.0]
                    for start, end, piece in reversed(arcs):
                        backward[start] = float(np.logaddexp(backward[start], backward[end] + self.logs[piece]))
                        total[piece] += counts[row] * math.exp(forward[start] + self.logs[piece] + backward[end] - whole)
            else:
                whole, arcs, forward = self._same_length(part)
                weight = counts[rows]
                backward = np.full(forward.shape, -np.inf)
                backward[-1] = 0
                for start, end, at, piece in reversed(arcs):
                    arc = self.logs[piece] + backward[end, at]
                    backward[start, at] = np.logaddexp(backward[start, at], arc)
                    np.add.at(total, piece, weight[at] * np.exp(forward[start, at] + arc - whole[at]))
        return total


def _by_length(words: list[bytes], most: int = 8192) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Positions and words of one length at a time, no more than `most` of them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        for at in range(0, len(group), most):
            rows = group[at:at + most]
            if len(rows):
                yield rows, [words[i] for i in rows.tolist()]


@dataclass(frozen=True)
class Pieces:
    """The model: pieces, their log probabilities, and that of the end of a text."""

    pieces: list[bytes]
    logs: np.ndarray
    end_log: float

    def word_factor(self) -> float:
        """Makes lattice sums a distribution over words: first pieces start with the space, and a word ends where the
        next piece has a space or the text ends."""
        starts = float(sum(math.exp(log) for piece, log in zip(self.pieces, self.logs) if piece.startswith(b" ")))
        return (starts + math.exp(self.end_log)) / starts

    def lattice(self) -> Lattice:
        return Lattice(self.pieces, self.logs)


# ---- counts and training ----

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in training rows; words of other rows count zero."""
    seen: dict[bytes, int] = {}
    get = seen.get

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])
        seen.clear()
        return batch

    for batch in batches:
        texts, train = batch.column(0), batch.column(1)
        for at in range(0, len(texts), 256):
            for text, learn in zip(texts.slice(at, 256).to_pylist(), train.slice(at, 256).to_pylist()):
                if learn:
                    for word in words_of(text):
                        seen[word] = get(word, 0) + 1
                else:
                    for word in set(words_of(text)):
                        seen.setdefault(word, 0)
                if len(seen) > COUNTED_WORDS:
                    yield out()
    yield out()


def word_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """(word, c): every word of every text, and how often it occurs in training texts."""
    rows = docs.select(F.col(text_col).alias("text"), train.alias("train"))
    return rows.mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train_pieces(words: DataFrame, texts: int, path: str, rounds: int = ROUNDS) -> Pieces:
    """Learns piece probabilities from a (word, c) table of `texts` texts; what comes to the driver is one row a piece."""
    pieces, prior = existing_vocabulary(path)
    model = Pieces(pieces, np.log(prior), 0.0)
    learned = words.filter("c > 0")
    for _ in range(rounds):
        current = model

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = current.lattice()
            total = np.zeros(len(current.logs))
            for batch in batches:
                total += lattice.expected_pieces(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

        counts = np.zeros(len(pieces))
        for piece, n in learned.mapInArrow(expected, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[piece] = n
        whole = counts.sum() + PRIOR + texts + 1
        model = Pieces(pieces, np.log((counts + PRIOR * prior) / whole), math.log((texts + 1) / whole))
    return model


# ---- scores ----

def score_documents(docs: DataFrame, train: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                    head_words: int = HEAD_WORDS) -> DataFrame:
    """One row a document: id, learned_from, n_tokens, n_known, train_tokens, base_score, score, piece_score (log10)."""
    words = staged(word_counts(docs, text_col, train), "words")
    texts = docs.filter(train).count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, kinds = total + texts, distinct + (texts > 0)
    model = train_pieces(words, texts, vocabulary)
    below = math.log10(tokens + 0.5 * (kinds + 1))
    # Half a token more for unseen words and for the end, so that all is defined with nothing to learn from.
    spelled = math.log(DISCOUNT * distinct + 0.5) + math.log(model.word_factor())

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model.lattice()
        for batch in batches:
            counts = batch.column(1).to_numpy()
            logs = lattice.log_probabilities(batch.column(0).to_pylist())
            with np.errstate(divide="ignore"):
                whole = np.logaddexp(np.log(np.maximum(counts - DISCOUNT, 0)), spelled + logs) - math.log(tokens + 1)
            columns = (np.log10(counts + 0.5) - below, whole / math.log(10), logs / math.log(10))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *map(pa.array, columns)], names=["word", "c", *SCORES])

    scored = staged(words.mapInArrow(word_scores, "word binary, c long, base double, log double, piece double"), "scored")
    # The head ends at a quantile of the counts, so each of its words comes to the driver once, from one task.
    n_words = words.count()
    share = 1 - head_words / max(n_words, 1)
    least = scored.agg(F.percentile_approx("c", share, 100_000)).first()[0] if share > 0 else -1
    top = scored.filter(F.col("c") > least).collect()
    head = {bytes(r["word"]): (*(r[s] for s in SCORES), r["c"] > 0) for r in top}
    end = (math.log10(texts + 0.5) - below, math.log10((texts + 0.5) / (tokens + 1)), model.end_log / math.log(10), texts > 0)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"row long, id {id_type}, learned_from boolean, n_tokens long, n_known long, base double, log double, "
              "piece double, rest array<struct<word:binary,n:long>>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), train.alias("learned_from"), F.col(text_col).alias("text"))
    started = staged(rows.mapInArrow(lambda b: _score_head(b, head, end), schema), "head")
    rest = started.select("row", F.explode("rest").alias("w")).select("row", F.col("w.word").alias("word"), F.col("w.n").alias("n"))
    summed = rest.join(scored, "word").groupBy("row").agg(
        *[F.sum(F.col("n") * F.col(s)).alias(f"more_{s}") for s in SCORES],
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    return started.drop("rest").join(summed, "row", "left").select(
        F.col("id").alias(id_col), "learned_from", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        *[(F.col(s) + F.coalesce(f"more_{s}", F.lit(0.0))).alias(name) for s, name in zip(SCORES, ("base_score", "score", "piece_score"))])


def _score_head(batches: Iterator[pa.RecordBatch], head: dict, end: tuple) -> Iterator[pa.RecordBatch]:
    """Sums over the words of the head; the others of each text are listed with their counts."""
    for batch in batches:
        texts, sums, words, counts, offsets = batch.column(3), [], [], [], [0]
        for at in range(0, len(texts), 256):
            for text in texts.slice(at, 256).to_pylist():
                found = words_of(text)
                base, log, piece, known = end[0], end[1], end[2], int(end[3])
                for word, n in Counter(found).items():
                    entry = head.get(word)
                    if entry is None:
                        words.append(word)
                        counts.append(n)
                    else:
                        base += n * entry[0]
                        log += n * entry[1]
                        piece += n * entry[2]
                        known += n * entry[3]
                offsets.append(len(words))
                sums.append((len(found) + 1, known, base, log, piece))
        n_tokens, n_known, *values = zip(*sums) if sums else ((),) * 5
        rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
             *[pa.array(v, pa.float64()) for v in values], rest],
            names=["row", "id", "learned_from", "n_tokens", "n_known", *SCORES, "rest"])
