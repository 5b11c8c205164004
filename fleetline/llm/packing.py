"""Packing of tokenized documents into fixed-length training sequences by bounded-space online best fit.

Each task tokenizes its rows and places the pieces as they come into a fixed number of open sequences. A bitset has
one bit for each free space that some open sequence has, so the tightest fit is the lowest set bit at or above the
piece's length. When a new sequence is needed and none may be opened, the fullest closes first. Sequences still open
when a task ends are packed together once more, as blocks, across tasks. Only those rows are shuffled.

Only documents longer than a sequence are cut: the first piece takes the remainder, the others fill a sequence each.
Defined results: a null text counts as empty; an empty text is its end token alone; ids of repeated rows repeat;
texts that spell a special token are ordinary text; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import BATCH_BYTES, worker_held
from fleetline.session import new_run_dir

CAPACITY, OPEN_SEQUENCES = 1024, 256
#: Distinct text chunks whose ids a Python worker remembers, and the code points of the longest of them.
REMEMBERED_CHUNKS, REMEMBERED_LENGTH = 1 << 17, 64
#: Half-filled sequences that one task packs together at the end.
BLOCKS_PER_TASK = 1 << 16

_WHITE = "".join(filter(str.isspace, map(chr, range(0x3001))))
# Texts that are not cut at spaces: one stands before other white space or at the end. The tokenizer never joins across
# a space that anything else follows, and that space belongs to what follows.
_UNCUT = f" (?:[{_WHITE}]|\\z)"


class ChunkEncoder:
    """Token ids of texts as little-endian 32-bit bytes; ids of chunks that occur again are remembered.

    A text is cut at spaces before words, which changes no id. Each different chunk of a batch is looked up once; those
    not remembered are encoded by one call, and a token that begins with a space begins the next chunk. `ranks` is the
    same vocabulary in the form of the faster library; without it the `tokenizers` file encodes them,
    and it encodes what that library cannot.
    """

    def __init__(self, path: str, ranks: str | None = None):
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            fast = tiktoken.Encoding(
                "chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_to_numpy

            def encode_chunk(chunk: str) -> np.ndarray:
                try:
                    return fast(chunk)
                except ValueError:  # its pattern gives up on hundreds of thousands of white space characters in a row
                    return _ids(_tokenizer(path), chunk)

            self.encode_chunk = encode_chunk
            spaced = {i: token.startswith(b" ") for token, i in merges.items()}
        else:
            tokenizer = _tokenizer(path)
            self.encode_chunk = lambda chunk: _ids(tokenizer, chunk)
            # Byte-level vocabularies write a space as this letter.
            spaced = {i: token.startswith("\u0120") for token, i in tokenizer.get_vocab().items()}
        #: Whether a token begins with a space, by id.
        self.spaced = np.array([spaced.get(i, False) for i in range(max(spaced) + 1)])
        #: Numbers of remembered chunks, by chunk without the space before it; chunk n has ids[bounds[n]:bounds[n + 1]].
        self.known: dict[str, int] = {}
        self.ids, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int32)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.StringArray) -> list[bytes]:
        uncut = pc.match_substring_regex(texts, _UNCUT)
        cut_ids = iter(self._of_cut(texts.filter(pc.invert(uncut))))
        return [self.encode_chunk(texts[i].as_py()).astype("<u4", copy=False).tobytes() if whole else next(cut_ids)
                for i, whole in enumerate(uncut.to_pylist())]

    def _of_cut(self, texts: pa.StringArray) -> list[bytes]:
        parts = pc.split_pattern(texts, " ")
        chunks, at = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        later = np.ones(len(chunks), bool)
        later[at[:-1]] = False
        firsts = chunks.take(pa.array(at[:-1])).to_pylist()
        coded = chunks.filter(pa.array(later)).dictionary_encode()
        number = coded.indices.to_numpy()
        source, begins, sizes = self._of_different(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), number)
        ids, ends = _gathered(source, begins[number], sizes[number])
        # A text's chunks but the first are the others of those before it.
        bounds = np.concatenate([[0], ends])[at - np.arange(len(at))].tolist()
        return [(self.encode_chunk(first).astype("<u4", copy=False).tobytes() if first else b"") + ids[i:j].tobytes()
                for first, i, j in zip(firsts, bounds, bounds[1:])]

    def _of_different(self, chunks: list[str], number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each chunk where its own begin and how many there are; `number` has their occurrences."""
        found = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int32, len(chunks))
        new = np.flatnonzero(found < 0)
        ids = self.encode_chunk(" ".join(["", *map(chunks.__getitem__, new.tolist())])).astype("<u4", copy=False)
        starts = np.flatnonzero(self.spaced[ids]).astype(np.int32)
        begins, sizes = self.bounds[found], np.diff(self.bounds, append=np.int32(0))[found]
        begins[new], sizes[new] = starts + np.int32(len(self.ids)), np.diff(starts, append=np.int32(len(ids)))
        source = np.concatenate([self.ids, ids])
        again = [i for i in new[np.bincount(number, minlength=len(chunks))[new] > 1].tolist()
                 if len(chunks[i]) <= REMEMBERED_LENGTH][:REMEMBERED_CHUNKS - len(self.known)]
        if again:
            kept, ends = _gathered(source, begins[again], sizes[again])
            self.known.update(zip([chunks[i] for i in again], range(len(self.known), len(self.known) + len(again))))
            self.bounds = np.concatenate([self.bounds, ends + np.int32(len(self.ids))])
            self.ids = np.concatenate([self.ids, kept])
        return source, begins, sizes


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _ids(tokenizer, chunk: str) -> np.ndarray:
    return np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, np.uint32)


def _gathered(source: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `source` one after another, and where each ends."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return source[np.repeat(begins - ends + sizes, sizes) + np.arange(sizes.sum(), dtype=np.int32)], ends


def worker_encoder(path: str, ranks: str | None) -> ChunkEncoder:
    return worker_held(f"chunks of {path} {ranks}", lambda: ChunkEncoder(path, ranks))


class OpenSequences:
    """Bounded-space best fit. `place` returns the sequence and offset of an item and the sequences it closed."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.opened, self.count = capacity, most, 0, 0
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}

    def _add(self, free: int, sequence: int) -> None:
        self.by_free.setdefault(free, []).append(sequence)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> int:
        waiting = self.by_free[free]
        sequence = waiting.pop()
        if not waiting:
            self.bits &= ~(1 << free)
        self.count -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int, list[int]]:
        closed = []
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count == self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            sequence, free = self.opened, self.capacity
            self.opened += 1
        if free > length:
            self._add(free - length, sequence)
        else:
            closed.append(sequence)
        return sequence, self.capacity - free, closed


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes the remainder."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pack_documents(df: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                   capacity: int = CAPACITY, open_sequences: int = OPEN_SEQUENCES) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids (little-endian 32-bit), sequence_id, offset.

    Tokenized pieces are written to the shared folder once. Those of closed sequences are final; the others join the
    table that says where their block went.
    """
    pieces = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = pieces.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, piece int, start long, length long, ids binary, sequence_id long, offset long, open boolean, filled long"
    path = new_run_dir(df.sparkSession, "pieces")
    pieces.mapInArrow(lambda b: _pack_task(b, vocabulary, ranks, end_id, capacity, open_sequences), schema).write.parquet(path)
    stored = df.sparkSession.read.schema(schema).parquet(path)
    # One row of each open sequence carries what it holds.
    blocks = stored.filter("filled IS NOT NULL").select("sequence_id", "filled")
    tasks = max(1, -(-blocks.count() // BLOCKS_PER_TASK))
    moves = blocks.repartition(tasks, "sequence_id").sortWithinPartitions(F.desc("filled"), "sequence_id").mapInArrow(
        lambda b: _pack_blocks(b, capacity), "sequence_id long, target long, shift long")
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids"]
    final = stored.filter("NOT open").select(*columns, "sequence_id", "offset")
    moved = stored.filter("open").join(moves, "sequence_id").select(
        *columns, F.col("target").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return final.unionByName(moved)


def _stretches(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Rows of at most BATCH_BYTES of text beside their first."""
    filled = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // BATCH_BYTES
    return pairwise([0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(texts)])


def _pack_task(batches: Iterator[pa.RecordBatch], vocabulary: str, ranks: str | None, end_id: int, capacity: int,
               most: int):
    encoder, bins = worker_encoder(vocabulary, ranks), OpenSequences(capacity, most)
    base, end = TaskContext.get().partitionId() << 33, struct.pack("<I", end_id)
    waiting: dict[int, list[tuple]] = {}
    id_type = None
    for batch in batches:
        id_type, done = batch.schema.field(0).type, []
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for i, j in _stretches(texts):
            for doc, data in zip(ids[i:j], encoder.encode_all(texts.slice(i, j - i))):
                data += end
                for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    sequence, offset, closed = bins.place(length)
                    waiting.setdefault(sequence, []).append(
                        (doc, k, start, length, data[4 * start:4 * (start + length)], base + sequence, offset))
                    for c in closed:
                        done += [(*row, False, None) for row in waiting.pop(c)]
        yield _batch(done, id_type)
    left = []
    for rows in waiting.values():
        filled = sum(row[3] for row in rows)
        left += [(*row, True, filled if i == 0 else None) for i, row in enumerate(rows)]
    if left:
        yield _batch(left, id_type)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ("id", "piece", "start", "length", "ids", "sequence_id", "offset", "open", "filled")
    types_ = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types_)], names=list(names))


def _pack_blocks(batches: Iterator[pa.RecordBatch], capacity: int):
    """Blocks come largest first. Targets are negative, so they never meet the numbers of closed sequences."""
    bins, base = OpenSequences(capacity, 1 << 62), TaskContext.get().partitionId() << 33
    for batch in batches:
        placed = [bins.place(filled) for filled in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([-1 - base - p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())],
            names=["sequence_id", "target", "shift"])


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: its ids in order as one binary value, and its length in tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))
