"""Benchmark decontamination by SimHash windows the size of each benchmark item.

Words are runs of letters and digits, lower-cased; shingles are five words (all of an item that has fewer). Windows of
an item's number of words slide over a document. A window and an item are candidates if their 64-bit SimHashes, with
shingles weighted by how often they occur, differ in at most `RADIUS` bits. Fingerprints are cut into eight blocks
with thresholds that sum to RADIUS - 7, so two within the radius agree in at least one block up to its threshold.
Candidates count as copies if the weighted Jaccard similarity (sum of smaller over sum of larger counts) is at least 0.8.

A window without any shingle of an item has similarity zero, so an item is looked for only in windows that reach over a
shingle of its own; lists of items by shingle name those pairs of window and item, and the blocks are compared on these
pairs alone. At this radius blocks by themselves would list most of a large benchmark for every window. The benchmark is
read in blocks of `BLOCK_WORDS` words, each of which is one pass over the documents; it is never cut.

Defined results: null or wordless texts and items match nothing; a document shorter than an item is one window; items
with equal texts all match; item ids keep their type; repeated rows match alike, columns beside id and text are ignored or
pass through, whatever their names; texts are read whole; an empty benchmark or table matches nothing.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.llm.common import own_name

WORDS, SIMILARITY, RADIUS = 5, 0.8, 20
BLOCKS, BLOCK_BITS = 8, 8
#: Benchmark words held by a task at once.
BLOCK_WORDS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
#: Pairs of window and item compared at once.
PAIRS = 1 << 20


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingle_hashes(words: list[str], size: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + size])) for i in range(len(words) - size + 1)], dtype=np.uint64)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _mark(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of signs: a bit is one if its sum is positive."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two counts of shingles."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (a.total() + b.total() - shared) if shared else 0.0


def thresholds(radius: int = RADIUS) -> list[int]:
    """One for each block; they sum to radius - blocks + 1 and differ by one at most."""
    total = radius - BLOCKS + 1
    return [total // BLOCKS + (i < total % BLOCKS) for i in range(BLOCKS)]


def near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints a[i] and b[i] are within the radius: some block is within its threshold, and then the whole."""
    blocks = np.bitwise_count((a ^ b).view(np.uint8).reshape(-1, BLOCKS))
    out = (blocks <= np.array(thresholds(radius))).any(axis=1)
    out[out] = blocks[out].sum(axis=1, dtype=np.int64) <= radius
    return out


class Lists:
    """Values by key in two flat arrays: those of the k-th key from `bounds[k]` to before `bounds[k + 1]`."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.bounds, self.values = np.append(first, len(keys)), values[order]

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `keys`, value) for all values of all keys that are known."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == keys)
        first, n = self.bounds[at[place]], (self.bounds[at[place] + 1] - self.bounds[at[place]])
        return np.repeat(place, n), self.values[_ranges(first, n)]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Benchmark:
    """Items as flat arrays: ids, lengths in words, fingerprints, shingle hashes, and lists of items by shingle."""

    def __init__(self, rows: list[tuple], radius: int = RADIUS, least: float = SIMILARITY):
        self.radius, self.least = radius, least
        self.vocabulary: dict[str, int] = {}
        self.ids, lengths, marks, hashes = [], [], [], []
        codes: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            size = min(WORDS, len(words))
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
            own = np.unique(self._codes(numbers, size))
            codes[size][0].append(own)
            codes[size][1].append(np.full(len(own), len(self.ids), dtype=np.int64))
            found = shingle_hashes(words, size)
            hashes.append(found)
            marks.append(_mark(_signs(found).sum(axis=0)[None])[0])
            lengths.append(len(words))
            self.ids.append(item_id)
        self.lengths, self.marks = np.array(lengths, dtype=np.int64), np.array(marks, dtype=np.uint64)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.ends = np.cumsum([len(h) for h in hashes])
        self.lists = {size: Lists(np.concatenate(c), np.concatenate(i)) for size, (c, i) in codes.items()}

    @staticmethod
    def _codes(numbers: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of vocabulary words."""
        n = len(numbers) - size + 1
        out = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (numbers[k:k + n] + 1).astype(np.uint64)
        return out

    def shingles(self, item: int) -> Counter:
        end = int(self.ends[item])
        return Counter(self.hashes[end - max(int(self.lengths[item]) - WORDS + 1, 1):end].tolist())

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, best similarity) of every item that some window of the text copies."""
        words = words_of(text)
        numbers = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        best: dict[int, float] = {}
        for size, lists in self.lists.items():
            if len(words) < size:
                continue
            known = np.convolve(numbers >= 0, np.ones(size, int), "valid") == size
            places = np.flatnonzero(known)
            at, item = lists.found(self._codes(numbers, size)[places])
            if not len(at):
                continue
            # Windows of the item's length over the shared shingle.
            last = np.maximum(len(words) - self.lengths[item], 0)
            first = np.minimum(np.maximum(places[at] - (self.lengths[item] - size), 0), last)
            n = np.minimum(places[at], last) - first + 1
            order = np.lexsort((first, self.lengths[item]))
            item, first, n = item[order], first[order], n[order]
            edges = np.flatnonzero(np.diff(self.lengths[item], prepend=-1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(item)]):
                for x, value in self._verified(words, size, int(self.lengths[item[a]]), item[a:b], first[a:b], n[a:b]):
                    best[x] = max(value, best.get(x, 0.0))
        out: dict = {}
        for x, value in best.items():
            out[self.ids[x]] = max(value, out.get(self.ids[x], 0.0))
        return sorted(out.items(), key=str)

    def _verified(self, words: list[str], size: int, length: int, item: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        """Pairs of one window length, by runs of neighbouring windows that share one running sum of signs."""
        reach = np.maximum.accumulate(first + n)
        gap = np.flatnonzero(first[1:] > reach[:-1] + length) + 1
        full = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1
        cuts = np.unique(np.concatenate(([0], gap, full, [len(first)]))).tolist()
        for a, b in zip(cuts, cuts[1:]):
            low, high = int(first[a]), int((first[a:b] + n[a:b]).max()) - 1
            part = words[low:high + length]
            hashes = shingle_hashes(part, size)
            width = min(length, len(part)) - size + 1
            pairs = np.unique(np.column_stack([_ranges(first[a:b], n[a:b]) - low, np.repeat(item[a:b], n[a:b])]), axis=0)
            for start in range(0, high - low + 1, 4096):  # signs of a stretch at a time
                own = pairs[(pairs[:, 0] >= start) & (pairs[:, 0] < start + 4096)]
                signs = _signs(hashes[start:start + 4096 + width])
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(signs, axis=0)))
                window = own[:, 0] - start
                windows, back = np.unique(window, return_inverse=True)
                marks = _mark(sums[windows + width] - sums[windows])
                close = near(marks[back], self.marks[own[:, 1]], self.radius)
                for at, x in own[close].tolist():
                    value = similarity(Counter(hashes[at:at + width].tolist()), self.shingles(x))
                    if value >= self.least:
                        yield x, value


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """The benchmark's (id, text) rows in blocks of about `block_words` words, one at a time on the driver."""
    words = benchmark.agg(F.sum(F.size(F.split(text_col, r"\s+")))).first()[0] or 0
    parts = max(1, -(-words // block_words))
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(parts))
    for k in range(parts):
        yield [tuple(r) for r in benchmark.filter(block == k).select(id_col, text_col).collect()]


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item_id, similarity): every row of `df` with every benchmark item of which a window is a copy."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))
    out = None
    for block in benchmark_blocks(benchmark, block_words=block_words):
        items = Benchmark(block)
        found = rows.select(id_col, F.explode(_matches(items, benchmark)("_text")).alias("m")).select(id_col, "m.item_id", "m.similarity")
        out = found if out is None else out.unionByName(found)
    return out


def _matches(items: Benchmark, benchmark: DataFrame, id_col: str = "item_id"):
    @F.pandas_udf(f"array<struct<item_id:{benchmark.schema[id_col].dataType.simpleString()},similarity:double>>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"item_id": i, "similarity": s} for i, s in items.matches(t)])

    return of


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `df` that copy no benchmark item."""
    for block in benchmark_blocks(benchmark):
        name = own_name(df, "_matches")
        df = df.withColumn(name, _matches(Benchmark(block), benchmark)(text_col)).filter(F.size(name) == 0).drop(name)
    return df
