"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct word shingles. Documents with equal sets are one node. A node has `BANDS` values, each
of `BAND_HASHES` least hashes of its shingles, and a signature of one bit for each of `SIGNATURE` least hashes: two sets
agree in a least hash with their similarity, in a bit with (1 + similarity) / 2. Nodes that share a band value are
candidates. Their signatures are compared word by word (64 bits), and after each word a candidate is dropped if, by the
posterior given the bits that agree so far, it reaches the asked similarity with odds below `MISS`. What survives is
verified on the whole sets.

Only links between different groups are of use, so there are three steps, each written to the shared folder:
1. In each bucket the node nearest to the majority signature is the hub; nodes that survive a comparison with it are its
   candidates, and the next of the rest is the next hub. A bucket gives fewer candidates than it has nodes. They are
   verified, and links make groups. Buckets of more than `CROWD` nodes are cut into chunks for this, and once more with
   one node of each group, so that chunks of one group become one.
2. In buckets that still hold several groups all survivors of different groups are candidates. A bucket of up to `SMALL`
   nodes lists its pairs for verification.
3. Larger buckets get the texts of the nodes that have such survivors, and verify in place: what is linked already is not
   compared again, and only links leave the task, fewer than there are nodes. Every two chunks of a crowd meet in a task.
After these, every pair of a bucket that may be alike is verified or lies inside one group. Members of a hub are verified in
runs of `RUN`, each with one copy of the hub's text.

Defined results: shingles are taken from the whole A-Z-lowered text, the whole sequence if it has fewer words; null,
empty and blank texts have no set and are linked with nothing; a null id takes part, but names a group only if all of its
ids are null; repeated rows are all returned; columns beside id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetline.llm.components import components
from fleetline.session import staged

WORDS, PERCENT, SEED = 3, 85, 42
#: Pairs at 85 percent share no band with odds of (1 - 0.85 ** 7) ** 24, less than 1 in 10,000.
BAND_HASHES, BANDS = 7, 24
SIGNATURE = 512
HASHES = max(SIGNATURE, BAND_HASHES * BANDS)
#: Chosen odds, at each look, of dropping a pair that is as similar as asked.
MISS = 1e-5
CROWD, SMALL, RUN = 2048, 16, 64
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_KEYS = ("value", "low", "high")


# ---- sets, bands and signatures ----

def shingles(text: str, words: int = WORDS) -> set[bytes]:
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes split at 0x20 and 0x09-0x0D only
    return {b" ".join(tokens[i:i + words]) for i in range(max(len(tokens) - words + 1, min(len(tokens), 1)))}


def least_hashes(found: set[bytes]) -> np.ndarray:
    hashes = np.fromiter(map(xxhash.xxh32_intdigest, found, repeat(SEED)), np.uint32, len(found))
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(hashes), 512):
        part = hashes[at:at + 512]
        np.minimum(least, (_FACTORS[:, None] * part + _OFFSETS[:, None]).min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    values = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in least[:BANDS * BAND_HASHES].reshape(BANDS, BAND_HASHES).T.astype(np.uint64):
        values = (values ^ part) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
    return values


def signature(least: np.ndarray) -> bytes:
    return np.packbits((least[:SIGNATURE] * np.uint32(0x85EBCA6B)) >> np.uint32(31)).tobytes()


def _described(text: str, words: int) -> tuple:
    """Digest of the set, its size, band values and signature; None, 0, None, None for no set."""
    found = shingles(text, words)
    if not found:
        return None, 0, None, None
    least = least_hashes(found)
    whole = xxhash.xxh3_128_digest(b"\n".join(sorted(found)))
    return whole, len(found), bands(least).view(np.int64), signature(least)


def with_sets(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, hash, digest, size, values, bits): `hash` is of the text, the rest of its set."""

    @F.pandas_udf("digest binary, size long, values array<long>, bits binary")
    def described(texts):
        import pandas as pd

        rows = [_described(t, words) for t in texts]
        return pd.DataFrame({name: [r[i] for r in rows] for i, name in enumerate(("digest", "size", "values", "bits"))})

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), described(text).alias("d")).select("id", "hash", "d.*")


# ---- posterior ----

def least_agreeing(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """For 1, 2, ... words of the signature the fewest agreeing bits with which a pair goes on.

    With a flat prior over the odds p in [0.5, 1] that a bit agrees, and m of n bits agreeing, the posterior is
    proportional to p^m (1-p)^(n-m); a pair goes on if its mass from (1 + similarity) / 2 upwards is `miss` or more.
    """
    p = np.linspace(0.5, 1, 20_001)[:-1] + 0.25 / 20_000
    alike = p >= (1 + percent / 100) / 2
    out = []
    for n in range(64, SIGNATURE + 1, 64):
        low, high = 0, n  # the mass grows with the agreeing bits, and all of them are enough
        while low < high:
            m = (low + high) // 2
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            mass = np.exp(logs - logs.max())
            low, high = (low, m) if mass[alike].sum() >= miss * mass.sum() else (m + 1, high)
        out.append(low)
    return tuple(out)


def survivors(bits: np.ndarray, i: int, at: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows `at` that may be as similar to row i as asked, and their agreeing bits."""
    agree = np.zeros(len(at), dtype=np.int64)
    for word, fewest in enumerate(least):
        agree = agree + 64 - np.bitwise_count(bits[at, word] ^ bits[i, word])
        keep = agree >= fewest
        at, agree = at[keep], agree[keep]
    return at, agree


# ---- candidates ----

def _hub_pairs(nodes: np.ndarray, bits: np.ndarray, least: tuple[int, ...]) -> list[np.ndarray]:
    """Each node but the hubs with the first hub that it may be alike to. An original comes before its copies."""
    every = np.unpackbits(bits.view(np.uint8).reshape(len(bits), -1), axis=1)
    middle = np.packbits(every.sum(axis=0, dtype=np.int64) * 2 > len(bits)).view(np.uint64)
    left, found = np.lexsort((nodes, np.bitwise_count(bits ^ middle).sum(axis=1))), []
    while len(left) > 1:
        hub, left = left[0], left[1:]
        at, _ = survivors(bits, hub, left, least)
        found.append(np.column_stack([np.full(len(at), nodes[hub]), nodes[at]]))
        left = left[~np.isin(left, at)]
    return found


def _open_pairs(nodes: np.ndarray, groups: np.ndarray, bits: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """All pairs of survivors in different groups of a small bucket; of a larger one the nodes that have any, as (node, -1)."""
    found = []
    for i in range(len(nodes)):
        at, _ = survivors(bits, i, np.flatnonzero(groups != groups[i]), least)
        if len(nodes) > SMALL:
            at = at[:1]
        found.append(np.column_stack([np.full(len(at), nodes[i]), np.full(len(at), -1) if len(nodes) > SMALL else nodes[at]]))
    pairs = np.concatenate(found)
    return pairs if len(nodes) > SMALL else np.sort(pairs, axis=1)


def _buckets(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Runs of whole buckets, each as its columns; rows come by the first `keys` columns, and a bucket may go on in the next batch."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.array(c.to_pylist(), dtype=object) if pa.types.is_binary(c.type) or pa.types.is_string(c.type)
                   else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)) + 1
        edges = [0, *new.tolist()]
        rest = [c[edges[-1]:] for c in columns]
        yield [[c[i:j] for c in columns] for i, j in zip(edges, edges[1:])]
    if rest is not None:
        yield [rest]


def _words(bits: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


def _hubs(batches: Iterator[pa.RecordBatch], least: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Pairs (hub, node) of rows (value, chunk, node, bits)."""
    for run in _buckets(batches, 2):
        found = [np.zeros((0, 2), np.int64)]
        for _, _, nodes, bits in run:
            if len(nodes) > 1:
                found += _hub_pairs(nodes, _words(bits), least)
        flat = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])


def _open(batches: Iterator[pa.RecordBatch], least: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(value, low, high, a, b) by `_open_pairs`, of rows (value, low, high, node, group, bits)."""
    for run in _buckets(batches, 3):
        found = [np.zeros((0, 5), np.int64)]
        for value, low, high, nodes, groups, bits in run:
            if (groups != groups[0]).any():
                pairs = _open_pairs(nodes, groups, _words(bits), least)
                found.append(np.column_stack([np.full(len(pairs), x[0], dtype=np.int64) for x in (value, low, high)] + [pairs]))
        flat = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(flat[:, i]) for i in range(5)], names=[*_KEYS, "a", "b"])


def _linked(batches: Iterator[pa.RecordBatch], words: int, percent: int, least: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between groups of each bucket, of rows (value, low, high, node, group, bits, text), verified in place.

    Sets are sorted 64-bit hashes of shingles, and nearest candidates come first.
    """
    for run in _buckets(batches, 3):
        links = []
        for *_, nodes, groups, bits, texts in run:
            sets, marks, now = [_hashed(t, words) for t in texts], _words(bits), groups.copy()
            for i in range(len(nodes) - 1):
                at, agree = survivors(marks, i, np.flatnonzero(now[i + 1:] != now[i]) + i + 1, least)
                for j in at[np.argsort(-agree, kind="stable")].tolist():
                    if now[i] != now[j] and _alike(sets[i], sets[j], percent):
                        links.append((nodes[i], nodes[j]))
                        now[now == now[i]] = now[j]
        flat = np.array(links, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])


def _hashed(text: str, words: int) -> np.ndarray:
    found = shingles(text, words)
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


# ---- verification ----

def _verified(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, same) of rows (a, run, b, text) in order; the row without b has the text of the hub a of the run."""
    at, hub = None, set()
    for batch in batches:
        out = []
        for a, run, b, text in zip(*(c.to_pylist() for c in batch.columns)):
            if b is None:
                at, hub = (a, run), shingles(text, words)
            elif at == (a, run):
                other = shingles(text, words)
                both = len(hub & other)
                out.append((a, b, 100 * both >= percent * (len(hub) + len(other) - both)))
            else:
                raise ValueError("the text of a hub is missing")
        columns = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "same"])


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, same) for all distinct pairs (a, b), from the texts (node, text)."""
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    placed = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).cast("int").alias("run"), "b")
    members = placed.join(texts.toDF("b", "text"), "b").select("a", "run", "b", "text")
    hubs = runs.join(texts.toDF("a", "text"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(hubs).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
    return rows.mapInArrow(lambda b: _verified(b, words, percent), "a long, b long, same boolean")


# ---- operator ----

def _chunked(rows: DataFrame, by: str, crowd: int) -> DataFrame:
    """`rows` with `chunk` and `chunks`: values that more than `crowd` rows share are cut, by a hash of the node."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / crowd).cast("int").alias("chunks"))
    return rows.join(sizes, by).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def linked_groups(sets: DataFrame, texts_of, words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """(node, component) of the nodes that have a link, from a written table (node, values, bits, ...).

    `texts_of` gives the texts (node, text) of a table of nodes.
    """
    least = least_agreeing(percent)
    met = sets.select("node", F.explode("values").alias("value"))
    shared = met.groupBy("value").count().filter("count > 1").select("value")
    placed = _chunked(met.join(shared, "value", "left_semi"), "value", crowd)
    rows = staged(placed.join(sets.select("node", "bits"), "node").select("value", "chunk", "chunks", "node", "bits"), "buckets")
    texts = staged(texts_of(rows.select("node").distinct()), "texts")

    def hub_links(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("value", "chunk", "node", "bits").repartition("value", "chunk").sortWithinPartitions("value", "chunk")
        pairs = staged(dealt.mapInArrow(lambda b: _hubs(b, least), "a long, b long").distinct(), "hubs")
        return staged(verified(pairs, texts, words, percent), "verified")

    def grouped(links: DataFrame, groups: DataFrame | None) -> DataFrame:
        if groups is not None:
            links = links.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return staged(components(links, "a", "b"), "groups")

    def named(table: DataFrame, groups: DataFrame) -> DataFrame:
        return table.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")

    tried = hub_links(rows)
    groups = grouped(tried.filter("same").select("a", "b"), None)
    crowds = rows.filter("chunks > 1")
    if not crowds.isEmpty():
        one = named(crowds.select("value", "node", "bits"), groups).groupBy("value", "group").agg(F.min(F.struct("node", "bits")).alias("m"))
        again = hub_links(_chunked(one.select("value", "m.node", "m.bits"), "value", crowd))
        groups = grouped(again.filter("same").select("a", "b"), groups)
        tried = tried.unionByName(again)

    now = staged(named(rows.select("value", "node"), groups), "named")
    open_ = now.groupBy("value").agg(F.min("group").alias("first"), F.max("group").alias("last")).filter("first < last").select("value")
    cut = _chunked(now.join(open_, "value", "left_semi"), "value", crowd).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = cut.join(sets.select("node", "bits"), "node").select(
        "value", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "node", "group", "bits")
    dealt = met.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    found = staged(dealt.mapInArrow(lambda b: _open(b, least), "value long, low long, high long, a long, b long"), "open")

    both = tried.select("a", "b").unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = found.filter("b >= 0").select("a", "b").distinct().join(both, ["a", "b"], "left_anti")
    small = verified(staged(pairs, "pairs"), texts, words, percent).filter("same").select("a", "b")
    # A node that has survivors in a large bucket goes there with its text.
    placed = found.filter("b < 0").select(*_KEYS, F.col("a").alias("node"))
    full = named(placed, groups).join(sets.select("node", "bits"), "node").join(texts, "node")
    full = full.select(*_KEYS, "node", "group", "bits", "text").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    large = full.mapInArrow(lambda b: _linked(b, words, percent, least), "a long, b long")
    return grouped(small.unionByName(large), groups)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """For each row of `df`: id, n_shingles, component_id (smallest id of its group), kept (whether that is its own id)."""
    marked = staged(with_sets(df, id_col, text_col, words), "sets")
    row = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "values", "bits")
    distinct = marked.filter("size > 0").groupBy("digest").agg(F.min(row).alias("m"))
    sets = staged(distinct.select("digest", "m.id", "m.hash", "m.values", "m.bits", F.monotonically_increasing_id().alias("node")), "nodes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """The text that each node's first row has; rows of one id and text are one."""
        wanted = sets.join(nodes, "node").select("node", F.col("id").alias("_id"), F.col("hash").alias("_hash"), "digest")
        rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
        met = rows.join(wanted, (F.col("hash") == F.col("_hash")) & F.col("id").eqNullSafe(F.col("_id")))
        return met.groupBy("node").agg(F.first("text").alias("text"))

    groups = linked_groups(sets.select("node", "values", "bits"), texts_of, words, percent, crowd)
    labelled = sets.join(groups, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("group"))
    names = labelled.join(labelled.groupBy("group").agg(F.min("id").alias("component_id")), "group").select("digest", "component_id")
    found = marked.filter("size > 0").select("id", "size", "digest").join(names, "digest").select("id", "size", "component_id")
    rest = marked.filter("size = 0").select("id", "size", F.col("id").alias("component_id"))
    return found.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
