"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits: a bit is one if more than half of the shingles' hashes have it. Texts are linked
when their fingerprints differ in `RADIUS` bits or fewer, and the links' connected components are the groups.

Search over the distinct fingerprints, all steps over all of them:
1. Correlations between bits are measured, and correlated bits are grouped into parts.
2. Any two fingerprints within radius k differ, in at least one of m parts, by no more than that part's threshold if
   the thresholds sum to k - m + 1 (a threshold of -1 leaves a part out). Collisions of each part are counted, and
   dynamic programming picks thresholds, and m, with the least estimated candidates and probe rows.
3. Each fingerprint is stored under its value in each used part and probes the values within the threshold. Only the
   fingerprint with a zero in the highest changed bit probes, so a pair of neighbouring values meets once.
4. Fingerprints that meet are compared. Of a larger bucket a task keeps only the minimum spanning tree of its links,
   never all pairs. Values that more than `CROWD` fingerprints share are cut into chunks and every two chunks meet in a
   task of their own.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a null id takes part but
is no component id unless all of its group are null (then the component id is null); repeated rows are kept; columns beside
id and text are ignored, whatever their names; an empty table gives an empty result; a text is read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetline.llm.common import own_name
from fleetline.llm.components import components
from fleetline.session import staged

BITS, RADIUS, SHINGLE_WORDS, SEED = 64, 4, 4, 42
#: Numbers of parts that the plan may choose from.
PART_COUNTS = (2, 3, 4, 5)
#: Cost of one shuffled row in comparisons of two fingerprints.
ROW_COST = 40.0
#: Fingerprints under one value beyond which the value is cut into chunks of this size.
CROWD = 8192
#: Buckets up to this size are compared by shifting whole batches against themselves.
SMALL = 24


# ---- fingerprints ----

def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of A-Z-lowered word shingles, repeats included; zero without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes split at 0x20 and 0x09-0x0D only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - size + 1
    pieces = [joined[i:j] for i, j in zip(starts[:n].tolist(), ends[size - 1:].tolist())]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, text_col: str, name: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """`df` with the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def mark(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return df.withColumn(name, mark(F.coalesce(F.col(text_col), F.lit(""))))


# ---- plan of the search ----

@dataclass(frozen=True)
class Plan:
    """Bit masks of the parts and a threshold for each."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bits_of(mask: int) -> list[int]:
    return [b for b in range(BITS) if mask >> b & 1]


def _co_occurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS))
    for batch in batches:
        marks = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
        for at in range(0, len(marks), 8192):
            bits = np.unpackbits(marks[at:at + 8192], axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
    pairs = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[0] * BITS + pairs[1]), pa.array(total[pairs].astype(np.int64))], names=["pair", "n"])


def bit_statistics(marks: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of ones of each bit, and absolute correlations between bits, over all fingerprints."""
    rows = marks.select("mark").mapInArrow(_co_occurrence, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for pair, ones in rows:
        both[pair // BITS, pair % BITS] = both[pair % BITS, pair // BITS] = ones
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    return share, related


def correlated_parts(related: np.ndarray, parts: int) -> tuple[int, ...]:
    """Masks of equal-sized parts: each grows from the most correlated free bit by the bit most correlated with it."""
    free, masks = set(range(BITS)), []
    for k in range(parts):
        size = (len(free) + parts - k - 1) // (parts - k)
        seed = max(sorted(free), key=lambda b: sum(related[b, x] for x in free))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: sum(related[b, x] for x in group))
            group.append(best)
            free.remove(best)
        masks.append(sum(1 << b for b in group))
    return tuple(masks)


def allocate(equal_pairs: list[float], shares: np.ndarray, masks: tuple[int, ...], n: int, radius: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds that sum to radius - parts + 1 at the least cost, by dynamic programming over parts.

    Pairs within threshold t of a part are estimated as its equal pairs times the elementary symmetric sums, up to
    order t, of the bits' odds of differing. Probe rows count `ROW_COST` comparisons each.
    """
    goal, n = radius - len(masks) + 1, max(n, 1)  # else an empty table could have any thresholds, and millions of probes
    agree = shares ** 2 + (1 - shares) ** 2
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for mask, pairs in zip(masks, equal_pairs):
        bits = _bits_of(mask)
        sums = [1.0] + [0.0] * radius
        for b in bits:
            odds = (1 - agree[b]) / max(agree[b], 1e-9)
            for s in range(radius, 0, -1):
                sums[s] += sums[s - 1] * odds
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for done, (cost, chosen) in best.items():
            rows = 1.0
            for t in range(-1, radius + 1):
                if t > 0:
                    rows += _choose(len(bits), t) / 2
                own = 0.0 if t < 0 else max(pairs, n * (n - 1) / 2 / 2.0 ** len(bits)) * sum(sums[:t + 1]) + ROW_COST * n * rows
                if done + t not in step or cost + own < step[done + t][0]:
                    step[done + t] = (cost + own, (*chosen, t))
        best = step
    return best[goal]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def make_plan(marks: DataFrame, radius: int = RADIUS) -> Plan:
    """Parts and thresholds for the distinct fingerprints in column `mark`."""
    n = marks.count()
    shares, related = bit_statistics(marks, n)
    options = [correlated_parts(related, m) for m in PART_COUNTS if m <= radius + 1]
    flat = [(i, j, mask) for i, masks in enumerate(options) for j, mask in enumerate(masks)]
    values = F.explode(F.array(*[F.struct(F.lit(i * 16 + j).alias("part"), F.col("mark").bitwiseAND(F.lit(signed(m))).alias("value"))
                                 for i, j, m in flat]))
    counted = marks.select(values.alias("at")).groupBy("at").count().groupBy("at.part").agg(
        F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    equal = {r["part"]: r["pairs"] for r in counted.collect()}
    costs = [(allocate([equal.get(i * 16 + j, 0.0) for j in range(len(masks))], shares, masks, n, radius), masks)
             for i, masks in enumerate(options)]
    (_, thresholds), masks = min(costs, key=lambda c: c[0][0])
    return Plan(masks, thresholds)


# ---- probe and verify ----

def _meetings(marks: DataFrame, plan: Plan) -> DataFrame:
    """(part, value, probe, mark): each fingerprint under its own value and under those that it probes."""
    places = []
    for part, (mask, threshold) in enumerate(zip(plan.masks, plan.thresholds)):
        if threshold < 0:
            continue
        own = F.col("mark").bitwiseAND(F.lit(signed(mask)))
        places.append(F.array(F.struct(F.lit(part).alias("part"), own.alias("value"), F.lit(False).alias("probe"))))
        bits = _bits_of(mask)
        flips = [(signed(sum(1 << b for b in c)), signed(1 << max(c))) for t in range(1, threshold + 1) for c in combinations(bits, t)]
        if flips:
            listed = F.array(*[F.struct(F.lit(f).alias("flip"), F.lit(h).alias("high")) for f, h in flips])
            zero = F.filter(listed, lambda x: F.col("mark").bitwiseAND(x["high"]) == 0)
            places.append(F.transform(zero, lambda x: F.struct(  # called at once, in this turn of the loop
                F.lit(part).alias("part"), own.bitwiseXOR(x["flip"]).alias("value"), F.lit(True).alias("probe"))))
    return marks.select("mark", F.explode(F.concat(*places)).alias("at")).select("at.part", "at.value", "at.probe", "mark")


def near_links(marks: DataFrame, plan: Plan, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect all distinct `mark`s within the radius."""
    met = _meetings(marks, plan)
    used = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col("mark").bitwiseAND(F.lit(signed(m))).alias("value"))
                               for p, (m, t) in enumerate(zip(plan.masks, plan.thresholds)) if t >= 0]))
    # Values with a crowd; all rows that meet there are dealt to pairs of chunks. Written, so its size is known.
    crowded = staged(marks.select(used.alias("at")).groupBy("at").count().filter(F.col("count") > crowd).select(
        "at.part", "at.value", F.ceil(F.col("count") / crowd).cast("int").alias("chunks")), "crowds")
    n_crowded = crowded.count()
    met = met.withColumns({"low": F.lit(0), "high": F.lit(0), "side": F.lit(0)})
    if n_crowded:
        chunk = F.pmod(F.xxhash64("mark"), F.col("chunks")).cast("int")
        cut = met.join(crowded, ["part", "value"]).withColumn("side", chunk).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns(
            {"low": F.least("side", "other"), "high": F.greatest("side", "other")})
        rest = met.join(crowded.select("part", "value"), ["part", "value"], "left_anti")
        columns = ["part", "value", "low", "high", "probe", "mark"]
        met = rest.select(*columns).unionByName(cut.select(*columns))
    keys = ["part", "value", "low", "high"]
    dealt = met.repartition(*keys).sortWithinPartitions(*keys, "probe").select(*keys, "probe", "mark")
    return dealt.mapInArrow(lambda b: _verify(b, radius), "a long, b long").distinct()


def _verify(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, stored ones before probes; a bucket may go on in the next batch."""
    rest = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns)]
        n = len(columns[0])
        if not n:
            continue
        new = np.ones(n, dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
        last = int(np.flatnonzero(new)[-1])
        rest = [c[last:] for c in columns]
        yield _links(new[:last], *(c[:last] for c in columns[4:]), radius)
    if rest is not None:
        new = np.zeros(len(rest[0]), dtype=bool)
        new[0] = True
        yield _links(new, *rest[4:], radius)


def _links(new: np.ndarray, probe: np.ndarray, marks: np.ndarray, radius: int) -> pa.RecordBatch:
    marks = marks.view(np.uint64)  # the bits of a negative number would be counted in its absolute value
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(new)))
    pairs = [np.zeros((0, 2), np.uint64)]
    if len(starts):
        bucket, size_of = np.cumsum(new) - 1, np.repeat(sizes, sizes)
        small = (size_of > 1) & (size_of <= SMALL) & np.repeat(~probe[starts], sizes)
        bucket, values, stored = bucket[small], marks[small], ~probe[small].astype(bool)
        for shift in range(1, min(SMALL, len(values))):
            same = (bucket[shift:] == bucket[:-shift]) & stored[:-shift]
            if not same.any():
                break
            x, y = values[:-shift][same], values[shift:][same]
            close = np.bitwise_count(x ^ y) <= radius
            pairs.append(np.column_stack([x[close], y[close]]))
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            if not probe[start]:
                pairs.append(spanning_links(marks[start:start + size], radius))
    flat = np.concatenate(pairs).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])


def spanning_links(marks: np.ndarray, radius: int) -> np.ndarray:
    """The minimum spanning tree (or forest) of the marks within the radius of each other, as rows of pairs.

    Trees grow from the marks reached so far by the nearest other one, in time quadratic and memory linear in the marks,
    which `CROWD` bounds.
    """
    marks = np.unique(marks)
    unreached, done = 1 << 14, 1 << 15
    weight = np.full(len(marks), unreached, dtype=np.int32)
    parent = np.full(len(marks), -1)
    at = 0
    for _ in range(len(marks)):
        weight[at] = done
        near = np.bitwise_count(marks ^ marks[at])
        closer = (near <= radius) & (near < weight) & (weight < done)
        weight[closer], parent[closer] = near[closer], at
        at = int(weight.argmin())
    child = np.flatnonzero(parent >= 0)
    return np.column_stack([marks[parent[child]], marks[child]])


# ---- operator ----

def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    words: int = SHINGLE_WORDS, crowd: int = CROWD) -> DataFrame:
    """One row for each row of `df`: id, fingerprint (16 hex digits), component_id (smallest id of its group)."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = staged(with_fingerprints(rows, "text", "mark", words).select("id", "mark"), "marks")
    return label_marks(marked, radius, crowd).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")


def label_marks(marked: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(id, mark) with `component_id`. Equal fingerprints are one node; their rows are never compared."""
    nodes = staged(marked.groupBy("mark").agg(F.min("id").alias("lead")), "nodes")
    links = near_links(nodes.select("mark"), make_plan(nodes, radius), radius, crowd)
    found = components(links, "a", "b")
    labelled = nodes.join(found, nodes["mark"] == found["node"], "left").select(
        "mark", "lead", F.coalesce("component", "mark").alias("group"))
    least = labelled.groupBy("group").agg(F.min("lead").alias("component_id"))
    names = labelled.join(least, "group").select("mark", "component_id")
    return marked.join(names, "mark")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                         words: int = SHINGLE_WORDS, crowd: int = CROWD) -> DataFrame:
    """`df` with one row of each group of `near_duplicates`: that of the smallest id, null ids last.

    Of rows with one id and text, the least by all columns stays. Rows are named by id and a hash of the text, so texts are
    shuffled once at most, by the join with the names of the rows that stay.
    """
    name = own_name(df, "_hash")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = df.withColumn(name, F.xxhash64(text))
    rows = hashed.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(name).alias("hash")).alias("id"),
                         text.alias("text"))
    marked = staged(with_fingerprints(rows, "text", "mark", words).select("id", "mark"), "marks")
    firsts = label_marks(marked, radius, crowd).filter("id <=> component_id").groupBy("component_id").agg(F.count("*").alias("n"))
    kept_id, kept_hash, copies = (own_name(df, n) for n in ("_kept_id", "_kept_hash", "_copies"))
    kept = staged(firsts.select("component_id.id", "component_id.hash", "n"), "kept").toDF(kept_id, kept_hash, copies)
    met = hashed.join(kept, (F.col(name) == F.col(kept_hash)) & F.col(id_col).eqNullSafe(F.col(kept_id)))
    order = Window.partitionBy(kept_id, kept_hash).orderBy(*df.columns)
    again = met.filter(F.col(copies) > 1).withColumn(copies, F.row_number().over(order))
    return met.filter(F.col(copies) == 1).unionByName(again.filter(F.col(copies) == 1)).select(*df.columns)
