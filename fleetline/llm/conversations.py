"""Repair of conversation structure: the cheapest edits that make roles alternate, found by a persistent audit DP.

A conversation's rows are read in order. Each row's first fault counts: blank, duplicate (role and text seen earlier in
the conversation), truncated. Edits are Keep, Rerole, Delete and Insert, and the roles' initials must become
`(s?(ua)+)?`. The programme has one state for each place in that pattern. A state's audit, the initials of the edits so
far, is a node that links to the audit it extends, so states share their common prefix. Nodes know their ancestors at
powers of two and the rolling hash of their letters. Equal costs are decided by the first letter in which two audits
differ, searched over the ancestors by hash; the prefix that hashes call equal is then compared letter by letter (once:
prefixes found equal are joined), so a collision changes nothing. Each state also has the SHA-256 of the text repaired so far.

Conversations are sorted by key and streamed, one row at a time. A conversation needs a digest for each different row and
the nodes its states still reach: what all states share is moved to a plain string, and only states that never meet keep
nodes for each row. The SHA-256 of a whole conversation and its audit of one letter a row are serial results by their
definition, so one conversation is one task's stream.

Defined results: a null role or text is one space; a null id is a conversation of its own; null turns come first and
count for no gap; rows of equal turn are ordered by role and text; an id without rows has zeros, an empty audit and the
hash of the empty string; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
#: Costs of the edits, and of leaving a truncated row in place.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The role that an edit writes in each state, and the state after it: start, after s, after u, after a.
_WRITES = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
_ENDS = (0, 3)
_LEGAL = frozenset(("su", "ua", "au"))
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Nodes after which those no longer reached are dropped.
MANY_NODES = 1 << 15
_PRIME, _BASE = (1 << 61) - 1, 0x5851F42D4C957F2D % ((1 << 61) - 1)


class Audits:
    """Strings of edit initials as nodes of a shared tree; node 0 is the empty string."""

    def __init__(self) -> None:
        self.letters, self.depths, self.hashes = [""], [0], [0]
        self.ups: list[list[int]] = [[]]
        self.alias: dict[int, int] = {}

    def extend(self, node: int, letter: str) -> int:
        at = len(self.letters)
        self.letters.append(letter)
        self.depths.append(self.depths[node] + 1)
        self.hashes.append((self.hashes[node] * _BASE + ord(letter)) % _PRIME)
        up, k = [node], 0
        while k < len(self.ups[up[k]]):
            up.append(self.ups[up[k]][k])
            k += 1
        self.ups.append(up)
        return at

    def ancestor(self, node: int, depth: int) -> int:
        while self.depths[node] > depth:
            step = (self.depths[node] - depth).bit_length() - 1
            node = self.ups[node][step]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's. A proper prefix comes first."""
        depth = min(self.depths[a], self.depths[b])
        x, y = self._split(self.ancestor(a, depth), self.ancestor(b, depth))
        if x == y:
            return self.depths[a] < self.depths[b]
        return self.letters[x] < self.letters[y]

    def _split(self, x: int, y: int) -> tuple[int, int]:
        """The first nodes in which two strings of one length differ, or the same node twice if they are equal."""
        if self.hashes[x] == self.hashes[y]:
            if self._same(x, y):
                return x, x
            return self._first_difference(x, y)
        above_x, above_y = x, y
        for k in range(len(self.ups[x]) - 1, -1, -1):
            if k < len(self.ups[above_x]) and self.hashes[self.ups[above_x][k]] != self.hashes[self.ups[above_y][k]]:
                above_x, above_y = self.ups[above_x][k], self.ups[above_y][k]
        if self._same(self.ups[above_x][0], self.ups[above_y][0]):
            return above_x, above_y
        return self._first_difference(x, y)

    def _top(self, node: int) -> int:
        root = node
        while root in self.alias:
            root = self.alias[root]
        while node != root:
            self.alias[node], node = root, self.alias[node]
        return root

    def _same(self, x: int, y: int) -> bool:
        """Whether two strings of one length and hash are equal letter by letter; what is found equal is joined."""
        walked = []
        while (x := self._top(x)) != (y := self._top(y)):
            if self.letters[x] != self.letters[y]:
                return False
            walked.append((x, y))
            x, y = self.ups[x][0], self.ups[y][0]
        for x, y in walked:
            x, y = self._top(x), self._top(y)
            if x != y:
                self.alias[max(x, y)] = min(x, y)
        return True

    def _first_difference(self, x: int, y: int) -> tuple[int, int]:
        """By walking both strings; only a collision of hashes leads here."""
        found = x, x
        while x != y:
            if self.letters[x] != self.letters[y]:
                found = x, y
            x, y = self.ups[x][0], self.ups[y][0]
        return found

    def settled(self, nodes: list[int]) -> tuple[str, Audits, list[int]]:
        """The prefix that all nodes share, a tree of what they have beyond it, and their places there."""
        paths = []
        for node in nodes:
            paths.append([node])
            while node:
                node = self.ups[node][0]
                paths[-1].append(node)
        shared = set(paths[0]).intersection(*paths[1:])
        root = max(shared)  # a node comes after its ancestors
        kept, places = Audits(), {root: 0}
        for node in sorted(set().union(*paths) - shared):
            places[node] = kept.extend(places[self.ups[node][0]], self.letters[node])
        return self.text(root), kept, [places[n] for n in nodes]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letters[node])
            node = self.ups[node][0]
        return "".join(reversed(out))


class Repair:
    """The programme over one conversation's rows."""

    def __init__(self) -> None:
        self.audits, self.settled, self.most = Audits(), [], MANY_NODES
        self.costs: list[int | None] = [0, None, None, None]
        self.nodes, self.hashes = [0] * 4, [hashlib.sha256() for _ in range(4)]

    def _better(self, cost: int, node: int, than_cost: int | None, than_node: int) -> bool:
        return than_cost is None or cost < than_cost or (cost == than_cost and self.audits.less(node, than_node))

    def _written(self, state: int, role: str, text: str):
        done = self.hashes[state].copy()
        done.update(f"{chr(10) if state else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        return done

    def insert(self) -> None:
        """Any rows that are worth inserting at this place."""
        again = True
        while again:
            again = False
            for state, cost in enumerate(self.costs):
                to = _NEXT[state]
                if cost is None or self.costs[to] is not None and cost + INSERT > self.costs[to]:
                    continue
                node = self.audits.extend(self.nodes[state], "I")
                if self._better(cost + INSERT, node, self.costs[to], self.nodes[to]):
                    self.costs[to], self.nodes[to], again = cost + INSERT, node, True
                    self.hashes[to] = self._written(state, _WRITES[state], "")

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        self.insert()
        costs: list[int | None] = [None] * 4
        nodes, made = [0] * 4, [None] * 4

        def offer(state: int, to: int, cost: int, letter: str, new_role: str) -> None:
            if costs[to] is not None and cost > costs[to]:
                return
            node = self.audits.extend(self.nodes[state], letter)
            if self._better(cost, node, costs[to], nodes[to]):
                costs[to], nodes[to], made[to] = cost, node, (state, letter, new_role)

        for state, cost in enumerate(self.costs):
            if cost is None:
                continue
            offer(state, state, cost + DELETE, "D", "")
            if must_go:
                continue
            cost += TRUNCATED * truncated
            if role[:1] == "s" and state == 0:
                offer(state, 1, cost, "K", role)
            elif role[:1] == _WRITES[state][0]:
                offer(state, _NEXT[state], cost, "K", role)
            offer(state, _NEXT[state], cost + REROLE, "R", _WRITES[state])
        self.hashes = [old if m is None or m[1] == "D" else self._written(m[0], m[2], text) for m, old in zip(made, self.hashes)]
        if costs[3] is not None:
            # What follows on an empty or opened start can follow here too, at most one kept s row has to go.
            costs[0] = None if costs[0] is not None and costs[0] > costs[3] + DELETE else costs[0]
            costs[1] = None if costs[1] is not None and costs[1] > costs[3] else costs[1]
        self.costs, self.nodes = costs, nodes
        if len(self.audits.letters) > self.most:
            live = [s for s in range(4) if costs[s] is not None]
            prefix, self.audits, places = self.audits.settled([nodes[s] for s in live])
            self.settled.append(prefix)
            for s, place in zip(live, places):
                self.nodes[s] = place
            self.most = max(MANY_NODES, 2 * len(self.audits.letters))

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the repaired text."""
        self.insert()
        best = _ENDS[0] if self.costs[_ENDS[0]] is not None else _ENDS[1]
        for s in _ENDS:
            if s != best and self.costs[s] is not None and self._better(self.costs[s], self.nodes[s], self.costs[best], self.nodes[best]):
                best = s
        return self.costs[best], "".join(self.settled) + self.audits.text(self.nodes[best]), self.hashes[best].hexdigest()


class Conversation:
    """What is counted of one conversation while its rows pass by."""

    def __init__(self, key) -> None:
        self.key, self.repair, self.seen = key, Repair(), set()
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in _LEGAL
        self.before = role[:1]
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        body = text.rstrip(_SPACE)
        blank, duplicate = not body, mark in self.seen
        truncated = not blank and not duplicate and body[-1] not in ".!?"
        self.seen.add(mark)
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated
        self.repair.row(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.result())


# ---- Spark ----

def _prepared(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), F.lit(True).alias("row"))


def _sorted(rows: DataFrame, first: str) -> DataFrame:
    by = [F.col(c).asc_nulls_first() for c in ("conv", first, "turn", "role", "text")]
    return rows.repartition("conv").sortWithinPartitions(*by)


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, row): the rows with test faults by a checksum of id and turn. A dropped row keeps its id, row is false."""
    rows = _prepared(df, conv_col, turn_col, role_col, text_col)

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(said("conv"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    gone = code == 0
    return rows.select("conv", "turn", F.when(gone, None).when(code == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(gone, None).otherwise(text).alias("text"), (~gone).alias("row"), F.explode(copies).alias("copy")).drop("copy")


def audit(rows: DataFrame) -> DataFrame:
    """One row for each id of rows (conv, turn, role, text, row), with what was found and the cheapest audit."""
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = _sorted(rows, "row").select("conv", "turn", "role", "text", "row")
    return ordered.mapInArrow(_audited, f"conv {kind}, {RESULT}")


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`audit` of a table of conversations as it is."""
    return audit(_prepared(df, conv_col, turn_col, role_col, text_col)).withColumnRenamed("conv", conv_col)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, out, now = None, [], None
    names = ["conv", *[c.split()[0] for c in RESULT.split(", ")]]

    def table() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out)] or [[] for _ in names]
        out.clear()
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        kind = batch.schema.field(0).type
        for key, turn, role, text, row in _batches([batch]):
            if now is None or now.key != key:
                if now is not None:
                    out.append(now.result())
                now = Conversation(key)
            if row:
                now.add(turn, role, text)
        if len(out) > 1024:
            yield table()
    if now is not None:
        out.append(now.result())
        yield table()


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, place, role, text): the conversations after the edits of their audits. Both tables as `audit` takes and returns them."""
    kind = rows.schema["conv"].dataType.simpleString()
    letters = audits.select("conv", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                            F.col("audit").alias("text"), F.lit(False).alias("row"))
    ordered = _sorted(rows.filter("row").unionByName(letters), "row").select("conv", "turn", "role", "text", "row")
    return ordered.mapInArrow(_applied, f"conv {kind}, place long, role string, text string")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left, state, place = iter(()), 0, 0
    now = None
    for batch in batches:
        out = []

        def put(role: str, text: str) -> None:
            nonlocal state, place
            out.append((now, place, role, text))
            state, place = (1 if role[:1] == "s" and state == 0 else _NEXT[state]), place + 1

        def insert() -> str:
            while (letter := next(left, "")) == "I":
                put(_WRITES[state], "")
            return letter

        for key, _, role, text, row in _batches([batch]):
            if not row:
                insert()  # what the conversation before still lacks
                now, left, state, place = key, iter(text), 0, 0
            elif (letter := insert()) != "D":
                put(role if letter == "K" else _WRITES[state], text)
        yield _turns(out, batch.schema.field(0).type)
    if now is not None or place:
        out = []
        while next(left, "") == "I":
            out.append((now, place, _WRITES[state], ""))
            state, place = _NEXT[state], place + 1
        yield _turns(out, batch.schema.field(0).type)


def _turns(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    types = [kind, pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", "place", "role", "text"])
