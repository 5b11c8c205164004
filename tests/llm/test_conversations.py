"""Audits against a plain programme over whole strings, the shared tree, and what the repaired rows are."""

import hashlib
import random
import zlib

import pytest

from fleetline.llm import conversations as c
from fleetline.llm import queries

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string"


def legal(initials):
    body = initials[1:] if initials.startswith("s") else initials
    return initials == "" or (len(body) > 0 and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))


def plain_result(rows):
    """(cost, audit, repaired rows) by keeping the best (cost, audit) of each place in the pattern, strings and all."""
    seen, best = set(), {0: (0, "", ())}
    writes, after = ("user", "user", "assistant", "user"), (2, 2, 3, 2)

    def inserted(states):
        states = dict(states)
        for _ in range(4):
            for s, (cost, audit, done) in list(states.items()):
                new = (cost + 3, audit + "I", (*done, (writes[s], "")))
                if after[s] not in states or new < states[after[s]]:
                    states[after[s]] = new
        return states

    for role, text in rows:
        bad = not text.strip(SPACE) or (role, text) in seen
        cut = 3 * (not bad and text.rstrip(SPACE)[-1] not in ".!?")
        seen.add((role, text))
        new = {}
        for s, (cost, audit, done) in inserted(best).items():
            tries = [(s, (cost + 4, audit + "D", done))]
            if not bad:
                if role[:1] == "s" and s == 0:
                    tries.append((1, (cost + cut, audit + "K", (*done, (role, text)))))
                if role[:1] == writes[s][0]:
                    tries.append((after[s], (cost + cut, audit + "K", (*done, (role, text)))))
                tries.append((after[s], (cost + cut + 3, audit + "R", (*done, (writes[s], text)))))
            for to, what in tries:
                if to not in new or what < new[to]:
                    new[to] = what
        best = new
    return min(v for s, v in inserted(best).items() if s in (0, 3))


def plain(conv, rows):
    """The contract's row for damaged rows (turn, role, text) in order."""
    seen, counts, pairs = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, 0
    for _, role, text in rows:
        if not text.strip(SPACE):
            counts["blank"] += 1
        elif (role, text) in seen:
            counts["duplicate"] += 1
        elif text.rstrip(SPACE)[-1] not in ".!?":
            counts["truncated"] += 1
        seen.add((role, text))
    for (_, a, _), (_, b, _) in zip(rows, rows[1:]):
        pairs += a[:1] + b[:1] not in ("su", "ua", "au")
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, done = plain_result([r[1:] for r in rows])
    assert legal("".join(r[:1] for r, _ in done))
    text = "\n".join(f"{r}:{t}" for r, t in done)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *counts.values(), pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else "".join(x for x in text if x not in ".!?") if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_whole_table(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = [plain(k, v) for k, v in plain_damage(given).items()]
    got = queries.queries()["op11_conversations"](spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert order(map(tuple, got.collect())) == order(want)


def random_rows(rng, n):
    texts = ["a.", "b", "", " \t", "c!", "d?", "a. \n", "e"]
    return [(rng.choice(["user", "assistant", "system", "tool", "", "u"]), rng.choice(texts) + str(rng.randrange(9)) * rng.randrange(2)) for _ in range(n)]


@pytest.mark.parametrize("settings", [{}, {"MANY_NODES": 8}, {"_PRIME": 2}, {"_PRIME": 3, "MANY_NODES": 20}])
def test_audits_of_random_rows(monkeypatch, settings):
    """Small primes make hashes collide all the time, a small limit drops nodes at every row."""
    for name, value in settings.items():
        monkeypatch.setattr(c, name, value)
    rng = random.Random(5)
    for n in [*range(12)] * 12 + [60, 200]:
        rows = random_rows(rng, n)
        now = c.Conversation(1)
        for turn, row in enumerate(rows):
            now.add(turn, *row)
        assert now.result() == plain(1, [(t, *r) for t, r in enumerate(rows)])


@pytest.mark.parametrize("prime", [2, 5, c._PRIME])
def test_tree_orders_strings(monkeypatch, prime):
    monkeypatch.setattr(c, "_PRIME", prime)
    rng, tree, strings = random.Random(3), c.Audits(), [""]
    for _ in range(300):
        at, letter = rng.randrange(max(0, len(strings) - 40), len(strings)), rng.choice("DK")
        tree.extend(at, letter)
        strings.append(strings[at] + letter)
    for _ in range(4000):
        a, b = rng.randrange(301), rng.randrange(301)
        assert tree.less(a, b) == (strings[a] < strings[b])
    assert [tree.text(n) for n in range(301)] == strings


def test_long_conversation_is_linear_in_memory(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}.") for t in range(30_000)]
    audit = c.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).first()
    assert audit["audit"] == "K" * 30_000 and audit["cost"] == 0
    one = c.Conversation(1)
    for t in range(100_000):
        one.add(t, ("user", "assistant")[t % 2], f"{t}." if t % 9 else "")
    assert len(one.repair.audits.letters) < 4 * c.MANY_NODES and len(one.result()[7]) >= 100_000


def test_nulls_ties_repeats_clashing_names_and_no_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (2, None, "system", "S."), (2, 3, "user", "A."),
            (2, 3, "assistant", "B."), (2, 9, "assistant", "x" * 200_000), (3, 0, "tool", "T."), (4, 1, "", "")]
    given = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", row long, audit string")
    got = order(map(tuple, c.audit(c.damaged(given)).collect()))
    assert got == order(plain(k, v) for k, v in plain_damage(rows).items())
    kept = {k: sorted(((t, " " if r is None else r, " " if x is None else x) for q, t, r, x in rows if q == k),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, *_ in rows}
    assert order(map(tuple, c.repair(given).collect())) == order(plain(k, v) for k, v in kept.items())
    empty = given.limit(0)
    assert c.repair(empty).count() == 0 and c.repaired_turns(c.damaged(empty), c.audit(c.damaged(empty))).count() == 0


def test_repaired_turns_have_the_hash(spark, sf_dir):
    rows = c.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    audits = c.audit(rows)
    turns = {}
    for r in c.repaired_turns(rows, audits).collect():
        turns.setdefault(r["conv"], []).append((r["place"], f"{r['role']}:{r['text']}"))
    for r in audits.collect():
        mine = sorted(turns.get(r["conv"], []))
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(t for _, t in mine).encode()).hexdigest() == r["repaired_sha256"]
