"""The report against a replay of every order over every document."""

import re
from itertools import permutations

from fleetline.llm import filter_audit as f
from fleetline.llm import queries

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(docs):
    """(part, set of letters, doc_id) of each row (doc_id, text, source)."""
    out = []
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, part in docs:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
               "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
               "E": i is not None and least[text] < i}
        out.append((part or "", {k for k, v in bad.items() if v}, i))
    return out


def plain(docs, labels):
    judged, want = failures(docs), []
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    for part in sorted({p for p, _, _ in judged}):
        rows, shares, steps = [(x, i) for p, x, i in judged if p == part], {}, []
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, letter in enumerate(order):
                gone = [r for r in left if letter in r[0]]
                failing = sum(letter in x for x, _ in rows)
                left = [r for r in left if letter not in r[0]]
                shares[letter] = shares.get(letter, 0) + len(gone)
                steps.append([part, order, k + 1, len(left), len(gone), failing - len(gone), sum(x == {letter} for x, _ in rows),
                              sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), letter])
        want += [(*s[:-1], shares[s[-1]]) for s in steps]
    return sorted(want)


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = queries.queries()["op13_filter_audit"](spark, sf_dir)
    assert tuple(got.columns) == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(docs, labels)


def test_nulls_ties_repeats_clashing_names_long_texts_and_no_rows(spark):
    varied = " ".join(f"w{i}" for i in range(60))
    docs = [(1, varied, "a"), (1, varied, "a"), (2, varied, "b"), (None, varied, "a"), (3, None, None), (4, "", ""), (5, "A B #", "a"),
            (5, varied + " x", "a"), (-7, "A B #", "a"), (6, "wort " * 300_000, "b"), (8, "X " * 60, "a"), (9, varied + "|", "b")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 1, 1), (99, 1, 1), (None, 1, 1)]
    given = spark.createDataFrame([(*d, 3, "y") for d in docs], "doc_id long, text string, source string, bits long, hash string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    best = [(1, 1, 0), (2, 1, 1), (5, 1, 1)]
    got = sorted(map(tuple, f.report(f.combinations(given, known)).collect()))
    assert got == plain(docs, best) and len(got) == 3 * 600
    assert f.report(f.combinations(given.limit(0), known)).count() == 0
    assert f.report(f.combinations(given, known.limit(0))).agg({"good_lost": "sum"}).first()[0] == 0


def test_only_builtin_functions(spark, sf_dir):
    plan = queries.queries()["op13_filter_audit"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
