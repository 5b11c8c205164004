"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier learns from their consensus.

Base spans (email, IP address, payment card, phone) follow fixed patterns and always stay. Wider patterns propose more
candidates of the same kinds. For each candidate regular expressions, gazetteers and the words around it vote for,
against, or not at all. Expectation-maximisation over all candidates of all texts estimates how often each labeler is
right for each kind; its posteriors train a logistic classifier over the candidate's features. Candidates that it takes
for personal data, and that overlap no base span, are added.

The fit needs only the number of candidates for each pattern of votes and features, which Spark counts; their number
is bounded by the labelers and binary features, not by the data.

Defined results: a null text counts as empty and has no spans; offsets are code points, ends exclusive; repeated rows
have equal spans; runs of digits may have any length; with no candidates nothing is fitted and nothing added; a column named
like a new one is replaced, all others pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict_form", "check", "gazetteer", "context", "neighbours")
#: Binary features of the final classifier, besides a bias.
FEATURES = ("strict_form", "loose_form", "check", "known_name", "context_for", "context_against", "glued", "grouped")
#: Code points on either side that the context labelers read.
WINDOW = 32
ROUNDS = 60

# ---- base patterns: fixed values of the contract ----
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Starts at the start of a run of digits, where the leftmost match is; a search from within a run cannot be quadratic.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# ---- wider patterns ----
_AT = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})\s?(?:\[at\]|\(at\)|\{at\})\s?([A-Za-z0-9-]{1,63}(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\})\s?[A-Za-z0-9-]{1,63}){1,4})")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])")
_LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z.,])[0-9]{4}([ ./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.,/-])(?:(?:\+|00)[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{3,4}(?![0-9A-Za-z])")

# ---- gazetteers and context words ----
_TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu it nl ch at be us ca".split())
_CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 82 86 91".split())
_CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt|schreib\w*)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|adresse|client|login|ping)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell|telefon|anruf\w*|tél|téléphone|teléfono|móvil)\b"),
}
_AGAINST = re.compile(r"(?i)(?:\b(?:version|isbn|issn|doi|order|invoice|ref|section|chapter|page|rfc|build|release|figure|table)\b[^A-Za-z0-9]{0,4}$|[$€£#=/\\]$)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(digits: str) -> bool:
    """At most 255; digits of equal length are ordered like their numbers, however long the run was."""
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, one look at each @: back to the start of the local part, forward over the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind and start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not any("0" <= c <= "9" for c in text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p.lstrip("0")) for p in m.group().split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    if re.search(r"(?i)[\[({]at[\])}]", text):
        yield from (("email", *m.span()) for m in _AT.finditer(text))
    if any("0" <= c <= "9" for c in text):
        if ":" in text:
            yield from (("ip", *m.span()) for m in _IP6.finditer(text))
        yield from (("card", *m.span()) for m in _LOOSE_CARD.finditer(text))
        yield from (("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text))


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...], tuple[int, ...]]]:
    """(kind, start, end, base, votes, features); votes are 1 for, 0 against, -1 none."""
    base = base_spans(text)
    taken = _merged((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    out = [(*span, True, *_votes(text, *span, True)) for span in base]
    for kind, start, end in _loose(text):
        before = bisect_left(starts, end) - 1  # the last taken stretch that starts before this end
        if before < 0 or taken[before][1] <= start:
            out.append((kind, start, end, False, *_votes(text, kind, start, end, False)))
    return out


def _merged(spans) -> list[tuple[int, int]]:
    """The stretches that the spans cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    span, before, after = text[start:end], text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    digits = digits_of(span)
    if kind == "email":
        check = int(len(span) <= 254 and ".." not in span)
        known = int(re.split(r"[.\])}\s]+", span.lower())[-1] in _TOP_DOMAINS)
    elif kind == "ip":
        check, known = 1, int(not span.startswith(("0.", "255.")))
    elif kind == "card":
        check, known = int(luhn(digits)), int(digits[0] in "3456")
    else:
        check = int(8 <= len(digits) <= 15)
        known = int(any(digits.removeprefix("00").startswith(c) for c in _CALLING_CODES)) if base or digits.startswith("00") else -1
    favour = bool(_CONTEXT[kind].search(before) or _CONTEXT[kind].search(after))
    against = bool(_AGAINST.search(before))
    glued = before[-1:].isalnum() or after[:1].isalnum()
    grouped = len(re.findall(r"[0-9A-Za-z]+", span)) > 1
    context = 1 if favour else 0 if against else -1
    return ((int(base), check, known, context, 0 if glued else 1),
            (int(base), int(not base), check, int(known == 1), int(favour), int(against), int(glued), int(grouped)))


# ---- reliabilities and the classifier ----

@dataclass(frozen=True)
class SpanModel:
    """For each kind the classifier's weights (bias first), and each labeler's estimated accuracy."""

    weights: dict[str, np.ndarray]
    accuracies: dict[str, np.ndarray]

    def probability(self, kind: str, features: tuple[int, ...]) -> float:
        if kind not in self.weights:
            return 0.0
        z = self.weights[kind][0] + float(np.dot(self.weights[kind][1:], features))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def reliabilities(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns and their counts: posterior of each pattern, and P(votes for | true), P(votes for | false).

    A vote follows a two-class model with one smoothed rate per labeler and class; abstentions say nothing. The start
    is the majority vote, which fixes which class is which.
    """
    cast = votes >= 0
    share = (np.where(cast, votes, 0).sum(axis=1) + 1) / (cast.sum(axis=1) + 2)
    posterior = np.clip(share, 0.05, 0.95)
    for _ in range(ROUNDS):
        weight = np.stack([posterior, 1 - posterior]) * counts
        given = weight @ np.where(cast, votes, 0)
        rates = (given + np.array([[4.0], [1.0]])) / (weight @ cast + 5.0)
        prior = np.clip((weight[0].sum() + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6)
        logs = [np.where(cast, np.where(votes == 1, np.log(r), np.log(1 - r)), 0.0).sum(axis=1) for r in rates]
        posterior = 1 / (1 + np.exp(np.clip(logs[1] - logs[0] + np.log((1 - prior) / prior), -500, 500)))
    return posterior, rates[0], rates[1]


def train(features: np.ndarray, targets: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft targets by Newton's method, with a ridge."""
    x = np.column_stack([np.ones(len(features)), features]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (counts * (p - targets)) + ridge * w
        hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(marked: DataFrame, name: str = "candidates") -> SpanModel:
    """Learns from all candidates in the column that `with_candidates` adds."""
    pattern = marked.select(F.explode(name).alias("c")).groupBy("c.kind", "c.votes", "c.features").count().collect()
    weights, accuracies = {}, {}
    for kind in KINDS:
        rows = sorted(((tuple(r["votes"]), tuple(r["features"]), r["count"]) for r in pattern if r["kind"] == kind))
        if not rows:
            continue
        votes, features = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        counts = np.array([r[2] for r in rows], dtype=float)
        posterior, true_rate, false_rate = reliabilities(votes, counts)
        weights[kind] = train(features, posterior, counts)
        accuracies[kind] = (true_rate + 1 - false_rate) / 2
    return SpanModel(weights, accuracies)


_CANDIDATE = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>>"


def _candidate_rows(text: str) -> list[dict]:
    keys = ("kind", "start", "end", "base", "votes", "features")
    return [dict(zip(keys, (*c[:4], list(c[4]), list(c[5])))) for c in candidates(text)]


def with_candidates(df: DataFrame, text_col: str = "text", name: str = "candidates") -> DataFrame:
    @F.pandas_udf(_CANDIDATE)
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(_candidate_rows)

    return df.withColumn(name, of(F.coalesce(F.col(text_col), F.lit(""))))


def with_spans(marked: DataFrame, model: SpanModel, name: str = "candidates", spans: str = "spans") -> DataFrame:
    """Adds the spans (kind, start, end, base): all base ones and the candidates that the classifier accepts.

    Spans of one kind do not overlap; they are ordered by kind as in `KINDS`, then by start.
    """

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,base:boolean>>")
    def of(lists: pd.Series) -> pd.Series:
        return lists.map(lambda cs: _chosen(cs, model))

    return marked.withColumn(spans, of(F.col(name)))


def _chosen(found, model: SpanModel) -> list[dict]:
    kept = []
    for c in found:
        if c["base"] or model.probability(c["kind"], tuple(c["features"])) >= 0.5:
            kept.append({k: c[k] for k in ("kind", "start", "end", "base")})
    return sorted(kept, key=lambda c: (KINDS.index(c["kind"]), c["start"]))


def redact(df: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """`df` with each span of the text replaced by its kind in brackets, such as [EMAIL]. Null texts stay null.

    Where spans of two kinds overlap, one replacement covers both, named after the one that starts first.
    """
    known = model or fit(with_candidates(df.select(F.col(text_col).alias("text"))))

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else replace_spans(t, _chosen(_candidate_rows(t), known)))

    return df.withColumn(text_col, of(F.col(text_col)))


def replace_spans(text: str, spans) -> str:
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            out += [text[done:s["start"]], f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join((*out, text[done:]))
