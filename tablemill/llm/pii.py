"""Personal data by weak supervision.

Base kinds follow fixed patterns and always stay. Beyond them, candidates (strings that look
like secrets or like numbers of a person) are voted on by labelers: shape patterns, a
gazetteer of names and prefixes, the words before, the mixture of characters. Votes are
counted over all documents by pattern, which is a table of bounded size; expectation-
maximisation on these counts estimates each labeler's reliability and the probability of
each pattern, and a logistic span classifier is trained on those probabilities. Spans that
the classifier accepts are added.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import map_rows, table, text_bytes, with_columns

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]

# Candidates beyond the base kinds.
_KEYED = re.compile(r"([A-Za-z][A-Za-z_]{1,30}) ?[=:] ?[\"']?([A-Za-z0-9_/+-]{6,})")
_MIXED = re.compile(r"[A-Za-z0-9_-]{12,}")
_NUMBER = re.compile(r"\(?[0-9][0-9 ().-]{5,30}[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")

# Labelers. Well-known names, prefixes and shapes.
_SECRET_SHAPE = re.compile(r"A[KS]IA[0-9A-Z]{16}|[0-9a-f]{16,}|[0-9A-F]{16,}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,}")
_NUMBER_SHAPE = re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}")
_SECRET_NAMES = frozenset("password passwd pwd passphrase token secret api_key apikey access_key auth credential".split())
_SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-", "xoxb", "xoxp", "AIza", "eyJ")
_NUMBER_PREFIXES = ("00", "(", "1-8")
_HINTS = frozenset("phone tel telephone mobile call fax ssn passport account contact key token password secret login".split())
_DOUBTS = frozenset("version page chapter line section isbn vol year figure table id no".split())


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str):
    """As finditer, but looking only around each @."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base kinds, in order."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]):
    """(kind number, start, end, votes, length class) of strings to vote on.

    They don't overlap base spans or each other; earlier patterns and places go first.
    """
    busy = sorted((a, b) for _, a, b in taken)

    def free(a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y in busy)

    found = []
    for m in _KEYED.finditer(text):
        found.append((4, m.start(2), m.end(2), m.group(1)))
    found += [(4, *m.span(), "") for m in _MIXED.finditer(text) if any(c in "0123456789" for c in m.group())]
    found += [(5, *m.span(), "") for m in _NUMBER.finditer(text) if len(_digits(m.group())) >= 7]
    for kind, a, b, name in found:
        if free(a, b):
            busy.append((a, b))
            yield kind, a, b, votes(kind, text[a:b], name, text[max(0, a - 40) : a]), min(7, (b - a) // 6)


def votes(kind: int, span: str, name: str, before: str) -> tuple[int, int, int, int]:
    """Votes of shape, gazetteer, context and mixture: 1 for, -1 against, 0 abstains."""
    digits = len(_digits(span))
    words = re.findall(r"[a-z_]+", before.lower())[-2:]
    context = 1 if _HINTS & set(words) else -1 if _DOUBTS & set(words) else 0
    if kind == 4:
        shape = 1 if _SECRET_SHAPE.fullmatch(span) else -1 if digits == 0 else 0
        known = 1 if name.lower() in _SECRET_NAMES or span.startswith(_SECRET_PREFIXES) else -1 if name else 0
        mixture = 1 if 0.1 <= digits / len(span) <= 0.9 else -1
    else:
        shape = 1 if _NUMBER_SHAPE.fullmatch(span) else 0
        known = 1 if span.startswith(_NUMBER_PREFIXES) else 0
        mixture = 1 if 9 <= digits <= 15 else -1
    return shape, known, context, mixture


# -- reliabilities and the classifier, from counts alone ----------------------------------
def fit_reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability that each vote pattern is personal data.

    ``patterns``: (kind, votes...). Labelers are independent given the truth; the share of
    personal data is the kind's own. Starts from labelers that are right seven times in ten.
    """
    kinds, cast = patterns[:, 0] == 5, patterns[:, 1:] + 1
    p = 1 / (1 + np.exp(-1.2 * patterns[:, 1:].sum(1)))
    for _ in range(rounds):
        like = np.zeros((2, len(p)))
        for truth, share in enumerate((1 - p, p)):
            weight = share * counts
            for kind in (False, True):
                rows = kinds == kind
                like[truth, rows] = np.log((weight[rows].sum() + 1) / (counts[rows].sum() + 2))
                for j in range(cast.shape[1]):
                    # one agreeing vote per outcome in advance keeps rare outcomes open
                    seen = np.bincount(cast[rows, j], weight[rows], 3) + (0.5, 1.0, 0.5 + truth)
                    if truth == 0:
                        seen += (1.0, 0.0, 0.0)
                    like[truth, rows] += np.log(seen / seen.sum())[cast[rows, j]]
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return p


def _features(pattern: np.ndarray) -> np.ndarray:
    """One column each for the kind, every vote by kind, and the length class."""
    kind, cast, size = pattern[:, 0] == 5, pattern[:, 1:-1], pattern[:, -1]
    columns = [np.ones(len(pattern)), kind, size / 7.0]
    for j in range(cast.shape[1]):
        for value in (-1, 1):
            columns += [(cast[:, j] == value) & ~kind, (cast[:, j] == value) & kind]
    return np.stack([np.asarray(c, float) for c in columns], 1)


def fit_classifier(pattern: np.ndarray, counts: np.ndarray, target: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps on weighted patterns."""
    x = _features(pattern)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - target)) + ridge * w
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


def train(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier, from the votes on all candidates of ``docs``."""

    def tally(batch):
        seen: Counter = Counter()
        for raw in batch.column(0).to_pylist():
            text = raw.decode("utf-8", "replace")
            for kind, _, _, cast, size in candidates(text, base_spans(text)):
                seen[(kind, *cast, size)] += 1
        columns = list(zip(*((*k, n) for k, n in seen.items()))) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    names = ["kind", "v0", "v1", "v2", "v3", "size", "n"]
    rows = (
        map_rows(docs.select(text_bytes()).where(_worth("text")), ", ".join(f"{n} long" for n in names), tally)
        .groupBy(*names[:-1])
        .agg(F.sum("n").alias("n"))
        .collect()  # at most 2 * 3^4 * 8 patterns
    )
    if not rows:
        return np.zeros(_features(np.zeros((1, 6))).shape[1])
    cells = np.array(sorted(tuple(r) for r in rows), np.int64)
    pattern, counts = cells[:, :-1], cells[:, -1].astype(float)
    target = fit_reliabilities(pattern[:, :-1], counts)
    return fit_classifier(pattern, counts, target)


def _worth(column: str):
    """Texts without a digit, an @, an equals sign or a colon have nothing to find."""
    return F.col(column).cast("string").rlike("[0-9@=:]")


def find_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """(base spans, all spans), each by kind and start."""
    base = base_spans(text)
    found = list(candidates(text, base))
    added = []
    if found and weights.any():
        x = _features(np.array([(k, *cast, size) for k, _, _, cast, size in found]))
        added = [f[:3] for f, score in zip(found, x @ weights) if score > 0]
    return base, base + sorted(added)


_QUICK = re.compile(rb"[0-9@=:]")


def detect(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``found`` (arrays of kind, start, end in code points) and
    ``masked``, the text with every found span as its kind in brackets.

    Null text: empty, nothing found. Other columns stay, nulls and repeated rows included;
    columns called ``base``, ``found``, ``masked`` are replaced. Empty table: no rows.
    """
    learned = train(docs) if weights is None else weights
    made = ("base", "found", "masked")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in made]).alias("row"), text_bytes())
    span = "array<struct<kind:string,start:long,end:long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def named(spans):
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def work(batch):
        base, found, masked = [], [], []
        for raw in batch.column(1).to_pylist():
            text = raw.decode("utf-8", "replace")
            b, f = find_spans(text, learned) if _QUICK.search(raw) else ([], [])
            base.append(named(b))
            found.append(named(f))
            masked.append(_masked(text, f))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, arrow), pa.array(found, arrow), pa.array(masked, pa.string())], ["row", *made]
        )

    return map_rows(source, with_columns(source, f"base {span}, found {span}, masked string"), work).select("row.*", *made)


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Overlapping spans (an address inside a phone number) become one mask."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        *(number(k) for k in BASE),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("found").alias("spans"),
    )


QUERIES = {"op9_weak_labels": op9_weak_labels}
