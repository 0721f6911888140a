"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, and a span classifier decides.

Kinds are email, ip, card and phone. Each has a base rule whose matches are always kept. Candidates are those matches,
matches of looser rules (addresses written out or with spaces around the @, addresses with bracketed dots or in IPv6, cards
grouped by other signs, phone numbers grouped, with 00 or after a word for one) and what the base rules matched but rejected. Labelers of three sorts vote yes, no or nothing: regular expressions of shape
and boundary, gazetteers of endings and number ranges, and words around the span. Counts of vote patterns, gathered over
all texts, are all that expectation-maximisation needs to estimate each labeler's reliability and the probability of
each pattern; a logistic classifier over votes and shape features is then fitted to those probabilities.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("rule", "shape", "boundary", "gazetteer", "check", "context")
FEATURES = ("plus", "brackets", "grouped", "long", "hexlike", "written")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins; saying so keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WRITTEN = re.compile(r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,5}", re.IGNORECASE)
#: What every address that WRITTEN may find for loose() has in it.
MARKED = re.compile(r"dot|at[\])]", re.IGNORECASE)
SPLIT_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9])")
SPACED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?: @ ?| ?@ )[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])")
OTHER_CARD = re.compile(r"(?<![0-9])[0-9]{4}([./_\u00a0\u2013]| - |  )[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])")
GROUPED = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")
INTERNATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])00[1-9][0-9]{0,2}[ .-]?[0-9](?:[ .-]?[0-9]){6,11}(?![0-9A-Za-z])")
CALLED = re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|cell|telefon|telefono)(?:[.:]| at| on)? {0,2}([0-9]{7,15})(?![0-9A-Za-z])", re.IGNORECASE)

# Endings of domains, first digits of card numbers, and words that speak for or against a kind.
ENDINGS = frozenset("com org net edu gov int info biz io co us uk de fr es it nl eu ch at be ca au jp br ru".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "38", "30")
FOR = {
    "email": frozenset("email e-mail mail mailto contact write address correo courriel".split()),
    "ip": frozenset("ip host server address login from client addr".split()),
    "card": frozenset("card visa mastercard amex credit debit payment carte tarjeta karte pay".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell contact telefon telefono appel".split()),
}
AGAINST = frozenset("version ver isbn issn doi order invoice sku serial token password key secret hash build page vol".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def is_ipv6(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of LOCAL+ @ DOMAIN, found from each @, in time linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, kind) of the base rules' matches, by start, then kind; and of matches that their checks rejected."""
    kept, failed = [(s, e, "email") for s, e in emails(text)], []
    if any_digit := DIGIT.search(text):
        first = any_digit.start()
        for m in IP.finditer(text, first):
            (kept if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.group().split(".")) else failed).append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text, first):
            if m.end() - m.start() >= 12:
                d = digits_of(m.group())
                if len(d) >= 12:
                    (kept if 14 <= len(d) <= 19 and luhn(d) else failed).append((m.start(), m.end(), "card"))
        for m in PHONE.finditer(text, max(0, first - 1)):
            (kept if 10 <= len(digits_of(m.group())) <= 15 else failed).append((m.start(), m.end(), "phone"))
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted(kept, key=order), sorted(failed, key=order)


def loose(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates of the looser rules that overlap nothing taken, nor one another; earlier rules go first."""
    rules = []
    if MARKED.search(text):
        rules.append(("email", (m.span() for m in WRITTEN.finditer(text) if MARKED.search(m.group()))))
    if " @" in text or "@ " in text:
        rules.append(("email", (m.span() for m in SPACED.finditer(text))))
    if re.search("[0-9] ?[\\[(]", text):
        rules.append(("ip", (m.span() for m in SPLIT_IP.finditer(text))))
    if ":" in text:
        rules.append(("ip", (m.span() for m in IPV6.finditer(text))))
    if re.search("[0-9]{2}", text):
        rules += [("card", (m.span() for m in OTHER_CARD.finditer(text))), ("phone", (m.span() for m in INTERNATIONAL.finditer(text)))]
        rules += [("phone", (m.span() for m in GROUPED.finditer(text))), ("phone", (m.span(1) for m in CALLED.finditer(text)))]
    used = Stretches((s, e) for s, e, _ in taken)
    return [(s, e, kind) for kind, found in rules for s, e in found if used.add(s, e)]


class Stretches:
    """Disjoint stretches of a text, in order."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, s: int, e: int) -> bool:
        """Add a stretch unless it overlaps one; whether it was added."""
        k = bisect.bisect_left(self.ends, s + 1)
        if k < len(self.starts) and self.starts[k] < e:
            return False
        self.starts.insert(k, s)
        self.ends.insert(k, e)
        return True


def describe(text: str, s: int, e: int, kind: str, rule: int) -> tuple[str, str]:
    """The votes of LABELERS (one of -0+ each) and the FEATURES (0 or 1 each) of a candidate."""
    span, d = text[s:e], digits_of(text[s:e])
    before, after = text[max(0, s - 60) : s], text[e : e + 30]
    near = set(re.findall(r"[a-zà-ÿ-]+", before.lower())[-6:]) | set(re.findall(r"[a-zà-ÿ-]+", after.lower())[:3])
    left, right = before[-1:], after[:1]
    joined = left.isalnum() or right.isalnum() or left in ('"', "'", "=", "#") or right in ('"', "'", "=")
    groups = re.split(r"[^0-9]+", span.strip("+ ()"))
    six = kind == "ip" and ":" in span
    shape = {
        "email": 1 if re.fullmatch(r"[A-Za-z0-9]\S*@\S+\.[A-Za-z]{2,}", span) else 0,
        "ip": 1 if six or all(len(g) <= 3 for g in groups) else -1,
        "card": 1 if len(set(d)) > 2 and (len(groups) == 1 or all(len(g) == 4 for g in groups[:-1])) else -1,
        "phone": 1 if max(map(len, groups)) <= 5 or len(groups) == 1 else 0,
    }[kind]
    ending = re.split(r"[^A-Za-z]+", span)[-1].lower()
    listed = {
        "email": 1 if ending in ENDINGS else -1,
        "ip": 0 if six or not d or d[0] == "0" else 1,
        "card": 1 if d.startswith(CARD_STARTS) else -1,
        "phone": 0 if len(set(d)) < 3 or d[:1] == "0" and d[:2] != "00" else 1,
    }[kind]
    check = {
        "email": 0,
        "ip": 1 if (is_ipv6(span) if six else all(len(g) < 6 and int(g or -1) <= 255 for g in groups) and all(groups)) else -1,
        "card": 1 if luhn(d) and 14 <= len(d) <= 19 else -1,
        "phone": 1 if 10 <= len(d) <= 15 else -1,
    }[kind]
    context = 1 if near & FOR[kind] else -1 if near & AGAINST else 0
    votes = (rule, shape, -1 if joined else 1, listed, check, context)
    features = (span[:1] == "+", "(" in span or "[" in span, len(groups) > 2, len(span) > 24, bool(re.search(r"[0-9a-f]$", before) and left), kind == "email" and "@" not in span)
    return "".join("-0+"[v + 1] for v in votes), "".join("01"[bool(f)] for f in features)


def candidates(text: str) -> list[tuple[int, int, str, int, str, str]]:
    """(start, end, kind, is base, votes, features) of all candidates of a text."""
    kept, failed = base(text)
    more = loose(text, kept) if "@" in text or DIGIT.search(text) or MARKED.search(text) or "::" in text else []
    return [(s, e, k, b, *describe(text, s, e, k, r)) for group, b, r in ((kept, 1, 1), (failed, 0, -1), (more, 0, 0)) for s, e, k in group]


def patterns(docs: DataFrame) -> DataFrame:
    """kind, votes, features, n over the candidates of all texts: at most 4 * 3**6 * 2**6 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in common.filled(batches):
            for text in b.column(0):
                held.update((k, v, f) for _, _, k, _, v, f in candidates(text.as_py() or ""))
        if held:
            k, v, f = zip(*held)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(f), pa.array(list(held.values()), pa.int64())], names=["kind", "votes", "features", "n"])

    return common.in_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "kind string, votes string, features string, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


@dataclass
class Classifier:
    """For each kind the weights of its logistic classifier, and the labelers' reliabilities and prior that EM gave."""

    weights: dict[str, np.ndarray]
    reliability: dict[str, dict[str, tuple[float, float]]]
    prior: dict[str, float]

    def probability(self, kind: str, votes: str, features: str) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-encode(votes, features) @ w)))


def encode(votes: str, features: str) -> np.ndarray:
    return np.array([1.0, *(float(v == "+") for v in votes), *(float(v == "-") for v in votes), *(float(f == "1") for f in features)])


def expectation_maximisation(votes: list[str], n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict[str, tuple[float, float]], float]:
    """Posterior of each vote pattern; by labeler the chance of a yes, of those who vote, for true and for false spans; the prior.

    Labelers vote independently given the truth. Starts from labelers that are right four times of five, smoothed by two
    such votes; the chance of not voting doesn't depend on the truth.
    """
    v = np.array([["-0+".index(c) - 1 for c in x] for x in votes]).reshape(len(votes), len(LABELERS))
    yes, no, prior = np.full(len(LABELERS), 0.8), np.full(len(LABELERS), 0.2), 0.5
    q = np.full(len(votes), 0.5)
    for _ in range(rounds):
        logit = np.log(prior / (1 - prior)) + (np.where(v > 0, np.log(yes / no), 0) + np.where(v < 0, np.log((1 - yes) / (1 - no)), 0)).sum(axis=1)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        t, f = (n * q)[:, None], (n * (1 - q))[:, None]
        new = ((t * (v > 0)).sum(0) + 1.6) / ((t * (v != 0)).sum(0) + 2), ((f * (v > 0)).sum(0) + 0.4) / ((f * (v != 0)).sum(0) + 2)
        moved = max(np.abs(new[0] - yes).max(), np.abs(new[1] - no).max())
        yes, no, prior = *new, float(np.clip((t.sum() + 1) / (n.sum() + 2), 1e-3, 1 - 1e-3))
        if moved < 1e-7:
            break
    return q, {x: (float(a), float(b)) for x, a, b in zip(LABELERS, yes, no)}, prior


def fit(table: pd.DataFrame, ridge: float = 1.0, rounds: int = 40) -> Classifier:
    """A classifier from counts of patterns. A kind without candidates accepts nothing beyond its base."""
    out = Classifier({}, {}, {})
    for kind, g in table.sort_values(["kind", "votes", "features"]).groupby("kind"):
        votes, n = g["votes"].tolist(), g["n"].to_numpy(float)
        q, out.reliability[kind], out.prior[kind] = expectation_maximisation(votes, n)
        a = np.stack([encode(v, f) for v, f in zip(votes, g["features"])])
        w = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a.T * (n * p * (1 - p) + 1e-9)) @ a + ridge * np.eye(len(w)), a.T @ (n * (q - p)) - ridge * w)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-7:
                break
        out.weights[kind] = w
    return out


def train(docs: DataFrame) -> Classifier:
    return fit(patterns(docs).toPandas())


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("probability", T.DoubleType())])


def spans(docs: DataFrame, classifier: Classifier, threshold: float = 0.5, redact: bool = False) -> DataFrame:
    """docs with pii_spans: kind, start, end (code points, end exclusive), base and probability, by start, then kind.

    A span is kept if it is base or its probability reaches the threshold. A null text has none; repeated rows are
    searched each for itself; an empty table gives no rows; a column pii_spans of docs is replaced. redact: each stretch of spans
    in text is replaced by its first span's kind in square brackets.
    """
    docs = docs.drop("pii_spans")
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.columns.index("text")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("pii_spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probability: dict[tuple, float] = {}
        types = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("probability", pa.float64())]))
        for b in common.filled(batches):
            texts, found = b.column(at).to_pylist(), []
            for i, text in enumerate(texts):
                own = []
                for s, e, kind, is_base, *key in candidates(text or ""):
                    if (p := probability.get((kind, *key))) is None:
                        p = probability[(kind, *key)] = shared.value.probability(kind, *key)
                    if is_base or p >= threshold:
                        own.append({"kind": kind, "start": s, "end": e, "base": bool(is_base), "probability": p})
                own.sort(key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))
                found.append(own)
                if redact and own:
                    texts[i] = replaced(text, own)
            columns = [*b.columns, pa.array(found, types)]
            if redact:
                columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "pii_spans"])

    return common.in_arrow(docs, run, schema)


def replaced(text: str, found: list[dict]) -> str:
    out, last = [], 0
    for x in found:
        if x["start"] >= last:
            out += [text[last : x["start"]], f"[{x['kind'].upper()}]"]
        last = max(last, x["end"])
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with personal data in text replaced; n_chars, where docs has it, follows the new text.

    A null text stays null; repeated rows are treated each for itself; an empty table stays empty; other columns of docs,
    except for one called pii_spans, are kept whatever their names.
    """
    out = spans(docs, train(docs), threshold, redact=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("pii_spans") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
