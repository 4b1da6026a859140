"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans are exact: regular expressions with checks (see BASE), always reported. Proposers add
looser candidates: other forms of phone numbers and e-mail addresses, identity numbers, and secrets.
Four labelers vote yes, no or nothing on every candidate: the strictness of its form with its check,
a gazetteer of known parts, the words before it, and its characters. Expectation-maximisation on the
counts of all vote patterns of the whole corpus (at most a few hundred) estimates each labeler's
reliability for a kind, and each pattern's probability. A logistic span classifier is trained on those
probabilities, over a sample of TRAIN_SPANS distinct candidates in the order of a hash, each weighed by
the logarithm of how often it occurs; candidates beside the
base spans are added where it gives a half or more, if they don't overlap a base span.

Edge cases: a null text counts as empty; without candidates nothing is trained; repeated rows get
equal results; an empty table gives an empty result; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged, texts

TRAIN_SPANS, EM_ROUNDS, STEPS, RATE, SEED = 20_000, 50, 400, 0.5, 5
KINDS = ("email", "ip", "card", "phone", "secret", "identity")
BEFORE = 40

#: Fixed forms of the base kinds; ``base_matches`` finds the first two in linear time.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]+)+"),
    "phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{16,}|(?i:(?<=password=)|(?<=passwd=)|(?<=pwd=)|(?<=secret=)|(?<=token=))[^\s\"']{6,}"),
    "identity": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
}

#: Each form, fixed or loose, needs one of these characters; texts without them aren't searched further.
SIGN = re.compile(r"[0-9@=\[(]")

#: Gazetteers: parts that known personal data have, and words that stand before it or before other numbers.
KNOWN_PARTS = {
    "email": (".com", ".org", ".net", ".edu", ".de", ".fr", ".es", ".uk"), "ip": (), "card": ("4", "51", "52", "53", "54", "55", "34", "37", "6011"),
    "phone": ("+1", "+7", "+33", "+34", "+44", "+49", "+39", "+81", "+86"), "secret": ("AKIA", "ASIA", "ghp_", "xox", "sk-", "AIza"), "identity": ("DE", "FR", "ES", "GB", "IT"),
}
CUES = {
    "email": ("mail", "contact", "write", "courriel", "correo"), "ip": ("ip", "host", "server", "address", "login"), "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "secret": ("password", "passwd", "pwd", "secret", "token", "key"), "identity": ("ssn", "iban", "passport", "account"),
}
OTHER_CUES = ("version", "release", "chapter", "section", "isbn", "page", "figure", "commit", "sha")


#: Characters before an address's "@", what follows it, and an address of four numbers from a run's first digit on.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
FOUR_NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")


def base_matches(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches of a base form, in linear time.

    The plain forms of addresses start anew at every character of a long run. A match of four numbers
    starts at a run's first digit or nowhere in that run; one of an e-mail address holds one "@" and
    starts as far to the left of it as its characters, or the match before, allow.
    """
    if kind == "ip":
        for m in FOUR_NUMBERS.finditer(text):
            yield m.start(), m.end()
    elif kind == "email":
        free, at = 0, text.find("@")
        while at >= 0:
            before = text[free:at]
            start = free + len(before.rstrip(LOCAL))
            found = DOMAIN.match(text, at + 1) if start < at else None
            free = at + 1
            if found:
                yield start, found.end()
                free = found.end()
            at = text.find("@", free)
    else:
        for m in BASE[kind].finditer(text):
            yield m.start(), m.end()


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    """A base match's check."""
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and the matches that fail their check."""
    good, failed = [], []
    for kind in BASE:
        if {"email": "@", "ip": ".", "phone": "+"}.get(kind, "") in text:
            for start, end in base_matches(kind, text):
                (good if valid(kind, text[start:end]) else failed).append((kind, start, end))
    return good, failed


class Taken:
    """Which characters spans have taken, as disjoint intervals in order."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, start: int, end: int) -> bool:
        n = bisect_left(self.starts, end)
        return n > 0 and self.ends[n - 1] > start


def ordered(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def examine(text: str, kind: str, start: int, end: int, strict: int) -> tuple[list[int], list[float]]:
    """A candidate's votes (1 yes, 0 no, -1 none) and its features."""
    found, before = text[start:end], text[max(0, start - BEFORE) : start].lower()
    digits, letters = sum("0" <= c <= "9" for c in found), sum(c.isalpha() for c in found)
    part = any((p in found) if kind == "email" else found.startswith(p) for p in KNOWN_PARTS[kind])
    cue, other = any(c in before for c in CUES[kind]), any(c in before for c in OTHER_CUES)
    entropy = _entropy(found)
    dense = {"secret": entropy >= 3 and digits >= 2, "card": 12 <= digits <= 19, "phone": 9 <= digits <= 15, "identity": digits >= 9}.get(kind)
    votes = [strict, 1 if part else -1, 1 if cue and not other else 0 if other and not cue else -1, -1 if dense is None else int(dense)]
    features = [1.0, *(float(kind == k) for k in KINDS), float(strict == 1), float(strict == 0), float(part), float(cue), float(other), entropy / 5, digits / len(found), letters / len(found), min(len(found), 64) / 64, float(dense or 0)]
    return votes, features


N_FEATURES = 1 + len(KINDS) + 10


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, list[int], list[float], bool]]]:
    """The base spans, and every candidate with its votes and features; its last item tells base spans."""
    if not SIGN.search(text):
        return [], []
    good, failed = base_spans(text)
    rows = [(*s, *examine(text, *s, 1), True) for s in good] + [(*s, *examine(text, *s, 0), False) for s in failed if s[0] != "card" or sum("0" <= c <= "9" for c in text[s[1] : s[2]]) >= 9]
    taken = Taken([(a, b) for _, a, b in good])
    for kind, form in LOOSE.items():
        for m in form.finditer(text):
            if not taken.touches(m.start(), m.end()):
                rows.append((kind, m.start(), m.end(), *examine(text, kind, m.start(), m.end(), -1), False))
    return good, rows


CANDIDATE = "array<struct<kind:string,start:long,end:long,votes:array<int>,features:array<float>,base:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, found (the candidates) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.float32())), ("base", pa.bool_())])
        for batch in batches:
            counts, digests, found = [], [], []
            for text in texts(batch.column(1)):
                good, rows = candidates(text or "")
                own = Counter(k for k, _, _ in good)
                counts.append([own[k] for k in BASE])
                digests.append(hashlib.sha256(ordered(good).encode()).hexdigest())
                found.append([dict(zip(("kind", "start", "end", "votes", "features", "base"), r)) for r in rows])
            columns = [pa.array([c[n] for c in counts], pa.int64()) for n in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(found, pa.list_(span))], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found {CANDIDATE}")


@dataclass
class SpanModel:
    """reliability: by kind and labeler, the chances of yes for personal data and for other spans; weights: of the features."""

    reliability: dict[str, list[tuple[float, float]]]
    posterior: dict[tuple[str, tuple[int, ...]], float]
    weights: np.ndarray

    def accepts(self, features: list[float]) -> bool:
        return float(np.dot(self.weights, features)) >= 0


def estimate(patterns: dict[tuple[str, tuple[int, ...]], int]) -> tuple[dict[str, list[tuple[float, float]]], dict[tuple[str, tuple[int, ...]], float]]:
    """Labelers' reliabilities and patterns' probabilities by EM; patterns: how often each (kind, votes) occurs.

    Starts from the majority of votes; a pattern without votes has its kind's prior. A match that fails
    its kind's check is known not to be one and stays at 0. Counts are smoothed by one vote each way in
    favour of labelers that do better than chance.
    """
    reliability, posterior = {}, {}
    for kind in sorted({k for k, _ in patterns}):
        own = {v: n for (k, v), n in patterns.items() if k == kind}
        p = {v: 0.0 if v[0] == 0 else (1 + 2 * v.count(1)) / (2 + 2 * (v.count(1) + v.count(0))) for v in own}
        rates: list[tuple[float, float]] = []
        for _ in range(EM_ROUNDS):
            prior = (1 + sum(n * p[v] for v, n in own.items())) / (2 + sum(own.values()))
            rates = []
            for j in range(len(next(iter(own)))):
                weigh = lambda said, true: sum(n * (p[v] if true else 1 - p[v]) for v, n in own.items() if v[j] in said)  # noqa: B023, E731
                rates.append(((4 + weigh((1,), True)) / (5 + weigh((0, 1), True)), (1 + weigh((1,), False)) / (5 + weigh((0, 1), False))))
            for v in (v for v in own if v[0] != 0):
                yes, no = math.log(prior), math.log(1 - prior)
                for said, (a, b) in zip(v, rates):
                    if said >= 0:
                        yes, no = yes + math.log(a if said else 1 - a), no + math.log(b if said else 1 - b)
                p[v] = 1 / (1 + math.exp(min(60, no - yes)))
        reliability[kind] = rates
        posterior |= {(kind, v): x for v, x in p.items()}
    return reliability, posterior


def fit(scanned: DataFrame) -> SpanModel:
    each = scanned.select(F.explode("found").alias("c"))
    counted = each.groupBy("c.kind", "c.votes").count().collect()  # a few hundred patterns at most
    reliability, posterior = estimate({(r["kind"], tuple(r["votes"])): r["count"] for r in counted})
    distinct = each.groupBy("c.kind", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    order = F.xxhash64(F.lit(SEED), "kind", "votes", "features")
    sample = distinct.select("*", order.alias("order")).orderBy("order", "kind", "features").limit(TRAIN_SPANS).collect()
    x = np.array([r["features"] for r in sample], np.float64).reshape(len(sample), N_FEATURES)
    y = np.array([posterior[r["kind"], tuple(r["votes"])] for r in sample])
    weigh = np.log1p([r["n"] for r in sample])  # a span copied a thousand times counts ten times
    weigh /= max(weigh.sum(), 1e-9)
    w = np.zeros(N_FEATURES)
    for _ in range(STEPS if len(sample) else 0):
        w -= RATE * (x.T @ (weigh * (1 / (1 + np.exp(-np.clip(x @ w, -60, 60))) - y)) + 1e-5 * w)
    return SpanModel(reliability, posterior, w)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every document."""
    scanned = staged(scan(docs))
    sent = docs.sparkSession.sparkContext.broadcast(fit(scanned))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, added = [], []
            for found in texts(batch.column(6)):
                spans = [(c["kind"], c["start"], c["end"]) for c in found if c["base"]]
                taken, free, chosen = Taken([(a, b) for _, a, b in spans]), 0, []
                for c in sorted((c for c in found if not c["base"]), key=lambda c: (c["start"], KINDS.index(c["kind"]))):
                    if c["votes"][0] != 0 and sent.value.accepts(c["features"]) and c["start"] >= free and not taken.touches(c["start"], c["end"]):
                        chosen.append((c["kind"], c["start"], c["end"]))
                        free = c["end"]
                said.append(ordered(spans + chosen))
                added.append(len(chosen))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(said, pa.string()), pa.array(added, pa.int64())], [*batch.schema.names[:6], "spans", "n_added"])

    kind = scanned.schema["doc_id"].dataType.simpleString()
    return map_batches(scanned, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
