"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings of letters counts the subsequences of three letters that they share, each by
DECAY to the power of the stretch it takes up in either (at most SPAN letters), and is normalised. An insult
with letters put in between, doubled, left out or replaced thus stays near the plain one. Letters are lower
case without marks; what isn't a letter is left out, so "i.d-i o t" reads as the word it spells: a unit is
a word, or a run of single letters, between two borders.

Nyström landmarks are units of the labelled texts: those that toxic documents have far more often than others
(witnesses), and common ones beside them. A unit's feature vector is its kernels with the landmarks times
the inverse root of the landmarks' own kernel matrix, and a linear machine with squared hinge loss is
trained on it. A witness is an example of either class, weighing as many documents of that class as have
it (copies count once); altered witnesses are further toxic examples, other units of clean documents clean
ones, and those that a machine rates highest join the next round's. A document's score is a logistic
function of its TOP highest margins. Two machines are trained, one on either half of the documents, and
calibrated on the other half's documents and their worst sentences; their mean is the model.

The machine is linear in kernels with the landmarks, so its margin is one number for each subsequence:
scoring is a look-up for every triple of letters within SPAN, in time linear in the text. A unit's norm
is found exactly where its margin could exceed FLOOR; a lower bound of the norm excludes the others,
which count as at it.

Bounds: trained on TRAIN_DOCS labelled documents of at most TRAIN_CHARS characters, taken
in the order of a hash of their id; every whole text is scored.

Edge cases: a null text counts as empty; a text without a unit of three letters has the score of margins at FLOOR; a
label that isn't 0 or 1, or whose id no document has, teaches nothing; with labels of one kind only, or none,
or without witnesses, every score is the share of label 1 (0 without labels); repeated rows get equal
scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, texts

TRAIN_DOCS, TRAIN_CHARS, SEED = 3000, 50_000, 11
SENTENCE = re.compile(r"[.!?\n]+")
#: Alphabet: 26 letters, one code for all others, and a unit's border on either side; the kernel's decay and longest stretch.
OTHER, BORDER, LETTERS = 26, 27, 28
DECAY, SPAN = 0.85, 6
SHOWN = "abcdefghijklmnopqrstuvwxyz?#"
LANDMARKS, WITNESSES, LEAST_DOCS, DRAWS = 320, 128, 3, 8
ROUNDS, COST, FLOOR, TOP = 3, 3.0, 0.0, 8
#: The share of a witness's margin that its altered forms are to reach.
NEAR = 0.5
THRESHOLD, PIECE = 0.7, 1 << 18

#: Letters of a unit that can be judged, borders included.
LEAST = 5
#: Offsets of a triple's second and third letter from its first, and its weight.
TRIPLES = [(b, c, DECAY ** (c + 1)) for c in range(2, SPAN) for b in range(1, c)]
CODES = LETTERS**3


def _code(point: int) -> int:
    """0 for what isn't a letter, 1 to 26 for a to z with or without marks, 27 for other letters: a letter's number and one."""
    char = chr(point)
    if not char.isalpha():
        return 0
    plain = unicodedata.normalize("NFKD", char.lower())[:1]
    return ord(plain) - 96 if "a" <= plain <= "z" else OTHER + 1


class _Alphabet:
    """Codes of the first code points; made once for each process. Those beyond are looked up one by one."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([_code(p) for p in range(0x3000)], np.int8)
        codes = cls.table[np.minimum(points, len(cls.table) - 1)]
        beyond = np.flatnonzero(points >= len(cls.table))
        if len(beyond):
            found, back = np.unique(points[beyond], return_inverse=True)
            codes[beyond] = np.array([_code(int(p)) for p in found], np.int8)[back]
        return codes


def units(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of some texts, the number of each one's unit, and each unit's text.

    A unit is a word, as white space parts them, or the single letters of words in a row, between two borders.
    """
    points = np.frombuffer("\n".join(found).encode("utf-32-le", "replace"), np.uint32)
    codes = _Alphabet.of(points)
    at = np.flatnonzero(codes)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = (points == 32) | ((points >= 9) & (points <= 13)) | (points == 0x85) | (points == 0xA0)
    word = np.cumsum(space, dtype=np.int32)[at]
    first = np.concatenate([[True], word[1:] != word[:-1]])
    ends = np.cumsum([len(t) + 1 for t in found])
    of = np.searchsorted(ends, at[first], "right")
    starts = np.flatnonzero(first)
    single = np.diff(starts, append=len(at)) == 1
    joined = np.concatenate([[False], single[1:] & single[:-1] & (of[1:] == of[:-1])])
    unit = (np.cumsum(~joined) - 1)[np.cumsum(first) - 1]
    sizes = np.bincount(unit) + 2
    letters = np.full(sizes.sum(), BORDER, np.int32)
    letters[np.arange(len(unit)) + 2 * unit + 1] = codes[at].astype(np.int32) - 1
    return letters, np.repeat(np.arange(len(sizes)), sizes), of[~joined]


_SHOWN = np.frombuffer(SHOWN.encode(), np.uint8)


def unit_text(letters: np.ndarray) -> str:
    return _SHOWN[letters].tobytes().decode()


_NUMBERS = np.zeros(128, np.int64)
_NUMBERS[_SHOWN] = np.arange(LETTERS)


def unit_texts(letters: np.ndarray, unit: np.ndarray) -> list[str]:
    whole, ends = unit_text(letters), np.flatnonzero(np.diff(unit, append=-1)) + 1
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)] if len(unit) else []


def embedded(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, subsequence, weight) of each string's normalised vector."""
    letters = _NUMBERS[np.frombuffer("".join(strings).encode("ascii"), np.uint8)]
    unit = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
    keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for b, c, weight in TRIPLES:
        n = max(0, len(letters) - c)
        inside = np.flatnonzero(unit[c:] == unit[:n])
        keys.append(unit[inside] * CODES + (letters[inside] * LETTERS + letters[inside + b]) * LETTERS + letters[inside + c])
        weights.append(np.full(len(inside), weight))
    seen, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums, of = np.bincount(back, np.concatenate(weights), len(seen)), seen // CODES
    norms = np.sqrt(np.bincount(of, sums * sums, len(strings)))
    return of, seen % CODES, sums / norms[of]


def kernels(strings: list[str], landmarks: np.ndarray, piece: int = 512) -> np.ndarray:
    """The normalised kernel of each string with each landmark; landmarks: their vectors, whole."""
    return np.concatenate([_dense(strings[k : k + piece]) @ landmarks.T for k in range(0, len(strings), piece)] or [np.zeros((0, len(landmarks)))])


def _dense(strings: list[str]) -> np.ndarray:
    out = np.zeros((len(strings), CODES), np.float32)
    of, codes, weights = embedded(strings)
    out[of, codes] = weights
    return out


def _least_norm(n: np.ndarray) -> np.ndarray:
    """The smallest norm that a unit of n letters can have: that of subsequences that are all distinct."""
    return np.sqrt(sum(np.maximum(n - c, 0) * w * w for _, c, w in TRIPLES))


@dataclass
class ToxicityModel:
    """weights: a number for each subsequence; margin = weights · unit / |unit| + bias; score = logistic(slopes · summary of the TOP margins + shift)."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(CODES, np.float32))
    bias: float = 0.0
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(3))
    shift: float = 0.0
    constant: float | None = None

    def margins(self, found: list[str]) -> tuple[np.ndarray, list[str]]:
        """The TOP highest margins of each text's units, FLOOR at least, and the highest one's unit; none where none exceeds FLOOR."""
        best, shown = np.full((len(found), TOP), FLOOR), [""] * len(found)
        letters, unit, of = units(found)
        if not len(letters):
            return best, shown
        second, first = letters * LETTERS, letters * (LETTERS * LETTERS)
        reached = np.zeros(len(letters), np.float32)
        for c in range(2, SPAN):
            n = len(letters) - c
            if n <= 0:
                break
            sums = np.zeros(n, np.float32)
            for b in range(1, c):
                sums += np.take(self.weights, first[:n] + second[b : b + n] + letters[c : c + n])
            reached[:n] += sums * (unit[c:] == unit[:n]) * np.float32(DECAY ** (c + 1))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1])
        totals, sizes = np.add.reduceat(reached, starts), np.diff(starts, append=len(letters))
        can = np.flatnonzero((sizes >= LEAST) & (totals > 0))
        can = can[totals[can] / _least_norm(sizes[can]) * 1.001 + self.bias > FLOOR]
        strings = [unit_text(letters[starts[k] : starts[k] + sizes[k]]) for k in can]
        each = self.unit_margins(strings)
        order = np.lexsort((-each, of[can]))
        order = order[each[order] > FLOOR]
        text = of[can][order]
        place = np.arange(len(order)) - np.searchsorted(text, text)
        kept = place < TOP
        best[text[kept], place[kept]] = each[order][kept]
        for k in order[place == 0]:
            shown[of[can][k]] = strings[k]
        return best, shown

    def unit_margins(self, strings: list[str]) -> np.ndarray:
        own = {u: k for k, u in enumerate(dict.fromkeys(strings))}
        found, names = [np.zeros(0)], list(own)
        for at in range(0, len(names), 2048):
            of, codes, weights = embedded(names[at : at + 2048])
            found.append(np.bincount(of, self.weights[codes] * weights, len(names[at : at + 2048])) + self.bias)
        return np.concatenate(found)[[own[u] for u in strings]] if strings else found[0]

    def scores(self, margins: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margins), self.constant)
        return 1 / (1 + np.exp(-np.clip(summary(margins) @ self.slopes + self.shift, -60, 60)))


def summary(margins: np.ndarray) -> np.ndarray:
    """The highest margin, and the means of the three and of all TOP highest."""
    return np.stack([margins[:, 0], margins[:, :3].mean(1), margins.mean(1)], 1)


def unit_sets(found: list[str]) -> list[set[str]]:
    """Each text's distinct units of three letters or more."""
    letters, unit, of = units(found)
    sets: list[set[str]] = [set() for _ in found]
    for k, string in zip(of, unit_texts(letters, unit)):
        if len(string) >= LEAST:
            sets[k].add(string)
    return sets


def near_groups(bags: list[set[str]]) -> list[int]:
    """A group's number for each bag: bags that share half of their units, as copies and near copies do, are one."""
    roots = list(range(len(bags)))

    def root(k: int) -> int:
        while roots[k] != k:
            roots[k] = k = roots[roots[k]]
        return k

    for seed in range(DRAWS):
        alike: dict[str, list[int]] = {}
        for k, bag in enumerate(bags):
            if bag:
                alike.setdefault(min(bag, key=lambda u: xxhash.xxh64_intdigest(u, seed)), []).append(k)  # noqa: B023
        for group in alike.values():
            for at, k in enumerate(group):
                for other in group[:at]:
                    if root(k) != root(other) and len(bags[k] & bags[other]) * 3 >= len(bags[k]) + len(bags[other]):
                        roots[root(k)] = root(other)
    return [root(k) for k in range(len(bags))]


def supports(bags: list[set[str]], y: np.ndarray) -> tuple[dict[str, int], dict[str, int], int, int]:
    """How many clean and how many toxic documents have each unit, and how many there are; copies and near copies count once."""
    counted: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
    groups = near_groups(bags)
    for bag, label, group in zip(bags, y, groups):
        for u in bag:
            counted[label].setdefault(u, set()).add(group)
    clean, toxic = ({u: len(of) for u, of in side.items()} for side in counted)
    n0, n1 = (max(1, len({g for g, t in zip(groups, y) if t == label})) for label in (0, 1))
    return clean, toxic, n0, n1


def witnesses(clean: dict[str, int], toxic: dict[str, int], n0: int, n1: int) -> list[str]:
    """Units that toxic documents have far more often than others, in LEAST_DOCS of them or more; the surest first."""
    rated = {}
    for u, k in toxic.items():
        n = k + clean.get(u, 0)
        surplus = (k - n * n1 / (n1 + n0)) / np.sqrt(n * n1 * n0 / (n1 + n0) ** 2)  # in standard deviations
        if k >= LEAST_DOCS and surplus >= 3 and k / n1 >= 4 * clean.get(u, 0) / n0:
            rated[u] = surplus
    return sorted(rated, key=lambda u: (-rated[u], u))[:WITNESSES]


def altered(unit: str, rng: np.random.Generator) -> list[str]:
    """The unit with a letter put in, one doubled and one left out, at each place between its borders."""
    word = unit[1:-1]
    put = [word[:k] + SHOWN[int(rng.integers(26))] + word[k:] for k in range(1, len(word))]
    doubled = [word[:k] + word[k - 1 :] for k in range(1, len(word) + 1)]
    without = [word[:k] + word[k + 1 :] for k in range(len(word))] if len(word) > 5 else []
    return [f"#{w}#" for w in (*put, *doubled, *without)]


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of least |w|²/2 + Σ cost · hinge², by Newton's method on the examples inside their margins (need)."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    loss = lambda w: w @ ridge @ w / 2 + cost @ np.maximum(need - y * (x1 @ w), 0) ** 2
    for _ in range(100):
        inside = y * (x1 @ w) < need
        xi, ci = x1[inside], cost[inside]
        step = np.linalg.solve(ridge + 2 * (xi.T * ci) @ xi, 2 * (xi.T * ci) @ (y * need)[inside]) - w
        size, before = 1.0, loss(w)
        while loss(w + size * step) > before and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _trained(found: list[str], y: np.ndarray) -> ToxicityModel | None:
    """A machine of labelled texts, not calibrated; none where no unit tells toxic texts from others."""
    bags = unit_sets(found)
    clean, toxic, n0, n1 = supports(bags, y)
    sure = witnesses(clean, toxic, n0, n1)
    if not sure:
        return None
    common = sorted((set(clean) | set(toxic)) - set(sure), key=lambda u: (-clean.get(u, 0) - toxic.get(u, 0), u))
    landmarks = _dense(sure + common[: LANDMARKS - len(sure)])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    kept = values > 1e-4
    root = vectors[:, kept] / np.sqrt(values[kept])  # the landmarks' kernel matrix to the power of -1/2

    rng = np.random.default_rng(SEED)
    near = {v: u for u in sure if not clean.get(u) for v in altered(u, rng) if v not in clean and v not in toxic}
    rest = sorted(set(clean) - set(sure))
    need = np.array([np.log((toxic[u] + 0.5) / n1 * n0 / (clean.get(u, 0) + 0.5)) / 2 for u in sure])  # the surer a witness, the wider its margin
    wide = np.concatenate([need, NEAR * np.array([need[sure.index(u)] for u in near.values()])])
    hard, model = np.arange(len(rest))[:: max(1, len(rest) // 2000)], None
    for _ in range(ROUNDS):
        own = kernels([*sure, *near, *(rest[k] for k in hard)], landmarks).astype(np.float64) @ root
        x = np.vstack([own, own[: len(sure)]])  # a witness that clean documents have too is an example of both classes
        z = np.concatenate([np.ones(len(wide)), -np.ones(len(hard) + len(sure))])
        weight = [*(toxic[u] for u in sure), *(1 for _ in near), *(1 for _ in hard), *(clean.get(u, 0) for u in sure)]
        w, bias = _machine(x, z, COST * np.array(weight, np.float64), np.concatenate([wide, np.ones(len(hard) + len(sure))]))
        model = ToxicityModel(((root @ w) @ landmarks.astype(np.float64)).astype(np.float32), bias)
        hard = np.union1d(hard, np.argsort(-model.unit_margins(rest), kind="stable")[:1000])
    return model


def fit(examples: list[tuple[str, int]]) -> ToxicityModel:
    """A model of (text, 0 or 1): the mean of two machines, one of either half, calibrated on the half that each hasn't seen."""
    y = np.array([t for _, t in examples], np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if len(set(y)) < 2:
        return ToxicityModel(constant=share)
    halves = [np.flatnonzero(np.arange(len(y)) % 2 == k) for k in (0, 1)]
    machines = [_trained([examples[k][0] for k in half], y[half]) for half in halves]
    margins, seen = [], []
    for machine, other in zip(machines, reversed(halves)):
        if machine:
            unseen = [examples[k][0] for k in other]
            margins += [machine.margins(piece)[0] for piece in pieces(iter(unseen))]
            margins.append(np.stack([own[own.sum(1).argmax()] for t in unseen for own in [machine.margins(SENTENCE.split(t))[0]]]))  # a text's label is its worst sentence's too
            seen += [y[other], y[other]]
    if not seen:
        return ToxicityModel(constant=share)
    found = [m for m in machines if m]
    slopes, shift = _calibrated(summary(np.concatenate(margins)), np.concatenate(seen))
    return ToxicityModel(sum(m.weights for m in found) / np.float32(len(found)), sum(m.bias for m in found) / len(found), slopes, shift)


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none negative, and shift of a logistic function, of least cross-entropy with a small ridge."""
    used = np.ones(x.shape[1], bool)
    while True:
        own = np.hstack([x[:, used], np.ones((len(x), 1))])
        w, ridge = np.zeros(own.shape[1]), np.diag([0.05] * int(used.sum()) + [1e-3])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            step = np.linalg.solve((own.T * (p * (1 - p))) @ own + ridge, own.T @ (p - y) + ridge @ w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        if (w[:-1] >= 0).all():
            slopes = np.zeros(x.shape[1])
            slopes[used] = w[:-1]
            return slopes, float(w[-1])
        used[np.flatnonzero(used)[w[:-1].argmin()]] = False


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fits on labelled documents that aren't held out, TRAIN_DOCS of them at most."""
    taught = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    few = taught.orderBy(order, "doc_id", "toxic").limit(TRAIN_DOCS)
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").filter(F.length("text") <= TRAIN_CHARS)  # TRAIN_DOCS rows
    rows = found.orderBy(order, "doc_id", "toxic", "text").limit(TRAIN_DOCS).select("text", "toxic").toLocalIterator()
    return fit([(r.text, r.toxic) for r in rows])


def pieces(found: Iterator[str]) -> Iterator[list[str]]:
    """The texts in lists of about PIECE characters; a longer text is a list of its own."""
    piece, size = [], 0
    for text in found:
        if piece and size + len(text) > PIECE:
            yield piece
            piece, size = [], 0
        piece.append(text)
        size += len(text)
    if piece:
        yield piece


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and unit (the letters that decided, empty for none) for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # CODES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            margins, shown = [np.zeros((0, TOP))], []
            for piece in pieces(t or "" for t in texts(batch.column(1))):
                own, decided = model.margins(piece)
                margins.append(own)
                shown += decided
            scores = model.scores(np.concatenate(margins))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([u.strip(SHOWN[BORDER]) for u in shown], pa.string())], ["doc_id", "score", "unit"])

    rated = map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, unit string")
    return rated.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "unit")
