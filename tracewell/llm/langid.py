"""Language identification by bit-sliced Bloom filters of character n-grams.

Each of a filter's positions holds a word with one bit for each language. An n-gram's HASHES words,
ANDed, are the set of languages that contain it. A text's hits are counted for each language; of N
n-grams, N times a language's false-positive rate (its share of set bits to the power of HASHES) are
expected without any, so (hits - N rate) / (1 - rate) is its corrected count. The largest decides; the
score is its share of all languages' corrected counts.

Bounds: learned from about TRAIN_DOCS distinct texts for each language, drawn by a hash, and the first
TRAIN_CHARS characters of each; n-grams are counted on the executors, and those that make a language's
filter, 1 / LEAST_SHARE at most, come to the driver; a position has a 64-bit word for every 64 languages. An n-gram belongs to a
language if it makes up LEAST_SHARE of its n-grams and at least LEAST_RATIO of the share that it has
where it is most frequent.

Edge cases: null and letterless texts are "und" with score 0; so is all if no language was learned; ties
go to the first language by name; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored. Whole texts count, long ones in pieces.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, held_out, map_batches, texts

TRAIN_DOCS, TRAIN_CHARS = 500, 20_000
GRAMS, HASHES, SLOTS = (3, 4), 3, 1 << 20
LEAST_SHARE, LEAST_RATIO = 2e-5, 0.2
PIECE, SEED = 1 << 19, 11


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every n-gram whose inner characters are letters, in lower-cased code points."""
    letter = _is_letter()[codes]
    signs = np.where(letter, codes, 0).astype(np.uint64)
    count = len(codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = letter[1 : 1 + count].copy()
    for k in range(2, n - 1):
        whole &= letter[k : k + count]
    at = np.flatnonzero(whole)
    value = np.full(len(at), n, np.uint64)
    for k in range(n):
        value = (value ^ signs[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value, at


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(f"\n{text.lower()}\n".encode("utf-32-le", "surrogatepass"), "<u4")


def _slots(value: np.ndarray, k: int) -> np.ndarray:
    return ((value + np.uint64(k) * ((value >> np.uint64(32)) | np.uint64(1))) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray

    def languages_of(self, value: np.ndarray) -> np.ndarray:
        """The bit masks of the languages that each n-gram is in, a column for every 64 languages."""
        mask = self.slots[_slots(value, 0)].copy()
        for k in range(1, HASHES):
            mask &= self.slots[_slots(value, k)]
        return mask

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return "und", 0.0
        hits, total, letters = np.zeros(len(self.languages)), 0, False
        for at in range(0, len(text), PIECE):
            codes = codes_of(text[max(0, at - max(GRAMS) + 1) : at + PIECE])
            letters = letters or bool(_is_letter()[codes].any())
            for n in GRAMS:
                value, _ = grams(codes, n)
                mask = self.languages_of(value)
                total += len(value)
                hits += [np.count_nonzero(mask[:, k >> 6] & np.uint64(1 << (k & 63))) for k in range(len(self.languages))]
        if not letters:
            return "und", 0.0
        fair = np.maximum((hits - total * self.rates) / (1 - self.rates), 0)
        best = int(np.argmax(fair))
        return self.languages[best], float(fair[best] / fair.sum()) if fair.sum() else 0.0


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text and how often each occurs."""
    codes = codes_of(text)
    return np.unique(np.concatenate([grams(codes, n)[0] for n in GRAMS]), return_counts=True)


def filters_of(own: dict[str, np.ndarray]) -> Filters:
    """Filters of each language's n-grams."""
    languages = sorted(own)
    slots, rates = np.zeros((SLOTS, -(-len(languages) // 64)), np.uint64), np.zeros(len(languages))
    for k, lang in enumerate(languages):
        for j in range(HASHES):
            slots[_slots(own[lang], j), k >> 6] |= np.uint64(1 << (k & 63))
        rates[k] = np.count_nonzero(slots[:, k >> 6] & np.uint64(1 << (k & 63))) ** HASHES / SLOTS**HASHES
    return Filters(languages, slots, np.minimum(rates, 0.999))


def fit(examples: list[tuple[str, str]]) -> Filters:
    """Filters of (text, language), by the rule that ``train`` has for tables."""
    counts: dict[str, Counter[int]] = {}
    for text, lang in examples:
        found, n = counts_of(text)
        counts.setdefault(lang, Counter()).update(dict(zip(found.tolist(), n.tolist())))
    share = {lang: {g: n / own.total() for g, n in own.items()} for lang, own in counts.items()}
    most: dict[int, float] = {}
    for own in share.values():
        for g, s in own.items():
            most[g] = max(s, most.get(g, 0.0))
    return filters_of({lang: np.array(sorted(g for g, s in own.items() if s >= LEAST_SHARE and s >= LEAST_RATIO * most[g]), np.uint64) for lang, own in share.items()})


def sample(docs: DataFrame) -> DataFrame:
    """lang, text: about TRAIN_DOCS distinct texts of each language, drawn by their hashes, twice as many at most."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    drawn = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = known.select("lang", drawn.alias("drawn"), F.substring("text", 1, TRAIN_CHARS).alias("text"))
    n = rows.select("lang", "drawn").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # copies have one draw
    few = rows.join(F.broadcast(n), "lang").filter(F.col("drawn") < F.least(F.lit(1.0), F.lit(float(TRAIN_DOCS)) / F.col("n"))).dropDuplicates(["lang", "drawn"])  # n: a row for each language
    return few.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("drawn"))).filter(F.col("nth") <= 2 * TRAIN_DOCS).select("lang", "text")


def train(docs: DataFrame) -> Filters:
    """Counts n-grams on the executors; those that come back are at most 1 / LEAST_SHARE for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                found, counts = counts_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    counted = map_batches(sample(docs).select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    languages = [r["lang"] for r in docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select("lang").distinct().collect()]
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))  # a row for each language
    own = shares.withColumn("most", F.max("share").over(W.partitionBy("gram"))).filter((F.col("share") >= LEAST_SHARE) & (F.col("share") >= LEAST_RATIO * F.col("most")))
    found: dict[str, list[int]] = {lang: [] for lang in languages}
    for r in own.select("lang", "gram").toLocalIterator():
        found[r["lang"]].append(r["gram"])
    return filters_of({lang: np.array(sorted(g), np.int64).view(np.uint64) for lang, g in found.items()})


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(filters or train(docs))  # SLOTS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [sent.value.predict(text) for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
