"""Benchmark decontamination on a distributed positional inverted index.

The index is sharded by document: a segment holds some documents' posting lists, each term's
positions in the segment's stream of words, and is one row of a table in the shared folder. Term
frequencies over all segments order each searched phrase's terms from the rarest on; in a segment,
the rarest term's positions, adjusted by its offset in the phrase, are intersected with the next
term's adjusted list, and so on. Nothing but a phrase's own words is compared, so matches are exact.

The searched items go to every segment in blocks of BLOCK_BYTES of text at most. For items of one
block the index stores the terms that they use; for more, or where ``build_index`` is called without
items, it stores every term, is built once, and answers any later ``search`` for phrases or proximity.
Terms are known by 62 bits of XXH64; matches are exact as far as those differ between words.

Edge cases: a null text has no words; an item without words matches nothing; one with fewer words
than a window is one window; an item without an id hits words but isn't listed; ids that repeat among
the items count once; repeated documents are judged one by one; very long documents get a segment
of their own; empty tables give an empty result or clean documents; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, one_of, staged

WINDOW = 10
#: Words of a segment, free positions between two documents, candidates that are held at once.
SEGMENT_WORDS, GAP, CANDIDATES = 1 << 20, 16, 1 << 21
#: Text of the items that are searched at once; a phrase takes WINDOW numbers of 8 bytes in memory, so a block some 16 times its text.
BLOCK_BYTES = 8 << 20

#: Bytes of words: digits, letters (lower-cased) and all of UTF-8 beyond ASCII; the others part words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

POSTINGS = "doc_ids array<{id}>, text_hashes array<long>, starts array<int>, lengths array<int>, terms array<long>, counts array<int>, positions array<int>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def term_id(word: bytes) -> int:
    """A term's 62-bit number in the index."""
    return xxhash.xxh64_intdigest(word) >> 2


def build_index(docs: DataFrame, items: list[bytes] | None = None) -> DataFrame:
    """The segments of docs (doc_id, text); only terms of the given items' texts, if any are given."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    known = None if items is None else spark.sparkContext.broadcast({w: term_id(w) for text in items for w in words(text)})  # BLOCK_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = (lambda w: term_id(w)) if known is None else known.value.get
        ids, hashes, starts, lengths, streams, at = [], [], [], [], [], 0
        for batch in batches:
            for doc_id, text_hash, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                found = words(text.as_py() or b"")
                if ids and at + len(found) > SEGMENT_WORDS:
                    yield _segment(ids, hashes, starts, lengths, streams, kind_of(batch))
                    ids, hashes, starts, lengths, streams, at = [], [], [], [], [], 0
                ids.append(doc_id.as_py())
                hashes.append(text_hash.as_py())
                starts.append(at)
                lengths.append(len(found))
                terms = np.array([find(w) or -1 for w in found], np.int64)
                used = np.flatnonzero(terms >= 0)
                streams.append((terms[used], (used + at).astype(np.int32)))
                at += len(found) + GAP
        if ids:
            yield _segment(ids, hashes, starts, lengths, streams, kind_of(batch))

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, POSTINGS.format(id=kind))


def kind_of(batch: pa.RecordBatch) -> pa.DataType:
    return batch.schema.field(0).type


def _segment(ids: list, hashes: list, starts: list, lengths: list, streams: list, kind: pa.DataType) -> pa.RecordBatch:
    terms, positions = (np.concatenate(x) for x in zip(*streams))
    order = np.argsort(terms, kind="stable")
    distinct, counts = np.unique(terms, return_counts=True)
    one = lambda x, t: pa.array([x], pa.list_(t))
    return pa.RecordBatch.from_arrays(
        [one(ids, kind), one(hashes, pa.int64()), one(starts, pa.int32()), one(lengths, pa.int32()), one(distinct, pa.int64()), one(counts, pa.int32()), one(positions[order], pa.int32())],
        ["doc_ids", "text_hashes", "starts", "lengths", "terms", "counts", "positions"],
    )


class Phrases:
    """Phrases of at most ``width`` terms as arrays: their terms' order from the rarest on, and the items that have them.

    ``terms`` has a row for each distinct phrase (-1 beyond its length); the owners of row n are
    ``owner[first[n] : first[n + 1]]``, numbers of ``items``.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], width: int) -> None:
        rows, owners = [np.zeros((0, width), np.int64)], [np.zeros(0, np.int64)]
        self.items = [item for item, _ in items]
        for n, (_, text) in enumerate(items):
            terms = np.array([term_id(w) for w in words(text)], np.int64)
            if len(terms):
                padded = np.concatenate([terms, np.full(max(0, width - len(terms)), -1, np.int64)])
                rows.append(np.lib.stride_tricks.sliding_window_view(padded, width))
                owners.append(np.full(len(rows[-1]), n, np.int64))
        self.terms, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        both = np.unique(np.stack([which.reshape(-1), np.concatenate(owners)], axis=1), axis=0)
        self.owner, self.first = both[:, 1], np.searchsorted(both[:, 0], np.arange(len(self.terms) + 1))
        self.length = (self.terms >= 0).sum(axis=1)
        self.order = np.tile(np.arange(width), (len(self.terms), 1))

    def rarest_first(self, frequency: dict[int, int]) -> Phrases:
        """Orders each phrase's offsets by its terms' frequency in the index; phrases with a term that it lacks go."""
        known = np.array(sorted(frequency), np.int64)
        counts = np.array([frequency[int(t)] for t in known], np.int64)
        at = np.minimum(np.searchsorted(known, self.terms), max(len(known) - 1, 0))
        seen = np.where(known[at] == self.terms, counts[at], 0) if len(known) else np.zeros(self.terms.shape, np.int64)
        seen[self.terms < 0] = np.iinfo(np.int64).max
        self.order = np.argsort(seen, axis=1, kind="stable")
        keep = (seen > 0).all(axis=1)
        sizes = np.diff(self.first)
        self.owner = self.owner[np.repeat(keep, sizes)]
        self.first = np.concatenate([[0], np.cumsum(sizes[keep])])
        self.terms, self.order, self.length = self.terms[keep], self.order[keep], self.length[keep]
        return self


class Segment:
    """A segment's posting lists, for searching."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray) -> None:
        self.starts, self.terms, self.positions = starts, terms, positions
        self.begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.span = int(positions.max(initial=0)) + 2 * GAP + 2
        self.keys = np.repeat(np.arange(len(terms)), counts) * self.span + positions

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Where each term's list is, -1 for none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def candidates(self, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) for every position of each phrase's rarest term, a bounded number at a time."""
        rows = np.arange(len(phrases.length))
        numbers = self.number(phrases.terms[rows, phrases.order[:, 0]])
        rows, numbers = rows[numbers >= 0], numbers[numbers >= 0]
        sizes = self.begin[numbers + 1] - self.begin[numbers]
        bounds = np.cumsum(sizes)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + CANDIDATES, "right")))
            n = sizes[at:to]
            which = np.repeat(np.arange(at, to), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield rows[which], self.positions[self.begin[numbers[which]] + inside] - phrases.order[rows[which], 0]
            at = to

    def has(self, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each list has a position from low to high."""
        if not len(self.keys):
            return np.zeros(len(numbers), bool)
        at = np.searchsorted(self.keys, numbers * self.span + np.maximum(low, 0))
        return (numbers >= 0) & (high >= 0) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= numbers * self.span + np.minimum(high, self.span - 1))

    def matches(self, phrases: Phrases, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every match: each term at its offset, or up to slack words from there in the same document."""
        rows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, start in self.candidates(phrases):
            start = start.astype(np.int64)
            anchor = start + phrases.order[row, 0]
            doc = np.searchsorted(self.starts, anchor, "right") - 1
            floor = self.starts[doc]
            ceiling = np.append(self.starts[1:], self.span)[doc] - 1
            for k in range(1, phrases.order.shape[1]):
                more = k < phrases.length[row]
                at = phrases.order[row, k]
                want = start + at
                low, high = np.maximum(want - slack, floor), np.minimum(want + slack, ceiling)
                keep = ~more | ((low <= high) & self.has(self.number(phrases.terms[row, at]), low, high))
                row, start, floor, ceiling = row[keep], start[keep], floor[keep], ceiling[keep]
            rows.append(row)
            starts.append(start)
        return np.concatenate(rows), np.concatenate(starts)


def frequencies(index: DataFrame, terms: set[int]) -> dict[int, int]:
    """Occurrences of each of the terms over the whole index."""
    asked = index.sparkSession.createDataFrame(pa.table({"term": pa.array(sorted(terms), pa.int64())}))
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    return {r["term"]: r["n"] for r in each.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}  # a block's terms


def search(index: DataFrame, items: list[tuple[str | None, bytes]], width: int = WINDOW, slack: int = 0) -> DataFrame:
    """segment, nth, doc_id, text_hash, n_words, spans (start, end; disjoint) and items (ids) for every document of the index."""
    spark = index.sparkSession
    phrases = Phrases(items, width)
    phrases.rarest_first(frequencies(index, {int(t) for t in np.unique(phrases.terms)}))
    sent = spark.sparkContext.broadcast(phrases)  # WINDOW numbers for each word of a block
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                get = lambda name: batch.column(name)[n].values  # noqa: B023, E731
                starts, lengths = get("starts").to_numpy().astype(np.int64), get("lengths").to_numpy()
                row, start = Segment(starts, get("terms").to_numpy(), get("counts").to_numpy(), get("positions").to_numpy().astype(np.int64)).matches(sent.value, slack)
                doc = np.searchsorted(starts, start + sent.value.order[row, 0], "right") - 1
                low, high = np.maximum(start - slack, starts[doc]), np.minimum(start + sent.value.length[row] + slack, starts[doc] + lengths[doc])
                spans: list[list] = [[] for _ in lengths]
                for d, a, b in sorted(zip(doc.tolist(), (low - starts[doc]).tolist(), (high - starts[doc]).tolist())):
                    if spans[d] and a <= spans[d][-1]["end"]:
                        spans[d][-1]["end"] = max(b, spans[d][-1]["end"])
                    else:
                        spans[d].append({"start": a, "end": b})
                owners: list[set] = [set() for _ in lengths]
                for d, p in set(zip(doc.tolist(), row.tolist())):
                    owners[d].update(sent.value.items[i] for i in sent.value.owner[sent.value.first[p] : sent.value.first[p + 1]].tolist())
                ids = get("doc_ids")
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(batch.column("segment")[n].as_py()), len(ids)), pa.array(range(len(ids)), pa.int32()), ids, get("text_hashes"), pa.array(lengths, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x - {None}) for x in owners], pa.list_(pa.string()))],
                    ["segment", "nth", "doc_id", "text_hash", "n_words", "spans", "items"],
                )

    numbered = index.select("*", F.xxhash64("doc_ids", "text_hashes", F.input_file_name()).alias("segment"))
    return map_batches(numbered, run, f"segment long, nth int, doc_id {kind}, text_hash long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and text_hash for every document."""
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / BLOCK_BYTES) or 1
    found, every = None, staged(build_index(docs)) if blocks > 1 else None
    for block in range(blocks):  # usually one
        some = texts if blocks == 1 else texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        taken = [(r.item_id, bytes(r.text)) for r in some.collect()]
        hits = search(staged(build_index(docs, [text for _, text in taken])) if every is None else every, taken, width)
        found = hits if found is None else found.unionByName(hits)
    if blocks == 1:
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    else:
        key = ["doc_id", "text_hash", "n_words"]  # equal documents have equal hits
        copies = found.groupBy(*key).agg((F.count(F.lit(1)) / blocks).cast("int").alias("copies"), F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        found = copies.select(*key, "spans", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
        n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1))))).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "text_hash",
    )


def proximity(docs: DataFrame, items: DataFrame, width: int, slack: int) -> DataFrame:
    """doc_id, item_id and spans where all terms of a window of an item lie within slack words of their places.

    For a number of items that fits one block.
    """
    taken = [(r.item_id, bytes(r.text)) for r in items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).collect()]
    if sum(len(t) for _, t in taken) > BLOCK_BYTES:
        raise ValueError("too many items for one block")
    hits = search(staged(build_index(docs, [t for _, t in taken])), taken, width, slack)
    return hits.filter(F.size("spans") > 0).select("doc_id", F.explode("items").alias("item_id"), "spans")


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs, all columns, without the rows that hold a window of an item."""
    key, text_hash = one_of("__hit_id", docs.columns), one_of("__hit_hash", docs.columns)
    hit = contamination(docs, items, width).filter("contaminated").select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(text_hash))
    return docs.join(hit, same, "left_anti")
