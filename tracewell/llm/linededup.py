"""Line dedup: an exact set-similarity join of lines.

A line is the set of its words, which white space parts. A line goes if an earlier one (by doc_id, then
line number) has a Jaccard similarity of 0.8 or more with it, whether that one stays or goes. Copies are
settled first: a line's text stands for all its occurrences, and only its first one can stay.

Distinct lines are joined through an inverted index. Words are numbered so that their order is the
order of rarity: a word's hash falls into one of BUCKETS buckets, the buckets are ranked by the words
they count over the whole corpus, and the rank replaces the bucket in the hash. A line of n words is
indexed by the first n // 5 + 1 of its words (as the longer one of a pair; n // 9 + 1 as the shorter),
and a pair that shares such a word is a candidate if the lengths, the words that remain after it, and
64-bit bitmaps of the lines' RAREST first words allow a similarity of 0.8. Candidates are verified on
their words.

The bitmaps' bound: let x and y be the sizes, s the words that must be shared, p and q the words in the
two bitmaps (RAREST or the whole line). Shared words have one order in both lines, so those in one of
the two heads but not in the other are all in the same one, and the heads differ in at most
max(2 (x - s) + q - p, 2 (y - s) + p - q) words, the bitmaps in no more bits. Lines of more than WIDE_FROM
words have a bitmap of all their words besides, in which each word flips a bit: a word of both lines flips
it twice, so that no more bits differ than words do, x + y - 2 s.

Words are read and numbered by Arrow functions over whole texts (in expressions they cost ten times as
much; the README has the figures), and postings travel as blocks. A word that the corpus has more than
MOST_POSTINGS times is indexed by pairs: two lines that share it as their first shared word share a second
one as well, at most one place beyond the prefix, and the pair of both is what they meet under. (Lines of
one word have no second; they only resemble lines of one word.) So a key's lines stay few while the corpus
grows. Keys of more than MOST_POSTINGS lines or of more than HOT candidates for each line, as groups of
near copies give, are treated apart, as joins of rows: those lines are first compared with the three
earliest lines that have the key, and only those that no such comparison removes are joined with all.

Texts stay where they are but for those of candidates: a bitmap of their first places is broadcast, and
the documents are read once more for the lines that it names.

Edge cases: a null text has no lines; a line without words stays; documents with one id count as one,
whose lines share their numbers, and lines in one place don't remove each other; null ids come first
in the order, and the smallest id there is counts as one; an empty table gives an empty result; other columns are ignored; long lines are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship_package
from .common import cut, map_batches, one_of, staged

BUCKET_BITS, CODE_BITS = 21, 52
BUCKETS, CHUNKS = 1 << BUCKET_BITS, 64
HOT, HEADS, MOST_POSTINGS = 32, 3, 1 << 12
#: A line's rarest words that its bitmap has; more would fill its 64 bits.
RAREST = 32
#: Lines of more words have a bitmap of WIDE 64-bit words besides.
WIDE_FROM, WIDE = 80, 2
_WIDE = [f"w{k}" for k in range(WIDE)]
#: Postings that a shard is meant to hold, the least number of shards, bytes and lines that are numbered at once.
SHARD_POSTINGS, LEAST_SHARDS, PIECE_BYTES, PIECE_LINES = 100_000, 64, 1 << 18, 1 << (64 - CODE_BITS)
#: Documents that a task hands to Python at once.
BATCH_DOCS = 512
#: Bits of the bitmap of places for each line that is fetched, the most it has in all, and those of a part of it.
PLACE_BITS, MOST_BITS, PART_BITS = 16, 28, 22
NO_ID = -(1 << 63)
#: What a worker keeps at most: hashes of lines that it has indexed, postings not yet sent, words not yet counted.
KEPT_LINES, KEPT_POSTINGS, KEPT_WORDS = 1 << 17, 1 << 17, 1 << 19
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.isin(np.arange(256), list(b" \t\n\r\v\f"))

POSTING = np.dtype([("code", "<u8"), ("key", "<i8"), ("bits", "<u8"), ("n", "<u4"), ("pos", "<u4"), *((c, "<u8") for c in _WIDE)])


def packed(rows: np.ndarray) -> bytes:
    """Postings sorted by code, column by column, the codes as differences."""
    columns = [np.diff(rows["code"], prepend=np.uint64(0)), *(np.ascontiguousarray(rows[c]) for c in POSTING.names[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    rows, at = np.empty(len(raw) // POSTING.itemsize, POSTING), 0
    for name in POSTING.names:
        kind = POSTING[name]
        rows[name] = np.frombuffer(raw, kind, len(rows), at)
        at += len(rows) * kind.itemsize
    rows["code"] = np.cumsum(rows["code"])
    return rows


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Powers:
    """Powers of FACTOR and of its inverse modulo 2**64, as many as a text has needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
            one = np.ones(1, np.uint64)
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate([one, np.full(n - 1, f, np.uint64)])) for f in (FACTOR, inverse))
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits of each number."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a text, and the number of its line: a polynomial in a word's bytes, from running sums."""
    codes = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], SPACES[codes], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = _Powers.of(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h), np.searchsorted(np.flatnonzero(codes == 10), starts)


def survey(docs: DataFrame) -> DataFrame:
    """A row for each document: doc, and k1, k2 (128-bit hashes of its lines, null for those without words); and rows of
    chunk and counts, a part of the word buckets' frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, np.int64)
        words: list[np.ndarray] = []

        def count(bodies: list[bytes], most: int) -> None:
            words.append((word_hashes(b"\n".join(bodies))[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            bodies.clear()
            if sum(map(len, words)) > most:
                totals[:] += np.bincount(np.concatenate(words), minlength=BUCKETS)
                words.clear()

        names = ["doc", "k1", "k2", "chunk", "counts"]
        longs, size = pa.list_(pa.int64()), BUCKETS // CHUNKS
        for batch in batches:
            own, size_of, first, second = [], 0, [], []
            for text in batch.column(1):
                body = text.as_py()
                keys = []
                if body is not None:
                    own.append(body)
                    size_of += len(body)
                    if size_of > PIECE_BYTES:
                        count(own, KEPT_WORDS)
                        size_of = 0
                    keys = [xxhash.xxh3_128_intdigest(line) if line.strip() else None for line in body.split(b"\n")]
                first.append([None if k is None else _signed(k >> 64) for k in keys])
                second.append([None if k is None else _signed(k & 0xFFFFFFFFFFFFFFFF) for k in keys])
            count(own, KEPT_WORDS)
            none = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, longs), pa.array(second, longs), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names)
        count([], 0)
        if totals.any():
            parts = [np.minimum(totals[k * size : k * size + size], (1 << 32) - 1).astype(np.uint32).tobytes() for k in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(CHUNKS, pa.int64()), pa.nulls(CHUNKS, longs), pa.nulls(CHUNKS, longs), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names)

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.col("text").cast("binary").alias("text"))
    return map_batches(rows, run, "doc long, k1 array<long>, k2 array<long>, chunk int, counts binary")


def bucket_counts(surveyed: DataFrame) -> np.ndarray:
    """The buckets' frequencies over the whole corpus."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.uint32).astype(np.int64) for c in table.column("counts"))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    ship_package(surveyed.sparkSession)
    parts = surveyed.filter("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()  # BUCKETS numbers
    counts = np.zeros(BUCKETS, np.int64)
    for part in parts:
        counts[part["chunk"] * (BUCKETS // CHUNKS) :][: BUCKETS // CHUNKS] = np.frombuffer(part["counts"], np.int64)
    return counts


def lines_of(surveyed: DataFrame) -> DataFrame:
    """doc, line, k1, k2 for every line."""
    each = surveyed.filter("chunk IS NULL").select("doc", F.posexplode(F.arrays_zip("k1", "k2")).alias("line", "k"))
    return each.select("doc", "line", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"))


def classes_of(lines: DataFrame) -> DataFrame:
    """k1, k2 and the place (doc, line) of a text's first occurrence; lines without words are left out."""
    firsts = lines.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min(F.struct("doc", "line")).alias("at"))
    return firsts.select("k1", "k2", "at.doc", "at.line")


def prefixes(lines: list[bytes], keys: list[int], ranks: np.ndarray, frequent: int) -> np.ndarray:
    """The postings of PIECE_LINES lines at most; words with codes from ``frequent`` on go by pairs."""
    h, row = word_hashes(b"\n".join(lines))
    low = np.uint64((1 << (CODE_BITS - BUCKET_BITS)) - 1)
    code = ranks[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(CODE_BITS - BUCKET_BITS) | (h & low)
    both = np.sort((row.astype(np.uint64) << np.uint64(CODE_BITS)) | code)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    row, code = (both >> np.uint64(CODE_BITS)).astype(np.int64), both & np.uint64((1 << CODE_BITS) - 1)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(row)))
    n, pos = np.repeat(sizes, sizes), np.arange(len(row)) - np.repeat(starts, sizes)
    marks = np.where(pos < RAREST, np.uint64(1) << (code & np.uint64(63)), np.uint64(0))
    bits = np.bitwise_or.reduceat(marks, starts) if len(starts) else marks
    wide = np.zeros((WIDE, len(starts)), np.uint64)
    many = sizes > WIDE_FROM
    if many.any():
        own = code[n > WIDE_FROM] >> np.uint64(6)
        begins, bit = np.cumsum(sizes[many]) - sizes[many], own % np.uint64(64 * WIDE)
        for k in range(WIDE):
            flips = np.where(bit >> np.uint64(6) == k, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
            wide[k, many] = np.bitwise_xor.reduceat(flips, begins)
    own = np.repeat(np.arange(len(starts)), sizes)
    kept = np.flatnonzero(pos < n // 5 + 1)
    paired = (code[kept] >= np.uint64(frequent)) & (n[kept] > 1)
    first = kept[paired]
    # the words after a frequent one, up to one place beyond the prefix
    after = np.minimum(n[first] // 5 + 1, n[first] - 1) - pos[first]
    at = np.repeat(first, after)
    second = at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(after) - after, after)
    of_pair = mixed(mixed(code[at]) + code[second]) | np.uint64(1 << 63)
    at, word = np.concatenate([kept[~paired], at]), np.concatenate([code[kept[~paired]], of_pair])
    found = np.empty(len(at), POSTING)
    line = own[at]
    for name, values in (("code", word), ("pos", pos[at]), ("n", n[at]), ("bits", bits[line] if len(at) else word), ("key", np.array(keys, np.int64)[row[at]])):
        found[name] = values
    for k, name in enumerate(_WIDE):
        found[name] = wide[k, line]
    return found


def blocks(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """shard, data: blocks of the postings of all distinct lines."""
    spark = docs.sparkSession
    ranks = np.empty(BUCKETS, np.uint32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint32)
    shards = max(LEAST_SHARDS, -(-int(counts.sum()) // (7 * SHARD_POSTINGS)))
    frequent = int(np.count_nonzero(counts <= MOST_POSTINGS)) << (CODE_BITS - BUCKET_BITS)  # codes from here on
    sent = spark.sparkContext.broadcast(ranks)  # BUCKETS numbers

    def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(found)
        if not len(rows):
            return
        shard = (((rows["code"] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((rows["code"], shard))
        rows, shard = rows[order], shard[order]
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for part in np.array_split(np.arange(len(cuts) + 1), max(1, len(rows) >> 18)):
            pieces = [(int(shard[lo]), packed(rows[lo:hi])) for lo, hi in ((([0, *cuts][k]), ([*cuts, len(rows)][k])) for k in part)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pieces], pa.int64()), pa.array([x for _, x in pieces], pa.binary())], ["shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        lines, keys, size, found, n_found = [], [], 0, [], 0
        for batch in batches:
            for text in batch.column(0):
                body = text.as_py()
                for line in body.split(b"\n") if body is not None else ():
                    key = xxhash.xxh3_128_intdigest(line)
                    if key in seen:
                        continue
                    if len(seen) >= KEPT_LINES:
                        seen.clear()
                    seen.add(key)
                    lines.append(line)
                    keys.append(_signed(key >> 64))
                    size += len(line)
                    if size >= PIECE_BYTES or len(lines) >= PIECE_LINES:
                        found.append(prefixes(lines, keys, sent.value, frequent))
                        n_found += len(found[-1])
                        lines, keys, size = [], [], 0
                        if n_found > KEPT_POSTINGS:
                            yield from flush(found)
                            found, n_found = [], 0
        if lines:
            found.append(prefixes(lines, keys, sent.value, frequent))
        if found:
            yield from flush(found)

    return map_batches(docs.select(F.col("text").cast("binary").alias("text")), run, "shard long, data binary")


def _pairs(rows: np.ndarray, group: np.ndarray, sizes: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (a, b), keys of two lines, among postings sorted by code and n; and which groups (of one code, of the
    given sizes) have more than ``hot`` of them for each line, whose candidates are left out."""
    n, pos, bits, key = rows["n"].astype(np.int64), rows["pos"].astype(np.int64), rows["bits"], rows["key"]
    heads, long = np.minimum(n, RAREST), n > WIDE_FROM
    found, of, first = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], np.arange(len(rows))
    counts, dense, step = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool), 0
    while True:
        step += 1
        first = first[: np.searchsorted(first, len(rows) - step)]
        second = first + step
        first = first[(group[first] == group[second]) & (n[second] * 4 <= n[first] * 5) & ~dense[group[first]]]
        if not len(first):
            break
        second = first + step
        x, y = n[first], n[second]
        need = -(-(x + y) * 4 // 9)
        can = (np.minimum(x - pos[first], y - pos[second]) >= need) & ((pos[first] * 9 <= x) | ((x == y) & (pos[second] * 9 <= y)))
        a, b, need = first[can], second[can], need[can]
        x, y, p, q = n[a], n[b], heads[a], heads[b]
        good = np.bitwise_count(bits[a] ^ bits[b]) <= np.maximum(2 * (x - need) + q - p, 2 * (y - need) + p - q)
        a, b, most = a[good], b[good], (x + y - 2 * need)[good]
        differ = sum(np.bitwise_count(rows[c][a] ^ rows[c][b]).astype(np.int64) for c in _WIDE)
        good = (differ <= most) | ~(long[a] & long[b])
        a, b = a[good], b[good]
        if len(a):
            found.append(np.stack([key[a], key[b]], axis=1))
            of.append(group[a])
            counts += np.bincount(group[a], minlength=len(sizes))
            dense = counts > hot * sizes
    pairs = np.concatenate(found)[~dense[np.concatenate(of)]]
    return np.unique(np.sort(pairs, axis=1), axis=0), dense


MATCHED = "word long, a long, b long, n int, bits long, pos int"


def match(table: pa.Table, hot: int, most: int) -> pa.Table:
    """Candidate pairs of a shard (a, b), and the postings (word, a, n, bits, pos) of keys that more than ``most`` lines or ``hot`` candidates for each have."""
    rows = np.concatenate([unpacked(x.as_py()) for x in table.column("data")])
    rows = rows[np.lexsort((rows["key"], rows["n"], rows["code"]))]
    again = (rows["code"][1:] == rows["code"][:-1]) & (rows["key"][1:] == rows["key"][:-1])
    rows = rows[np.concatenate([[True], ~again])]
    starts = np.flatnonzero(np.concatenate([[True], rows["code"][1:] != rows["code"][:-1]]))
    sizes = np.diff(np.append(starts, len(rows)))
    compared = (sizes > 1) & (sizes <= most)
    each = np.repeat(compared, sizes)
    pairs, dense = _pairs(rows[each], np.repeat(np.arange(int(compared.sum())), sizes[compared]), sizes[compared], hot)
    apart = sizes > most
    apart[np.flatnonzero(compared)[dense]] = True
    left = rows[np.repeat(apart, sizes)]
    none = lambda k, t: pa.nulls(k, t)
    long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    cold = pa.table({"word": none(len(pairs), pa.int64()), "a": long(pairs[:, 0]), "b": long(pairs[:, 1]), "n": none(len(pairs), pa.int32()), "bits": none(len(pairs), pa.int64()), "pos": none(len(pairs), pa.int32())})
    apart = pa.table({"word": long(left["code"]), "a": long(left["key"]), "b": none(len(left), pa.int64()), "n": pa.array(left["n"].astype(np.int32)), "bits": long(left["bits"]), "pos": pa.array(left["pos"].astype(np.int32))})
    return pa.concat_tables([cold, apart])


def _similar_enough(a, b) -> Column:
    """Whether two postings of one word can be of lines with a similarity of 0.8; a and b name their columns."""
    total = a("n") + b("n")
    need = F.ceil(total * 4 / 9)
    lengths = (a("n") * 5 >= b("n") * 4) & (b("n") * 5 >= a("n") * 4)
    after = F.least(a("n") - a("pos"), b("n") - b("pos")) >= need
    p, q = F.least(a("n"), F.lit(RAREST)), F.least(b("n"), F.lit(RAREST))
    bitmap = F.bit_count(a("bits").bitwiseXOR(b("bits"))) <= F.greatest(2 * (a("n") - need) + q - p, 2 * (b("n") - need) + p - q)
    return lengths & after & bitmap


KEYS = ["k1", "k2"]
PAIR = ("later_k1", "later_k2", "early_k1", "early_k2")


def _before(a, b) -> Column:
    """Whether a's place comes before b's. Plain comparisons: those of structs become methods of thousands of bytes, and the
    JVM's compiler took up to 490 MB, outside the heap, for one of them."""
    return (a("doc") < b("doc")) | ((a("doc") == b("doc")) & (a("line") < b("line")))


def _pair(late, early) -> list[Column]:
    return [late("k1").alias("later_k1"), late("k2").alias("later_k2"), early("k1").alias("early_k1"), early("k2").alias("early_k2")]


def _ordered(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Candidates (a, b: first halves of keys) as classes in the order of their places; two that begin in one place, as
    several documents of one id have it, are left out."""
    at = lambda key: wanted.select(F.col("k1").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in (*KEYS, "doc", "line")))
    side = lambda key: (lambda c: F.col(f"{key}_{c}"))
    a, b = side("a"), side("b")
    late, early = (lambda c: F.when(_before(a, b), b(c)).otherwise(a(c))), (lambda c: F.when(_before(a, b), a(c)).otherwise(b(c)))
    return pairs.join(at("a"), "a").join(at("b"), "b").filter((a("doc") != b("doc")) | (a("line") != b("line"))).select(*_pair(late, early))


def _joined(probe: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates of two sets of postings: probe's lines and earlier ones of index."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    return probe.alias("a").join(index.alias("b"), (a("word") == b("word")) & _before(b, a) & _similar_enough(a, b)).select(*_pair(a, b)).distinct()


def _bits(doc: np.ndarray, line: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a place in a bitmap of 2**size."""
    h = mixed(mixed(doc.astype(np.int64).view(np.uint64)) + line.astype(np.uint64))
    return (h >> np.uint64(64 - size)).astype(np.int64), (h & np.uint64((1 << size) - 1)).astype(np.int64)


def places_of(wanted: DataFrame) -> np.ndarray:
    """A bitmap of the places (doc, line) of lines, of MOST_BITS at most: its parts are made by tasks."""
    size = min(MOST_BITS, max(PART_BITS, (PLACE_BITS * wanted.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy(), batch.column(1).to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array((at >> PART_BITS).astype(np.int32)), pa.array((at & ((1 << PART_BITS) - 1)).astype(np.int32))], ["part", "at"])

    def made(table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << PART_BITS, bool)
        marks[table.column("at").to_numpy()] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    at = map_batches(wanted.select("doc", F.col("line").cast("int").alias("line")), run, "part int, at int")
    bitmap = np.zeros((1 << size) >> 3, np.uint8)
    for part in at.groupBy("part").applyInArrow(made, "part int, bits binary").collect():  # 2**size bits
        bitmap[part["part"] << (PART_BITS - 3) :][: 1 << (PART_BITS - 3)] = np.frombuffer(part["bits"], np.uint8)
    return bitmap


def bodies_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """k1, k2, body of the wanted classes (k1, k2, and the place doc, line of an occurrence), and of a few others whose places the bitmap can't tell from theirs."""
    bitmap = places_of(wanted)
    size = len(bitmap).bit_length() + 2
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = lambda at: (sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        for batch in batches:
            column = batch.column(1)
            counts = np.array([0 if body is None else body.count(b"\n") + 1 for body in (x.as_py() for x in column)], np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            line = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            one, two = _bits(batch.column(0).to_numpy()[row], line, size)
            hits = np.flatnonzero(marked(one) & marked(two))
            bodies, last, lines = [], -1, []
            for r, at in zip(row[hits].tolist(), line[hits].tolist()):
                if r != last:
                    last, lines = r, column[r].as_py().split(b"\n")
                bodies.append(lines[at])
            keys = [xxhash.xxh3_128_intdigest(body) for body in bodies]
            halves = [pa.array([_signed(k >> 64) for k in keys], pa.int64()), pa.array([_signed(k & 0xFFFFFFFFFFFFFFFF) for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays([*halves, pa.array(bodies, pa.binary())], [*KEYS, "body"])

    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.col("text").cast("binary").alias("text"))
    return map_batches(texts, run, "k1 long, k2 long, body binary")


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs of a similarity of 0.8 or more, by the words of the two lines."""
    key = lambda side: [f"{side}_{c}" for c in KEYS]
    of = lambda side: bodies.select(*(F.col(c).alias(f"{side}_{c}") for c in (*KEYS, "body")))
    both = pairs.join(of("later"), key("later")).join(of("early"), key("early"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [similar(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept, pa.bool_())) for c in batch.columns[:4]], list(PAIR))

    return map_batches(both.select(*PAIR, "later_body", "early_body"), run, ", ".join(f"{c} long" for c in PAIR))


def similar(a: bytes, b: bytes) -> bool:
    """Whether two lines' sets of words have a Jaccard similarity of 0.8 or more."""
    x, y = set(a.split()), set(b.split())
    shared = len(x & y)
    return shared * 5 >= (len(x) + len(y) - shared) * 4


def removed_classes(docs: DataFrame, counts: np.ndarray, classes: DataFrame) -> DataFrame:
    """k1, k2 of the distinct lines that an earlier line removes."""
    ship_package(docs.sparkSession)
    hot_from, most = HOT, MOST_POSTINGS
    matched = staged(blocks(docs, counts).groupBy("shard").applyInArrow(lambda table: match(table, hot_from, most), MATCHED))
    pairs = staged(matched.filter("b IS NOT NULL").select("a", "b").distinct())
    posted = matched.filter("b IS NULL").dropDuplicates(["word", "a"])
    # a posting has the first half of its line's key; two lines that share it both become candidates
    asked = pairs.select(F.explode(F.array("a", "b")).alias("k1")).unionByName(posted.select(F.col("a").alias("k1"))).distinct()
    wanted = staged(classes.join(asked, "k1", "left_semi"))
    hot = staged(posted.withColumnRenamed("a", "k1").join(wanted, "k1").select("word", *KEYS, "doc", "line", "n", "bits", "pos"))
    bodies = staged(bodies_of(docs, wanted))
    later = lambda pairs: verified(pairs, bodies).select(F.col("later_k1").alias("k1"), F.col("later_k2").alias("k2"))
    gone = later(_ordered(pairs, wanted))
    # the words of many lines: the earliest lines first
    if not hot.isEmpty():
        first = hot.groupBy("word", F.pmod(F.xxhash64(*KEYS), F.lit(HEADS)).alias("nth")).agg(F.min(F.struct("doc", "line", *KEYS, "n", "bits", "pos")).alias("h"))
        heads = cut(first.select("word", "h.*"))
        gone = cut(gone.unionByName(later(_joined(hot, heads))).distinct())
        left = hot.join(gone, KEYS, "left_anti")
        gone = gone.unionByName(later(_joined(left, hot)))
    return gone.distinct()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_DOCS rows: a batch of whole texts is held twice by the JVM, outside its heap, and twice by Python."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, str(BATCH_DOCS))
    try:
        yield
    finally:
        spark.conf.set(rows, before)


def marked_lines(docs: DataFrame) -> DataFrame:
    """doc, line, gone for every line of every document."""
    with small_batches(docs.sparkSession):
        surveyed = staged(survey(docs))
        lines = lines_of(surveyed)
        classes = staged(classes_of(lines))
        gone = cut(removed_classes(docs, bucket_counts(surveyed), classes)).withColumn("class_gone", F.lit(True))
    settled = classes.join(gone, KEYS, "left").select(*KEYS, F.col("doc").alias("first_doc"), F.col("line").alias("first_line"), "class_gone")
    found = lines.join(settled, KEYS, "left")
    copy = _before(lambda c: F.col(f"first_{c}"), F.col)
    return found.select("doc", "line", F.coalesce(F.col("first_doc").isNotNull() & (copy | F.col("class_gone")), F.lit(False)).alias("gone"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (the removed lines' numbers from 0, comma-joined) for every id."""
    marked = marked_lines(docs)
    numbers = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("line")))), lambda n: n.cast("string")), ",")
    counted = marked.groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("gone").cast("long")).alias("n_removed"), numbers.alias("removed"))
    ids = docs.select("doc_id").distinct().withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return ids.join(counted, "doc", "left").select("doc_id", zero("n_lines"), zero("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the removed lines taken out of the texts."""
    key, gone = one_of("__id", docs.columns), one_of("__gone", docs.columns)
    report = dedup_report(docs).select(F.col("doc_id").alias(key), F.split(F.nullif("removed", F.lit("")), ",").cast("array<int>").alias(gone))
    joined = docs.join(report, docs["doc_id"].eqNullSafe(F.col(key)), "left")
    kept = F.filter(F.split("text", "\n"), lambda _, n: ~F.coalesce(F.array_contains(gone, n), F.lit(False)))
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), F.array_join(kept, "\n"))).drop(key, gone)
