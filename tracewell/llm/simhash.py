"""SimHash near-duplicates: exact links by a forest of vantage-point trees.

A 64-bit fingerprint has a bit set where more than half of a text's word shingles have it in their
XXH64. Fingerprints link at RADIUS or fewer differing bits.

Search. The 64 bits are cut into TREES groups. Two fingerprints within RADIUS bits are within
RADIUS // TREES bits in one group at least, so each group has a vantage-point tree under the Hamming
distance of that group's bits, and linked fingerprints meet in one tree at least. A tree's node has a
vantage point and a distance mu: what is at most mu away goes to the inner shard, the rest to the
outer one, and a point of the inner side whose distance is within the group's radius of the boundary
is sent to the outer shard as well (by the triangle inequality nothing else can have a partner across
it). Trees are fitted on a bounded sample (a SAMPLE_PART-th of the distinct fingerprints and SAMPLE
of them at most); every fingerprint is routed through them. What meets in a leaf is compared over all
64 bits, so links are exact whatever the trees look like. A leaf with more than LEAF_CAP points is
dealt into blocks, and each pair of blocks is a group of its own: no task holds more than twice the cap.

Only distinct fingerprints are searched, so copies cost nothing, and a group returns a spanning forest
of its links, not the pairs.

Edge cases: a null text has no words and fingerprint zero, as an empty one; texts with fewer words
than a shingle make one shingle of all their words; a null doc_id is never a component's id unless
nothing else is there; repeated rows get equal results; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, one_of, ship_package, staged
from .components import components

WORDS, RADIUS, SEED = 4, 4, 42
TREES = 3
#: Points a leaf is meant to hold, and the most that are compared as one group.
LEAF, LEAF_CAP = 1024, 4096
SAMPLE_PART, SAMPLE = 8, 1 << 21
#: The 64 bits in TREES groups of 21, 21 and 22.
GROUPS = ((0, 21), (21, 42), (42, 64))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = list(accumulate(len(w) + 1 for w in tokens))
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :])]
    return _majority(np.array(hashes, np.uint64))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, fp: a row for every row of docs, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py() or b"", words) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")), run, f"doc_id {kind}, text_hash long, fp long")


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def fit_tree(points: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and boundaries of a tree with 2**depth leaves, its nodes in the order of a heap.

    A node that no boundary divides well keeps all its points on the inner side: mu is 64 there.
    """
    vantage, mu = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, 64, np.int16)
    rng, todo = np.random.default_rng(SEED), [(0, points)]
    while todo:
        node, here = todo.pop()
        if node >= len(vantage) or len(here) < 2:
            continue
        best = (0.9 * len(here), np.uint64(0), 64)
        for point in here[rng.integers(0, len(here), 6)]:
            inside = np.cumsum(np.bincount(_distance(here, point), minlength=66))
            sent = len(here) - np.concatenate([np.zeros(radius, np.int64), inside])[: len(inside)]
            worst = np.maximum(inside, sent)
            at = int(worst[:65].argmin())
            best = min(best, (int(worst[at]), point, at), key=lambda b: b[0])
        _, vantage[node], mu[node] = best
        if mu[node] < 64:
            d = _distance(here, vantage[node])
            todo += [(2 * node + 1, here[d <= mu[node]]), (2 * node + 2, here[d > mu[node] - radius])]
    return vantage, mu


def route(points: np.ndarray, vantage: np.ndarray, mu: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of a point, leaf) for each leaf that each point is a member or a visitor of."""
    row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    for _ in range((len(vantage) + 1).bit_length() - 1):
        d, edge = _distance(points[row], vantage[node]).astype(np.int16), mu[node]
        inner = d <= edge
        both = inner & (d > edge - radius) & (edge < 64)
        row, node = np.concatenate([row, row[both]]), np.concatenate([np.where(inner, 2 * node + 1, 2 * node + 2), 2 * node[both] + 2])
    return row, node - len(vantage)


def local_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among points (signed longs): each linked point and its tree's smallest."""
    points = np.unique(points)
    rest, linked, roots = points.view(np.uint64), [], []
    while len(rest):
        seed, front, rest = rest[:1], rest[:1], rest[1:]
        reached = []
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            step = max(1, (1 << 20) // len(rest))
            for at in range(0, len(front), step):
                near |= (_distance(rest[None, :], front[at : at + step, None]) <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            reached.append(front)
        found = np.concatenate([*reached, seed[:0]])
        linked.append(found)
        roots.append(np.repeat(seed, len(found)))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *linked]).view(np.int64), np.concatenate([none, *roots]).view(np.int64)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the fingerprints (column fp, no repeats) as all their links do."""
    spark, inner_radius = distinct.sparkSession, radius // TREES
    n = distinct.count()
    part = max(SAMPLE_PART, -(-n // SAMPLE))
    sample = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(part)) == 0).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    sample = np.sort(sample)
    depth = max(0, min((max(n, 1) // LEAF).bit_length(), max(1, len(sample) // 8).bit_length() - 1))
    groups = [(np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)) for lo, hi in GROUPS]
    forest = spark.sparkContext.broadcast([fit_tree((sample >> lo) & mask, depth, inner_radius) for lo, mask in groups])  # 2**depth nodes a tree, at most a fourth of the sample

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for tree, ((lo, mask), (vantage, mu)) in enumerate(zip(groups, forest.value)):
                row, leaf = route((fp.view(np.uint64) >> lo) & mask, vantage, mu, inner_radius)
                yield pa.RecordBatch.from_arrays([pa.array((tree << 40) + leaf), pa.array(fp[row])], ["cell", "fp"])

    def compare(table: pa.Table) -> pa.Table:
        a, b = local_links(table.column("fp").to_numpy(), radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    placed = map_batches(distinct.select("fp"), assign, "cell long, fp long")
    counts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LEAF_CAP).cast("int").alias("blocks"))
    sized = placed.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = sized.select("cell", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grouped = paired.select("cell", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    ship_package(spark)
    return grouped.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long")


def _members(prints: DataFrame, radius: int) -> DataFrame:
    """fp, component_id (the smallest doc_id), n_component, head (the first row by id, then text hash) for every fingerprint of prints."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), first.alias("head"), F.count(F.lit(1)).alias("n"))
    roots = components(links(distinct.select("fp"), radius))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "head", "n", F.coalesce("root", "fp").alias("root"))
    totals = cut(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.min("head").alias("head"), F.sum("n").alias("n_component")))  # so that a large component's side of the join can be split
    return cut(placed.select("fp", "root").join(totals, "root").select("fp", "component_id", "head", "n_component"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach), n_component (rows)."""
    prints = staged(fingerprints(docs, words))
    joined = prints.join(_members(prints, radius), "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_component")


def keep_first(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each component, all columns: the smallest doc_id's, where ids repeat the smallest text hash's.

    A row without an id stays only where all of its component lack one; of rows with equal ids and texts
    one stays, whichever their other columns are. Different texts of one id are judged apart.
    """
    prints = staged(fingerprints(docs, words))
    key, text_hash = one_of("__head_id", docs.columns), one_of("__head_hash", docs.columns)
    heads = cut(_members(prints, radius).select(F.col("head.doc_id").alias(key), F.col("head.text_hash").alias(text_hash)).distinct())
    kept = docs.join(heads, docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(text_hash)), "left_semi")
    rows = prints.join(heads, prints["doc_id"].eqNullSafe(F.col(key)) & (prints["text_hash"] == F.col(text_hash)), "left_semi").count()  # as kept has, without its texts
    if rows == heads.count():
        return kept
    return kept.withColumn(text_hash, F.xxhash64("text")).dropDuplicates(["doc_id", text_hash]).drop(text_hash)
