"""Hard-negative mining by a Voronoi-partition kNN join.

Vectors are rounded down to integers of SCALE steps; a score is their inner product. A vector x, none
longer than M, gets a coordinate sqrt(M² - |x|²) more; an anchor q gets a zero and the length M, which
changes none of its orders. Their distance is then sqrt(2 M² - 2 q·x): high scores are near neighbours. Pivots are rows; every anchor belongs to its
nearest one's cell, and a cell's anchors are a group, in blocks of MOST_ANCHORS. What an anchor still
needs lies in a shell of distances around it, and by the triangle inequality in a shell around its pivot:
a candidate goes to the groups whose shells hold it, and there it is joined exactly.

Two such joins run. The first serves candidates to groups of their own label and finds an anchor's
PARTNERS best positives. The second has, for each positive, a band of scores, and finds the best NEGATIVES
of other labels in it. The shells' far bounds come from a sample of SAMPLE rows: what an anchor finds
there is a score that its true partners reach at least. The sample decides how many candidates travel and
never what is found. Where distances tell little (random directions in many dimensions), most candidates
reach most groups; there are then as few groups as MOST_ANCHORS allows, and nothing is left out.

A join's task is a block of anchors against SPLIT candidates of one group or so, dealt by their hash, so
that neither a label, a cell nor copies of one vector fill a task; each task sends the few best of each
anchor, and a window ranks those.

Edge cases: a row without an id, a label or a vector, or with a null or non-finite component, takes no
part; a shorter vector counts as filled up with zeros; repeated rows that are no anchors are rows of
their own, an anchor that is repeated as a whole is one anchor, and rows with the anchor's id are never
its partners; scores that are no long are cut to the nearest; with too few partners there are fewer rows;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workers import ship_package
from .common import map_batches, staged

#: Rows that pivots are taken from and bounds are estimated on, and their numbers at most; cells for so many anchors each, between the least and the most.
SAMPLE, SAMPLE_NUMBERS, CELL_ANCHORS, LEAST_CELLS, MOST_CELLS = 4096, 1 << 20, 2048, 4, 1024
#: Anchors of a block, candidates of a task, and buckets of labels by which the first join's groups are told apart.
MOST_ANCHORS, SPLIT, LABELS = 4096, 32_768, 16


@dataclass(frozen=True)
class Recipe:
    """Every ``every``-th id is an anchor; negatives score from low % to high % of a positive's score."""

    every: int = 50
    scale: int = 256
    partners: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


PRODUCTION = Recipe()
OUTPUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
CANDIDATE = "cell int, bucket int, block int, split int, kind int, ids binary, labels binary, vectors binary, more binary"


def vectors_of(rows: DataFrame, scale: int = PRODUCTION.scale) -> DataFrame:
    """id, label, v (whole numbers as doubles) of the rows (vec_id, label, embedding) that take part."""
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    steps = F.transform("embedding", lambda x: x.cast("double") * scale)
    floored = F.transform(steps, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return kept.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), floored.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow list column, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as int64 where they fit, else as Python's integers."""
    bound = float(np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0)))
    if bound < 2.0**52:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return whole(a) @ whole(b).T


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by place."""
    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > kth)
    found = np.concatenate([above, np.flatnonzero(scores == kth)[: k - len(above)]])
    return found[np.argsort(-scores[found], kind="stable")]


@dataclass
class Space:
    """The augmented space: its pivots, the largest squared norm, the number of rows, and the sample."""

    dims: int
    top: float
    total: int
    pivots: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    sample: np.ndarray

    def distances(self, v: np.ndarray, augmented: bool) -> np.ndarray:
        """Of each row to each pivot; a candidate is augmented, an anchor isn't."""
        own = (v * v).sum(1)
        extra = lambda n: np.sqrt(np.maximum(self.top - n, 0))
        pivots = (self.pivots * self.pivots).sum(1)
        square = own[:, None] + pivots[None, :] - 2 * (v @ self.pivots.T)
        square += (extra(own)[:, None] - extra(pivots)[None, :]) ** 2 if augmented else (extra(pivots) ** 2)[None, :]
        return np.sqrt(np.maximum(square, 0))

    def away(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance that a score means; infinite for a score of -inf."""
        return np.sqrt(np.maximum(norms + self.top - 2 * scores, 0))


def space_of(rows: DataFrame, anchors: int, total: int, dims: int) -> Space:
    order = F.xxhash64("id", "label")
    taken = rows.orderBy(order, "id", "label", "v").limit(max(16, min(SAMPLE, SAMPLE_NUMBERS // dims))).toArrow()
    sample = _matrix(taken.column("v").combine_chunks(), dims)
    cells = max(LEAST_CELLS, min(MOST_CELLS, anchors // CELL_ANCHORS))
    pivots = np.unique(sample, axis=0)
    pivots = pivots[np.random.default_rng(total).permutation(len(pivots))[:cells]]
    top = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    return Space(dims, float(top) * (1 + 1e-12), total, pivots, taken.column("id").to_numpy(), taken.column("label").to_numpy(), sample)


def _packed(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> tuple[bytes, bytes, bytes]:
    small = np.abs(v).max(initial=0) < 2**15
    return ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), (b"h" + v.astype(np.int16).tobytes()) if small else b"d" + v.tobytes()


def _vectors(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if data[:1] == b"h" else np.float64, offset=1).reshape(-1, dims).astype(np.float64)


def _bucket(labels: np.ndarray) -> np.ndarray:
    return (labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % LABELS


def _deal(ids: np.ndarray, n: int) -> np.ndarray:
    """A part of n for each row; copies of one id go to several parts."""
    h = (ids.astype(np.uint64) + np.arange(len(ids), dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % n


ASKED = "id long, label long, v array<double>, vkey long, cell int, bucket int, near double, far double"


def _anchor_rows(anchors: DataFrame, space: Space, how: Recipe) -> DataFrame:
    """Each anchor's group and the shell around its pivot in which its partners lie; with a column ``bands`` (positive scores), its negatives."""
    sent, negative = anchors.sparkSession.sparkContext.broadcast(space), "bands" in anchors.columns  # SAMPLE and MOST_CELLS vectors

    def reach(s: Space, own: np.ndarray, me: int, label: int, bands: list[int] | None) -> tuple[float, float]:
        """The lowest and highest score that a partner can have."""
        scores = s.sample @ own
        if bands is None:
            scores = scores[(s.labels == label) & (s.ids != me)]
            return (float(np.partition(scores, len(scores) - how.partners)[len(scores) - how.partners]) if len(scores) >= how.partners else -np.inf), np.inf
        scores, low = scores[s.labels != label], []
        for p in bands:
            inside = scores[(scores * 100 <= how.high * p) & (scores * 100 >= how.low * p)]
            low.append(np.partition(inside, len(inside) - how.negatives)[len(inside) - how.negatives] if len(inside) >= how.negatives else how.low * p / 100)
        return float(min(low)), how.high * max(bands) / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), s.dims)
            bands = batch.column(3).to_pylist() if negative else [None] * len(ids)
            ends = np.array([reach(s, own, ids[k], labels[k], bands[k]) for k, own in enumerate(v)])
            norms = (v * v).sum(1)
            scale = np.sqrt(s.top / np.where(norms > 0, norms, s.top or 1.0))
            d = s.distances(v * scale[:, None], False)
            cell = d.argmin(1)
            from_pivot = d[np.arange(len(cell)), cell]
            far, near = (s.away(norms * scale**2, ends[:, k] * scale) for k in (0, 1))
            slack = 1e-6 * (1 + s.top**0.5)  # of the distances' rounding
            shell = (np.maximum(np.maximum(near - from_pivot, from_pivot - far), 0) - slack, from_pivot + far + slack)
            keys = [xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) for own in v]
            bucket = np.zeros(len(ids), np.int64) if negative else _bucket(labels)
            added = [pa.array(keys, pa.int64()), pa.array(cell, pa.int32()), pa.array(bucket, pa.int32()), pa.array(shell[0]), pa.array(shell[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added, *([batch.column(3)] if negative else [])], [*_names(ASKED), *(["bands"] if negative else [])])

    return map_batches(anchors, run, ASKED + (", bands array<long>" if negative else ""))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass(frozen=True)
class Group:
    """A cell's anchors (of one bucket of labels): their shell, and the blocks and splits into which the join is cut."""

    cell: int
    bucket: int
    near: float
    far: float
    blocks: int
    splits: int


def _groups(asked: DataFrame, space: Space, by_label: bool) -> list[Group]:
    """A group's splits follow from the share of the sample that its shell holds; a wrong guess only changes the tasks' size."""
    rows = asked.groupBy("cell", "bucket").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()  # LABELS * MOST_CELLS rows
    d, bucket, found = space.distances(space.sample, True), _bucket(space.labels), []
    for r in rows:
        held = ~((d[:, r["cell"]] < r["near"]) | (d[:, r["cell"]] > r["far"])) & ((bucket == r["bucket"]) | (not by_label))
        served = held.mean() * space.total
        found.append(Group(r["cell"], r["bucket"], r["near"], r["far"], -(-r["n"] // MOST_ANCHORS), max(1, int(-(-served // SPLIT)))))
    return found


def _served(rows: DataFrame, groups: list[Group], space: Space, by_label: bool) -> DataFrame:
    """Candidates, packed, for every group that may need them."""
    context = rows.sparkSession.sparkContext
    sent, dealt = context.broadcast(space), context.broadcast(groups)  # SAMPLE and MOST_CELLS vectors, LABELS * MOST_CELLS groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), s.dims)
            d, bucket, found = s.distances(v, True), _bucket(labels), []
            for g in dealt.value:
                wanted = ~((d[:, g.cell] < g.near) | (d[:, g.cell] > g.far)) & ((bucket == g.bucket) | (not by_label))  # distances past a double's range are served
                split = _deal(ids, g.splits)
                for part in np.unique(split[wanted]):
                    ours = wanted & (split == part)
                    packed = _packed(ids[ours], labels[ours], v[ours])
                    found += [(g.cell, g.bucket, block, int(part), 0, *packed, None) for block in range(g.blocks)]
                if len(found) >= 64:
                    yield _batch(found)
                    found = []
            if found:
                yield _batch(found)

    return map_batches(rows, run, CANDIDATE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 5 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _names(CANDIDATE))


def _asked(anchors: DataFrame, groups: list[Group], dims: int) -> DataFrame:
    """The anchors' blocks, packed, once for each split; more: each one's number of bands, and the bands."""
    spark = anchors.sparkSession
    cuts = spark.createDataFrame([(g.cell, g.bucket, g.blocks, g.splits) for g in groups], "cell int, bucket int, blocks int, splits int")
    dealt = anchors.join(F.broadcast(cuts), ["cell", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id", "vkey"), F.col("blocks")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        ids, labels, v = table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("v").combine_chunks(), dims)
        bands = table.column("bands").to_pylist() if "bands" in table.column_names else [[]] * len(ids)
        more = b"".join(np.array([len(b), *b], np.int64).tobytes() for b in bands)
        first = [table.column(c)[0].as_py() for c in ("cell", "bucket", "block")]
        packed = _packed(ids, labels, v)
        return pa.Table.from_batches([_batch([(*first, split, 1, *packed, more) for split in range(table.column("splits")[0].as_py())])])

    return dealt.groupBy("cell", "bucket", "block").applyInArrow(pack, CANDIDATE)


def _unpacked(table: pa.Table, kind: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    rows = [r for r in table.to_pylist() if r["kind"] == kind]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims)), []
    ids, labels = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("ids", "labels"))
    v = np.concatenate([_vectors(r["vectors"], dims) for r in rows])
    bands, flat = [], np.concatenate([np.frombuffer(r["more"] or b"", np.int64) for r in rows])
    at = 0
    while at < len(flat):
        bands.append(flat[at + 1 : at + 1 + flat[at]])
        at += 1 + int(flat[at])
    return ids, labels, v, bands


def _clipped(scores: list) -> pa.Array:
    return pa.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores], pa.int64())


FOUND = "anchor_id long, label long, vkey long, partner_id long, score long, of long"


def _joined(asked: DataFrame, served: DataFrame, dims: int, how: Recipe, negative: bool) -> DataFrame:
    """The best partners that each anchor has in each task; ``of`` is the positive score whose band it is."""

    def local(table: pa.Table) -> pa.Table:
        ids, labels, v, bands = _unpacked(table, 1, dims)
        other, other_labels, w, _ = _unpacked(table, 0, dims)
        order = np.argsort(other, kind="stable")
        other, other_labels, w = other[order], other_labels[order], w[order]
        found: list[tuple] = []
        for at in range(0, len(ids), 256):
            scores = _products(v[at : at + 256], w) if len(other) else np.zeros((len(ids[at : at + 256]), 0), np.int64)
            for k in range(at, min(at + 256, len(ids))):
                own = (other_labels != labels[k]) if negative else (other_labels == labels[k]) & (other != ids[k])
                if negative:  # what no band holds goes first
                    own &= (scores[k - at] * 100 <= how.high * int(bands[k].max())) & (scores[k - at] * 100 >= how.low * int(bands[k].min()))
                places = np.flatnonzero(own)
                mine = scores[k - at][places]
                key = xxhash.xxh64_intdigest(v[k].tobytes()) - (1 << 63)
                for p in bands[k].tolist() if negative else (None,):
                    inside = places if p is None else places[(mine * 100 >= how.low * p) & (mine * 100 <= how.high * p)]
                    best = inside[_best(scores[k - at][inside], how.negatives if negative else how.partners)]
                    found += [(ids[k], labels[k], key, other[x], scores[k - at][x], p) for x in best]
        columns = list(zip(*found)) if found else [()] * 6
        return pa.table([_clipped(c) if k == 4 else pa.array(c, pa.int64()) for k, c in enumerate(columns)], _names(FOUND))

    return asked.unionByName(served).groupBy("cell", "bucket", "block", "split").applyInArrow(local, FOUND)


def mine(rows: DataFrame, how: Recipe = PRODUCTION) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; rows: vec_id, label, embedding."""
    spark = rows.sparkSession
    ship_package(spark)
    vectors = vectors_of(rows, how.scale)
    is_anchor: Column = F.pmod("id", F.lit(how.every)) == 0
    said = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("v")).alias("dims")).first()
    if not said["anchors"]:
        return spark.createDataFrame([], OUTPUT)
    dims = max(1, said["dims"])
    space = space_of(vectors, said["anchors"], said["n"], dims)

    def joined(asked: DataFrame, negative: bool) -> DataFrame:
        groups = _groups(asked, space, not negative)
        return _joined(_asked(asked, groups, dims), _served(vectors, groups, space, not negative), dims, how, negative)

    asked = staged(_anchor_rows(vectors.filter(is_anchor).dropDuplicates(["id", "label", "v"]), space, how))
    first = W.partitionBy("anchor_id", "label", "vkey").orderBy(F.desc("score"), "partner_id")
    positives = staged(joined(asked, False).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= how.partners).drop("of", "nth"))

    bands = positives.filter("score >= 0").groupBy(F.col("anchor_id").alias("id"), "label", "vkey").agg(F.array_sort(F.collect_set("score")).alias("bands"))
    banded = staged(_anchor_rows(asked.join(bands, ["id", "label", "vkey"]).select("id", "label", "v", "bands"), space, how))
    if banded.isEmpty():
        return spark.createDataFrame([], OUTPUT)
    best = W.partitionBy("anchor_id", "label", "vkey", "of").orderBy(F.desc("score"), "partner_id")
    kept = joined(banded, True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= how.negatives)
    kept = kept.select("anchor_id", "label", "vkey", F.col("of").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("partner_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = positives.select("anchor_id", "label", "vkey", F.col("partner_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(kept, ["anchor_id", "label", "vkey", "positive_score"]).select(*_names(OUTPUT))
