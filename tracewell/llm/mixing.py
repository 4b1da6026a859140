"""Mixing sources to target weights over a domain - language - source tree.

Budgets. The total is dealt out from the root: children share their parent's budget by weight, a
child takes no more than its subtree can give (its tokens times MAX_EPOCHS), and what it leaves goes
to its siblings by weight. A subtree as a whole passes a shortage on only when all its children are
exhausted, so shortages are made up among siblings before ancestors. Children without a weight share
what the weights leave (1 less their sum) in proportion to their tokens. Where the weights leave
nothing, as PRODUCTION's do, such children have their share of all the children's tokens, and the
weighted ones share the rest by weight: no language or source is left out for being unlisted.

Selection. Epoch e orders a leaf's documents by a hash of (seed, e, doc_id). A budget of q whole
passes and a rest takes every document q times and, in epoch q, the shortest prefix that holds the
rest: the documents up to a hash, found from sums over PARTS ranges of hashes and then within one
range. No leaf is sorted in one task, and no text moves.

Bounds: the tree has LEAVES leaves at most, and only their sums come to the driver.

Edge cases: null or empty names are "unknown"; null and empty texts have no tokens, and come along
where their hash lies in the prefix; a leaf without tokens gets no budget; documents with one id share
their hash and are taken together; a budget over all capacities takes all there is; an empty table or
budget gives an empty result; further columns of the input are kept by ``select`` and ignored by ``plan``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import one_of, staged

SEED, MAX_EPOCHS, LEAVES, PARTS = 97, 4, 1 << 16, 1024


def domain_of_source() -> Column:
    """The domain of a document of the test tables: by its source's number."""
    n = F.expr("try_cast(regexp_extract(source, '^src([0-9]+)$', 1) AS INT)")
    return F.when(n < 10, "web").when(n < 15, "books").when(n >= 15, "code").otherwise("unknown")


@dataclass(frozen=True)
class Recipe:
    """levels: the tree's columns from the root on; weights: by path, such as ("web", "en")."""

    levels: tuple[tuple[str, Callable[[], Column]], ...] = (("domain", domain_of_source), ("lang", lambda: F.col("lang")), ("source", lambda: F.col("source")))
    weights: dict[tuple[str, ...], float] = field(default_factory=lambda: {("web",): 0.55, ("books",): 0.25, ("code",): 0.2} | {(d, lang): w for d in ("web", "books", "code") for lang, w in (("en", 0.55), ("de", 0.17), ("fr", 0.17), ("es", 0.11))})
    total: int | None = None
    seed: int = SEED
    max_epochs: int = MAX_EPOCHS


PRODUCTION = Recipe()


def shares(children: dict[tuple[str, ...], int], weights: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], float]:
    """The weight of each child; children: their tokens by path."""
    given = {c: max(0.0, weights[c]) for c in children if c in weights}
    rest = {c: n for c, n in children.items() if c not in given}
    left, tokens = 1 - sum(given.values()), sum(rest.values())
    if left < 1e-9 and tokens:
        left = tokens / sum(children.values())
        given = {c: w * (1 - left) / sum(given.values()) for c, w in given.items()}
    return given | {c: left * n / tokens if tokens else 0.0 for c, n in rest.items()}


def deal(budget: int, weights: dict, capacity: dict) -> dict:
    """Whole tokens for each key, by weight and no more than its capacity; ties of the rounding go by key."""
    got, open_ = dict.fromkeys(weights, 0), {k for k in weights if capacity[k] > 0}
    left = min(budget, sum(capacity[k] for k in open_))
    while left > 0 and open_:
        total = sum(weights[k] for k in open_)
        part = {k: left * (weights[k] / total if total > 0 else 1 / len(open_)) for k in open_}
        full = {k for k in open_ if got[k] + part[k] >= capacity[k]}
        for k in full:
            left -= capacity[k] - got[k]
            got[k] = capacity[k]
        open_ -= full
        if not full:
            for k in open_:
                got[k] += int(part[k])
            left -= sum(int(part[k]) for k in open_)
            for k in sorted(open_, key=lambda k: (int(part[k]) - part[k], k)):
                if left > 0 and got[k] < capacity[k]:
                    got[k], left = got[k] + 1, left - 1
            break
    return got


def budgets(tokens: dict[tuple[str, ...], int], recipe: Recipe) -> dict[tuple[str, ...], int]:
    """The tokens that each leaf is to give; tokens: what each leaf has, by path."""
    found: dict[tuple[str, ...], int] = {}

    def below(path: tuple[str, ...], budget: int, leaves: dict[tuple[str, ...], int]) -> None:
        if len(path) == len(recipe.levels):
            found[path] = budget
            return
        children: dict[tuple[str, ...], dict] = {}
        for leaf, n in leaves.items():
            children.setdefault(leaf[: len(path) + 1], {})[leaf] = n
        have = {c: sum(x.values()) for c, x in children.items()}
        got = deal(budget, shares(have, recipe.weights), {c: n * recipe.max_epochs for c, n in have.items()})
        for c in children:
            below(c, got[c], children[c])

    below((), sum(tokens.values()) if recipe.total is None else recipe.total, tokens)
    return found


def count_tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _path(recipe: Recipe) -> Column:
    return F.array(*(F.coalesce(F.nullif(at().cast("string"), F.lit("")), F.lit("unknown")) for _, at in recipe.levels))


def _rank(seed: int, epoch: Column) -> Column:
    """A document's place in an epoch, 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), F.col("doc_id")), 1)


def leaf_cuts(slim: DataFrame, recipe: Recipe) -> DataFrame:
    """path, passes, cut (the last rank taken in epoch ``passes``, null for none); slim: doc_id, path, tokens."""
    spark = slim.sparkSession
    sums = slim.groupBy("path").agg(F.sum("tokens").alias("tokens")).limit(LEAVES + 1).collect()
    if len(sums) > LEAVES:
        raise ValueError(f"the tree has more than {LEAVES} leaves")
    have = {tuple(r["path"]): r["tokens"] for r in sums}
    asked = budgets(have, recipe)
    rows = [(list(p), asked[p] // n if n else 0, asked[p] % n if n else 0) for p, n in have.items()]
    plan = F.broadcast(spark.createDataFrame(rows, "path array<string>, passes long, rest long"))  # LEAVES rows at most
    ranked = slim.join(plan, "path").filter("rest > 0").select("path", "passes", "rest", "tokens", _rank(recipe.seed, F.col("passes")).alias("rank"))
    ranked = ranked.withColumn("part", F.shiftright("rank", 53).cast("int"))
    parts = ranked.groupBy("path", "part").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    ahead = W.partitionBy("path").orderBy("part")  # PARTS rows of a leaf
    parts = parts.withColumn("upto", F.sum("n").over(ahead)).filter("upto >= rest and upto - n < rest").select("path", "part", (F.col("upto") - F.col("n")).alias("before"))
    inside = ranked.join(F.broadcast(parts), ["path", "part"])  # a row for each leaf
    each = inside.groupBy("path", "rank").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    each = each.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("path").orderBy("rank")))  # a PARTS-th of a leaf
    cuts = each.filter("upto >= rest").groupBy("path").agg(F.min("rank").alias("cut"))
    return plan.join(F.broadcast(cuts), "path", "left").select("path", "passes", "cut")


def _slim(docs: DataFrame, recipe: Recipe) -> DataFrame:
    return staged(docs.select("doc_id", _path(recipe).alias("path"), count_tokens(F.col("text")).alias("tokens")))


def _epochs(passes: Column, cut: Column, rank: Column) -> Column:
    """The epochs in which a document is taken."""
    whole = F.when(passes > 0, F.sequence(F.lit(0).cast("long"), passes - 1)).otherwise(F.array().cast("array<long>"))
    return F.concat(whole, F.when(rank <= cut, F.array(passes)).otherwise(F.array().cast("array<long>")))


def plan(docs: DataFrame, recipe: Recipe = PRODUCTION) -> DataFrame:
    """doc_id, the tree's levels, epoch and tokens: a row for each time that a document is taken."""
    slim = _slim(docs, recipe)
    cuts = leaf_cuts(slim, recipe)
    rows = slim.join(F.broadcast(cuts), "path").select("*", _rank(recipe.seed, F.col("passes")).alias("rank"))
    taken = rows.select("doc_id", "path", "tokens", F.explode(_epochs(F.col("passes"), F.col("cut"), F.col("rank"))).alias("epoch"))
    return taken.select("doc_id", *(F.col("path")[n].alias(name) for n, (name, _) in enumerate(recipe.levels)), "epoch", "tokens")


def select(docs: DataFrame, recipe: Recipe = PRODUCTION) -> DataFrame:
    """docs, all columns, a row for each time that a document is taken."""
    cuts = leaf_cuts(_slim(docs, recipe), recipe)
    path, epoch, passes, upto = (one_of(c, docs.columns) for c in ("__path", "__epoch", "__passes", "__cut"))
    cuts = cuts.select(F.col("path").alias(path), F.col("passes").alias(passes), F.col("cut").alias(upto))
    placed = docs.withColumn(path, _path(recipe)).join(F.broadcast(cuts), path)
    taken = _epochs(F.col(passes), F.col(upto), _rank(recipe.seed, F.col(passes)))
    return placed.withColumn(epoch, F.explode(taken)).drop(path, passes, upto, epoch)
