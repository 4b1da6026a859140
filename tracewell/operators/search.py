"""Ranked full-text search over one index of several corpora.

``StoredIndex`` (see ``textindex``) is the index as tables. A query reads the postings of its own words only,
evaluates its MATCH tree on them, ranks, and fetches bodies for the rows of the page. Positions are
read for phrases, NEAR and ^ only; for other trees a word's frequency will do. A page for any of some words,
ranked, comes from the highest tiers of their postings.

A frame of documents (source_table, ref, body, tokens, dl), as ``index_of`` makes it, can be searched as
well, for small corpora and for one query: the same expressions run over each row's tokens, in one scan
for the statistics and one for the ranking.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_candidate, terms, tokens
from ..plans import match as M
from .textindex import B, IDF_FLOOR, K1, KEYS, StoredIndex, counted_words, words_only

MOST, DEFAULT, SCAN = 50, 10, 40
NEIGHBOUR_DOCS, NEIGHBOUR_TERMS, NEIGHBOUR_SHARE = 24, 8, 0.6


def clamp_limit(limit: int | None) -> int:
    return max(1, min(MOST, DEFAULT if limit is None else limit))


def index_of(corpora: dict[str, DataFrame]) -> DataFrame:
    """One index of corpora (ref, body) by name."""
    frames = [df.select(F.lit(name).alias("source_table"), F.col("ref").cast("long").alias("ref"), F.col("body")) for name, df in corpora.items()]
    joined = spread(reduce(DataFrame.unionByName, frames)).withColumn("tokens", tokens(F.col("body")))
    return joined.withColumn("dl", F.size("tokens").cast("long"))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where the input is too few files to fill them; a large input stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def postings(index: Index) -> DataFrame:
    """source_table, term, ref, tf, positions."""
    if isinstance(index, StoredIndex):
        return index.postings.select("source_table", "term", "ref", "tf", "positions")
    each = index.select("source_table", "ref", F.posexplode("tokens").alias("pos", "term"))
    return each.groupBy("source_table", "term", "ref").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def vocabulary(index: Index) -> DataFrame:
    """term, df (rows that have it), cf (times it occurs); a frame's words are counted where its texts are read."""
    return index.words_like(None) if isinstance(index, StoredIndex) else counted_words(index)


class _Tokens:
    """Where words are in a row's tokens."""

    def positions(self, word: str, prefix: bool) -> Column:
        hit = (lambda t: t.startswith(word)) if prefix else (lambda t: t == word)
        return F.filter(F.transform("tokens", lambda t, n: F.when(hit(t), n)), lambda n: n.isNotNull())

    def at(self, place: Column, word: str, prefix: bool) -> Column:
        found = F.get("tokens", place)
        return F.coalesce(found.startswith(word) if prefix else found == word, F.lit(False))


class _Columns:
    """Where words are, from one column of positions for each."""

    def __init__(self, words: list[tuple[str, bool]]) -> None:
        self.names = {w: f"__p{k}" for k, w in enumerate(words)}

    def positions(self, word: str, prefix: bool) -> Column:
        return F.col(self.names[word, prefix])

    def at(self, place: Column, word: str, prefix: bool) -> Column:
        return F.array_contains(self.positions(word, prefix), place)


class _Counts(_Columns):
    """How often words occur, from one column for each."""

    def count(self, phrase: M.Phrase) -> Column:
        return F.col(self.names[_words(phrase)[0]])


TOKENS = _Tokens()
View = _Tokens | _Columns | _Counts


def count(phrase: M.Phrase, view: View) -> Column:
    """How often a phrase occurs in a row."""
    return view.count(phrase) if isinstance(view, _Counts) else F.size(phrase_starts(phrase, view))


def _words(phrase: M.Phrase) -> list[tuple[str, bool]]:
    return [(w, phrase.prefix and k == len(phrase.words) - 1) for k, w in enumerate(phrase.words)]


def phrase_starts(phrase: M.Phrase, view: View = TOKENS) -> Column:
    """The positions at which a phrase begins."""
    words = _words(phrase)
    starts = view.positions(*words[0])
    if len(words) > 1:
        starts = F.filter(starts, lambda n: reduce(lambda a, b: a & b, (view.at(n + k, *w) for k, w in enumerate(words) if k)))
    return F.filter(starts, lambda n: n == 0) if phrase.first else starts


def near_starts(near: M.Near, view: View = TOKENS) -> list[Column]:
    """For each of the group's phrases, the positions that take part in a stretch that holds them all.

    A stretch begins at some phrase and reaches as far as the distance beyond that phrase's end.
    """
    found = [(len(p.words), phrase_starts(p, view)) for p in near.phrases if p.words]
    begins = []
    for n, starts in found:
        whole = lambda p: reduce(lambda a, b: a & b, (F.exists(s, lambda q: (q >= p) & (q - p - n <= near.distance)) for _, s in found))  # noqa: B023, E731
        begins.append(F.transform(F.filter(starts, whole), lambda p: F.struct(p.alias("low"), (p + n + near.distance).alias("high"))))  # noqa: B023
    stretches = F.concat(*begins)
    return [F.filter(s, lambda q: F.exists(stretches, lambda w: (q >= w["low"]) & (q <= w["high"]))) for _, s in found]


def frequencies(tree: M.Node, view: View = TOKENS) -> list[Column]:
    """How often each of the tree's scored phrases counts in a row; in a NEAR group, where it is near the others."""
    if isinstance(tree, M.Phrase):
        return [count(tree, view)] if tree.words else []
    if isinstance(tree, M.Near):
        return [F.size(s) for s in near_starts(tree, view)]
    if isinstance(tree, M.Not):
        return frequencies(tree.kept, view)
    # of alternatives, those that a row doesn't satisfy add nothing, whatever words of theirs it has
    open_ = isinstance(tree, M.Or)
    return [F.when(matches(part, view), f).otherwise(0) if open_ and not isinstance(part, M.Phrase) else f for part in tree.parts for f in frequencies(part, view)]


def matches(tree: M.Node, view: View = TOKENS) -> Column:
    """Whether a row satisfies the tree."""
    if isinstance(tree, M.Phrase):
        return count(tree, view) > 0 if tree.words else F.lit(False)
    if isinstance(tree, M.Near):
        return F.size(near_starts(tree, view)[0]) > 0
    if isinstance(tree, M.Not):
        return matches(tree.kept, view) & ~matches(tree.dropped, view)
    if isinstance(tree, M.Or):
        return reduce(lambda a, b: a | b, (matches(p, view) for p in tree.parts))
    parts = [p for p in tree.parts if not (isinstance(p, M.Phrase) and not p.words)]
    return reduce(lambda a, b: a & b, (matches(p, view) for p in parts)) if parts else F.lit(False)


def words_of(*trees: M.Node) -> list[tuple[str, bool]]:
    """The distinct words of the trees, those that must not match included; True for prefixes."""
    found: dict[tuple[str, bool], None] = {}
    todo = list(trees)
    while todo:
        node = todo.pop(0)
        if isinstance(node, M.Phrase):
            found |= dict.fromkeys(_words(node))
        else:
            todo += [node.kept, node.dropped] if isinstance(node, M.Not) else node.phrases if isinstance(node, M.Near) else node.parts
    return list(found)


Index = DataFrame | StoredIndex


def rows_of(index: StoredIndex, words: list[tuple[str, bool]], view: View) -> DataFrame:
    """source_table, ref, dl and what the view needs of each word, for the documents that have any of them."""
    found = index.postings_of(words)
    own = lambda word, prefix, column: F.when(F.col("term").startswith(word) if prefix else F.col("term") == word, F.col(column))
    if isinstance(view, _Counts):
        columns = [F.coalesce(F.sum(own(*w, "tf")), F.lit(0)).alias(name) for w, name in view.names.items()]
    else:
        columns = [F.sort_array(F.flatten(F.collect_list(own(*w, "positions")))).alias(name) for w, name in view.names.items()]
    return found.groupBy("source_table", "ref", "dl").agg(*columns)


def view_of(trees: list[M.Node]) -> View:
    """Frequencies for trees of single words, positions for others."""
    words, todo, plain = words_of(*trees), list(trees), True
    while todo:
        node = todo.pop()
        if isinstance(node, M.Phrase):
            plain &= len(node.words) <= 1 and not node.first
        elif isinstance(node, M.Near):
            plain = False
        else:
            todo += [node.kept, node.dropped] if isinstance(node, M.Not) else node.parts
    return _Counts(words) if plain else _Columns(words)


@dataclass(frozen=True)
class Stats:
    """What a query needs of the whole index: rows, mean length, rows with each phrase, and rows that match each tree."""

    n: int
    avgdl: float
    with_phrase: tuple[int, ...]
    matched: tuple[int, ...]


def statistics(index: Index, phrases: list[M.Phrase], trees: tuple[M.Node, ...] = (), keep: Column | None = None, scope: DataFrame | None = None) -> Stats:
    """One pass over the index, or over the words' postings; ``keep``, which may name columns of ``scope`` (ref, ...), only restricts which rows count as matches."""
    within, view, rows = F.lit(True) if keep is None else keep, TOKENS, index
    if isinstance(index, StoredIndex):
        words = words_of(*phrases, *trees)
        if not words:
            return Stats(index.n, index.avgdl, (0,) * len(phrases), (0,) * len(trees))
        single = [p.words[0] for p in phrases if len(p.words) == 1 and not p.prefix and not p.first]
        if len(single) == len(phrases) and not any(isinstance(t, M.Not | M.Near | M.And) for t in trees) and (not trees or (keep is None and len(phrases) == 1)):
            df = {r["term"]: r["df"] for r in index.words_like([(w, False) for w in single]).collect()}  # a row for each word
            seen = tuple(df.get(w, 0) for w in single)
            return Stats(index.n, index.avgdl, seen, seen * len(trees))
        view = view_of([*phrases, *trees])
        rows = rows_of(index, words, view)
    rows = rows if scope is None else rows.join(scope, "ref", "left")
    asked = [F.count_if(count(p, view) > 0).alias(f"n{k}") for k, p in enumerate(phrases)] + [F.count_if(matches(t, view) & within).alias(f"m{k}") for k, t in enumerate(trees)]
    said = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *asked).first()
    n, avgdl = (index.n, index.avgdl) if isinstance(index, StoredIndex) else (said["n"], said["avgdl"] or 1.0)
    return Stats(n, avgdl, tuple(said[f"n{k}"] for k in range(len(phrases))), tuple(said[f"m{k}"] for k in range(len(trees))))


def ranked(index: Index, tree: M.Node, keep: Column | None = None, stats: Stats | None = None, scope: DataFrame | None = None) -> DataFrame:
    """source_table, ref, dl and the BM25 ``rank`` (the lower, the better) of the matching rows; with body and tokens where the index is a frame.

    Rows, mean length and phrase frequencies are those of the whole index; ``keep`` only decides which
    matching rows are returned.
    """
    phrases = M.phrases_of(tree)
    stats = stats or statistics(index, phrases)
    stored, words = isinstance(index, StoredIndex), words_of(tree)
    view, rows = TOKENS, index
    if stored:
        view = view_of([tree])
        rows = rows_of(index, words or [("", False)], view)
    rows = rows if scope is None else rows.join(scope, "ref", "left")
    found = rows.filter(matches(tree, view) if keep is None else matches(tree, view) & keep)
    counted = found.withColumns({f"__f{k}": f for k, f in enumerate(frequencies(tree, view))})
    rank = F.lit(0.0)
    for k, n in enumerate(stats.with_phrase):
        idf = math.log((stats.n - n + 0.5) / (n + 0.5)) if stats.n else 0.0
        f, dl = F.col(f"__f{k}").cast("double"), F.col("dl") / stats.avgdl
        rank = rank - F.lit(idf if idf > 0 else IDF_FLOOR) * f * (K1 + 1) / (f + K1 * (1 - B + B * dl))
    return counted.withColumn("rank", rank).select("source_table", "ref", *(() if stored else ("body", "tokens")), "dl", "rank")


@dataclass(frozen=True)
class Counted:
    match: str
    total: int
    query_broadened: bool
    stats: Stats


def count_with_fallback(index: Index, raw: str, keep: Column | None = None, scope: DataFrame | None = None) -> Counted:
    """Matches of all words, or of any where none has all; both are counted in one pass, with the statistics of either."""
    plain = M.sanitize(raw)
    wide = M.broadened(raw, plain)
    trees = [M.parse(plain), *([M.parse(wide)] if wide else [])]
    stats = statistics(index, M.phrases_of(trees[0]), tuple(trees), keep, scope)  # the wide tree has the same phrases
    if wide and stats.matched[0] == 0 and stats.matched[1] > 0:
        return Counted(wide, stats.matched[1], True, stats)
    return Counted(plain, stats.matched[0], False, stats)


def best(index: Index, rows: DataFrame, limit: int, bodies: bool = True) -> DataFrame:
    """The first of ranked rows, with their bodies if asked for."""
    page = rows.orderBy("rank", "source_table", "ref").limit(limit)
    return index.with_bodies(page).orderBy("rank", "source_table", "ref") if bodies and isinstance(index, StoredIndex) else page


def top(index: Index, raw: str, limit: int | None = None, broaden: bool = True, keep: Column | None = None, bodies: bool = True) -> DataFrame:
    """The best rows for a query, by rank and key; a query of several words falls back to any of them."""
    counted = count_with_fallback(index, raw, keep) if broaden else None
    tree = M.parse(counted.match if counted else M.sanitize(raw))
    return page(index, tree, clamp_limit(limit), keep, counted.stats if counted else None, bodies)


def page(index: Index, tree: M.Node, limit: int, keep: Column | None = None, stats: Stats | None = None, bodies: bool = True) -> DataFrame:
    """The best rows for a tree; where it asks for any of some words, a stored index reads their highest tiers."""
    parts = [tree] if isinstance(tree, M.Phrase) else tree.parts if isinstance(tree, M.Or) else []
    if isinstance(index, StoredIndex) and keep is None and parts and all(isinstance(p, M.Phrase) and len(p.words) == 1 and not p.prefix and not p.first for p in parts):
        return best(index, index.best_words([p.words[0] for p in parts], limit), limit, bodies)
    return best(index, ranked(index, tree, keep, stats), limit, bodies)


def rank_span(rows: DataFrame) -> DataFrame:
    """top_rank and rank_spread of ranked rows; nulls for none."""
    return rows.agg(F.min("rank").alias("top_rank"), (F.max("rank") - F.min("rank")).alias("rank_spread"))


def also_matched(rows: DataFrame, limit: int) -> DataFrame:
    """path, match_line, matches for files that only rows below the limit have; rows: path, match_line, pos (from 1, SCAN at most)."""
    below = rows.filter((F.col("pos") > limit) & (F.col("pos") <= SCAN)).join(rows.filter(F.col("pos") <= limit).select("path").distinct(), "path", "left_anti")
    return below.groupBy("path").agg(F.min_by("match_line", "pos").alias("match_line"), F.count(F.lit(1)).alias("matches"), F.min("pos").alias("first_pos"))


def neighbourhood(index: Index, raw: str, keep: Column | None = None, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """term, score: words that the best rows for any of the query's words share and the index as a whole doesn't.

    Nothing unless more rows have any word than have what the query asks for. Of a frame, texts don't move: a scan
    takes the query's words and lengths (which ``kept`` may write, as they are read more than once), one the best
    rows' bodies, and one counts the words that those share.
    """
    wide = M.broadened(raw, M.sanitize(raw))
    spark = index.spark if isinstance(index, StoredIndex) else index.sparkSession
    empty = spark.createDataFrame([], "term string, score double")
    if wide is None:
        return empty
    plain, tree, searched = M.parse(M.sanitize(raw)), M.parse(wide), index
    few = not isinstance(index, StoredIndex) and isinstance(view_of([plain, tree]), _Counts)
    if few:
        searched = words_only(index, words_of(plain, tree))
        searched = (kept(searched) if kept else searched).withColumn("body", F.lit(None).cast("string"))
    stats = statistics(searched, M.phrases_of(tree), (plain, tree), keep)
    if stats.matched[1] <= stats.matched[0]:
        return empty
    read = page(searched, tree, NEIGHBOUR_DOCS, keep, stats)
    if few:
        read = index.select(*KEYS, "body").join(F.broadcast(read.select(*KEYS)), KEYS)  # NEIGHBOUR_DOCS keys
    read = read.select(*KEYS, F.array_distinct(terms(F.col("body"))).alias("own"))
    local = read.withColumn("n_docs", F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))).select("n_docs", F.explode("own").alias("term"))  # NEIGHBOUR_DOCS rows
    local = local.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("n_docs").alias("n_docs"))
    asked = [t for w in raw.split() for t in M.tokenize(w)]
    local = local.filter((F.col("n") >= 2) & (F.col("n") <= F.ceil(F.col("n_docs") * NEIGHBOUR_SHARE)) & is_candidate(F.col("term")) & ~F.col("term").isin(asked))
    if few:
        shared = local.collect()  # words of NEIGHBOUR_DOCS documents
        local = spark.createDataFrame(shared, local.schema)
    local = F.broadcast(local)  # words of NEIGHBOUR_DOCS documents, in half of them at least two
    if few:
        known = counted_words(index, [r["term"] for r in shared]).select("term", "df")
    elif isinstance(index, StoredIndex):
        known = index.words_like(None).join(local.select("term"), "term", "left_semi").select("term", "df")  # of the dictionary
    else:
        known = index.select(F.explode(F.array_distinct("tokens")).alias("term")).join(local, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = known.join(local, "term", "right")
    score = F.col("n") * F.greatest(F.lit(0.0), F.log(F.lit(float(stats.n)) / F.coalesce("df", F.lit(1))))
    return rows.select("term", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "term").limit(NEIGHBOUR_TERMS)


def within_budget(rows: DataFrame, length: str, order: list[str], budget: int, to: str = "shown") -> DataFrame:
    """Marks the rows, in order, before which less than the budget was spent; for ranked results, a few rows."""
    spent = F.sum(length).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn(to, F.coalesce(spent, F.lit(0)) < budget)


#: Snippets: tokens shown, and what a further phrase, a repetition, the first sentence and another sentence's start are worth.
SNIPPET_TOKENS = 64
NEW_PHRASE, REPEATED, FIRST_SENTENCE, SENTENCE = 1000, 1, 120, 100


def occurrences(tree: M.Node, words: list[str]) -> list[tuple[int, int, int]] | None:
    """(position, the phrase's number, its words), in order, of the phrases by which a row satisfies the tree; None where it doesn't."""
    numbers = {id(p): k for k, p in enumerate(M.phrases_of(tree))}

    def phrase(p: M.Phrase) -> list[int]:
        size = len(p.words)
        fits = lambda at: all(words[at + k].startswith(w) if p.prefix and k == size - 1 else words[at + k] == w for k, w in enumerate(p.words))
        return [at for at in range(1 if p.first and words else max(0, len(words) - size + 1)) if at + size <= len(words) and fits(at)]

    def found(node: M.Node) -> list[tuple[int, int, int]] | None:
        if isinstance(node, M.Phrase):
            return [(at, numbers[id(node)], len(node.words)) for at in phrase(node)] or None if node.words else None
        if isinstance(node, M.Not):
            return None if found(node.dropped) is not None else found(node.kept)
        if isinstance(node, M.Near):
            each = [(p, phrase(p)) for p in node.phrases if p.words]
            reach = [(at, at + len(p.words) + node.distance) for p, starts in each for at in starts]
            whole = [(low, high) for low, high in reach if all(any(low <= q <= high for q in starts) for _, starts in each)]
            kept = [(q, numbers[id(p)], len(p.words)) for p, starts in each for q in starts if any(low <= q <= high for low, high in whole)]
            return kept or None
        parts = [found(part) for part in node.parts if not (isinstance(node, M.And) and isinstance(part, M.Phrase) and not part.words)]
        if not parts or (isinstance(node, M.And) and None in parts):
            return None
        return [x for part in parts if part is not None for x in part] or None

    hits = found(tree)
    return None if hits is None else sorted(hits)


class _Sliding:
    """The phrases inside a window of tokens whose begin only moves on."""

    def __init__(self, hits: list[tuple[int, int, int]], size: int) -> None:
        self.hits, self.size, self.low, self.high, self.counts = hits, size, 0, 0, Counter[int]()

    def move(self, begin: int) -> tuple[int, int, int]:
        """The score of the window from a token on, and where its first phrase begins and its last one ends."""
        while self.high < len(self.hits) and self.hits[self.high][0] < begin + self.size:
            self.counts[self.hits[self.high][1]] += 1
            self.high += 1
        while self.low < self.high and self.hits[self.low][0] < begin:
            self.counts[self.hits[self.low][1]] -= 1
            self.low += 1
        distinct = sum(n > 0 for n in self.counts.values())
        if self.low == self.high:
            return 0, begin, begin
        last = self.hits[self.high - 1]
        return distinct * NEW_PHRASE + (self.high - self.low - distinct) * REPEATED, self.hits[self.low][0], last[0] + last[2]


def snippet_span(text: str, tree: M.Node, size: int = SNIPPET_TOKENS) -> tuple[int, int]:
    """Where the stretch of ``size`` tokens begins and ends that shows the most distinct phrases, then the most of them.

    Windows begin at a phrase, and are then moved so that its phrases are in the middle; or at the
    sentence that holds a phrase, which is worth more. The first of equal ones wins. One pass over the phrases.
    """
    spans = M.spans(text)
    hits, n = occurrences(tree, [w for _, _, w in spans]) or [], len(spans)
    sentences = [0, *(k for k in range(1, n) if re.search(r"[.:][ \t\n\r]+\Z", text[spans[k - 1][1] : spans[k][0]]))]
    by_phrase, by_sentence, at = _Sliding(hits, size), _Sliding(hits, size), 0
    best, begin = 0, 0
    for place, _, _ in hits:
        score, first, last = by_phrase.move(place)
        if score > best:
            middle = first - int((size - (last - first)) / 2)
            best, begin = score, max(0, min(middle, n - size))
        while at + 1 < len(sentences) and sentences[at + 1] <= place:
            at += 1
        if n > size and sentences[at] < place:
            score = by_sentence.move(sentences[at])[0] + (FIRST_SENTENCE if sentences[at] == 0 else SENTENCE)
            if score > best:
                best, begin = score, sentences[at]
    return spans[begin][0] if begin else 0, spans[begin + size - 1][1] if begin + size < n else len(text)


def snippet(text: str, tree: M.Node, size: int = SNIPPET_TOKENS) -> str:
    low, high = snippet_span(text, tree, size)
    return ("…" if low else "") + text[low:high] + ("…" if high < len(text) else "")


def with_snippet(rows: DataFrame, tree: M.Node, to: str = "snippet", line: str | None = None) -> DataFrame:
    """Adds the snippet of ``body``, and the number of the line (from 0) in which it begins; for the few rows of a result."""

    @F.pandas_udf("snippet string, line long")
    def show(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for bodies in batches:
            shown = [(None, None) if b is None else (snippet(b, tree), b.count("\n", 0, b.find(b[slice(*snippet_span(b, tree))]))) for b in bodies]
            yield pd.DataFrame(shown, columns=["snippet", "line"])

    found = rows.withColumn("__shown", show("body")).withColumn(to, F.col("__shown.snippet"))
    return (found.withColumn(line, F.col("__shown.line")) if line else found).drop("__shown")
