"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame and SQL functions only. The model is fitted on a small labelled table: its examples' Gram
matrix is a bounded array, on which one SQL expression runs gradient descent in the examples' span;
the bucket weights that follow (at most BUCKETS of them) are a literal of the scoring expression.

Edge cases: a null URL, or one without "://", has an empty host and path, no rule, and the verdict
that the model gives to the empty text; repeated rows are judged alike; an empty table gives an empty
result; columns beside page_id and url are ignored, and html isn't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SIZES = 4096, (3, 4, 5)
STEPS, RATE, DECAY = 400, 4.0, 0.0005
#: The bucket of the constant feature, by which every two examples share one.
BIAS = -1

#: (verdict, host, path), with the path's leading slash.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The labelled table: hosts that serve spam, and plain ones, in the shapes that crawled URLs have.
BLOCKED = (
    "http://ads-server.example.com/en/120", "https://m.ads-track.example.org/de/7731?utm_source=feed", "http://blog.track-pixel.example.com/fr/992.html",
    "https://casino-bonus.example.org/en/4410/", "https://www.casino-win.example.com/es/318#top", "http://poker-casino.example.com/en/77",
    "https://spam-farm.example.com/en/5021?page=2&ref=x", "http://m.spam-links.example.org/de/81.html", "http://blog.link-farm.example.com/fr/6620/",
    "https://adult-x.example.org/en/930", "https://www.adult-cams.example.com/es/1204?page=2&ref=x", "http://xxx-adult.example.org/fr/15#top",
    "http://cheap-pills.example.com/en/2209.html", "https://cheap-loans.example.org/de/40", "http://m.diet-pills.example.com/en/3381/",
    "https://free-bets.example.org/en/871?utm_source=feed", "http://www.sports-bets.example.com/es/96", "https://blog.free-prize.example.com/fr/5512#top",
    "http://win-lottery.example.org/en/1?page=2&ref=x", "https://replica-shop.example.com/de/702/", "http://payday-cash.example.com/en/65.html",
)
ALLOWED = (
    "http://thelin.example.com/en/120", "https://m.tionar.example.org/de/7731?utm_source=feed", "http://blog.therund.example.com/fr/992.html",
    "https://ththeon.example.org/en/4410/", "https://www.thistle.example.com/es/318#top", "http://ststones.example.com/en/77",
    "https://ternth.example.com/en/5021?page=2&ref=x", "http://m.library.example.org/de/81.html", "http://blog.thrill.example.com/fr/6620/",
    "https://garden.example.org/en/930", "https://www.tionsea.example.com/es/1204?page=2&ref=x", "http://science.example.org/fr/15#top",
    "http://theory.example.com/en/2209.html", "https://museum.example.org/de/40", "http://m.weather.example.com/en/3381/",
    "https://blog.history.example.org/en/871?utm_source=feed", "http://www.ththand.example.com/es/96", "https://blog.kitchen.example.com/fr/5512#top",
    "http://northern.example.org/en/1?page=2&ref=x", "https://m.station.example.com/de/702/", "http://lighthouse.example.com/en/65.html",
    "https://thering.example.org/en/38104", "https://blog.nation.example.org/de/20991#top", "http://m.bletion.example.com/es/14400/", "https://www.others.example.com/fr/31187?page=2&ref=x",
)
LABELLED = tuple((u, 1) for u in BLOCKED) + tuple((u, 0) for u in ALLOWED)


@dataclass(frozen=True)
class UrlModel:
    weights: tuple[float, ...]
    bias: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _grams(host: Column, path: Column) -> Column:
    """The hash bucket of every n-gram of the two framed strings, with repeats."""
    marked = [F.concat(F.lit("\u0002h"), host, F.lit("\u0003")), F.concat(F.lit("\u0002p"), path, F.lit("\u0003"))]
    cuts = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), _cutter(s, n)) for s in marked for n in SIZES]
    return F.concat(*cuts)


def _cutter(s: Column, n: int):
    return lambda i: F.pmod(F.xxhash64(F.substring(s, i, F.lit(n))), F.lit(BUCKETS)).cast("int")


def train(spark: SparkSession, labelled: tuple[tuple[str, int], ...] = LABELLED) -> UrlModel:
    """Fits the model on a labelled table small enough for its Gram matrix (rows squared) to be one value."""
    if len(labelled) > 512:
        raise ValueError("the labelled table is for a few hundred rows at most")
    if not labelled:
        return UrlModel((0.0,) * BUCKETS, 0.0)
    quoted = ", ".join("({}, '{}', {}D)".format(i, u.replace("\\", "\\\\").replace("'", "\\'"), float(y)) for i, (u, y) in enumerate(labelled))
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(i, url, y)")
    host, path = host_and_path(F.col("url"))
    grams = rows.select("i", "y", host.alias("host"), path.alias("path")).select("i", "y", _grams(F.col("host"), F.col("path")).alias("g"))
    counted = grams.select("i", F.size("g").alias("n"), F.explode("g").alias("b")).groupBy("i", "b").agg((F.count(F.lit(1)) / F.sqrt(F.max("n"))).alias("x"))
    x = counted.unionByName(rows.select("i", F.lit(BIAS).alias("b"), F.lit(1.0).alias("x")))
    z = x.select(F.col("i").alias("j"), "b", F.col("x").alias("z"))
    gram = x.join(z, "b").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("k"))
    by_row = gram.join(rows.select("i", "y"), "i").groupBy("i", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "k"))), lambda c: c["k"]).alias("k"))
    table = by_row.agg(F.array_sort(F.collect_list(F.struct("i", "y", "k"))).alias("t"))

    def step(a: Column, _: Column) -> Column:
        margin = lambda k: F.aggregate(F.zip_with(k, a, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        return F.zip_with(a, F.col("t"), lambda v, r: v * (1 - RATE * DECAY) - RATE * (1 / (1 + F.exp(-margin(r["k"]))) - r["y"]) / len(labelled))

    start = F.transform(F.col("t"), lambda r: F.lit(0.0))
    alpha = table.select(F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)).alias("i", "a"))
    sums = x.join(alpha, "i").groupBy("b").agg(F.sum(F.col("x") * F.col("a")).alias("w"))
    weights = {b: round(w, 12) for b, w in sums.collect()}  # BUCKETS + 1 rows at most
    return UrlModel(tuple(weights.get(b, 0.0) for b in range(BUCKETS)), weights.get(BIAS, 0.0))


def block_probability(host: Column, path: Column, model: UrlModel) -> Column:
    weights = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")
    grams = _grams(host, path)
    total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.element_at(weights, b + 1))
    n = sum((F.greatest(F.length(s) + 3 - size + 1, F.lit(1)) for s in (host, path) for size in SIZES), F.lit(0))
    return 1 / (1 + F.exp(-(total / F.sqrt(n) + model.bias)))


def judge(pages: DataFrame, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (the model's probability, also where a rule decides)."""
    model = model or train(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    said = parts.select("*", rule.alias("rule"), verdict.alias("__said"), block_probability(F.col("host"), F.col("path"), model).alias("p_block"))
    by_model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return said.select("page_id", "host", "path", "rule", F.coalesce("__said", by_model).alias("verdict"), "p_block")
