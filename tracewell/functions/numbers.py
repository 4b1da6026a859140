"""Numbers, times and labels: column expressions and order statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the buckets that exported counts are shown in.
BUCKET_STARTS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384, 65536)


def percentile_nearest(values: Column, q: float) -> Column:
    """Aggregate: the value at rank (n - 1) q, rounded half up, of the sorted values; null without any."""
    ordered = F.array_sort(F.collect_list(values))
    return F.when(F.size(ordered) > 0, F.get(ordered, F.round((F.size(ordered) - 1) * F.lit(q)).cast("int")))


def percentile_by_rank(q: float, rank: Column, n: Column) -> Column:
    """Whether a row, whose rank from 0 of n is given, is that percentile: the form without collected lists."""
    return rank == F.round((n - 1) * F.lit(q)).cast("long")


def upper_median(values: Column) -> Column:
    """Aggregate: the sorted values' element n // 2; null without any."""
    ordered = F.array_sort(F.collect_list(values))
    return F.when(F.size(ordered) > 0, F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")))


def count_bucket(n: Column) -> Column:
    """0, 1, 2-3, 4-7, ... 16384-65535, 65536+; negative counts are 0."""
    said = F.lit("0")
    for low, high in zip(BUCKET_STARTS[1:], (*BUCKET_STARTS[2:], None)):
        said = F.when(n >= low, f"{low}+" if high is None else str(low) if high == low + 1 else f"{low}-{high - 1}").otherwise(said)
    return said


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def epoch_of(text: Column) -> Column:
    """Epoch seconds of an RFC 3339 time, null where it isn't one."""
    return F.unix_timestamp(F.try_to_timestamp(text)).cast("long")


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / 4).cast("long")


def age_label(seconds: Column) -> Column:
    """How old an index is, with a warning from a day on."""
    hours, days = (F.floor(seconds / n).cast("string") for n in (3600, 86400))
    return F.when(seconds < 300, "index current").when(seconds < 86400, F.concat(F.lit("index "), hours, F.lit("h old"))).otherwise(F.concat(F.lit("⚠ index "), days, F.lit(" days old — may predate recent work")))


def ago_label(seconds: Column) -> Column:
    minutes, hours, days = (F.floor(seconds / n).cast("string") for n in (60, 3600, 86400))
    return F.when(seconds < 3600, F.concat(minutes, F.lit(" min ago"))).when(seconds < 86400, F.concat(hours, F.lit(" h ago"))).otherwise(F.concat(days, F.lit(" d ago")))


def duration_label(seconds: Column) -> Column:
    """Nd Nh, Nh Nm or Nm of a duration without its sign."""
    s = F.abs(seconds)
    day, hour, minute = F.floor(s / 86400).cast("string"), F.floor(s % 86400 / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    return F.when(s >= 86400, F.concat(day, F.lit("d "), hour, F.lit("h"))).when(s >= 3600, F.concat(hour, F.lit("h "), minute, F.lit("m"))).otherwise(F.concat(minute, F.lit("m")))


def delta_label(seconds: Column) -> Column:
    """A time difference to a piece of code, with its sign and on which side it lies."""
    return F.concat(F.when(seconds < 0, "−").otherwise("+"), duration_label(seconds), F.when(seconds < 0, " before code").otherwise(" after code"))


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def signed(n: Column) -> Column:
    return F.concat(F.when(n >= 0, "+").otherwise("-"), F.format_number(F.abs(n), 0))


def delta_shape(seconds: Column) -> Column:
    s = F.abs(seconds)
    return F.when(s < 3600, "under_hour").when(s < 86400, "under_day").when(s < 604800, "under_week").otherwise("week_or_more")


def savings(result: Column, returned: Column, p50: Column, p95: Column, factor: float, overhead: int, empty_knob: int) -> tuple[Column, Column, Column]:
    """(counterfactual p50, counterfactual p95, tokens saved, signed) of an answer.

    A tool without a counterfactual saves nothing; an answer without results saves the knob; otherwise
    the counterfactual is at least what the result would have cost by hand.
    """
    zero = F.lit(0).cast("long")
    wide = F.greatest(p50, F.round(result * F.lit(factor)).cast("long") + F.lit(overhead))
    cost = F.when(p50 == 0, zero).when(returned == 0, F.greatest(result + F.lit(empty_knob), zero)).otherwise(wide)
    saved = F.when(p50 == 0, zero).when(returned == 0, F.lit(empty_knob).cast("long")).otherwise(wide - result)
    return F.greatest(cost, zero), F.greatest(p95, cost, zero), saved


def dollars(tokens: Column, per_million: Column) -> Column:
    return tokens / F.lit(1e6) * per_million
