"""Joins and groupings along time: as-of join, interval overlap, sessions, runs of days, funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, as_: str) -> DataFrame:
    """left plus as_: value of right's latest row of the same keys at or before left's time, null if there is none.

    One union and one window per key instead of a join by inequality: a key's rows are sorted once, and no
    pair of rows is made. At equal times right's row counts as earlier.
    """
    kept = [c for c in left.columns if c not in (*keys, time)]
    a = left.select(*keys, time, F.lit(1).alias("__side"), F.struct(*kept).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    b = right.select(*keys, time, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"))
    latest = Window.partitionBy(*keys).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(b).withColumn(as_, F.last("__value", ignorenulls=True).over(latest))
    return found.where("__side = 1").select(*keys, time, *(F.col(f"__row.{c}").alias(c) for c in kept), as_)


def asof_join_sliced(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], slice_seconds: int) -> DataFrame:
    """left plus values: those of right's latest row of the same keys at or before left's time, null if there is none.

    Time is cut into slices, and a key's slices are sorted by different tasks; what the latest row before a slice
    carries into it comes from one row for each key and slice. So a key with most rows is no task's alone, and the
    work of a slice is bounded by its length. Of right rows at one time the one of the largest values counts; rows with a
    null key or time match nothing and are matched by nothing. Columns of left keep their names; values must not be among them.
    """
    kept = [c for c in left.columns if c not in (*keys, time)]
    cut = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (slice_seconds * 1_000_000))
    found = F.struct(*values)
    a = left.select(*keys, time, F.lit(1).alias("__side"), F.struct(F.lit(0).alias("__"), *kept).alias("__row"))
    b = right.dropna(subset=[*keys, time]).select(*keys, time, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), found.alias("__found"))
    rows = a.withColumn("__found", F.lit(None).cast(b.schema["__found"].dataType)).unionByName(b).withColumn("__slice", cut)
    # One row for each key and slice, summed up before the shuffle.
    ends = rows.groupBy(*keys, "__slice").agg(F.max(F.when(F.col("__side") == 0, F.struct(time, "__found"))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "__slice", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    within = Window.partitionBy(*keys, "__slice").orderBy(time, "__side", "__found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumn("__found", F.last("__found", ignorenulls=True).over(within)).where("__side = 1")
    same = [here[c].eqNullSafe(carried[c]) for c in (*keys, "__slice")]
    met = here.join(carried, same, "left").select(*(here[c] for c in (*keys, time)), *(F.col("__row")[c].alias(c) for c in kept), F.coalesce("__found", "__carried.__found").alias("__found"))
    known = F.lit(True)
    for c in (*keys, time):
        known &= F.col(c).isNotNull()
    return met.select(*keys, time, *kept, *(F.when(known, F.col("__found")[v]).alias(v) for v in values))


def overlaps(spans: DataFrame, key: str, start: str, end: str, id_col: str, bucket_seconds: int) -> DataFrame:
    """(a, b, key) of pairs of one key whose half-open spans overlap, a < b.

    Each span is listed in the time buckets that it touches and meets only the spans of those, so a key with
    many rows makes pairs of neighbours and not of all; a pair counts in the bucket where the later one starts.
    """
    def bucket(c: Column) -> Column:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / bucket_seconds)

    listed = spans.select(key, F.col(start).alias("s"), F.col(end).alias("e"), F.col(id_col).alias("i"), F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))).alias("bucket"))
    x, y = listed.alias("x"), listed.alias("y")
    meet = (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.i") < F.col("y.i"))
    cross = (F.col("x.s") < F.col("y.e")) & (F.col("y.s") < F.col("x.e")) & (F.col("x.bucket") == bucket(F.greatest("x.s", "y.s")))
    return x.join(y, meet & cross).select(F.col("x.i").alias("a"), F.col("y.i").alias("b"), F.col(f"x.{key}").alias(key))


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, started, ended, n) of runs of events less than gap apart; ended is the last event's time plus gap."""
    return events.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def day_runs(events: DataFrame, key: str, time: str, least: int) -> DataFrame:
    """(key, first_day, last_day, days) of runs of at least `least` consecutive days with an event."""
    days = events.select(key, F.to_date(time).alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    runs = days.withColumn("island", island).groupBy(key, "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))
    return runs.where(F.col("days") >= least).drop("island")


def funnel(events: DataFrame, key: str, time: str, step: str, steps: Sequence[str]) -> DataFrame:
    """(key, reached): how many of steps each key went through in this order, by the earliest time each could happen.

    Step by step, the earliest time of each key is a grouped minimum after the time of the step before, which tasks take
    before the shuffle; no task holds a key's history. Keys with an event of any step are returned.
    """
    own = events.where(F.col(step).isin(*steps)).select(F.col(key), F.col(time).alias("__t"), F.col(step).alias("__s"))
    out = own.groupBy(key).agg(F.min(F.when(F.col("__s") == steps[0], F.col("__t"))).alias("__1"))
    for n, name in enumerate(steps[1:], 2):
        later = own.where(F.col("__s") == name).join(out.select(key, F.col(f"__{n - 1}").alias("__after")), key).where("__t > __after")
        out = out.join(later.groupBy(key).agg(F.min("__t").alias(f"__{n}")), key, "left")
    return out.select(key, sum((F.col(f"__{n}").isNotNull().cast("int") for n in range(1, len(steps) + 1)), F.lit(0)).alias("reached"))
