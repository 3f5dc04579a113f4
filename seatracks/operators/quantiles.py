"""Exact quantiles by rank selection, without all values of a table or group in one task.

The values are counted in ranges between their smallest and largest; the range that holds a wanted rank is kept, with its own
smallest and largest value, and counted again in finer ranges, until it holds few values or one value only. Each
round is one scan whose counts are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Ranges that an interval is counted in.
RANGES = 4096
#: An interval of so many values is sorted as it is.
FEW = 4096
MOST_ROUNDS = 40


def _range_of(v: Column, lo: Column, hi: Column, ranges: int) -> Column:
    """Number of the range of ``v``: never falls as v grows, 0 for lo and the last for hi; halves keep the span finite."""
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.when(lo == hi, 0).otherwise(F.least(F.lit(ranges - 1), F.floor(share * ranges).cast("int")))


def exact_quantiles(df: DataFrame, value: str, fractions: list[float], keys: tuple[str, ...] = (), ranges: int = RANGES, few: int = FEW, stored: bool = False) -> DataFrame:
    """(keys, n, min, max, mean, q): q has the value at each fraction, between two values by linear interpolation.

    Null, NaN and infinite values count as missing; a group without any value is left out; without keys there is always one row. The result is as exact as a
    sort: equal values are counted, never collected. The values are written once (unless ``df`` is a ``stored`` table) and read in each round. The groups' intervals are a
    table; Spark joins it to the values as its size asks for. Without keys they are two numbers for each fraction, sent with the plan.
    """
    keys = tuple(keys)
    real = F.col(value).cast("double")
    group = F.struct(*(F.struct(F.col(k).isNull().alias("none"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("is")) for k in keys))
    rows = df.select(*keys, (group if keys else F.lit(0)).alias("_g"), real.alias("_v")).where(F.abs(real) < float("inf"))
    rows = rows if stored else written(rows, "values")
    about = (F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"))
    whole = rows.groupBy("_g").agg(*(F.first(k).alias(k) for k in keys), *about) if keys else rows.agg(F.lit(0).alias("_g"), *about)
    whole = written(whole, "groups")
    places = F.array(*(F.lit(float(f)) * (F.col("n") - 1) for f in fractions))
    ranks = F.array_sort(F.array_distinct(F.concat(F.transform(places, lambda p: F.floor(p).cast("bigint")), F.transform(places, lambda p: F.ceil(p).cast("bigint")))))
    # open: intervals (lo, hi) of n values, before values below them, that hold a wanted rank
    state = whole.select("_g", F.explode(ranks).alias("rank"), F.lit(0).cast("bigint").alias("before"), "n", F.col("min").alias("lo"), F.col("max").alias("hi"))
    done = None
    for _ in range(MOST_ROUNDS):
        state = written(state, "ranks")
        settled = state.where((F.col("lo") == F.col("hi")) | (F.col("n") <= few))
        done = settled if done is None else done.unionByName(settled)
        state = state.where((F.col("lo") < F.col("hi")) & (F.col("n") > few))
        if state.isEmpty():
            break
        counted = _inside(rows, state, bool(keys)).groupBy("_g", "lo", _range_of(F.col("_v"), F.col("lo"), F.col("hi"), ranges).alias("r"))
        counted = counted.agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("_g", "lo").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most ``ranges`` rows
        counted = counted.withColumn("below", below)
        start = F.col("before") + F.col("below")
        found = state.drop("n", "hi").join(counted, ["_g", "lo"]).where((start <= F.col("rank")) & (F.col("rank") < start + F.col("n")))
        state = found.select("_g", "rank", start.alias("before"), "n", F.col("low").alias("lo"), F.col("high").alias("hi"))
    else:
        raise RuntimeError(f"ranks did not settle in {MOST_ROUNDS} rounds")
    same = done.where("lo = hi").select("_g", "rank", F.col("lo").alias("v"))
    small = done.where("lo < hi")
    lists = _inside(rows, small, bool(keys)).groupBy("_g", "lo").agg(F.array_sort(F.collect_list("_v")).alias("vs"))  # at most ``few`` values
    picked = small.join(lists, ["_g", "lo"]).select("_g", "rank", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("v"))
    of_rank = same.unionByName(picked).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two for each fraction

    def between(p: Column) -> Column:
        low, high = F.col("at")[F.floor(p).cast("bigint")], F.col("at")[F.ceil(p).cast("bigint")]
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return whole.join(of_rank, "_g", "left").select(*keys, "n", "min", "max", "mean", F.transform(places, between).alias("q"))


def _inside(rows: DataFrame, state: DataFrame, grouped: bool) -> DataFrame:
    """(_g, _v, lo, hi): the values that lie in an open interval of their group; the intervals of a group do not overlap."""
    v, real = F.col("_v"), "array<struct<lo:double,hi:double>>"
    if grouped:
        spans = state.groupBy("_g").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # two for each fraction at most
        own = rows.select("_g", "_v").join(spans, "_g")
    else:
        ends = {(r["lo"], r["hi"]) for r in state.select("lo", "hi").collect()}
        own = rows.select("_g", "_v", F.array(*(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in sorted(ends))).cast(real).alias("spans"))
    own = own.withColumn("_s", F.get(F.filter("spans", lambda s: (s["lo"] <= v) & (v <= s["hi"])), F.lit(0)))
    return own.where(F.col("_s").isNotNull()).select("_g", "_v", "_s.lo", "_s.hi")
