"""Summaries of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def minutes_between(later, earlier):
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 60_000_000.0


def input_counts(points: DataFrame) -> DataFrame:
    """One row: rows, tracks, and the ranges of speed and course."""
    return points.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("trajectory_id").alias("n_tracks"),
        F.min("SOG").alias("min_sog"),
        F.max("SOG").alias("max_sog"),
        F.min("COG").alias("min_cog"),
        F.max("COG").alias("max_cog"),
    )


def interval_stats(points: DataFrame, approx: bool = False) -> DataFrame:
    """One row: min, mean, median and max minutes between consecutive points of a track.

    The exact median is found by rank selection; ``approx`` uses a sketch instead.
    """
    before = F.lag("timestamp").over(Window.partitionBy("trajectory_id").orderBy("timestamp"))
    gaps = points.select(minutes_between(F.col("timestamp"), before).alias("m")).where("m IS NOT NULL")
    if approx:
        return gaps.agg(F.min("m").alias("min_minutes"), F.avg("m").alias("mean_minutes"), F.percentile_approx("m", 0.5, 10_000).alias("median_minutes"), F.max("m").alias("max_minutes"))
    found = exact_quantiles(gaps, "m", [0.5])
    return found.select(F.col("min").alias("min_minutes"), F.col("mean").alias("mean_minutes"), F.get("q", F.lit(0)).alias("median_minutes"), F.col("max").alias("max_minutes"))


def length_stats(points: DataFrame) -> DataFrame:
    """One row: min, max, mean and median points of a track."""
    n = points.groupBy("trajectory_id").agg(F.count("*").alias("n"))
    whole = lambda c: F.col(c).cast("bigint").alias(f"{c}_points")
    return exact_quantiles(n, "n", [0.5]).select(whole("min"), whole("max"), F.col("mean").alias("mean_points"), F.get("q", F.lit(0)).alias("median_points"))


def token_distribution(tokens: DataFrame, rare_percent: float = 0.5) -> DataFrame:
    """(kind, token, n, percent, rare) of the speed and course tokens, most frequent first."""
    long = tokens.select(F.expr("stack(2, 'sog', sog_token, 'cog', cog_token) AS (kind, token)")).where("token IS NOT NULL")
    counts = long.groupBy("kind", "token").agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("kind"))
    return counts.withColumn("percent", share).withColumn("rare", F.col("percent") < rare_percent).orderBy("kind", F.col("n").desc(), "token")
