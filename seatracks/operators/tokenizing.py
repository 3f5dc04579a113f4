"""Token columns, vocabularies and fitted speed bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bins import FIXED_EDGES, QUANTILE_BINS, SpeedBins, cog_labels, cog_token, sog_token
from ..functions.geohash import geohash_encode
from .quantiles import exact_quantiles

#: Declared: tokens outside the speed and course bins that a vocabulary also lists.
SPECIAL_TOKENS = ("<GAP>", "<PREFIX>", "<SUFFIX>")


def fit_sog_quantiles(points: DataFrame, variant: str, approx: bool = False) -> DataFrame:
    """(bin, cut): cut points of the quantile bins from the train tracks' speeds above the fixed bins (rule declared).

    ``points`` needs a split column. The result has at most 15 rows.
    """
    n = QUANTILE_BINS[variant]
    fractions = [i / n for i in range(1, n)]
    rows = points.where((F.col("split") == "train") & (F.col("SOG") >= FIXED_EDGES[-1]) & ~F.isnan("SOG"))
    found = rows.agg(F.percentile_approx("SOG", fractions, 100_000).alias("cuts")) if approx else exact_quantiles(rows, "SOG", fractions).select(F.col("q").alias("cuts"))
    return found.select(F.posexplode("cuts").alias("bin", "cut")).withColumn("bin", F.col("bin") + 1)


def token_vocabulary(spark: SparkSession, bins: SpeedBins, cog_variant: str) -> DataFrame:
    """(kind, token): the speed, course and special tokens of a variant pair."""
    kinds = (("sog", bins.labels), ("cog", cog_labels(cog_variant)), ("special", SPECIAL_TOKENS))
    entries = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("token")) for kind, labels in kinds for t in labels))
    return spark.range(1).select(F.inline(entries))


def tokenize(points: DataFrame, bins: SpeedBins, cog_variant: str, precision: int = 7) -> DataFrame:
    """Appends geohash_7, sog_token and cog_token; row by row, so it needs no shuffle."""
    return points.withColumns(
        {"geohash_7": geohash_encode(F.col("latitude"), F.col("longitude"), precision), "sog_token": sog_token(F.col("SOG"), bins), "cog_token": cog_token(F.col("COG"), cog_variant)}
    )
