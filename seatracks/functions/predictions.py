"""Parsing and scoring of predicted cell texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import bound, path_ade_km, path_diagonal_km, path_fde_km, path_mse_km2, step_distances
from .geohash import decode_all, geohash_valid

#: Fixed value: the cell that stands in when a prediction has no valid one.
FALLBACK_CELL = "zzzzzzz"


def parse_tokens(text: Column) -> Column:
    """Tokens between white space and commas; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\s,]+"), lambda t: t != "")


def truth_tokens(messages: Column) -> Column:
    """Tokens of the third message."""
    return F.filter(F.split(F.element_at(messages, 3)["content"], "\\s+"), lambda t: t != "")


def constrain_n(tokens: Column, n: Column) -> Column:
    """Exactly n valid cells: invalid ones dropped, the last repeated or the rest cut; without any, the fallback cell."""
    valid = F.filter(tokens, lambda c: geohash_valid(c))
    some = F.when(F.size(valid) > 0, valid).otherwise(F.array(F.lit(FALLBACK_CELL)))
    missing = F.greatest(F.lit(0), n - F.size(some)).cast("int")
    return F.slice(F.concat(some, F.array_repeat(F.element_at(some, -1), missing)), F.lit(1), n.cast("int"))


def raw_length_ok(tokens: Column, n: Column) -> Column:
    return F.size(tokens) == n


def _count(xs: Column) -> Column:
    return F.size(F.filter(xs, lambda x: x))


def right_tokens(pred: Column, true: Column) -> Column:
    """Number of predictions that equal the truth at their place."""
    common = F.least(F.size(true), F.size(pred))
    return _count(F.zip_with(F.slice(pred, F.lit(1), common), F.slice(true, F.lit(1), common), lambda p, t: p == t))


def token_metrics(pred: Column, true: Column, right: Column | None = None) -> Column:
    """struct of the nine token metrics. ``right``: the number of right tokens, where it is not that of these two alone."""
    n_true, n_pred = F.size(true), F.size(pred)
    common = F.least(n_true, n_pred)
    right = right_tokens(pred, true) if right is None else right
    share = lambda n: F.when(n_true > 0, n / n_true).otherwise(0.0)
    return F.struct(
        share(right).alias("exact_token_accuracy"),
        share(common - right).alias("wrong_token_rate"),
        (pred == true).cast("int").alias("sequence_exact_match"),
        (_count(F.transform(pred, lambda p: ~geohash_valid(p))) / F.greatest(n_pred, F.lit(1))).alias("invalid_token_rate"),
        share(F.greatest(F.lit(0), n_true - n_pred)).alias("missing_token_rate"),
        share(F.greatest(F.lit(0), n_pred - n_true)).alias("extra_token_rate"),
        (n_pred == n_true).cast("int").alias("output_length_correct"),
        n_true.alias("n_true"),
        n_pred.alias("n_pred"),
    )


def decoded_paths(pred: Column, true: Column) -> tuple[Column, Column]:
    """Centres of the cells over the common length; an invalid prediction is replaced by the truth."""
    common = F.least(F.size(pred), F.size(true))
    truth = F.slice(true, F.lit(1), common)
    filled = F.zip_with(F.slice(pred, F.lit(1), common), truth, lambda p, t: F.when(geohash_valid(p), p).otherwise(t))
    return decode_all(filled), decode_all(truth)


def spatial_metrics(distances: Column) -> Column:
    """struct of the path errors without DTW (see the DTW helper); null members without common steps."""
    ade = path_ade_km(distances)
    return F.struct(
        path_mse_km2(distances).alias("MSE_km2"), ade.alias("MAE_km"), ade.alias("ADE_km"), path_fde_km(distances).alias("FDE_km"), path_diagonal_km(distances).alias("diagonal_km")
    )


def token_distances(pred: Column, true: Column) -> Column:
    a, b = decoded_paths(pred, true)
    return bound(F.struct(a.alias("p"), b.alias("t")), lambda s: step_distances(s["p"], s["t"]))


def token_spatial_metrics(pred: Column, true: Column) -> Column:
    """The spatial metrics of two token arrays; cells are decoded and distances worked out once."""
    return bound(token_distances(pred, true), spatial_metrics)
