"""Text records of samples, and scores of predicted texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predictions as P
from ..functions.geo import bound, path_diagonal_km, path_dtw_km, path_fde_km, step_distances

#: Our wording.
SYSTEM_TEXT = "You restore hidden ship positions. Answer with one cell for each hidden step, separated by spaces."
TOKEN_METRICS = ("exact_token_accuracy", "wrong_token_rate", "sequence_exact_match", "invalid_token_rate", "missing_token_rate", "extra_token_rate", "output_length_correct", "n_true", "n_pred")


def sft_records(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, trajectory_id, gap_steps, messages) of each sample: system, user and assistant message.

    The user's part lists the visible rows' tokens and minutes, the assistant's the hidden cells in order. ``by``: columns whose
    values in a sample get a record each.
    """
    item = F.struct("global_row_index", "row_type", "geohash_7", "sog_token", "cog_token", F.format_string("%.1f", F.col("dt_min")).alias("dt"))
    per = rows.groupBy("sample_id", "trajectory_id", "gap_steps", *by).agg(F.array_sort(F.collect_list(item)).alias("rows"))
    seen = lambda kind: F.array_join(
        F.transform(F.filter("rows", lambda r: r["row_type"] == kind), lambda r: F.concat_ws(" ", r["geohash_7"], r["sog_token"], r["cog_token"], r["dt"])), "; "
    )
    hidden = F.array_join(F.transform(F.filter("rows", lambda r: r["row_type"] == "gap"), lambda r: r["geohash_7"]), " ")
    user = F.concat(F.lit("PREFIX: "), seen("prefix"), F.lit("\nHIDDEN STEPS: "), F.col("gap_steps").cast("string"), F.lit("\nSUFFIX: "), seen("suffix"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return per.select("sample_id", "trajectory_id", "gap_steps", F.array(message("system", F.lit(SYSTEM_TEXT)), message("user", user), message("assistant", hidden)).alias("messages"))


def scored_predictions(df: DataFrame, constrain: bool = True, dtw: bool = False, pool: tuple[str, ...] = ()) -> DataFrame:
    """Adds pred_tokens, true_tokens, raw_length_ok, the nine token metrics and the spatial metrics.

    ``df`` has sample_id, trajectory_id, gap_steps, predicted and true texts. With ``constrain`` the prediction is brought to
    exactly as many valid cells as the truth has; with ``dtw`` DTW_km is the true one (the vectorized helper), else null.
    ``pool``: key of a sample that may have several texts. Right cells and distances are then those of all its texts, as one
    path; the lengths and DTW_km stay the text's own. The final distance is that of the longest text (the largest of several).
    """
    out = df.withColumns({"raw_tokens": P.parse_tokens(F.col("predicted")), "true_tokens": P.parse_tokens(F.col("true"))})
    n, raw = F.size("true_tokens"), F.col("raw_tokens")
    out = out.withColumns({"raw_length_ok": P.raw_length_ok(raw, n), "pred_tokens": P.constrain_n(raw, n) if constrain else raw})
    pred, true = P.decoded_paths(F.col("pred_tokens"), F.col("true_tokens"))
    kept = out.columns
    if pool:
        return _pooled(out.withColumn("_p", F.struct(pred.alias("pred"), true.alias("true"))), kept, dtw, pool)
    out = out.withColumns({"_m": P.token_metrics(F.col("pred_tokens"), F.col("true_tokens")), "_p": F.struct(pred.alias("pred"), true.alias("true"))})
    distances = step_distances(F.col("_p.pred"), F.col("_p.true"))
    warped = path_dtw_km(F.col("_p.pred"), F.col("_p.true")) if dtw else F.lit(None).cast("double")
    out = out.select(*kept, "_m.*", bound(distances, P.spatial_metrics).alias("_s"), warped.alias("DTW_km"))
    return out.select(*kept, *TOKEN_METRICS, "_s.*", "DTW_km")


def _pooled(out: DataFrame, kept: list[str], dtw: bool, pool: tuple[str, ...]) -> DataFrame:
    own = Window.partitionBy(*pool)
    tokens = F.col("pred_tokens"), F.col("true_tokens")
    out = out.withColumns({"_r": P.right_tokens(*tokens), "_d": step_distances(F.col("_p.pred"), F.col("_p.true"))})
    out = out.withColumns({"_n": F.size("_d"), "_s": path_diagonal_km(F.col("_d")), "_q": path_diagonal_km(F.transform("_d", lambda d: d * d)), "_f": path_fde_km(F.col("_d"))})
    last = F.when(F.col("_n") > 0, F.struct("_n", "_f"))
    out = out.withColumns({"_right": F.sum("_r").over(own), "_steps": F.sum("_n").over(own), "_sum": F.sum("_s").over(own), "_squares": F.sum("_q").over(own), "_last": F.max(last).over(own)})
    mean, squares = F.try_divide("_sum", F.col("_steps")), F.try_divide("_squares", F.col("_steps"))
    warped = path_dtw_km(F.col("_p.pred"), F.col("_p.true")) if dtw else F.lit(None).cast("double")
    spatial = [squares.alias("MSE_km2"), mean.alias("MAE_km"), mean.alias("ADE_km"), F.col("_last._f").alias("FDE_km"), F.col("_sum").alias("diagonal_km")]
    out = out.select(*kept, P.token_metrics(*tokens, right=F.col("_right")).alias("_m"), *spatial, warped.alias("DTW_km"))
    return out.select(*kept, "_m.*", *(c for c in out.columns if c not in (*kept, "_m")))


def token_steps(scored: DataFrame) -> DataFrame:
    """Step rows (gap_step from 0, positions of prediction and truth) of scored predictions."""
    pred, true = P.decoded_paths(F.col("pred_tokens"), F.col("true_tokens"))
    both = scored.select("sample_id", "trajectory_id", "gap_steps", F.posexplode(F.arrays_zip(pred.alias("p"), true.alias("t"))).alias("gap_step", "z"))
    return both.select(
        "sample_id", "trajectory_id", "gap_steps", "gap_step", F.col("z.p.lat").alias("pred_lat"), F.col("z.p.lon").alias("pred_lon"), F.col("z.t.lat").alias("true_lat"), F.col("z.t.lon").alias("true_lon")
    )


def per_step_accuracy(scored: DataFrame) -> DataFrame:
    """(gap_steps, step, accuracy, n): all positions of each gap size, with a null accuracy where nothing is aligned."""
    common = F.least(F.size("pred_tokens"), F.size("true_tokens"))
    right = F.zip_with(F.slice("pred_tokens", F.lit(1), common), F.slice("true_tokens", F.lit(1), common), lambda p, t: p == t)
    hits = scored.select("gap_steps", F.posexplode(right).alias("step", "hit")).groupBy("gap_steps", "step").agg(F.count_if("hit").alias("h"), F.count("*").alias("n"))
    grid = scored.select("gap_steps").distinct().select("gap_steps", F.explode(F.sequence(F.lit(0), F.col("gap_steps") - 1)).alias("step"))
    out = grid.join(hits, ["gap_steps", "step"], "left")
    return out.select("gap_steps", "step", (F.col("h") / F.col("n")).alias("accuracy"), F.coalesce("n", F.lit(0)).alias("n"))


def prediction_table(scored: DataFrame) -> DataFrame:
    """One output row for each sample, the spatial columns of all five metrics included."""
    return scored.select(
        "sample_id",
        "trajectory_id",
        "gap_steps",
        F.array_join("pred_tokens", " ").alias("predicted"),
        F.array_join("true_tokens", " ").alias("true"),
        "n_true",
        "n_pred",
        "exact_token_accuracy",
        "sequence_exact_match",
        "ADE_km",
        "FDE_km",
        "DTW_km",
        "MAE_km",
        "MSE_km2",
    )
