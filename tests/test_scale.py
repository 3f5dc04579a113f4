"""What plans must hold at scale: blocks of long tracks, one exchange, one scan, bucketed tables, filtered splits, kept bad lines."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from seatracks.functions import bins as B
from seatracks.functions import geohash as H
from seatracks.operators import compare as C
from seatracks.operators import fills as L
from seatracks.operators import splits as S
from seatracks.operators import tokenizing as K
from seatracks.operators import validate as V
from seatracks.operators import windows as W
from seatracks.plans.queries import QUERIES
from seatracks.settings import Settings
from seatracks.sources import fixtures as X
from seatracks.sources import io

SMALL = Settings(gap_sizes=(2, 3), prefix_steps=4, suffix_steps=4, train_windows=3)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single)", plan_of(df)))


def long_track(spark, n):
    """One track with a point every 20 seconds, some of them at no known time."""
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20)
    return spark.range(0, n, 1, 16).select(F.lit("t").alias("trajectory_id"), (F.col("id") + 7).alias("MMSI"), F.when(F.col("id") != 5, t).alias("timestamp"), (F.col("id") % 90).cast("double").alias("latitude"))


def test_a_long_track_in_blocks_equals_the_plain_window(spark):
    n = 1_000_000
    points = long_track(spark, n)
    got = W.track_index(points, block_minutes=60 * 24)
    both = got.join(W.track_index(points).select("latitude", "timestamp", F.col("position").alias("p"), F.col("step_min").alias("s"), F.col("MMSI").alias("m"), F.col("track_length").alias("l")), ["timestamp", "latitude"])
    same = (F.col("position") == F.col("p")) & F.col("step_min").eqNullSafe(F.col("s")) & F.col("MMSI").eqNullSafe(F.col("m")) & (F.col("track_length") == F.col("l"))
    assert got.count() == n and both.where(same).count() == n - 1  # all but the one without a time, which no join meets
    assert got.where("timestamp IS NULL AND position = 0 AND step_min IS NULL").count() == 1
    sizes = points.groupBy("trajectory_id", W.time_blocks(60 * 24).alias("b")).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 4320 and sizes[1] > 200  # what a window gets, and what the frames over a track run over


def test_windows_of_blocked_tracks(spark, data):
    points = X.with_split(X.points(spark, data))
    columns = ["sample_id", "event_id", "global_row_index", "row_type", "dt_min", "MMSI"]
    a, b = (W.gap_windows(points, block_minutes=m).select(*columns) for m in (None, 500.0))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sample_checks_need_one_exchange_more_than_the_windows(spark, data):
    rows = W.gap_windows(K.tokenize(X.with_split(X.points(spark, data)), B.S1, "C2"))
    checked = V.check_samples(rows, W.gap_metadata(rows), B.S1.labels, B.cog_labels("C2"))
    checked.collect()
    plan = checked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<!Reused)Exchange hash", plan)) == 2 and "Join" not in plan  # the windows' own, read twice, and one
    kept, dropped = L.complete_samples(rows)
    assert exchanges(kept) == 1 and exchanges(dropped) == 1 and "Join" not in plan_of(kept)


def test_alignment_and_behaviour_read_the_events_once(spark, data):
    for name in ("step_alignment", "behaviour_join"):
        plan = plan_of(QUERIES[name](spark, data))
        assert len(re.findall("Scan parquet", plan)) == 1 and "Join" not in plan
        assert plan.count("Exchange hashpartitioning") == 1


def test_pairs_read_the_events_once(spark, data):
    for name in ("win_rate", "config_win_rate"):
        plan = plan_of(QUERIES[name](spark, data))
        assert len(re.findall("Scan parquet", plan)) == 1 and "Join" not in plan
        assert plan.count("Exchange hashpartitioning") == 2  # by track, and the few sums by gap size


def test_behaviour_of_outside_metadata_is_the_same(spark, data):
    rows = W.gap_windows(S.filter_split(X.with_split(X.points(spark, data)), "test"))
    metrics = C.sample_metrics(X.steps(rows).where("config = 'x'"))
    joined = C.behaviour_join(metrics, W.gap_metadata(rows), "b", "linear", 150.0)
    carried = C.behaviour_join(C.sample_metrics(X.steps(W.with_durations(rows), C.DURATIONS).where("config = 'x'"), carry=C.DURATIONS), None, "b", "linear", 150.0)
    assert joined.count() > 0 and joined.exceptAll(carried).isEmpty() and carried.exceptAll(joined).isEmpty()
    lonely = C.behaviour_join(metrics.where("model <> 'b' OR gap_steps > 5"), W.gap_metadata(rows), "b", "linear")
    assert lonely.where("gap_steps = 5").isEmpty() and lonely.count() > 0


def test_quantile_queries_have_no_percentile_over_a_table(spark, data):
    for name in ("interval_stats", "length_stats", "fit_sog_quantiles", "metric_distribution", "win_by_duration_quartile"):
        assert "percentile" not in plan_of(QUERIES[name](spark, data))


def test_bucketed_windows_are_read_without_an_exchange(spark, data, tmp_path):
    rows = W.gap_windows(K.tokenize(X.with_split(X.points(spark, data)), B.S1, "C2"))
    table = io.write_gap_examples_by_track(rows, "windows_by_track", str(tmp_path / "w"), buckets=4)
    files = [p for p in (tmp_path / "w").iterdir() if p.suffix == ".parquet"]
    assert len(files) <= 4 and table.count() == rows.count()
    grouped = table.groupBy("trajectory_id").agg(F.count("*"))
    joined = table.groupBy("trajectory_id", "sample_id").agg(F.max("dt_min").alias("x")).join(spark.table("windows_by_track"), ["trajectory_id", "sample_id"])
    assert "Exchange" not in plan_of(grouped)
    assert grouped.count() == rows.select("trajectory_id").distinct().count() and joined.count() == rows.count()
    io.write_gap_examples_by_track(rows, "windows_in_parts", str(tmp_path / "v"), buckets=2, rows_per_file=1000)
    assert len([p for p in (tmp_path / "v").iterdir() if p.suffix == ".parquet"]) > 2
    for t in ("windows_by_track", "windows_in_parts"):
        spark.sql(f"DROP TABLE {t}")


def test_only_the_wanted_split_reaches_the_exchange(spark):
    points = spark.range(0, 40_000).select(F.concat(F.lit("t"), F.col("id") % 2000).alias("trajectory_id"), "id")
    splits = spark.range(0, 2000).select(F.concat(F.lit("t"), "id").alias("trajectory_id"), F.when(F.col("id") % 20 == 0, "test").otherwise("train").alias("split"))
    passes = S.bloom_filter(splits.where("split = 'test'"), "trajectory_id")
    let = points.where(passes(F.col("trajectory_id")))
    assert 2000 <= let.count() <= 2040  # a twentieth, and next to nothing else
    small = S.bloom_filter(splits.where("split = 'test'"), "trajectory_id", bits=100)  # too few bits: more pass, none is lost
    assert points.where(small(F.col("trajectory_id"))).join(splits.where("split = 'test'"), "trajectory_id", "left_semi").count() == 2000
    nobody = S.bloom_filter(splits.where("false"), "trajectory_id")
    assert points.where(nobody(F.col("trajectory_id"))).count() == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = S.points_of_split(points, splits, "test")
        plan = plan_of(got)
        assert "SortMergeJoin" in plan and "getbit" in plan.lower()
        assert got.count() == 2000 and got.where("split <> 'test' OR CAST(substr(trajectory_id, 2) AS INT) % 20 <> 0").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    odd = spark.createDataFrame([(None, 1)], "trajectory_id string, id int")
    assert S.points_of_split(odd, splits, "test").count() == 0


def test_checked_readers_lose_no_good_row(spark, tmp_path):
    lines = ["k,n"] + [f"r{i},{i}" for i in range(90)] + ["bad,x"] * 5 + ["short"] * 3 + ["long,1,2"] * 2
    (tmp_path / "a.csv").write_text("\n".join(lines))
    rows, bad = io.read_table_csv_checked(spark, str(tmp_path / "a.csv"), "k string, n int")
    assert rows.count() == 90 and bad.count() == 10
    assert {(r["file"], r["record"]) for r in bad.collect()} == {("a.csv", "bad,x"), ("a.csv", "short"), ("a.csv", "long,1,2")}
    good = {"sample_id": "s", "trajectory_id": "t", "gap_steps": 5, "messages": [{"role": "user", "content": "x"}]}
    (tmp_path / "b.jsonl").write_text("\n".join([json.dumps(good)] * 20 + ["{cut", json.dumps(good | {"gap_steps": "five"}), "[]"]))
    rows, bad = io.read_sft_jsonl_checked(spark, str(tmp_path / "b.jsonl"))
    assert rows.count() == 20 and {r["messages"][0]["content"] for r in rows.collect()} == {"x"}
    assert bad.where("record LIKE '%five%' OR record = '{cut'").count() == 2
    start = dt.datetime(2024, 1, 1)
    points = [("t", str(i), f"2024-01-01 00:{i:02d}:00", 1.0, 2.0, "nan" if i == 3 else "5.5", None) for i in range(20)]
    points += [("t", "x", "2024-01-01 00:30:00", 1.0, 2.0, "1", 1.0), ("t", "1", "noon", 1.0, 2.0, "quick", 1.0)]
    spark.createDataFrame(points, "trajectory_id string, MMSI string, timestamp string, latitude double, longitude double, SOG string, COG double").write.parquet(str(tmp_path / "p"))
    rows, bad = io.read_points_checked(spark, str(tmp_path / "p"))
    assert rows.count() == 20 and rows.where("SOG IS NULL").count() == 1 and rows.agg(F.min("timestamp")).first()[0] == start
    assert {(r["column_name"], r["value"]) for r in bad.collect()} == {("MMSI", "x"), ("timestamp", "noon"), ("SOG", "quick")}


def test_metrics_of_several_models_in_one_file(spark, tmp_path):
    df = spark.createDataFrame([("a", "overall", 1.0), ("a", "5", 2.0), ("b", "5", None)], "model string, gap string, ADE_km double")
    io.write_metrics_json(df, str(tmp_path / "m"), model_col="model")
    got = {(r["model"], r["gap"]): dict(r["metrics"]) for r in io.read_metrics_json(spark, str(tmp_path / "m")).collect()}
    assert got == {("a", "overall"): {"ADE_km": 1.0}, ("a", "5"): {"ADE_km": 2.0}, ("b", "5"): {}}


@pytest.mark.parametrize("precision", [1, 4, 5, 7, 8])
def test_cells_and_their_centres(spark, precision):
    """Halving the ranges bit by bit gives the same cell, whose centre gives the cell again."""
    places = [(57.64911, 10.40744), (-90.0, -180.0), (90.0, 180.0), (0.0, 0.0), (-33.3, 151.2), (89.999999, -0.000001), (12.5, -179.999)]

    def cell(lat, lon):
        spans, out, bits = [[-90.0, 90.0], [-180.0, 180.0]], "", 0
        for b in range(5 * precision):
            span, v = (spans[1], lon) if b % 2 == 0 else (spans[0], lat)
            middle = (span[0] + span[1]) / 2
            bits = 2 * bits + (v >= middle)
            span[0 if v >= middle else 1] = middle
            if b % 5 == 4:
                out, bits = out + H.ALPHABET[bits], 0
        return out, sum(spans[0]) / 2, sum(spans[1]) / 2

    df = spark.createDataFrame(places, "lat double, lon double").withColumn("c", H.geohash_encode(F.col("lat"), F.col("lon"), precision))
    df = df.withColumn("p", H.geohash_decode(F.col("c"), precision)).withColumn("again", H.geohash_encode(F.col("p.lat"), F.col("p.lon"), precision))
    for r in df.collect():
        want = cell(r["lat"], r["lon"])
        assert (r["c"], r["p"]["lat"], r["p"]["lon"]) == want and r["again"] == r["c"]


def test_win_rates_beside_the_means_of_a_set(spark):
    nan = float("nan")
    rows = [("x", m, s, "t", g, float(v), 1.0, 1.0, 1.0, 1.0) for m, s, g, v in [("a", "s1", 30, 1), ("b", "s1", 30, 2), ("a", "s2", 30, 3), ("b", "s2", 30, nan), ("a", "s3", 5, 1), ("c", "s9", 30, 1)]]
    m = spark.createDataFrame(rows, "config string, model string, sample_id string, trajectory_id string, gap_steps int, ADE_km double, FDE_km double, DTW_km double, MAE_km double, MSE_km2 double")
    got = {r["model"]: (r["n"], r["wins"], r["total"], r["win_percent"]) for r in C.sized_subset_table(m, (30,), "a", ["b", "c"]).collect()}
    assert got == {"a": (2, None, None, None), "b": (2, 1, 2, 50.0), "c": (1, None, None, None)}
