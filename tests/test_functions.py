import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seatracks.functions import bins as B
from seatracks.functions import geo as G
from seatracks.functions import geohash as H
from seatracks.functions import predictions as P


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "lat, lon, cell", [(57.64911, 10.40744, "u4pruyd"), (90.0, 180.0, "zzzzzzz"), (-90.0, -180.0, "0000000"), (0.0, 0.0, "s000000")]
)
def test_geohash_known_cells(spark, lat, lon, cell):
    assert one(spark, H.geohash_encode(F.lit(lat), F.lit(lon)))[0] == cell


def test_geohash_valid(spark):
    rows = spark.createDataFrame([(c,) for c in ("u4pruyd", "abc", "u4pruya", "U4PRUYD", "", None)], "c string")
    assert [r[0] for r in rows.select(H.geohash_valid(F.col("c"))).collect()] == [True, False, False, False, False, False]


def test_geohash_round_trip_within_half_a_cell(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 500), rng.uniform(-180, 180, 500))]
    df = spark.createDataFrame(rows, "lat double, lon double")
    out = df.withColumn("p", H.geohash_decode(H.geohash_encode(F.col("lat"), F.col("lon")))).select("lat", "lon", "p.*").toPandas()
    out.columns = ["lat", "lon", "clat", "clon"]
    assert (abs(out.lat - out.clat) <= 180 / 2**18 + 1e-12).all() and (abs(out.lon - out.clon) <= 360 / 2**19 + 1e-12).all()
    assert one(spark, H.geohash_decode(F.lit("nope")))[0] is None


def test_speed_edges(spark):
    for bins in (B.S0, B.S1):
        values = [x for e in bins.edges for x in (math.nextafter(e, 0), e)]
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "s double").select(B.sog_token(F.col("s"), bins)).collect()]
        assert got == [bins.labels[i + k] for i in range(len(bins.edges)) for k in (0, 1)]
    assert one(spark, *(B.sog_token(F.lit(x).cast("double"), B.S1) for x in (None, -0.1, float("nan"))))[:] == (None, None, None)


def test_quantile_bins_have_their_names():
    bins = B.quantile_bins("S3", [float(i + 5) for i in range(15)])
    assert bins.labels[4] == "<SOG_04_Q01>" and bins.labels[-1] == "<SOG_19_Q16>"
    assert B.quantile_bins("S2", [float(i + 5) for i in range(11)]).labels[-1] == "<SOG_15_Q12>"
    with pytest.raises(ValueError):
        B.quantile_bins("S2", [1.0])
    assert B.S1.labels[0] == "<SOG_00_STOP>" and B.S1.labels[-1] == "<SOG_09_VFAST>"


def test_course_bins(spark):
    cases = {0.0: ("N", "<COG_000>", "<COG_000>"), 22.5: ("NE", "<COG_015>", "<COG_020>"), 359.9: ("N", "<COG_345>", "<COG_350>"), 360.0: ("N", "<COG_000>", "<COG_000>"), 720.5: ("N", "<COG_000>", "<COG_000>"), -10.5: ("N", "<COG_345>", "<COG_340>")}
    for cog, want in cases.items():
        assert one(spark, *(B.cog_token(F.lit(cog), v) for v in ("C0", "C2", "C3")))[:] == want
    assert one(spark, B.cog_normalize(F.lit(-10.5)))[0] == 349.5


def test_distances(spark):
    d = lambda *x: one(spark, G.haversine_km(*(F.lit(float(v)) for v in x)))[0]
    assert d(10, 20, 10, 20) == 0
    assert d(0, 0, 0, 180) == pytest.approx(math.pi * 6371)
    assert d(0, 179.9, 0, -179.9) == pytest.approx(0.2 * math.pi / 180 * 6371)


def test_enu_round_trip(spark):
    lat, lon, a, b = (F.lit(x) for x in (10.3, 20.4, 10.0, 20.0))
    e = one(spark, G.to_enu_m(lat, lon, a, b))[0]
    back = one(spark, G.from_enu_m(F.lit(e["east_m"]), F.lit(e["north_m"]), a, b))[0]
    assert back["lat"] == pytest.approx(10.3) and back["lon"] == pytest.approx(20.4)


def plain_dtw(a, b):
    cost = lambda p, q: G.dtw_batch([np.array([p])], [np.array([q])])[0]
    t = np.full((len(a) + 1, len(b) + 1), np.inf)
    t[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = cost(a[i], b[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


path = st.lists(st.tuples(st.floats(-80, 80), st.floats(-170, 170)), min_size=1, max_size=6)


@settings(max_examples=30, deadline=None)
@given(path, path)
def test_dtw_is_the_plain_recurrence(a, b):
    got = G.dtw_batch([np.array(a)], [np.array(b)])[0]
    assert got == pytest.approx(plain_dtw(a, b), abs=1e-6)
    assert G.dtw_batch([np.array(a)], [np.array(a)])[0] == pytest.approx(0, abs=1e-6)


def test_dtw_column(spark):
    point = "struct<lat:double,lon:double>"
    df = spark.createDataFrame([([(0.0, 0.0), (0.0, 1.0)], [(0.0, 0.0), (0.0, 1.0), (0.0, 1.0)]), ([], [(0.0, 0.0)]), (None, [(0.0, 0.0)])], f"p array<{point}>, t array<{point}>")
    got = [r[0] for r in df.select(G.path_dtw_km(F.col("p"), F.col("t"))).collect()]
    assert got[0] == pytest.approx(0) and got[1:] == [None, None]


def test_path_errors(spark):
    point = "struct<lat:double,lon:double>"
    df = spark.createDataFrame([([(0.0, 0.0), (0.0, 2.0), (9.0, 9.0)], [(0.0, 1.0), (0.0, 2.0)])], f"p array<{point}>, t array<{point}>")
    d = G.step_distances(F.col("p"), F.col("t"))
    r = df.select(G.path_ade_km(d).alias("a"), G.path_fde_km(d).alias("f"), G.path_mse_km2(d).alias("m"), G.path_diagonal_km(d).alias("s"), F.size(d).alias("n")).first()
    km = math.pi / 180 * 6371
    assert r["n"] == 2 and r["a"] == pytest.approx(km / 2) and r["f"] == pytest.approx(0) and r["m"] == pytest.approx(km * km / 2) and r["s"] == pytest.approx(km)


@pytest.mark.parametrize(
    "text, n, want",
    [
        ("u4pruyd, u4pruyc\nbad! u4pruyb", 2, ["u4pruyd", "u4pruyc"]),
        ("u4pruyd", 3, ["u4pruyd"] * 3),
        ("", 2, ["zzzzzzz"] * 2),
        (None, 1, ["zzzzzzz"]),
        ("nope bad!", 2, ["zzzzzzz"] * 2),
    ],
)
def test_constrained_predictions(spark, text, n, want):
    assert one(spark, P.constrain_n(P.parse_tokens(F.lit(text).cast("string")), F.lit(n)))[0] == want


def test_token_metrics_add_up(spark):
    pred, true = F.array(*map(F.lit, ("u4pruyd", "bad!", "u4pruyb"))), F.array(*map(F.lit, ("u4pruyd", "u4pruyc", "u4pruyb", "u4pruy9", "u4pruy8")))
    m = one(spark, P.token_metrics(pred, true))[0]
    assert m["exact_token_accuracy"] + m["wrong_token_rate"] + m["missing_token_rate"] == pytest.approx(1)
    assert (m["n_true"], m["n_pred"], m["sequence_exact_match"], m["output_length_correct"]) == (5, 3, 0, 0)
    assert m["invalid_token_rate"] == pytest.approx(1 / 3) and m["extra_token_rate"] == 0
