import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatracks.operators import quantiles as Q

FRACTIONS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def values(kind: str, n: int) -> list[float]:
    rng = random.Random(n)
    return {
        "spread": [rng.uniform(-5, 5) for _ in range(n)],
        "ties": [float(rng.randrange(3)) for _ in range(n)],
        "one value": [2.5] * n,
        "outliers": [rng.random() * 1e-9 for _ in range(n - 2)] + [-1e300, 1e300],
        "hot middle": [0.0] * (n // 3) + [rng.gauss(0, 1) for _ in range(n - n // 3)],
        "span beyond doubles": [rng.choice([-1.0, 1.0]) * 1.7e308 * rng.random() for _ in range(n)],
    }[kind]


@pytest.mark.parametrize("kind", ["spread", "ties", "one value", "outliers", "hot middle", "span beyond doubles"])
def test_quantiles_equal_a_sort(spark, kind):
    v = values(kind, 5000)
    df = spark.createDataFrame([(x,) for x in v], "x double")
    got = Q.exact_quantiles(df, "x", FRACTIONS, ranges=16, few=20).first()
    s = np.sort(v)
    for f, q in zip(FRACTIONS, got["q"]):
        p = f * (len(s) - 1)
        lo, hi = s[math.floor(p)], s[math.ceil(p)]
        want = lo if lo == hi else (math.ceil(p) - p) * lo + (p - math.floor(p)) * hi
        assert q == pytest.approx(want, rel=1e-12, abs=1e-300)
    assert (got["n"], got["min"], got["max"]) == (5000, s[0], s[-1])


def test_groups_missing_values_and_empty_tables(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, ""]), rng.randrange(2), rng.choice([None, float("nan"), float("inf"), *([rng.random()] * 9)])) for _ in range(3000)]
    rows += [("only missing", 0, None), ("single", 0, 7.0)]
    df = spark.createDataFrame(rows, "k string, g int, x double")
    got = {(r["k"], r["g"]): r for r in Q.exact_quantiles(df, "x", [0.25, 0.5], ("k", "g"), ranges=4, few=3).collect()}
    own = {}
    for k, g, x in rows:
        if x is not None and math.isfinite(x):
            own.setdefault((k, g), []).append(x)
    assert set(got) == set(own)
    for key, x in own.items():
        assert got[key]["n"] == len(x) and got[key]["q"] == pytest.approx(np.percentile(x, [25, 50]).tolist(), abs=1e-12)
    assert Q.exact_quantiles(df.where("false"), "x", [0.5], ("k",)).count() == 0
    alone = Q.exact_quantiles(df.where("false"), "x", [0.5]).collect()
    assert [(r["n"], r["q"]) for r in alone] == [(0, [None])]


def test_plan_has_no_percentile_and_no_single_task(spark):
    df = spark.range(200_000).select((F.hash("id") / 7.0).alias("x"))
    out = Q.exact_quantiles(df, "x", [0.5], few=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan
    assert out.first()["q"][0] == pytest.approx(df.agg(F.percentile("x", F.lit(0.5))).first()[0])
