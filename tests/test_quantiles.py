"""Exact quantiles by narrowing spans."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from commitflow.operators import stats

POINTS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def test_equal_the_sorted_values(spark):
    r = random.Random(3)
    cols = {
        "many": [r.gauss(0, 1) for _ in range(3000)],
        "far": [r.choice([1e308, -1e308, 5e-324, 0.0, 1.0, 1e-300, math.pi]) for _ in range(3000)],
        "one": [7.0] * 3000,
        "few": [float(r.randint(0, 3)) if i % 2 else None for i in range(3000)],
        "none": [None] * 3000,
    }
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(4)
    got = stats.exact_quantiles(df, list(cols), POINTS)
    spark_own = df.agg(*(F.percentile(c, F.array(*(F.lit(p) for p in POINTS))).alias(c) for c in cols)).first()
    assert got["none"] is None and spark_own["none"] is None
    for c in ("many", "one", "few"):
        assert got[c] == spark_own[c]
        assert np.allclose(got[c], np.quantile([v for v in cols[c] if v is not None], POINTS))
    ordered = sorted(cols["far"])
    assert [got["far"][0], got["far"][-1]] == [ordered[0], ordered[-1]]


def test_infinities_and_nan_have_their_places(spark):
    values = [-math.inf, 1.0, 2.0, math.inf, math.nan]
    got = stats.exact_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), ["x"], [0, 0.25, 0.5, 0.75, 1])["x"]
    assert got[:4] == values[:4] and math.isnan(got[4])
    assert stats.exact_quantiles(spark.createDataFrame([], "x double"), ["x"], [0.5]) == {"x": None}


def test_no_percentile_in_the_plan(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert "percentile" not in stats.describe(df, ["x"])._jdf.queryExecution().toString()
