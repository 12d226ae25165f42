import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import percentiles


@pytest.mark.parametrize("name", ["wide", "ties", "signs", "near", "one", "tiny"])
def test_order_statistics(spark, monkeypatch, name):
    monkeypatch.setattr(percentiles, "BINS", 16)
    rng = random.Random(1)
    values = {
        "wide": [10.0 ** rng.uniform(-300, 300) for _ in range(500)], "ties": [float(rng.randint(0, 5)) for _ in range(500)], "signs": [rng.choice([-1, 0, 1]) * 2.0 ** rng.randint(-1000, 1000) for _ in range(500)],
        "near": [1.0 + k * 2.0**-52 for k in range(300)], "one": [7.5], "tiny": [5e-324 * k for k in range(1, 200)] + [1e308, -1e308],
    }[name]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    ranks = sorted({0, len(values) - 1, *(rng.randrange(len(values)) for _ in range(6))})
    want = sorted(values)
    assert percentiles.order_statistics(df, F.col("x"), ranks) == {r: want[r] for r in ranks}


def test_percentiles(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    shares = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r["share"]: r["value"] for r in percentiles.exact_percentiles(df, F.col("l_extendedprice") * (1 - F.col("l_discount")), shares).collect()}
    x = np.array([r[0] for r in df.select(F.col("l_extendedprice") * (1 - F.col("l_discount"))).collect()])
    assert got == {s: pytest.approx(np.quantile(x, s), rel=1e-12) for s in shares}
    assert [r["value"] for r in percentiles.exact_percentiles(df.limit(0), F.col("l_tax"), [0.5]).collect()] == [None]
    with pytest.raises(ValueError, match="ranks"):
        percentiles.order_statistics(df, F.col("l_tax"), [10**9])
