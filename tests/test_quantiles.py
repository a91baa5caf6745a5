import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from microatlas.operators.quantiles import exact_medians, exact_quantiles, from_bits, order_bits

QS = [0.0, 0.01, 0.33, 0.5, 0.66, 0.99, 1.0]


def shapes():
    rng = random.Random(7)
    yield "uniform", [rng.random() for _ in range(3000)]
    yield "heavy value", [5.0] * 2000 + [rng.gauss(0, 1e6) for _ in range(1500)]
    yield "outlier", [rng.random() for _ in range(1500)] + [1e300, -1e300]
    yield "two values", [0.0, 1.0] * 500
    yield "close", [1.0 + i * 2.0**-52 for i in range(600)]
    yield "one", [3.25]


@pytest.mark.parametrize("name,values", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_quantiles_are_exact(spark, name, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "x double").repartition(3)
    found = exact_quantiles(df, {"x": QS})["x"]
    assert np.allclose(found, np.quantile(values, QS), rtol=1e-12)


def test_nan_is_missing_and_infinities_are_ends(spark):
    values = [float(i) / 7 for i in range(1000)]
    df = spark.createDataFrame([(v, v) for v in values] + [(math.nan, -math.inf), (None, math.inf)], "x double, y double")
    found = exact_quantiles(df, {"x": QS, "y": [0.0, 0.5, 1.0]})
    assert np.allclose(found["x"], np.quantile(values, QS), rtol=1e-12)
    assert found["y"] == [-math.inf, np.quantile(values, 0.5), math.inf]
    assert exact_medians(df.filter("x is null or isnan(x)"), ["x"]) == {"x": None}


def test_answers_do_not_change_with_the_layout(spark):
    df = spark.range(5000).selectExpr("(id * 7919 % 5003) / 7 as x")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        many = exact_quantiles(df, {"x": QS})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert many == exact_quantiles(df, {"x": QS})


def test_weights_stand_for_equal_rows(spark):
    rows = [(1.0, 5), (2.0, 1), (9.0, 4), (None, 3)]
    df = spark.createDataFrame(rows, "x double, n bigint")
    flat = [x for x, n in rows if x is not None for _ in range(n)]
    assert exact_quantiles(df, {"x": QS}, "n")["x"] == pytest.approx(list(np.quantile(flat, QS)))


def test_median_takes_the_middle_of_two(spark):
    df = spark.createDataFrame([(1, None), (2, None), (4, None), (9, None)], "a int, b int")
    assert exact_medians(df, ["a", "b"]) == {"a": 3.0, "b": None}


def test_order_bits_are_the_bits_of_the_value(spark):
    import struct

    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, -1.0, 2.0**-1022, 2.0**-1074, 2.0**-1023, -(2.0**-1060) * 3, 1.7976931348623157e308, math.inf, -math.inf, math.nextafter(2.0**-1022, 0)]
    values += [s * math.nextafter(2.0**e, d) for e in range(-1074, 1024, 7) for d in (0, math.inf) for s in (1, -1)] + [2.0**e for e in range(-1074, 1024)]
    values += [struct.unpack("<d", struct.pack("<q", rng.getrandbits(63)))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", order_bits(F.col("x")).alias("b"))
    for x, b in df.collect():
        own = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert b == (-own if x < 0 else own) and from_bits(b) == x


def test_passes_are_as_many_at_any_size(spark):
    context = spark.sparkContext
    stages = []
    for n in (2000, 200_000):
        df = spark.range(n).selectExpr("rand(5) * 1e9 - 5e8 as x", "cast(id as double) as y")
        context.setJobGroup(f"quantiles {n}", "quantiles")
        try:
            found = exact_quantiles(df, {"x": [0.5], "y": QS})
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        assert np.allclose(found["y"], np.quantile(np.arange(float(n)), QS))
        stages.append(len(context.statusTracker().getJobIdsForGroup(f"quantiles {n}")))
    assert stages[1] <= stages[0] + 2


def test_quantiles_of_negative_and_tiny_values(spark):
    values = [-(2.0**-1074) * i for i in range(50)] + [-float(i) for i in range(50)] + [-math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, {"x": [0.0, 0.3, 1.0]})["x"] == pytest.approx([-math.inf, np.quantile(values[:-1] + [-1e308], 0.3), 0.0])
    assert exact_quantiles(df, {"x": []}) == {"x": []} and exact_quantiles(df.limit(0), {"x": [0.5]}) == {"x": [None]}


def test_what_makes_the_values_is_done_once(spark):
    """Four passes over a join joined four times and took the bits anew for every use of them."""
    from pyspark.sql.types import DoubleType

    made = spark.sparkContext.accumulator(0)

    def half(x):
        made.add(1)
        return x / 2

    df = spark.range(1000).select(F.udf(half, DoubleType())(F.col("id")).alias("x"))
    assert exact_medians(df, ["x"]) == {"x": 249.75}
    assert made.value == 1000


def test_a_prefix_is_a_range_of_values():
    from microatlas.operators.quantiles import value_range

    rng, of = random.Random(9), lambda x: int.from_bytes(np.float64(abs(x)).tobytes(), "little") * (-1 if x < 0 else 1)
    values = [0.0, -0.0, 5e-324, -5e-324, 1.0, -1.0, math.inf, -math.inf, 1.7976931348623157e308] + [rng.choice((-1, 1)) * 2.0 ** rng.uniform(-1074, 1023) for _ in range(500)]
    for shift in (48, 32, 16):
        for x in values:
            low, high = value_range(of(x) >> shift, shift)
            assert low <= x <= high
            assert all(of(y) >> shift != of(x) >> shift for y in (math.nextafter(low, -math.inf), math.nextafter(high, math.inf)) if not low <= y <= high)


def test_scratch_of_the_passes_is_deleted(spark):
    import os

    from microatlas.runtime import scratch_path

    folder = os.path.dirname(scratch_path(spark, "x"))
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    exact_medians(spark.range(10).selectExpr("id * 1.5 as x"), ["x"])
    assert set(os.listdir(folder)) == before
