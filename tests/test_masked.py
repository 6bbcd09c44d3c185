import math

import pytest
from pyspark.sql import functions as F

from rillflow.functions import masked as M


def one(spark, column, **arrays):
    df = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} array<{'int' if k == 'm' or isinstance(v[0], (int, bool)) and not isinstance(v[0], bool) else 'boolean' if isinstance(v[0], bool) else 'double'}>" for k, v in arrays.items()))
    return df.select(column.alias("x")).first()["x"]


def test_nan_under_the_mask_never_counts(spark):
    assert one(spark, M.masked_sum("v", "m"), v=[1.0, float("nan"), 3.0], m=[1, 0, 1]) == 4.0
    assert one(spark, M.masked_mean("v", "m"), v=[1.0, float("nan"), 3.0], m=[1, 0, 1]) == pytest.approx(2.0)


def test_clip_keeps_nan(spark):
    got = spark.createDataFrame([(5.0,), (-5.0,), (float("nan"),)], "x double").select(M.clip("x", -1, 1)).collect()
    assert [r[0] for r in got[:2]] == [1.0, -1.0] and math.isnan(got[2][0])


def test_gae_passes_masked_tokens(spark):
    got = one(spark, M.gae("r", "v", "m", 0.9, 0.95), r=[0.0, 0.1, 1.0], v=[0.5, 0.4, 0.3], m=[1, 0, 1])
    assert got == pytest.approx([0.3685, 0.7, 0.7])


def test_gae_ignores_values_under_the_mask(spark):
    m = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    r = [0.0, 0.0, 0.1, 0.1, 0.1, 0.0, 0.0, 0.1, 1.0, 0.0, 0.0]
    a = [0.2 * i for i in range(11)]
    b = [x if k else 99.0 for x, k in zip(a, m)]
    x, y = (one(spark, M.gae("r", "v", "m", 0.9, 0.9), r=r, v=v, m=m) for v in (a, b))
    assert [p for p, k in zip(x, m) if k] == pytest.approx([p for p, k in zip(y, m) if k])


def test_discounted_returns_are_cut_by_the_mask(spark):
    got = one(spark, M.discounted_returns("r", "m", 0.5), r=[1.0, 1.0, 1.0], m=[1, 0, 1])
    assert got == pytest.approx([1.0, 1.5, 1.0])


def test_response_mask(spark):
    assert one(spark, M.response_mask("t", 9), t=[1, 9, 3, 9]) == [1, 1, 0, 0]
    assert one(spark, M.response_mask("t", [3, 9]), t=[1, 3, 9]) == [1, 1, 0]
    assert one(spark, M.response_mask("t", 9), t=[1, 2]) == [1, 1]


def test_truncation_sides(spark):
    t = [1, 2, 3, 4, 5]
    assert one(spark, M.truncate("t", 3, "left"), t=t) == [3, 4, 5]
    assert one(spark, M.truncate("t", 3, "right"), t=t) == [1, 2, 3]
    assert one(spark, M.truncate("t", 3, "middle"), t=t) == [1, 4, 5]
    with pytest.raises(Exception, match="longer than 3"):
        one(spark, M.truncate(F.col("t").cast("array<bigint>"), 3), t=t)
    with pytest.raises(ValueError):
        M.truncate("t", 3, "up")


def test_place_last_and_completion(spark):
    assert one(spark, M.place_last(F.lit(2.0), "m"), m=[1, 1, 0]) == [0.0, 2.0, 0.0]
    assert one(spark, M.place_last(F.lit(2.0), "m"), m=[0, 0]) == [0.0, 0.0]
    assert one(spark, M.completion_mask("c", 2), c=[False, True, False]) == [1, 1, 1, 1, 0, 0]
    assert one(spark, M.completion_mask("c"), c=[False, False]) == [1, 1]


def test_whitening_needs_two_tokens(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0)], "v double, mask int")
    with pytest.raises(Exception, match="fewer than two"):
        M.whiten(df, "v").collect()
    df = spark.createDataFrame([(1.0, 1), (3.0, 1), (9.0, 0)], "v double, mask int")
    assert [r["v"] for r in M.whiten(df, "v").collect()] == pytest.approx([-(0.5**0.5), 0.5**0.5, 7 / 2**0.5], abs=1e-6)
    assert [r["v"] for r in M.whiten(df, "v", shift_mean=False).collect()] == pytest.approx([2 - 0.5**0.5, 2 + 0.5**0.5, 2 + 7 / 2**0.5], abs=1e-6)


def test_pad_and_unpad(spark):
    assert one(spark, M.pad("t", 4, 0, left=True), t=[1, 2]) == [0, 0, 1, 2]
    assert one(spark, M.pad("t", 1, 0), t=[1, 2]) == [1, 2]
    assert one(spark, M.unpad("t", "m"), t=[1, 2, 3], m=[0, 1, 1]) == [2, 3]


def test_long_and_array_forms_are_inverse(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [1, 0]), (2, [3.0], [1])], "k long, v array<double>, mask array<int>")
    back = M.to_arrays(M.to_long(df, ["k"], ["v", "mask"]), ["k"], ["v", "mask"])
    assert sorted(back.collect()) == sorted(df.collect())
