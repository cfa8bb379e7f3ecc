import numpy as np
import pytest

from tessella.operators import tensors

SCHEMA = "k int, m array<double>"


def frame(spark, arrays, parts=4):
    rows = [(i % 2, a.ravel().tolist() if a is not None else None) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("axis", [None, 0, 1, (0, 2)])
@pytest.mark.parametrize("ddof", [0.0, 1.0])
def test_equals_numpy(spark, axis, ddof):
    x = np.random.default_rng(42).uniform(size=(10, 4, 5))
    got = tensors.tensor_aggregate(frame(spark, list(x)), "m", (4, 5), axis, ddof).first()
    reduced = (0, axis) if isinstance(axis, int) and axis else axis
    assert np.allclose(got["mean(m)"], x.mean(axis=reduced).ravel(), rtol=1e-6, atol=1e-8)
    assert np.allclose(got["std(m)"], x.std(axis=reduced, ddof=ddof).ravel(), rtol=1e-6, atol=1e-8)


def test_nulls(spark):
    df = frame(spark, [np.array([1.0, 2.0]), None, np.array([3.0, 4.0])])
    assert tensors.tensor_aggregate(df, "m", (2,), 0).first()["mean(m)"] == [2.0, 3.0]
    with pytest.raises(Exception, match="contains null values"):
        tensors.tensor_aggregate(df, "m", (2,), 0, ignore_nulls=False).collect()


def test_empty_single_and_ragged(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = tensors.tensor_aggregate(empty, "m", (2,)).first()
    assert np.isnan(row["mean(m)"]) and np.isnan(row["std(m)"])
    assert np.isnan(tensors.tensor_aggregate(empty, "m", (2,), 0).first()["mean(m)"]).all()
    one = frame(spark, [np.array([5.0, 6.0])])
    assert np.isnan(tensors.tensor_aggregate(one, "m", (2,), 0).first()["std(m)"]).all()
    assert tensors.tensor_aggregate(one, "m", (2,), 0, 0.0).first()["std(m)"] == [0.0, 0.0]
    with pytest.raises(Exception, match="shape"):
        tensors.tensor_aggregate(one, "m", (3,)).collect()


def test_large_offset_is_stable(spark):
    x = 1e9 + np.array([1, 2, 1, 2, 3, 4, 3, 4.0])
    df = frame(spark, [np.array([v]) for v in x])
    got = tensors.tensor_aggregate(df, "m", (1,)).first()["std(m)"]
    assert np.isclose(got, x.std(ddof=1), rtol=1e-6)


def test_groups_and_axis_rules(spark):
    x = np.arange(12.0).reshape(4, 3)
    rows = {r["k"]: r["mean(m)"] for r in tensors.tensor_aggregate(frame(spark, list(x)), "m", (3,), 0, by=["k"]).collect()}
    assert rows[0] == x[::2].mean(axis=0).tolist() and rows[1] == x[1::2].mean(axis=0).tolist()
    with pytest.raises(ValueError, match="axis must include 0"):
        tensors.kept_axes((4, 5), (1, 2))
    with pytest.raises(ValueError, match="out of range"):
        tensors.kept_axes((4, 5), 3)
