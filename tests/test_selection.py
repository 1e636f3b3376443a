"""Quantiles by selection against numpy."""

import numpy as np
import pytest

from catalogweave.operators import selection
from catalogweave.operators.profile import exact_quantiles
from catalogweave.operators.selection import selected_quantiles

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
random = np.random.default_rng(11)
COLUMNS = {
    "plain": random.normal(size=4000) * 1000,
    "whole": random.integers(-50, 50, 4000).astype(float),
    "one": np.full(300, 7.25),
    "pair": np.array([1.0, 2.0]),
    "single": np.array([-3.5]),
    "spread": np.ldexp(random.normal(size=3000), random.integers(-1000, 900, 3000)),
    "tiny": 5e-324 * random.integers(-9, 9, 500),
    "close": 1.0 + 2.0**-52 * random.integers(0, 400, 900),
    "hot": np.concatenate([np.zeros(3000), random.normal(size=1000)]),
}


@pytest.mark.parametrize("bins", [selection.BINS, 4])
def test_quantiles_equal_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    data = [(c, float(x), 1) for c, values in COLUMNS.items() for x in values] + [("plain", None, 1), ("none", None, 1)]
    rows = spark.createDataFrame(data, "column string, value double, n int").repartition(5)
    got = {(r["column"], r["share"]): r["value"] for r in selected_quantiles(rows, SHARES).collect()}
    assert set(got) == {(c, s) for c in COLUMNS for s in SHARES}
    for (c, s), value in got.items():
        assert value == pytest.approx(np.quantile(COLUMNS[c], s), rel=1e-12, abs=1e-300), (c, s)


def test_weights_infinities_and_nan(spark):
    rows = [("a", 1.0, 3), ("a", 5.0, 1), ("a", 1.0, 2), ("b", float("inf"), 1), ("b", float("-inf"), 1), ("b", 0.0, 1), ("b", float("nan"), 1)]
    frame = spark.createDataFrame(rows, "column string, value double, n int")
    got = {(r["column"], r["share"]): r["value"] for r in selected_quantiles(frame, (0.0, 1 / 3, 2 / 3, 0.8, 1.0)).collect()}
    assert [got["a", s] for s in (0.0, 0.8, 1.0)] == [1.0, 1.0, 5.0]
    assert [got["b", s] for s in (0.0, 1 / 3, 2 / 3)] == [float("-inf"), 0.0, float("inf")] and np.isnan(got["b", 1.0])


def test_no_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], "a int, b double")
    assert exact_quantiles(empty, ["a", "b"]).count() == 0
    frame = spark.range(100).selectExpr("id as a", "cast(id as double) as column", "'x' as value")
    assert {(r["column"], r["share"], r["value"]) for r in exact_quantiles(frame, ["a", "column"], (0.5,)).collect()} == {
        ("a", 0.5, 49.5),
        ("column", 0.5, 49.5),
    }
