"""One-pass least squares against plain solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photospark.operators import baselines as B
from photospark.operators import linear as L

rng = np.random.default_rng(3)
X = rng.normal(size=(400, 5)) * [1, 100, 0.01, 5, 1] + [0, 1e4, 3, -2, 0]
Y = np.stack([X @ [0.1, 0.001, 2, 0.02, 0] - 16, rng.normal(size=400)], axis=1)
X[:, 4] = 2 * X[:, 0] - 0.05 * X[:, 3]  # depends on two others
NAMES, TARGETS = [f"x{i}" for i in range(5)], ("s", "t")


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, "train" if i % 4 else "val", *map(float, X[i]), *map(float, Y[i]), 7.0) for i in range(400)]
    return spark.createDataFrame(rows, "photo long, split string, " + ", ".join(f"{c} double" for c in [*NAMES, *TARGETS, "still"])).repartition(7)


def test_moments_equal_plain_ones(table):
    found = L.moments(table, [*NAMES, *TARGETS])[0]
    z = np.concatenate([X, Y], axis=1)
    assert found.n == 400 and np.allclose(found.mean, z.mean(axis=0))
    assert np.allclose(found.m, (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)))


@pytest.mark.parametrize("used", [NAMES[:4], NAMES, ["x0", "still", "x1"]])
def test_fit_equals_least_squares(table, used):
    coef = L.solve(L.moments(table, [*used, *TARGETS])[0], len(used))
    a = np.array(table.orderBy("photo").select(*used).collect())
    centred = (a - a.mean(axis=0)) / np.where(a.std(axis=0) > 1e-9, a.std(axis=0), 1)
    plain = centred @ np.linalg.lstsq(centred, Y - Y.mean(axis=0), rcond=1e-8)[0] + Y.mean(axis=0)
    assert np.allclose(a @ coef[:-1] + coef[-1], plain, atol=1e-6)
    if "still" in used:
        assert coef[used.index("still")].tolist() == [0, 0]


def test_penalty_and_no_intercept(table):
    found = L.moments(table, [*NAMES[:4], *TARGETS])[0]
    a = X[:, :4]
    s = (a - a.mean(axis=0)) / a.std(axis=0)
    ridge = np.linalg.solve(s.T @ s / 400 + 0.3 * np.eye(4), s.T @ (Y - Y.mean(axis=0)) / 400) / a.std(axis=0)[:, None]
    assert np.allclose(L.solve(found, 4, 0.3)[:-1], ridge)
    through = L.solve(found, 4, intercept=False)
    assert np.allclose(a @ through[:-1], a @ np.linalg.lstsq(a, Y, rcond=None)[0], atol=1e-5) and (through[-1] == 0).all()


def test_resamples_weigh_rows(spark, table):
    picks = [r["n"] for r in spark.range(20_000).select(L.poisson_picks(7, "id").alias("n")).collect()]
    assert abs(np.mean(picks) - 1) < 0.03 and abs(np.var(picks) - 1) < 0.05
    found = L.moments(table, ["x0", "s"], [F.lit(1), L.poisson_picks(7, "photo")])
    w = dict(table.select("photo", L.poisson_picks(7, "photo")).collect())
    w = np.array([w[i] for i in range(400)])
    assert found[1].n == w.sum() and np.allclose(found[1].mean, [np.average(X[:, 0], weights=w), np.average(Y[:, 0], weights=w)])


def test_odd_tables(spark, table):
    with pytest.raises(ValueError, match="no rows"):
        L.moments(table.where("false"), ["x0", "s"])
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(Exception, match="lacks a feature"):
            L.moments(table.withColumn("x0", F.when(F.col("photo") == 5, bad).otherwise(F.col("x0"))), ["x0", "s"])
    with pytest.raises(ValueError, match="iterative"):
        L.moments(table, ["x0"] * 2_001)
    assert B.linear_baseline(table.where("split = 'train'"), NAMES[:2], TARGETS).count() == 0


def test_grid_is_screened_then_run_on_seeds(table):
    rows = B.grid_screen(table, NAMES[:4], TARGETS, [0.0, 0.5, 5.0], (1, 2, 3)).collect()
    screen = {r["reg"]: r["score"] for r in rows if r["stage"] == "screen"}
    reruns = [r for r in rows if r["stage"] == "rerun"]
    best = min(screen, key=screen.get)
    assert len(screen) == 3 and {r["seed"] for r in reruns} == {1, 2, 3} and {r["reg"] for r in reruns} == {best}
    one = B.linear_baseline(table, NAMES[:4], TARGETS, reg=0.5).where("split = 'val'").agg(F.avg(F.abs(F.col("pred") - F.col("truth")))).first()[0]
    assert np.isclose(one, screen[0.5])
