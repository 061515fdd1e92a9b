import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import conformal, learner


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(1)
    test = [(i, round(r.gauss(0, 1), 1)) for i in range(120)]  # rounded, so that ties occur
    cal = [(int(r.random() < 0.4), round(r.gauss(-0.5, 1), 1)) for _ in range(90)]
    return spark.createDataFrame(test, "row_key long, margin double"), spark.createDataFrame(cal, "label int, alpha double")


def brute(test, cal):
    out, known = {}, [tuple(r) for r in cal.collect()]
    for k, m in map(tuple, test.collect()):
        p = []
        for c in (0, 1):
            alphas = [a for label, a in known if label == c]
            own = -m if c == 1 else m
            p.append((sum(a >= own for a in alphas) + 1) / (len(alphas) + 1))
        out[k] = tuple(p)
    return out


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_p_values(tables, bound):
    test, cal = tables
    got = conformal.with_p_values(test, cal, max_calibration_rows=bound)
    assert {r.row_key: (r.p0, r.p1) for r in got.collect()} == brute(test, cal)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_copies_null_keys_and_unknown_margins(spark, tables, bound):
    rows = [(1, 0.5), (1, 0.5), (1, -0.5), (None, 0.1), (2, None), (3, float("nan"))]
    test = spark.createDataFrame(rows, "row_key long, margin double")
    got = conformal.with_p_values(test, tables[1], max_calibration_rows=bound).collect()
    known = brute(spark.createDataFrame([(i, m) for i, m in enumerate((0.5, 0.5, -0.5, 0.1))], "row_key long, margin double"), tables[1])
    want = [(k, *known[i]) for i, (k, _) in enumerate(rows[:4])] + [(2, None, None), (3, None, None)]
    assert sorted(((r.row_key, r.p0, r.p1) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_class_without_calibration_is_never_rejected(tables, bound):
    test, cal = tables
    got = conformal.with_p_values(test, cal.filter("label = 0"), max_calibration_rows=bound)
    assert {r.p1 for r in got.collect()} == {1.0}


def test_sets_grow_as_significance_falls(tables):
    p = conformal.with_p_values(*tables).cache()
    sets = {e: {r.row_key: set(r.pred_set) for r in conformal.with_predictions(p, e).collect()} for e in (0.05, 0.2, 0.5)}
    assert all(sets[0.5][k] <= sets[0.2][k] <= sets[0.05][k] for k in sets[0.5])
    names = {(): "UNKNOWN", (0,): "BAD", (1,): "GOOD", (0, 1): "UNKNOWN"}
    out = conformal.with_predictions(p, 0.5).collect()
    assert all(r.verdict == names[tuple(r.pred_set)] for r in out)
    row = conformal.efficiency(conformal.with_predictions(p, 0.5)).first()
    assert (row.singletons, row.total) == (sum(len(r.pred_set) == 1 for r in out), 120)
    with pytest.raises(ValueError):
        conformal.prediction_set(1.2)


def test_error_rate_on_exchangeable_rows(spark):
    r = random.Random(3)
    draw = lambda n: [(i, int(i % 2), r.gauss(1 if i % 2 else -1, 1)) for i in range(n)]
    test = spark.createDataFrame(draw(4000), "row_key long, label int, margin double")
    cal = conformal.calibration_table(spark.createDataFrame(draw(2000), "row_key long, label int, margin double"), F.col("margin"))
    out = conformal.with_predictions(conformal.with_p_values(test, cal), 0.2)
    missed = out.filter(~F.array_contains("pred_set", F.col("label"))).count() / 4000
    assert 0.17 < missed < 0.23


def test_efficiency_of_nothing(spark):
    empty = spark.createDataFrame([], "pred_set array<int>")
    assert conformal.efficiency(empty).first().efficiency is None


def test_margins_and_p_values_share_a_worker(spark):
    """One evaluation in Python for both steps, so that a task has one worker and not two."""
    rows = spark.createDataFrame([(1, (2, [0, 1], [1.0, 2.0])), (2, None)], "row_key long, features struct<size:bigint,ids:array<bigint>,vals:array<double>>")
    model = learner.LinearModel.dense(spark, [1.0, -1.0], 0.5)
    known = conformal.Calibration.of(spark.createDataFrame([(0, 0.0), (0, -2.0), (1, 0.5)], "label int, alpha double"))
    out = conformal.with_p_values(model.with_margin(rows), known).select("row_key", "p0", "p1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {tuple(r) for r in out.collect()} == {(1, 2 / 3, 1.0), (2, None, None)}
