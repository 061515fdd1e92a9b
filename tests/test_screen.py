import os

import pytest
from pyspark.sql import functions as F

from gleaner.functions.hashing import HASH_SPAN
from gleaner.functions.vectors import from_dense
from gleaner.operators import conformal
from gleaner.operators.learner import LinearSVM
from gleaner.operators.scorers import table_scorer
from gleaner.operators.topn import top_n
from gleaner.plans.screen import ScreenParams, _Loop, screen
from gleaner.session import Workspace

N = 600
LEARNER = LinearSVM(max_iter=10)


@pytest.fixture(scope="module")
def data(spark):
    """Two features; the score is a linear function of them, so it can be learned."""
    df = spark.range(N).selectExpr("CAST(id AS string) AS row_key", "concat('m', id % 150) AS mol_id", "sin(id * 1.7) * 6 AS a", "cos(id * 2.3) * 6 AS b")
    rows = df.withColumn("score", F.col("a") * 2 - F.col("b")).withColumn("features", from_dense(F.array("a", "b"))).cache()
    return rows.select("row_key", "mol_id", "features"), rows.select("row_key", "score")


@pytest.fixture(scope="module")
def result(data):
    candidates, scores = data
    return screen(candidates, table_scorer(scores), ScreenParams(bad_bin=4, good_bin=6), LEARNER)


def test_finds_the_best_with_fewer_scores(data, result):
    candidates, scores = data
    assert result.stop_reason == "converged"
    assert result.scored.count() < N * 0.8
    full = candidates.join(scores, "row_key")
    best = {r.mol_id for r in top_n(full, 20).collect()}
    assert len(best & {r.mol_id for r in top_n(result.scored, 20).collect()}) >= 18


def test_no_row_is_scored_twice_and_all_are_predicted(result):
    assert result.scored.count() == result.scored.select("row_key").distinct().count()
    assert result.predictions.count() == N
    assert result.predictions.filter((F.col("p0") <= 0) | (F.col("p1") > 1)).count() == 0
    assert all(c.efficiency >= 0.8 for c in result.cycles[-2:])


def test_dropped_rows_are_not_sampled_later(data, result):
    last, (candidates, _), dropped_ever = len(result.cycles), data, 0
    assert [cycle for cycle, _, _ in result.history] == [c.cycle for c in result.cycles if c.trained]
    for k, model, calibration in result.history:
        predicted = conformal.with_predictions(conformal.with_p_values(model.with_margin(candidates), calibration), 0.2)
        dropped = predicted.filter("verdict = 'BAD'").select("row_key").cache()
        dropped_ever += dropped.count()
        for later in range(k + 1, last + 1):
            assert result.workspace.read(f"scored/cycle={later}").join(dropped, "row_key").count() == 0
    assert dropped_ever > 0


def test_only_the_last_predictions_are_kept(result):
    kept = sorted(os.listdir(result.workspace.path))
    assert kept == ["calibration", "predictions", "scored"]
    assert {r.cycle for r in result.predictions.select("cycle").distinct().collect()} == {result.history[-1][0]}


def test_a_window_opens_the_files_of_its_range_only(spark, data):
    candidates, scores = data
    loop = _Loop(candidates, table_scorer(scores), ScreenParams(), LEARNER, Workspace(spark, "files"), [])
    files = lambda df: {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}
    every = files(loop.pool)
    window = loop._window(HASH_SPAN // 4, HASH_SPAN // 4 + HASH_SPAN // 128)
    assert 0 < len(files(window)) <= 4 < len(every) // 20
    assert "PartitionFilters: [isnotnull(part" in window._jdf.queryExecution().executedPlan().toString()
    assert window.count() == loop.pool.filter((F.col("u") > HASH_SPAN // 4) & (F.col("u") <= HASH_SPAN // 4 + HASH_SPAN // 128)).count()
    assert loop._window(-1, HASH_SPAN - 1).count() == N


def test_same_input_gives_the_same_result(data, result):
    candidates, scores = data
    shuffled = candidates.repartition(5).orderBy(F.desc("row_key"))
    again = screen(shuffled, table_scorer(scores), ScreenParams(bad_bin=4, good_bin=6), LEARNER)
    pick = lambda r: sorted((x.row_key, x.cycle) for x in r.scored.select("row_key", "cycle").collect())
    assert pick(again) == pick(result)


def test_single_cycle_with_failures_and_payload(data):
    candidates, scores = data
    known = scores.filter(F.col("row_key") % 5 != 0)  # a fifth of all rows cannot be scored

    def scorer(batch):
        assert "note" in batch.columns
        return table_scorer(known)(batch)

    params = ScreenParams(bad_bin=4, good_bin=6, single_cycle=True, stratified=True, edges="cumulative")
    out = screen(candidates.withColumn("note", F.lit("x")), scorer, params, LEARNER, scorer_columns=["note"])
    assert out.stop_reason == "single cycle" and len(out.cycles) == 1
    assert out.scored.filter("cycle = 1").count() == 100
    failed = out.scored.filter("score IS NULL")
    assert failed.count() > 0 and failed.filter(F.col("row_key") % 5 != 0).count() == 0


def test_pool_runs_out(spark, data):
    candidates, _ = data
    few = candidates.filter(F.col("row_key") < 30)
    flat = few.select("row_key", F.lit(1.0).alias("score"))  # equal scores: nothing can be labelled
    out = screen(few, table_scorer(flat), ScreenParams(initial_size=20, increment_size=20))
    assert out.stop_reason == "pool empty" and out.predictions is None and out.model is None
    assert [c.sampled for c in out.cycles] == [20, 10] and out.scored.count() == 30
    none = screen(few.limit(0), table_scorer(flat))
    assert none.stop_reason == "pool empty" and none.scored.count() == 0


def test_copies_are_scored_once_and_counted_in_full(data):
    candidates, scores = data
    hot = candidates.filter("row_key = '7'").crossJoin(candidates.sparkSession.range(300)).drop("id")
    out = screen(candidates.unionByName(hot), table_scorer(scores), ScreenParams(bad_bin=4, good_bin=6, single_cycle=True), LEARNER)
    assert out.predictions.count() == N
    assert out.predictions.agg(F.sum("copies")).first()[0] == N + 300
    assert out.scored.groupBy("row_key").count().filter("count > 1").count() == 0


def test_parameters_are_checked():
    for wrong in ({"bad_bin": 5, "good_bin": 4}, {"edges": "other"}, {"initial_size": 0}):
        with pytest.raises(ValueError):
            ScreenParams(**wrong)
