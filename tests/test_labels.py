import pytest

from gleaner.operators import labels


def scored(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_key int, score double")


def test_histogram(spark):
    out = labels.score_histogram(scored(spark, [0.0, 1.0, 9.5, 10.0, None, float("nan")])).orderBy("bin").collect()
    assert [r.n for r in out] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2]
    assert out[0].low == 0.0 and out[9].high == 10.0 and out[3].high == 4.0


def test_histogram_of_equal_or_no_scores(spark):
    (row,) = labels.score_histogram(scored(spark, [2.0, 2.0])).collect()
    assert (row.bin, row.low, row.high, row.n) == (0, 2.0, 2.0, 2)
    assert labels.score_histogram(scored(spark, [None])).collect() == []


def test_label_extremes(spark):
    df = scored(spark, [0.0, 1.0, 1.01, 3.9, 4.0, 10.0, None])
    got = {r.row_key: r.label for r in labels.label_extremes(df, 1, 4).collect()}
    assert got == {0: 0.0, 1: 0.0, 4: 1.0, 5: 1.0}
    shared = {r.row_key: r.label for r in labels.label_extremes(df, 4, 4).collect()}
    assert shared[4] == 0.0  # a shared edge is poor
    assert labels.label_extremes(scored(spark, [3.0, 3.0]), 1, 4).count() == 0


def test_edges_from_another_table(spark):
    got = labels.label_extremes(scored(spark, [5.0, 6.0]), 1, 9, edges_from=scored(spark, [0.0, 60.0]))
    assert [(r.row_key, r.label) for r in got.collect()] == [(0, 0.0), (1, 0.0)]


def test_bin_order_is_checked():
    with pytest.raises(ValueError):
        labels.check_bins(5, 4)
