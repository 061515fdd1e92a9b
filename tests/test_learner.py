import math
import random

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from gleaner.functions.vectors import append_constant, dot, from_dense, parse_vector, sparse, to_ml_vector, vector_text
from gleaner.operators import learner, spread_fit
from gleaner.operators.learner import Known, LinearModel, LinearSVM, Logistic


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    rows = []
    for i in range(200):
        x = [r.gauss(0, 4) for _ in range(5)]
        rows.append((i, x, 1.0 if x[0] - 2 * x[1] + 3 > 0 else 0.0))
    df = spark.createDataFrame(rows, "row_key long, x array<double>, label double")
    return df.select("row_key", "label", from_dense(F.col("x")).alias("features")).cache()


@pytest.mark.parametrize("learner", [LinearSVM(), LinearSVM(bias="free"), Logistic()])
def test_separable_rows(labelled, learner):
    model = learner.fit(labelled)
    out = model.with_margin(labelled)
    right = out.filter((F.col("margin") > 0) == (F.col("label") == 1.0)).count()
    assert right >= 170 and model.weights.count() == 5 and out.columns == [*labelled.columns, "margin"]


def test_one_class_is_refused(labelled):
    with pytest.raises(ValueError):
        LinearSVM().fit(labelled.filter("label = 1"))


def test_margin_of_sparse_rows(spark):
    df = spark.createDataFrame([("(4,[1,3],[2.0,0.5])",), ("(4,[],[])",), ("bad",)], "t string").select(parse_vector(F.col("t")).alias("features"))
    model = LinearModel.dense(spark, [1.0, 10.0, 100.0, 1000.0], 0.5)
    for bound in (10, 0):
        out = model.with_margin(df.withColumn("place", F.monotonically_increasing_id()), max_weights=bound).collect()
        assert {r.place: r.margin for r in out}.values() and sorted((r.place, r.margin) for r in out)[0][1] == 520.5
        assert [r.margin for r in sorted(out, key=lambda r: r.place)] == [520.5, 0.5, None]


def wide(features, factor):
    """The same rows with their ids spread over a space ``factor`` times as wide."""
    return sparse(features["size"] * factor, F.transform(features["ids"], lambda i: i * factor + 7), features["vals"])


@pytest.mark.parametrize("learner", [LinearSVM(), LinearSVM(bias="free"), Logistic()])
def test_the_width_of_the_space_changes_nothing(labelled, learner):
    """Ten million times as wide; a dense fit would hold fifty million weights."""
    narrow = learner.fit(labelled)
    there = labelled.withColumn("features", wide(F.col("features"), 10_000_000))
    model = learner.fit(there)
    assert sorted(r.sig_id for r in model.weights.collect()) == [i * 10_000_000 + 7 for i in range(5)]
    a = {r.row_key: r.margin for r in narrow.with_margin(labelled).collect()}
    b = {r.row_key: r.margin for r in model.with_margin(there).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_fit_equals_the_dense_fit(labelled):
    """The weights of a fit over the whole space, which has places that no row holds."""
    from pyspark.ml.classification import LinearSVC

    padded = labelled.withColumn("features", sparse(F.lit(40), F.transform("features.ids", lambda i: i * 7), F.col("features.vals")))
    table = padded.select("label", to_ml_vector(append_constant(F.col("features"))).alias("x")).coalesce(1)
    dense = LinearSVC(featuresCol="x", labelCol="label", maxIter=50, regParam=0.1, tol=1e-4, standardization=False, fitIntercept=False).fit(table)
    weights = dense.coefficients.toArray()
    model = LinearSVM().fit(padded)
    found = {r.sig_id: r.weight for r in model.weights.collect()}
    assert {i for i, w in enumerate(weights[:-1]) if w != 0} == set(found)
    assert max(abs(weights[i] - w) for i, w in found.items()) < 1e-6 and abs(weights[-1] - model.intercept) < 1e-6


def test_margins_by_shuffle_equal_those_by_look_up(spark, monkeypatch):
    monkeypatch.setattr(learner, "_HOT_SAMPLE", 0.5)
    monkeypatch.setattr(learner, "_HOT_IDS", 3)
    r = random.Random(2)
    rows = [(i, sorted(r.sample(range(60), r.randrange(12)) + [100]), "x") for i in range(300)]
    rows += [(i, rows[3][1], "copy") for i in range(1000, 1200)] + [(i, [], "empty") for i in range(2000, 2200)] + [(3000, None, "null"), (3, [5], "same key")]
    df = spark.createDataFrame(rows, "row_key long, ids array<long>, margin_of string")
    vals = F.transform("ids", lambda i: (i % 7 + 1).cast("double"))
    df = df.withColumn("features", F.when(F.col("ids").isNotNull(), sparse(F.lit(200), F.col("ids"), vals)))
    weights = [r.uniform(-1, 1) if i % 3 else 0.0 for i in range(90)]
    model = LinearModel.dense(spark, weights, 0.25)
    a, b = (model.with_margin(df, max_weights=bound) for bound in (1000, 0))
    assert a.columns == b.columns
    key = lambda x: (x.row_key, x.margin_of)
    a, b = ({key(x): x.margin for x in out.collect()} for out in (a, b))
    assert len(a) == len(rows) and a.keys() == b.keys() and a[3000, "null"] is None and b[3000, "null"] is None
    assert max(abs(a[k] - b[k]) for k in a if a[k] is not None) < 1e-9
    assert a[2000, "empty"] == b[2000, "empty"] == 0.25


def test_a_model_without_weights(spark, labelled):
    model = LinearModel.dense(spark, [0.0, 0.0], 1.5)
    assert model.weights.count() == 1
    assert {r.margin for r in model.with_margin(labelled).collect()} == {1.5}
    assert Known(model).fit(labelled) is model


def test_vector_forms(spark):
    df = spark.createDataFrame([("(4, [1,3], [2.0,-0.5])",), (None,)], "t string").select(parse_vector(F.col("t")).alias("f"))
    row, missing = df.select(vector_text(F.col("f")).alias("t"), to_ml_vector(F.col("f")).alias("v"), dot(F.col("f"), F.array(F.lit(1.0), F.lit(3.0))).alias("d")).collect()
    assert row.t == "(4,[1,3],[2.0,-0.5])" and row.v.toArray().tolist() == [0.0, 2.0, 0.0, -0.5]
    assert row.d == 6.0  # no weight for id 3
    assert missing.t is None and missing.v is None


def _refused(self, dataset):
    raise AssertionError("more ids than may reach the driver")


@pytest.fixture(scope="module")
def many_ids(spark):
    """Each row has an id of its own among 10,000,000, one that tells the label and one with the same value everywhere; some rows hold none."""
    label = (F.col("id") % 10 >= 5).cast("double")
    ids = F.array((F.col("id") * 997) % 10_000_000, F.lit(12_345_678), F.lit(15_000_000))
    vals = F.array(F.lit(1.0), F.when(label == 1, 10.0).otherwise(-10.0), F.lit(3.0))
    rows = spark.range(5000).select(F.col("id").alias("row_key"), label.alias("label"), sparse(F.lit(20_000_000), ids, vals).alias("features"))
    empty = sparse(F.lit(20_000_000), F.array().cast("array<bigint>"), F.array().cast("array<double>"))
    return rows.unionByName(spark.range(5000, 5004).select(F.col("id").alias("row_key"), (F.col("id") % 2).cast("double").alias("label"), empty.alias("features")))


@pytest.mark.parametrize("chosen", [LinearSVM(), Logistic()])
def test_gradients_of_many_ids_stay_off_the_driver(many_ids, monkeypatch, chosen):
    """Spark's learners bring a number for each id at each evaluation; 400 MB for 100,000 ids."""
    for estimator in (learner.LinearSVC, learner.LogisticRegression):
        monkeypatch.setattr(estimator, "_fit", _refused)
    null = many_ids.limit(1).withColumn("features", F.when(F.col("row_key") < 0, F.col("features")))
    model = chosen.fit(many_ids.unionByName(null))
    out = model.with_margin(many_ids).filter("row_key < 5000")
    assert out.filter((F.col("margin") > 0) != (F.col("label") == 1)).count() == 0
    assert model.weights.filter("sig_id < 0 OR weight = 0").count() == 0


def test_many_ids_need_both_classes(many_ids):
    with pytest.raises(ValueError):
        LinearSVM().fit(many_ids.filter("label = 1"))


@pytest.mark.parametrize("chosen", [LinearSVM(), LinearSVM(bias="free"), Logistic()])
def test_the_spread_fit_is_as_good_as_sparks(spark, monkeypatch, chosen):
    """The same risk, in several blocks of rows and ids, up to what is left when both stop. A smooth loss has the same margins too."""
    r = random.Random(5)
    rows = []
    for key in range(400):
        ids = sorted(r.sample(range(200), r.randrange(1, 12))) + [1000]
        side = sum(i % 5 - 1.7 for i in ids) + r.gauss(0, 3)
        rows.append((key, ids, [1.0 + r.random() * (i % 3) for i in ids[:-1]] + [2.5], float(side > 0)))
    df = spark.createDataFrame(rows, "row_key long, ids array<long>, vals array<double>, label double")
    df = df.select("row_key", "label", sparse(F.lit(2000), F.col("ids"), F.col("vals")).alias("features")).cache()
    dense = chosen.fit(df)
    monkeypatch.setattr(learner, "_MAX_DENSE_IDS", 0)
    monkeypatch.setattr(spread_fit, "_ENTRIES_PER_BLOCK", 1000)
    monkeypatch.setattr(spread_fit, "_IDS_PER_BLOCK", 80)
    spread = chosen.fit(df)

    def risk(model):
        margins = [((2 * x.label - 1) * x.margin) for x in model.with_margin(df).collect()]
        each = [math.log1p(math.exp(-m)) if isinstance(chosen, Logistic) else max(0.0, 1 - m) for m in margins]
        return sum(each) / len(each) + chosen.reg / 2 * sum(x.weight**2 for x in model.weights.collect())

    assert risk(spread) <= risk(dense) * 1.001
    # A column with one value in all rows has weight 0 in both; a penalised bias is one.
    assert 1000 not in {x.sig_id for x in spread.weights.collect()} | {x.sig_id for x in dense.weights.collect()}
    assert (spread.intercept == 0) == (dense.intercept == 0) == (chosen == LinearSVM())
    if isinstance(chosen, Logistic):
        a, b = ({x.row_key: x.margin for x in m.with_margin(df).collect()} for m in (dense, spread))
        assert max(abs(a[k] - b[k]) for k in a) < 1e-4


def test_a_block_without_rows():
    block, ids = spread_fit._made_block([], 3, True)
    sides, margins, along = spread_fit._margins(block, [])
    assert len(ids) == len(sides) == 0 and not list(spread_fit._described(0, block, ids))
    assert spread_fit._losses(sides, margins, along, np.array([0.0, 1.0]), "hinge").tolist() == [[0.0, 0.0], [0.0, 0.0]]
    none = spread_fit._first_weights([], 5, 0.1)
    assert spread_fit._stepped(none, [], np.zeros(1), 0.0, 5, True).products().tolist() == [[[0.0, 0.0], [0.0, 0.0]]] * 2


def test_more_partitions_than_asked_for(many_ids, monkeypatch):
    """Blocks without rows, and as many as there are partitions."""
    plain, by_key = type(many_ids).repartition, RDD.partitionBy
    monkeypatch.setattr(type(many_ids), "repartition", lambda self, n, *keys: plain(self, max(n, 5), *keys))
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *how: by_key(self, max(n, 9), *how))
    rows = many_ids.filter("row_key < 4 OR row_key >= 4997").withColumn("label", (F.col("row_key") % 2).cast("double"))
    monkeypatch.setattr(learner, "_MAX_DENSE_IDS", 0)
    model = Logistic(max_iter=3).fit(rows)
    assert model.with_margin(rows).filter("margin IS NULL").count() == 0 and model.weights.count() > 1


def test_step_lengths_of_a_kinked_risk():
    """The risk falls to a kink at 3e-8 or at 5e4, off the first lengths."""
    for kink in (3e-8, 5e4):
        risk = lambda t: (np.abs(t - kink), np.where(t < kink, -1.0, 1.0))
        value, length = spread_fit._length(risk, kink, -1.0)
        assert value < kink and 0 < length < 2 * kink
    assert spread_fit._length(lambda t: (1 + t, np.ones_like(t)), 1.0, -1.0) == (1.0, 0.0)
