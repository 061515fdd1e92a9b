import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import LONG

from gleaner.llm import quality, sums, toxicity

SF = "/root/testdata/sf0.1"


def held(i, folds, rest):
    return i is not None and zlib.crc32(str(i).encode()) % folds == rest


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def made(n=400):
    rng = random.Random(1)
    docs, marks = [], []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 5 == 0
        words = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.choice('aeiou')}" for _ in range(rng.randrange(20, 200))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vileword", "badword", "awful" + rng.choice("xyz")])
        docs.append((i, " ".join(f"{w}$$$" if bad else w for w in words)))
        if i % 2:
            marks.append((i, int(not bad), int(toxic)))
        else:
            marks.append((i, None, int(toxic) if i % 4 else None))
    return docs, marks


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy(spark, name):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality.quality_scores(docs, marks) if name == "quality" else toxicity.toxicity_scores(docs, marks)
    got = scores.where("held_out").join(marks, "doc_id").select(F.col(name).alias("y"), "score", "predicted").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    ones, zeros = got[got.y == 1], got[got.y == 0]
    # Some 4 % of the rows that are labelled toxic hold nothing that tells them from junk.
    assert (ones.predicted == 1).mean() > 0.9 and (zeros.predicted == 0).mean() > 0.98


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_edges(spark, make, which):
    docs, marks = made()
    docs += [(None, "x"), (9001, None), (9002, ""), (9003, LONG), (9004, "x"), (9004, "x")]
    marks += [(9001, 1, 0), (9001, 0, 1), (None, 1, 1), (99999, 1, 1), (3, 7, 7)]
    f, folds, rest = (quality.quality_scores, 3, 1) if which == "quality" else (toxicity.toxicity_scores, 5, 0)
    got = f(make(docs, extra=True), labels(spark, marks).withColumn("score", F.lit("x")).withColumn("label", F.lit("y"))).collect()
    assert len(got) == len(docs) and all(r.held_out == held(r.doc_id, folds, rest) and 0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[9001] == by_id[9002] and by_id[9004] == by_id[None]
    assert f(make([]), labels(spark, marks)).collect() == []
    alone = f(make(docs), labels(spark, [(1, 1, 0)])).collect()
    assert {r.score for r in alone} == ({0.5} if which == "quality" else {0.0})


def test_labels_of_the_held_fold_are_not_learnt(spark, make):
    docs, marks = made()
    other = [(i, None if q is None else 1 - q, None if t is None else 1 - t) if held(i, 3, 1) else (i, q, t) for i, q, t in marks]
    a, b = ({r.doc_id: round(r.score, 9) for r in quality.quality_scores(make(docs), labels(spark, m)).collect()} for m in (marks, other))
    assert a == b
    other = [(i, q, None if t is None else 1 - t) if held(i, 5, 0) else (i, q, t) for i, q, t in marks]
    a, b = ({r.doc_id: round(r.score, 6) for r in toxicity.toxicity_scores(make(docs), labels(spark, m)).collect()} for m in (marks, other))
    assert a == b


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(300, 2)) @ [[1, 0.4], [0, 0.5]], rng.normal(size=(500, 2)) + [1, 1]]
    one = [np.column_stack((np.ones(len(a)), a)) for a in x]
    model = quality.discriminant(np.array([a.T @ a for a in one]), pooled=0, rounded=0)
    at = rng.normal(size=(20, 2))
    density = [len(a) / 800 * np.exp(-0.5 * np.einsum("ij,jk,ik->i", at - a.mean(0), np.linalg.inv(np.cov(a.T, bias=True)), at - a.mean(0))) / np.sqrt(np.linalg.det(np.cov(a.T, bias=True))) for a in x]
    assert np.allclose(model.scores(at), density[1] / (density[0] + density[1]))


def dense(rows):
    """Dense 0/1 rows as the inputs that a task reads."""
    lists = [np.flatnonzero(r).tolist() for r in rows]
    columns = [pa.array([0] * len(rows), pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))]
    return toxicity.read_inputs(pa.RecordBatch.from_arrays(columns, ["words", "x", "times"]), rows.shape[1])


def test_risk_correction_finds_the_positives_in_unlabelled_text():
    rng = np.random.default_rng(4)
    sample = lambda n, p: np.column_stack((rng.random((n, 5)) < p, rng.random((n, 40)) < 0.3))
    positive, hidden, clean = sample(200, 0.5), sample(200, 0.5), sample(1800, 0.001)
    every = np.concatenate((positive, hidden, clean))
    counts = np.array([every.sum(axis=0), positive.sum(axis=0)])
    chosen = toxicity.chosen_inputs(counts, len(every), len(positive))
    assert set(range(5)) <= set(chosen)
    positive, hidden, clean, every = (rows[:, chosen] for rows in (positive, hidden, clean, every))
    x = dense(every)
    is_positive = (np.arange(2200) < 200)[:, None].astype(float)
    start = toxicity.start_weights(counts, chosen, len(every), len(positive))
    w = toxicity.train(lambda w: toxicity.risk_sums(x, w, 1 - is_positive, is_positive), start[:, None], 0.1)
    some = hidden[:, :5].any(axis=1)
    assert (dense(hidden[some]).times(w) > 0).mean() > 0.85 and (dense(clean[~clean[:, :5].any(axis=1)]).times(w) > 0).mean() < 0.02


def test_many_weak_inputs_that_go_together_do_not_hide_the_strong():
    rng = np.random.default_rng(5)
    n, weak = 3000, 1500

    def sample(n, strong, share):
        long = rng.random((n, 1)) < share  # the weak inputs are those of long texts, of which positives are a few more
        return np.column_stack((rng.random((n, 5)) < strong, (rng.random((n, weak)) < np.where(long, 0.4, 0.05))))

    positive, hidden, clean = sample(150, 0.7, 0.7), sample(150, 0.7, 0.7), sample(n - 300, 0.001, 0.5)
    every = np.concatenate((positive, hidden, clean))
    counts = np.array([every.sum(axis=0), positive.sum(axis=0)])
    x, is_positive = dense(every), (np.arange(n) < 150)[:, None].astype(float)
    start = toxicity.start_weights(counts, np.arange(5 + weak), n, 150)
    w = toxicity.train(lambda w: toxicity.risk_sums(x, w, 1 - is_positive, is_positive), start[:, None], 0.1)
    assert (dense(hidden).times(w) > 0).mean() > 0.75 and (dense(clean).times(w) > 0).mean() < 0.02


def test_sums_equal_the_dense_formula():
    rng = np.random.default_rng(6)
    rows = rng.random((50, 7)) < 0.3
    x, w = dense(rows), rng.normal(size=(9, 2))
    full = np.column_stack((rows * np.log(11), np.zeros(50), np.ones(50)))
    u, p = (rng.random((50, 2)) < 0.5).astype(float), (rng.random((50, 2)) < 0.2).astype(float)
    got = toxicity.risk_sums(x, w, u, p).reshape(2, 2, -1)
    s = 1 / (1 + np.exp(-full @ w))
    assert np.allclose(x.times(w), full @ w)
    for k in range(2):
        for part, rows_in in ((got[k, 0], u[:, k]), (got[k, 1], p[:, k])):
            assert np.allclose(part, np.concatenate(([rows_in.sum(), rows_in @ s[:, k]], (rows_in * s[:, k] * (1 - s[:, k])) @ full)))


@pytest.mark.parametrize("positives", [1, 2, 3])
def test_few_positives_are_enough(spark, make, positives):
    docs, _ = made(3000)
    insult = " quarrelsome insult nobody else writes" * 2
    marked = [i for i in range(0, 3000, 50) if not held(i, 5, 0)][:positives]
    docs = [(i, t + insult if i in marked else t) for i, t in docs]
    docs += [(10_000 + k, docs[51 + 5 * k][1] + insult) for k in range(5)]
    marks = [(i, None, 1) for i in marked] + [(i, None, 0) for i, _ in docs if i % 10 == 3]
    got = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(make(docs), labels(spark, marks)).collect()}
    assert np.mean([got[10_000 + k] for k in range(5)]) > 0.7
    assert np.mean([got[i] for i, _ in docs[:3000] if i % 5]) < 0.05


def test_a_prior_above_a_half(spark, make):
    rng = random.Random(2)
    clean = [f"{rng.choice('bdfg')}o{rng.choice('klmn')}{rng.choice('aeiou')}" for _ in range(60)]
    docs = [(i, " ".join(rng.choices(clean, k=40) + (["vileword", "badword"] if i % 10 < 7 else []))) for i in range(500)]
    marks = [(i, None, int(i % 10 < 7)) for i in range(0, 500, 2)]
    for prior in (None, 0.7):
        got = toxicity.toxicity_scores(make(docs), labels(spark, marks), prior=prior).collect()
        assert np.mean([r.predicted == int(r.doc_id % 10 < 7) for r in got]) > 0.97
    only = [(i, None, 1) for i, _, t in marks if t]  # nothing says how common the others are
    got = toxicity.toxicity_scores(make(docs), labels(spark, only), prior=0.7).collect()
    assert np.mean([r.predicted == int(r.doc_id % 10 < 7) for r in got]) > 0.97


def test_counts_and_sums_by_lanes_give_the_same(spark, make, monkeypatch):
    docs, marks = made(200)
    want = {r.doc_id: round(r.score, 9) for r in toxicity.toxicity_scores(make(docs), labels(spark, marks)).collect()}
    monkeypatch.setattr(sums, "DIRECT_TASKS", 0)
    assert {r.doc_id: round(r.score, 9) for r in toxicity.toxicity_scores(make(docs), labels(spark, marks)).collect()} == want


def test_without_toxic(spark, make):
    docs, marks = made()
    df = make(docs, extra=True)
    out = toxicity.without_toxic(df, labels(spark, marks))
    gone = {d for d, _ in docs} - {r.doc_id for r in out.collect()}
    assert out.columns == df.columns and all(i % 5 == 0 for i in gone) and len(gone) > 60
