import hashlib
import math

import pytest

from gleaner.operators import sampling


def order(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest()[:15], k))


@pytest.mark.parametrize("limit", [50_000, 7, 1])
@pytest.mark.parametrize("n", [0, 1, 250, 999, 1000, 5000])
def test_exact_sample(spark, n, limit):
    df = spark.range(1000)
    got = {r.id for r in sampling.exact_sample(df, "id", n, 7, bucket_rows=limit).collect()}
    assert got == set(order(range(1000), 7)[:n])


def test_partitioning_does_not_matter(spark):
    take = lambda df: {r.id for r in sampling.exact_sample(df, "id", 30, 5, bucket_rows=3).collect()}
    assert take(spark.range(500, numPartitions=1)) == take(spark.range(500).repartition(9).orderBy("id"))


def test_fraction(spark):
    got = {r.id for r in sampling.fraction_sample(spark.range(2000), "id", 0.3, 5).collect()}
    below = {k for k in range(2000) if int(hashlib.md5(f"{k}:5".encode()).hexdigest()[:8], 16) / 2**32 < 0.3}
    assert got == below and 500 < len(got) < 700
    with pytest.raises(ValueError):
        sampling.fraction_sample(spark.range(1), "id", 1.5, 5)


@pytest.mark.parametrize("limit", [50_000, 1])
@pytest.mark.parametrize("n", [3, 20, 64, 65, 70])
def test_sample_with_copies_and_null_keys(spark, n, limit):
    rows = [(None, i) for i in range(5)] + [(i % 20, i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v long")
    got = sampling.exact_sample(df, "id", n, 7, bucket_rows=limit).collect()
    text = {k: "\0null" if k is None else k for k, _ in rows}
    ranks = sorted((hashlib.md5(f"{text[k]}:7".encode()).hexdigest()[:15], str(k)) for k, _ in rows)
    assert sorted(str(r.id) for r in got) == sorted(k for _, k in ranks[:n])
    assert len({(r.id, r.v) for r in got}) == min(n, 65)
    assert sorted(got) == sorted(sampling.exact_sample(df.repartition(7), "id", n, 7).collect()) if n < 60 and None not in {r.id for r in got} else True


def test_stratified_split(spark):
    df = spark.range(900).selectExpr("id", "IF(id < 850, 0.0D, 1.0D) AS label")  # one class is rare
    out = sampling.with_stratified_split(df, "id", "label", 0.3, 3).collect()
    for label, keys in ((0.0, range(850)), (1.0, range(850, 900))):
        held = {r.id for r in out if r.label == label and r.side == "calibration"}
        assert held == set(order(keys, 3)[: math.ceil(0.3 * len(keys))])
    assert len(out) == 900


def test_split_is_stable(spark):
    side = lambda df: {r.id: r.side for r in sampling.with_split(df, "id", 0.3, 11).collect()}
    whole = side(spark.range(300))
    assert side(spark.range(100)) == {k: v for k, v in whole.items() if k < 100}
