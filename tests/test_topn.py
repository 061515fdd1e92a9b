import pytest

from gleaner.operators import overlap, sets, topn

POSES = [
    (1, "a", -5.0), (2, "a", -3.0), (3, "a", -3.0),  # two equal best: the smaller key wins
    (4, "b", -4.0), (5, "b", None), (6, "c", None), (7, "c", None), (8, "d", -3.5),
]


@pytest.fixture
def poses(spark):
    return spark.createDataFrame(POSES, "row_key long, mol_id string, score double")


def rows(df):
    return [(r.row_key, r.mol_id, r.score) for r in df.collect()]


def test_top_n(poses):
    assert rows(topn.top_n(poses, 3)) == [(2, "a", -3.0), (8, "d", -3.5), (4, "b", -4.0)]
    assert rows(topn.top_n(poses, 9))[3:] == [(6, "c", None)]  # failed ids fill spare places
    assert len(rows(topn.top_n(poses, 9, drop_failed=True))) == 3
    assert rows(topn.top_n(poses, 1, ascending=True)) == [(1, "a", -5.0)]
    assert rows(topn.top_n(poses, 0)) == []


def test_result_does_not_depend_on_partitioning(spark, poses):
    expected = rows(topn.top_n(poses, 4))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert rows(topn.top_n(poses.repartition(n, "score"), 4)) == expected
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_semi_join_keeps_ties_and_failed(poses):
    top = topn.top_n(poses, 4)
    assert sorted(rows(topn.semi_join_top(poses, top)), key=lambda r: r[0]) == [
        (2, "a", -3.0), (3, "a", -3.0), (4, "b", -4.0), (6, "c", None), (7, "c", None), (8, "d", -3.5)
    ]


@pytest.mark.parametrize("salted_above", [1000, 1])
def test_collapse(poses, monkeypatch, salted_above):
    monkeypatch.setattr(topn, "SALTED_ABOVE", salted_above)
    out = topn.collapse(poses, 2)
    assert sorted((r.row_key, r["rank"]) for r in out.collect()) == [(2, 1), (3, 2), (4, 1), (5, 2), (6, 1), (7, 2), (8, 1)]


def test_collapse_of_a_hot_id_by_salt(spark, monkeypatch):
    monkeypatch.setattr(topn, "SALTED_ABOVE", 5)
    df = spark.range(3000).selectExpr("id AS row_key", "IF(id % 3 = 0, 'hot', concat('m', id % 50)) AS mol_id", "CAST(id % 977 AS double) AS score")
    out = topn.collapse(df, 40)
    pdf = df.toPandas().sort_values(["score", "row_key"], ascending=[False, True])
    expected = pdf.groupby("mol_id").head(40)
    assert sorted(r.row_key for r in out.collect()) == sorted(expected.row_key)


@pytest.mark.parametrize("kind, ascending", [("spread", False), ("ties", True), ("equal", False), ("huge", True)])
def test_selection_of_long_lists(spark, ascending, kind, monkeypatch):
    monkeypatch.setattr(topn, "_ACCURACY", 50)  # so that the sketch is coarse
    score = {"spread": "sin(id) * 1e6", "ties": "CAST(id * id % 7 AS double) - 3", "equal": "1.5D", "huge": "IF(id % 2 = 0, 1, -1) * pow(10.0D, id % 300)"}[kind]
    df = spark.range(0, 2000, 1, 4).selectExpr("(id * 7919) % 2000 AS row_key", f"IF(id % 9 = 0, NULL, {score}) AS score", "id % 5 AS other")
    rows = sorted(df.collect(), key=lambda r: (r.score is None, 0 if r.score is None else (r.score if ascending else -r.score), r.row_key))
    for n in (0, 17, 700, 1777, 1900, 2000):
        got = topn.select_best(df, n, ascending=ascending, bucket_rows=10)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows[:n]), key=str)


@pytest.mark.parametrize("kinds, n", [(2, 1500), (2, 1501), (3, 1000), (3, 2001)])
def test_selection_at_the_border_of_frequent_scores(spark, monkeypatch, kinds, n):
    df = spark.range(3000).selectExpr("id AS row_key", f"CAST(id % {kinds} AS double) AS score")
    rounds, look = [], topn._bracket
    monkeypatch.setattr(topn, "_bracket", lambda *given: rounds.append(1) or (look(*given) if len(rounds) < 20 else pytest.fail("it never ends")))
    expected = sorted((-(i % kinds), i) for i in range(3000))[:n]
    assert sorted(r.row_key for r in topn.select_best(df, n, bucket_rows=20).collect()) == sorted(i for _, i in expected)


def test_a_long_list_is_best_first(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS row_key", "id % 150 AS mol_id", "CAST(id % 40 AS double) AS score")
    short = [tuple(r) for r in topn.top_n(df, 100).collect()]
    monkeypatch.setattr(topn, "MAX_LISTED", 10)
    assert [tuple(r) for r in topn.top_n(df, 100).collect()] == short


def test_sort(poses):
    assert [r[0] for r in rows(topn.sort_by_score(poses))] == [2, 3, 8, 4, 1, 5, 6, 7]


def test_attach_payload(spark, poses):
    hits = topn.top_n(poses, 2)
    table = poses.selectExpr("row_key", "concat('text ', row_key) AS raw")
    for bound in (10, 1):
        out = topn.attach_payload(hits, table, max_hits=bound)
        assert [(r.row_key, r.raw) for r in out.collect()] == [(2, "text 2"), (8, "text 8")]
        assert out.count() == topn.attach_payload(hits, table.union(table), max_hits=bound).count()


def test_minus_keeps_duplicates(spark):
    pool = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "row_key string")
    gone = spark.createDataFrame([("b",), ("b",), ("x",)], "row_key string")
    assert sorted(r.row_key for r in sets.minus(pool, gone).collect()) == ["a", "a", "c"]


def test_overlap(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "mol_id string")
    b = spark.createDataFrame([("x",), ("x",), ("x",), ("z",), ("w",)], "mol_id string")
    assert tuple(overlap.hit_overlap(a, b, 10).first()) == (7, 2, 70.0)
    ids = a.distinct()
    assert overlap.hit_overlap(ids, ids, 3).first().percent == 100.0
    assert tuple(overlap.hit_overlap(a, b.filter("mol_id = 'w'"), 10).first()) == (0, 0, 0.0)
