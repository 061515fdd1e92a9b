import random
from collections import defaultdict

import pytest
from tests.llm.conftest import LONG

from gleaner.llm import mixing


def fill(sizes, weights, share, most):
    """Targets by dealing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in free}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.source].append(r)
    return out


def rows_of(spread):
    return [(i, "w " * (1 + (i * 7919) % 90), f"s{i % spread}" if i % 11 else None) for i in range(3000)]


@pytest.mark.parametrize("spread", [1, 3, 7])
def test_targets_and_taken_words(make, spread):
    got = mixing.mix(make(rows_of(spread), extra=True)).collect()
    groups = by_source(got)
    sizes = {s: sum(r.size for r in rs) for s, rs in groups.items()}
    want = fill(sizes, (5, 2, 1), 1.5, 2)
    for s, rs in groups.items():
        assert rs[0].target == pytest.approx(want[s]) and rs[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in rs) - want[s]) <= max(r.size for r in rs)
        assert all(r.taken <= 2 * r.size for r in rs)


def test_reruns_agree_and_seeds_differ(make):
    df = make(rows_of(3))
    a, b, c = ({r.doc_id: r.copies for r in mixing.mix(d, seed=s).collect()} for d, s in ((df, 17), (df.repartition(13), 17), (df, 18)))
    assert a == b != c


def test_inclusion_follows_the_weights(make):
    rows = [(i, "w " * (100 if i % 2 else 25), "a") for i in range(4000)]
    got = mixing.mix(make(rows), share=0.5).collect()
    short, long = (sum(r.copies for r in got if r.size == n) / 2000 for n in (25, 100))
    assert short / long == pytest.approx(2, rel=0.15)  # weights fall with the square root of the length


def test_expected_words_are_the_rest(spark):
    rng = random.Random(3)
    words = [(no, w, rng.randrange(1, 5000)) for no in range(1, 9) for w in rng.sample(range(1, 3000), 40)] + [(9, 7, 10), (10, 0, 0), (11, 3, 5), (11, 2, 1)]
    total = {no: sum(n for o, _, n in words if o == no) for no in range(1, 12)}
    rests = [(no, total[no] * share) for no, share in zip(range(1, 12), (0.0, 0.01, 0.2, 0.5, 0.7, 0.9, 0.99, 0.9999, 0.5, 0.5, 0.97))]
    frame = spark.createDataFrame(words, "source_no int, weight bigint, words bigint")
    found = {r.source_no: r for r in mixing.sampling_scales(frame, spark.createDataFrame(rests, "source_no int, rest double")).collect()}
    for no, rest in rests:
        if total[no]:
            p = [(1.0 if w > found[no].certain else found[no].scale * w, n) for o, w, n in words if o == no]
            assert all(0 <= x <= 1 for x, _ in p)
            assert sum(x * n for x, n in p) == pytest.approx(rest)
    assert 10 not in found


def test_certain_documents_come_first(make):
    # Weights differ forty times over, and nine tenths of the words are wanted: the short ones are certain.
    rows = [(i, "w " * (1 if i % 2 else 1500), "a") for i in range(400)]
    got = mixing.mix(make(rows), share=0.9).collect()
    assert {r.copies for r in got if r.size == 1} == {1}
    assert abs(sum(r.taken for r in got) - got[0].target) <= 750


def test_the_cut_is_narrowed_twice(make, monkeypatch):
    df = make(rows_of(3))
    want = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "RANGES", 3)  # nearly all of the order is then left to the last step
    assert {r.doc_id: r.copies for r in mixing.mix(df).collect()} == want


def test_edges(make):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (3, "x", None), (4, "x", None), (4, "x", None), (5, LONG, "b"), (6, " \t\n", "c")]
    got = mixing.mix(make(rows)).collect()
    assert len(got) == len(rows)
    assert [r.taken for r in got if r.size == 0] == [0, 0, 0]
    assert {r.target for r in got if r.source == "c"} == {0.0}
    assert mixing.mix(make([])).collect() == []


def test_rows_are_repeated_as_decided(make):
    df = make(rows_of(3), extra=True)
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    found = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert found == {k: v for k, v in copies.items() if v}
