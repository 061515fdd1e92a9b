import random

import numpy as np
import pytest
from tests.llm.conftest import LONG

from gleaner.llm import ngram_join
from gleaner.llm.components import components
from gleaner.session import Workspace

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x for x in (text or "").translate(UPPER).translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def result(df):
    return sorted((tuple(r) for r in ngram_join.shingle_components(df).collect()), key=str)


def near_copies(rng, words, n, share):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(int(len(w) * share * rng.random())):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage = fresh(60)
    texts = []
    for _ in range(n):
        texts += near_copies(rng, fresh(rng.choice([3, 6, 12, 40, 100, 130, 200, 400])), rng.choice([1, 1, 2, 3, 6]), 0.08)
        texts.append(" ".join(passage + fresh(rng.choice([2, 8, 12, 16, 20, 100]))))
    texts += near_copies(rng, fresh(150), 150, 0.06) + [" ".join(fresh(50))] * 40
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_against_brute_force(make):
    rows = corpus(1)
    assert result(make(rows, extra=True)) == brute(rows)


def test_small_chunks_salts_and_parts_change_nothing(make, monkeypatch):
    rows = corpus(3, 30)
    for name, value in (("CHUNK_DOCUMENTS", 16), ("CARRIED", 2), ("SALT_ROWS", 8), ("PART", 5000), ("BUCKET", 300), ("HOT_SHARE", 0.01)):
        monkeypatch.setattr(ngram_join, name, value)
    assert result(make(rows)) == brute(rows)


def test_without_block_rounds_the_completion_finds_every_link(spark, make, monkeypatch):
    rows = corpus(4, 30)
    monkeypatch.setattr(ngram_join, "_block_links", lambda sets, total: sets.sparkSession.createDataFrame([], "u bigint, v bigint"))
    assert result(make(rows)) == brute(rows)


def test_repeated_rows_are_one_set(spark, make, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(0, 60, 3):
        words = [f"v{rng.randrange(10**6)}" for _ in range(rng.choice([30, 60, 150]))]
        near = " ".join(words[:-2] + ["other", f"end{i}"])
        rows += [(i, " ".join(words))] * rng.choice([2, 3, 9]) + [(i, " ".join(words).upper()), (i + 1, near), (i + 2, " ".join(words[:20]))]
    rng.shuffle(rows)
    want = brute(rows)
    assert sum(c != d for d, _, c in want) >= 20
    assert result(make(rows)) == want
    monkeypatch.setattr(ngram_join, "_block_links", lambda sets, total: sets.sparkSession.createDataFrame([], "u bigint, v bigint"))
    assert result(make(rows)) == want


def test_edges(make):
    rows = [(5, None), (6, ""), (7, " \t"), (8, "One two"), (9, "one TWO"), (10, "É one"), (11, "é one"), (None, "one two"), (None, None)]
    rows += [(20, LONG), (21, LONG + " more"), (4, LONG + " other")]
    assert result(make(rows)) == brute(rows)
    assert result(make([])) == []


def test_rows_of_one_id_share_a_component(make):
    rows = [(1, "a b c"), (7, "a b c"), (7, "d e f"), (9, "d e f"), (9, "d e f")]
    assert {(r[0], r[2]) for r in result(make(rows))} == {(1, 1), (7, 1), (9, 1)}
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abc"]
    rows = [(3, t) for t in texts] + [(9, texts[1] + " more"), (12, texts[2] + " more")]
    assert {(r[0], r[2]) for r in result(make(rows))} == {(3, 3), (9, 3), (12, 3)}


def test_threshold_is_exact(make):
    base = [f"w{i}" for i in range(32)]  # 28 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[4:] + ["x", "y", "z", "v"])), (3, " ".join(base[5:] + ["k", "l", "m", "n", "o"]))]
    assert result(make(rows)) == brute(rows)
    (a, x), (b, y) = ((d, shingles(t)) for d, t in rows[:2])
    assert 100 * len(x & y) == 75 * len(x | y)


def test_one_of_each(make):
    df = make([(3, "a b c"), (2, "a b c"), (1, "other"), (None, "a b c"), (4, None)], extra=True)
    out = ngram_join.one_of_each(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "4", "None"]


def test_block_search_equals_counting():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 2**63, 60).astype(np.uint64), base)) for _ in range(40)]
    block = ngram_join.Block(list(range(40)), sets)
    for x in range(40):
        want = {y for y in range(x) if len(np.intersect1d(block.sets[x], block.sets[y])) >= ngram_join.required(len(block.sets[x]), len(block.sets[y]))}
        assert {y for y, _ in block.search(x)} == want


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 300)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    root = list(range(1300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint"), Workspace(spark, "t")).collect()}
    assert got == {i: find(i) for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint"), Workspace(spark, "t")).collect() == []


def thue_morse(n, swap=False):
    """Words whose hashes agree under any polynomial modulo a power of two."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_patterned_words_are_told_apart(make, n):
    x, y = thue_morse(n), thue_morse(n, True)
    rows = [(1, x), (2, y), (3, "other words"), (4, f"{x} {y} " * 4), (5, f"{y} {x} " * 4), (6, " ".join([x] * 7)), (7, " ".join([y] * 7)), (8, x.upper())]
    assert result(make(rows)) == brute(rows)


def test_hashes_of_structured_words():
    import pyarrow as pa

    from gleaner.llm.textbytes import slices, words

    pool = {c * k for c in "ab\0é" for k in (1, 7, 8, 9, 16, 17, 255, 256, 257, 600)} | {format(i, "013b") for i in range(8192)}
    pool |= {thue_morse(n, s) for n in (8, 128, 512, 2048) for s in (False, True)} | {("a" * i + "b" + "a" * (300 - i)) for i in range(301)}
    every = sorted(pool)
    (texts,) = slices(pa.array([" ".join(every)]))
    first, second, owner = words(texts)
    assert len(owner) == len(every) == len(np.unique(first)) == len(np.unique(second))
    (again,) = slices(pa.array(["x " + " ".join(reversed(every))]))
    assert words(again)[0][1:][::-1].tolist() == first.tolist()  # the place of a word doesn't matter


def test_hot_shingles_change_nothing(make, monkeypatch):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(80)]
    rows = corpus(5, 25)
    rows += [(10_000 + i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 9, 12, 20, 24]))])) for i in range(120)]
    for name, value in (("HOT_LEAST", 5), ("BATCH_ROWS", 40)):
        monkeypatch.setattr(ngram_join, name, value)
    assert result(make(rows)) == brute(rows)
    monkeypatch.setattr(ngram_join, "_block_links", lambda sets, total: sets.sparkSession.createDataFrame([], "u bigint, v bigint"))
    assert result(make(rows)) == brute(rows)
