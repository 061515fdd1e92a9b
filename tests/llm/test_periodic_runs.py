import random

import numpy as np
import pytest

from gleaner.llm import periodic_runs as p


def brute(words):
    """Runs by comparing every word with every other."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            whole = range(i, j + q)
            smaller = any(all(words[k] == words[k + r] for k in range(i, j + q - r)) for r in range(1, q))
            if len(whole) >= max(6, 4 * q) and not smaller:
                out.append((i, len(whole), q))
            i = max(j, i) + 1
    return sorted(out)


def made(rng, n, alphabet):
    words = []
    while len(words) < n:
        if rng.random() < 0.4:
            block = [rng.randrange(alphabet) for _ in range(rng.randint(1, 7))]
            words += (block * 9)[: rng.randint(1, len(block) * 8)]
        else:
            words.append(rng.randrange(alphabet + 3))
    return words[:n]


@pytest.mark.parametrize("alphabet", [1, 2, 3, 9])
def test_runs_against_brute_force(alphabet):
    rng = random.Random(alphabet)
    for _ in range(300):
        words = made(rng, rng.randint(0, 90), alphabet)
        assert p.runs_of(np.array(words, np.int64), np.zeros(len(words), np.int64)) == brute(words)


def test_long_periods_and_neighbouring_texts():
    block = list(range(500))
    words = np.array(block * 4 + block[:7] + [-1] * 6 + [-1] * 6, np.int64)
    owner = np.array([0] * (len(words) - 6) + [1] * 6)
    assert p.runs_of(words, owner) == [(0, 2007, 500), (2007, 6, 1), (2013, 6, 1)]


def test_segments_are_stable():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 30, 3000)
    for begin, end in p.surviving_segments(words, np.zeros(len(words), np.int64)):
        assert end - begin >= 6 and np.unique(words[begin:end], return_counts=True)[1].min() >= 4


def test_documents(make):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "a a a a a", "a a a a a a", "x " + "é b\x0bc\n" * 5 + "é y", "A a A a A a A a", "  " * 6, "z" * 100_000]
    texts += [" ".join(f"w{w}" for w in made(rng, 200, 3)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 9), (4, "a a a a a a"), (4, "other")]
    expected = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        runs = brute(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        expected.append((doc_id, len(words), runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in p.periodic_runs(make(rows, extra=True)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_longest_prefers_early_and_short(make):
    text = "a a a a a a x b b b b b b y c d c d c d c d c"
    (row,) = p.periodic_runs(make([(1, text)])).select(p.longest().alias("r")).collect()
    assert tuple(row.r) == (14, 9, 2)
    (row,) = p.periodic_runs(make([(1, "a a a a a a x b b b b b b")])).select(p.longest().alias("r")).collect()
    assert tuple(row.r) == (0, 6, 1)
    (row,) = p.periodic_runs(make([(1, "no run")])).select(p.longest().alias("r")).collect()
    assert row.r is None


def test_empty_table(make):
    assert p.periodic_runs(make([])).collect() == []
