import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm import line_dedup
from gleaner.session import Workspace

BLANKS = " \t\n\x0b\f\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, least=10):
    last = (1 << 62, 0)
    order = lambda i: last if i is None else (i, 0)  # noqa: E731  null behind all others
    first = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            k = key_of(line)
            if len(k) >= least:
                first[k] = min(first.get(k, last), order(doc_id))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < least or first[key_of(x)] == order(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df, **parameters):
    return sorted((tuple(r) for r in line_dedup.dedup_lines(df, **parameters).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    common = [f"A line that many documents share, {i}" for i in range(12)] + ["short", "", "  \t ", " nine char", "0123456789"]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.6 else f"own line {i} {rng.randrange(4)} of the text" for _ in range(rng.randint(0, 9))]
        lines = [rng.choice(["", " ", "\t\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "  ", "\x0b"]) for x in lines]
        rows.append((rng.randrange(10 * n), "\n".join(lines)))
    return rows


@pytest.mark.parametrize("batches, fan", [(1, 2), (5, 2), (8, 3)])
def test_against_brute_force(make, batches, fan):
    rows = corpus(batches, 150) + [(5, None), (6, ""), (7, "\n\n"), (None, "of null ids only\nA line that many documents share, 1"), (None, "of null ids only")]
    rows += [(20_000, "twice the same line\nx\ntwice the same line"), (20_001, "x\ntwice the same line"), (20_001, "twice the same line\nanother text")]
    rows += [(20_001, "x\ntwice the same line")] + [(30_000 + i, "a hot line of text\n" + "İ ſ not ASCII 1") for i in range(300)]
    assert result(make(rows, extra=True), batches=batches, fan=fan) == brute(rows)


def test_a_very_long_text(make):
    text = "\n".join(f"line number {i % 20_000} of many" for i in range(30_000))
    rows = [(1, "line number 7 of many"), (2, text), (3, "LINE NUMBER 19999 OF MANY\nline of the third")]
    assert result(make(rows)) == brute(rows)


def test_other_bounds(make):
    rows = [(1, "abc\nab"), (2, "abc\nab\n"), (3, "ABC")]
    assert result(make(rows), least=3) == brute(rows, least=3)


def test_empty_table(make):
    assert result(make([])) == []


def test_all_ids_null(make):
    rows = [(None, "a line of ten or more"), (None, "a line of ten or more\nb")]
    assert result(make(rows)) == brute(rows)


def test_runs_are_disjoint_levelled_and_never_shuffled(spark):
    work = Workspace(spark, "runs")
    runs = line_dedup.LineRuns(spark, work, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), fan=2)
    seen = set()
    for i in range(7):
        values = {10 * i + j for j in range(25)}
        batch = spark.createDataFrame([(bytes([v]), v) for v in values], "hash binary, first bigint")
        if runs.runs():
            plan = runs.split(batch)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == len(runs.runs()) and plan.count("Exchange") == 1  # that of the batch
        judged = runs.add(batch).collect()
        assert {r["first"] for r in judged if r.earlier} == values & seen
        assert {r["first"] for r in judged} == values
        seen |= values
        assert all(len(level) < 2 for level in runs.levels)
    assert len(runs.runs()) == 3  # seven batches: one, two and four
    stored = [r["first"] for run in runs.runs() for r in run.collect()]
    assert sorted(stored) == sorted(seen)
    runs.close()
    assert not any(t.name.startswith("line_run") and t.name in runs.made for t in spark.catalog.listTables())


def test_without_places(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], p) for p in ([0], [3], [0, 1, 2, 3], [1, 2], [])], "l array<string>, p array<int>")
    got = [r[0] for r in df.select(line_dedup.without_places(F.col("l"), F.col("p"))).collect()]
    assert got == [["b", "c", "d"], ["a", "b", "c"], [], ["a", "d"], ["a", "b", "c", "d"]]
