import zlib
from collections import defaultdict

import numpy as np
from tests.llm.conftest import LONG

from gleaner.llm import sharding


def check(rows, got, shards):
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(
        str((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for d, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def loads(got, shards, what=lambda r: r.size):
    out = np.zeros(shards)
    for r in got:
        out[r.shard] += what(r)
    return out


def test_balance_and_groups(make):
    rows = [(i, f"text {i} " * (1 + (i * 7919) % 60)) for i in range(6000)] + [(10_000 + i, f"copy {i % 50}" * 20) for i in range(1000)]
    got = sharding.shard_documents(make(rows, extra=True), 24).collect()
    check(rows, got, 24)
    size = loads(got, 24)
    assert size.max() / size.min() < 1.02
    count = loads(got, 24, lambda r: 1)
    assert count.max() / count.min() < 1.2
    shards_of = defaultdict(set)
    text = dict(rows)
    for r in got:
        shards_of[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shards_of.values())


def test_a_hot_group_is_cut_evenly(make):
    rows = [(i, f"text {i} " * 40) for i in range(4000)] + [(10_000 + i, "hot " * 60) for i in range(3000)]
    got = sharding.shard_documents(make(rows), 24).collect()
    check(rows, got, 24)
    size = loads(got, 24)
    assert size.max() / size.min() < 1.05


def test_edges(make):
    rows = [(1, None), (2, ""), (None, "x"), (None, "x"), (3, LONG), (4, "é"), (4, "é")]
    check(rows, sharding.shard_documents(make(rows), 24).collect(), 24)
    assert sharding.shard_documents(make([]), 24).collect() == []


def test_a_unit_goes_where_its_product_with_the_residual_is_highest():
    vectors = np.array([[0.5, 0.1], [0.1, 0.5], [0.3, 0.1], [0.1, 0.3]])
    assert sharding.place(vectors, 2, (1, 1)).tolist() == [0, 1, 1, 0]
