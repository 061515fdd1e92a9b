"""Every stage against a plain version on its own input, and the whole on the smallest tables."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_ngram_join import brute as components
from tests.oracle_check import differences, duck

from gleaner.session import Workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    work, docs = Workspace(spark, "steps"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = work.write(stage(spark, docs, SF), name)
        out.append((name, docs))
    return [(name, df, df.collect()) for name, df in out]


def test_all_but_the_last_return_the_columns_of_documents(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "sharding"]
    assert all(df.columns == steps[0][1].columns for _, df, _ in steps[:-1])


def test_clean_documents_pass_the_toxicity_stage(spark, steps):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    gone = {r.doc_id for r in steps[0][2]} - {r.doc_id for r in steps[1][2]}
    assert not gone & toxic


def test_one_of_each_component_stays(steps):
    want = [d for d, _, c in components([(r.doc_id, r.text) for r in steps[1][2]]) if d == c]
    assert sorted(want) == sorted(r.doc_id for r in steps[2][2])


def test_documents_with_items_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, *_ in contaminated([(r.doc_id, r.text) for r in steps[2][2]], items)}
    assert sorted(r.doc_id for r in steps[2][2] if r.doc_id not in hit) == sorted(r.doc_id for r in steps[3][2])


def test_mixed_rows_are_documents_and_near_the_share(steps):
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert {tuple(r) for r in steps[4][2]} <= {tuple(r) for r in steps[3][2]}
    assert words(steps[4][2]) == pytest.approx(1.5 * words(steps[3][2]), rel=0.25)


def test_every_row_gets_one_slot(steps):
    assert sorted(r.doc_id for r in steps[4][2]) == sorted(r.doc_id for r in steps[5][2])
    assert len({(r.shard, r.slot) for r in steps[5][2]}) == len(steps[5][2])


def test_run_gives_the_same_rows(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in got.collect()))) == sorted(map(str, ((r.doc_id, r.size, r.text_crc32) for r in steps[5][2])))


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_oracles(spark, name):
    sf = SF
    assert differences(entry.queries()[name](spark, sf), entry.oracle_sql()[name], duck(sf)) is None
