"""What the physical plans look like: no needless shuffles, no cross joins, filters and columns pushed to the scan."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from gleaner.functions.descriptors import with_descriptors
from gleaner.operators import labels, rules, sampling, topn, universe
from gleaner.operators.learner import LinearModel
from gleaner.plans import queries as q
from gleaner.plans import recipes
from gleaner.plans import stand_in as S
from gleaner.sources import models, sdf
from gleaner.sources.rules import parse_rules

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_is_one_shuffle_and_a_bounded_sort(spark):
    text = plan(q.top_n_poses(spark, SF))
    assert "TakeOrderedAndProject" in text and text.count("Exchange") == 1 and "partial_min" in text
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in text


def test_collapse_is_cut_before_the_shuffle(spark):
    text = plan(q.collapse_best_2(spark, SF))
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")  # printed top down: the limit is also below it


@pytest.mark.parametrize("name", ["fraction_sample", "split_proper_calibration", "label_extremes", "target_name", "score_parse", "score_rows", "smiles_split", "nonconformity"])
def test_row_wise_queries_do_not_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    head = text.split("Subquery")[0]
    assert "hashpartitioning" not in head and "SinglePartition" not in head and "rangepartitioning" not in head


def test_molecule_work_stays_in_the_row(spark):
    mols = S.molecules(spark, SF)
    for df in (q._signed(spark, SF), with_descriptors(mols), rules.rule_filter(with_descriptors(mols), parse_rules(q.RULE_TEXT))):
        text = plan(df)
        assert "hashpartitioning" not in text and "Join" not in text and "Python" not in text


def test_filters_reach_the_scan(spark):
    poses = q._poses(spark, SF).filter("mol_id = 5")
    assert "EqualTo(user_id,5)" in plan(topn.top_n(poses, 3))


def test_samples_are_filters(spark):
    df = S.table(spark, SF, "orders").select("o_orderkey")
    assert "Exchange" not in plan(sampling.exact_sample(df, "o_orderkey", 500, 1, bucket_rows=20))


def test_edges_are_subqueries_and_weights_are_looked_up(spark):
    assert "Join" not in plan(labels.label_extremes(q._poses(spark, SF), 1, 4))
    rows = spark.range(3).select(F.struct(F.lit(2).alias("size"), F.array(F.lit(0)).alias("ids"), F.array(F.lit(1.0)).alias("vals")).alias("features"))
    text = plan(LinearModel.dense(spark, [1.0, 2.0], 0.0).with_margin(rows))
    assert "Join" not in text and text.count("ArrowEvalPython") == 1


def test_long_lists_are_not_gathered_in_one_task(spark):
    poses = q._poses(spark, SF)
    text = plan(topn.select_best(poses, 500, bucket_rows=5))
    assert "TakeOrdered" in text  # of the few rows that are left
    text = plan(topn.select_best(poses.withColumn("score", F.lit(1.0)), 500, bucket_rows=5))
    assert "SinglePartition" not in text and "TakeOrdered" not in text and "GlobalLimit" not in text


def test_scores_of_a_file_build_no_blocks(spark, tmp_path):
    poses = sdf.read_poses(spark, SF, "Chemgauss4", ("row_key", "mol_id"))
    assert poses.columns == ["row_key", "mol_id", "raw", "score"]
    text = plan(poses.select("mol_id", "score", "row_key"))
    assert "named_struct(idx" not in text and "parity" not in text and "stereo" not in text and "M  CHG" not in text
    assert "parity" in plan(sdf.read_poses(spark, SF, "Chemgauss4"))


@pytest.mark.parametrize("name", ["top_semi_join", "top_n_payload", "pool_minus_scored", "hit_overlap", "conformal_p_values", "graph_vectors"])
def test_joins_are_hash_or_merge_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_tasks_become_more_and_not_longer(spark, tmp_path):
    from gleaner.operators.sets import fill_cores

    spark.range(0, 5000, 1, 16).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert fill_cores(rows, 200).rdd.getNumPartitions() == 25
    assert fill_cores(rows, 100_000).rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    assert fill_cores(rows, 200).distinct().count() == 5000


def test_new_molecules_with_signatures_keep_them(spark, monkeypatch):
    monkeypatch.setattr(recipes, "with_atom_signatures", None)  # nothing is signed again
    schema = "row_key string, signatures array<struct<height:int,signature:string>>"
    rows = spark.createDataFrame([("a", [(1, "x"), (1, "x"), (2, "y")]), ("b", [(1, "z")]), ("a", [(1, "x"), (1, "x"), (2, "y")])], schema)
    known = spark.createDataFrame([("x", 0), ("y", 1)], "signature string, sig_id bigint")
    weights = spark.createDataFrame([(0, 2.0), (1, 0.5)], "sig_id bigint, weight double")
    calibration = spark.createDataFrame([(0, 1.0), (1, 1.0)], "label int, alpha double")
    stored = models.StoredModel("t", "c", 1, LinearModel(weights, 0.25), 0.2, 2, calibration)
    for df in (rows, rows.dropDuplicates(["row_key"])):
        assert {(r.row_key, r.margin) for r in recipes.predict_new(df, known, stored).collect()} == {("a", 4.75), ("b", 0.25)}
        assert recipes.predict_new(df, known, stored).count() == 2


def test_signatures_are_counted_within_the_row_unless_keys_repeat(spark):
    assert "hashpartitioning(row_key" not in plan(q.signature_counts(spark, SF))
    schema = "row_key string, signatures array<struct<height:int,signature:string>>"
    rows = spark.createDataFrame([("a", [(1, "C()"), (2, "C:(x)"), (1, "C()"), (2, "C()")]), ("b", [(1, "C()")]), ("c", [])], schema)
    want = {("a", 1, "C()", 2), ("a", 2, "C:(x)", 1), ("a", 2, "C()", 1), ("b", 1, "C()", 1)}
    assert {tuple(r) for r in universe.counts_by_row(rows, rows.select("row_key")).collect()} == want
    twice = rows.unionByName(rows)
    assert {tuple(r) for r in universe.counts_by_row(twice, twice.select("row_key")).collect()} == {(*r[:3], 2 * r[3]) for r in want}


def test_scores_of_a_table_build_no_molecules(spark):
    """Molecules are built once, for the filter, whose rows are stored; what follows has no generator that builds them again."""
    assert "Generate" not in plan(q.filter_score_sort(spark, SF))


def test_records_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch):
    """Records come from a table that is small on disk; the driver would have to hold all of them to broadcast them."""
    plans = []
    monkeypatch.setattr(recipes, "write_sdf", lambda signed, path: plans.append(plan(signed)))
    recipes.signed_records(
        q._molecules_from_text(spark, SF, "row_key", "mol_id", "atoms", "bonds", "tags").drop("o_orderkey"), str(tmp_path / "r")
    )
    (text,) = plans
    assert "SortMergeJoin [row_key" in text and "BroadcastHashJoin" not in text
