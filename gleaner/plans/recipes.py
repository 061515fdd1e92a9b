"""Whole jobs over the operators. Each is a few calls; none adds logic of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.descriptors import with_smiles_descriptors
from gleaner.functions.names import file_stem
from gleaner.functions.records import DELIMITER, first_line, set_tag
from gleaner.functions.signatures import with_atom_signatures
from gleaner.functions.vectors import vector_text
from gleaner.operators.overlap import hit_overlap
from gleaner.operators.rules import rule_filter
from gleaner.operators.sampling import exact_sample, fraction_sample
from gleaner.operators.scorers import Scorer, score_rows_with
from gleaner.operators.sets import spread
from gleaner.operators.topn import attach_payload, rank_order, sort_by_score, top_n
from gleaner.operators.universe import count_vectors, stored_universe
from gleaner.plans.screen import ScreenParams, ScreenResult, screen
from gleaner.session import Workspace
from gleaner.sources import sdf
from gleaner.sources.models import StoredModel, predict_with, save_model
from gleaner.sources.rules import Rule
from gleaner.sources.sinks import append_once, prediction_rows, score_rows, stored, write_sdf, write_single


def distinct_records(molecules: DataFrame) -> DataFrame:
    """One row per record text. Copies are dropped before the shuffle wherever they meet in a task."""
    return molecules.dropDuplicates(["row_key"])


def featurise(molecules: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """(features by row_key, dictionary) of a molecule table; the signatures are computed once and stored."""
    signed = with_atom_signatures(distinct_records(molecules).select("row_key", "mol_id", "atoms", "bonds"))
    rows = workspace.write(signed.select("row_key", "mol_id", "signatures"), "signatures")
    universe = stored_universe(rows, workspace)
    # By its compressed size a stored table looks light; no side of these joins is one for the driver to broadcast.
    features = count_vectors(rows, universe).join(rows.select("row_key", "mol_id").hint("merge"), "row_key")
    return workspace.write(features, "features"), universe


def learned_screening(
    molecules: DataFrame, scorer: Scorer, n: int, params: ScreenParams | None = None, scorer_columns: list[str] | None = None
) -> tuple[DataFrame, ScreenResult]:
    """Signatures, then the loop, then the best ``n`` ids; ``store_screening`` writes what it leaves behind."""
    ws = Workspace(molecules.sparkSession, "screening")
    features, _ = featurise(molecules, ws)
    candidates = features
    if scorer_columns:
        payload = distinct_records(molecules).select("row_key", *scorer_columns)
        candidates = features.join(payload, "row_key")
    params = params or ScreenParams(unique_keys=True)
    result = screen(candidates, scorer, params, scorer_columns=scorer_columns, workspace=ws)
    return top_n(result.scored, n), result


def store_screening(
    result: ScreenResult,
    n: int,
    path: str,
    target_path: str,
    code: str,
    run: str,
    significance: float = 0.2,
    universe_size: int = 0,
    version: int = 1,
    records: DataFrame | None = None,
    reference: DataFrame | None = None,
) -> DataFrame:
    """Everything that a screen leaves behind, below ``path``; returns the best ``n`` ids.

    ``predictions`` and ``scores``, appended once under the name ``run``; the last model with its calibration in ``models``; the
    hits as one text file, ``hits``, best first, with the record text where ``records`` (row_key, raw) is given; and their
    overlap with the ids of ``reference`` (mol_id) in ``overlap``. Repeating it with the same run adds nothing twice.
    """
    spark = result.scored.sparkSession
    hits = stored(top_n(result.scored, n), f"{path}/top")
    if result.predictions is not None:
        append_once(prediction_rows(result.predictions, target_path, code), f"{path}/predictions", run)
    append_once(score_rows(result.scored, target_path, code), f"{path}/scores", run)
    if result.model is not None:
        name = spark.range(1).select(file_stem(F.lit(target_path)).alias("name")).first()["name"]
        save_model(path, StoredModel(name, code, version, result.model, significance, universe_size, result.calibration))
    best_first = hits.orderBy(*rank_order())
    line = F.concat_ws("\t", F.col("mol_id").cast("string"), F.col("score").cast("string"))
    if records is not None:
        best_first, line = attach_payload(hits, records.select("row_key", "raw")), F.concat("raw", F.lit(DELIMITER))
    write_single(best_first, f"{path}/hits", line, mode="overwrite")
    if reference is not None:
        hit_overlap(hits.select("mol_id"), reference.select("mol_id"), n).write.mode("overwrite").parquet(f"{path}/overlap")
    return hits


def signed_records(molecules: DataFrame, path: str, workspace: Workspace | None = None) -> DataFrame:
    """Signatures only: writes every record with its count vector as a data item; returns the dictionary.

    ``sdf.read_featured`` reads vectors back, so signatures and learning can be jobs of their own.
    """
    features, universe = featurise(molecules, workspace or Workspace(molecules.sparkSession, "signed"))
    texts = features.select("row_key", vector_text(F.col("features")).alias("_vector"))
    signed = molecules.join(texts.hint("merge"), "row_key").withColumn("tags", set_tag(F.col("tags"), sdf.SIGNATURE_TAG, F.col("_vector")))
    write_sdf(signed, path)
    return universe


def plain_screening(
    molecules: DataFrame, scorer: Scorer, n: int, fraction: float = 1.0, seed: int = 11, poses_path: str | None = None
) -> DataFrame:
    """Optional sample, score everything, best ``n`` ids. Scores are stored, as each costs far more than its bytes."""
    work = Workspace(molecules.sparkSession, "poses")
    chosen = work.write(spread(fraction_sample(molecules, "row_key", fraction, seed)), "chosen")
    poses = chosen.select("row_key", "mol_id").join(score_rows_with(scorer, chosen), "row_key")
    return top_n(stored(poses, poses_path or work.table_path("poses")), n)


def filter_score_sort(molecules: DataFrame, rules: list[Rule], scorer: Scorer, n: int, path: str) -> DataFrame:
    """Rule filter, save, score, sort, first ``n``."""
    kept = stored(rule_filter(molecules, rules), path)
    scores = score_rows_with(scorer, spread(kept))
    poses = kept.select("row_key", "mol_id").join(scores, "row_key")
    return sort_by_score(poses).limit(n)


def standardise(smiles: DataFrame, custom: list[Rule], preset: list[Rule], partitions: int | None = None) -> DataFrame:
    """Custom filter, preset filter, even partitions for the work that follows."""
    described = with_smiles_descriptors(smiles)
    return spread(rule_filter(rule_filter(described, custom), preset), partitions).select(*smiles.columns)


def top_of_file(spark: SparkSession, path: str, method: str, n: int) -> DataFrame:
    """Best ``n`` ids of a scored file with their record text, one row per id, best first."""
    poses = sdf.read_poses(spark, path, method, ("row_key", "mol_id"))
    texts = sdf.scan_records(spark, path).select(F.md5("raw").alias("row_key"), "raw")  # the key of a record; nothing is parsed again
    return attach_payload(top_n(poses.select("row_key", "mol_id", "score"), n), texts)


def compare_files(spark: SparkSession, first: str, second: str, n: int) -> DataFrame:
    """Overlap of the ids in two files."""
    ids = [sdf.scan_records(spark, p).select(first_line(F.col("raw")).alias("mol_id")) for p in (first, second)]
    return hit_overlap(ids[0], ids[1], n)


def sample_records(spark: SparkSession, path: str, n: int, seed: int = 1234) -> DataFrame:
    """``n`` records of a file, by hash."""
    rows = sdf.scan_records(spark, path).withColumn("row_key", F.md5("raw"))
    return exact_sample(rows, "row_key", n, seed)


def first_records(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Any ``n`` records of a file; no more of it is read than they need."""
    return sdf.scan_records(spark, path).limit(n)


def predict_new(molecules: DataFrame, universe: DataFrame, model: StoredModel, significance: float = 0.5) -> DataFrame:
    """Features over the stored dictionary and the predictions of a stored model, one row per key.

    Molecules that come with their ``signatures``, which should be a stored table then, keep them; those of others are
    computed once and stored. A table with signatures is shuffled whole only if keys repeat in it.
    """
    if "signatures" in molecules.columns:
        rows = molecules.select("row_key", "signatures")
        if not rows.groupBy("row_key").count().filter("count > 1").isEmpty():
            rows = distinct_records(rows)
    else:
        signed = with_atom_signatures(distinct_records(molecules.select("row_key", "atoms", "bonds")))
        rows = Workspace(molecules.sparkSession, "predict").write(signed.select("row_key", "signatures"), "signatures")
    return predict_with(model, count_vectors(rows, universe), significance=significance)
