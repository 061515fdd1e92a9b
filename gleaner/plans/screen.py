"""The learned screening loop.

Sample, score, label the score extremes, train, calibrate, predict a label set for every candidate, drop those that are
confidently poor, and stop when the predictions have become decisive. At the end the confidently good ones are scored.

How it stays cheap on a very large table:

* Candidates are stored once, in folders by range of a hash of their key and sorted by it. Samples are taken in hash order,
  so a cycle reads the files of the ranges between the last sample and the next, and everything already scored lies behind.
* Nothing is subtracted from the stored table, and no predictions are kept of a cycle that goes on. A candidate is out of the
  pool if an earlier cycle predicted it poor; the earlier models are asked again, for the few rows that come up for sampling.
* A cycle makes one pass over the features, without a shuffle, and returns one row of counts. Only the last one's predictions are
  written.
* Every step ends in a table in the shared folder, so lost executors cost a task, and plans do not grow with the cycles. Tables
  that only served the loop are deleted at its end.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions.hashing import HASH_BITS, HASH_SPAN, hash_rank
from gleaner.operators import conformal
from gleaner.operators.labels import check_bins, label_extremes
from gleaner.operators.learner import LinearModel, LinearSVM, Learner
from gleaner.operators.sampling import cut_at, with_split, with_stratified_split
from gleaner.operators.scorers import Scorer, score_rows_with
from gleaner.session import Workspace

_SLACK = 1.5  # how far beyond the expected place the first look for a sample goes
_RANGE_BITS = 8  # candidates are stored in 2 ** 8 ranges of hashes; a sample lies in one of them or a few


@dataclass(frozen=True)
class ScreenParams:
    initial_size: int = 100
    increment_size: int = 50
    calibration: float = 0.3
    bad_bin: int = 1
    good_bin: int = 4
    significance: float = 0.2
    single_cycle: bool = False
    stratified: bool = False
    edges: str = "batch"  # or "cumulative"
    efficiency_target: float = 0.8
    decisive_cycles: int = 2
    max_cycles: int | None = None  # None: until the predictions are decisive or the pool is empty
    seed: int = 11
    unique_keys: bool = False  # True: row_key is known to be unique, so the grouping of copies is left out

    def __post_init__(self):
        check_bins(self.bad_bin, self.good_bin)
        if self.edges not in ("batch", "cumulative"):
            raise ValueError("edges is 'batch' or 'cumulative'")
        if min(self.initial_size, self.increment_size, 1 if self.max_cycles is None else self.max_cycles, self.decisive_cycles) < 1:
            raise ValueError("sizes and cycle counts must be positive")


@dataclass
class Cycle:
    cycle: int
    sampled: int
    labelled: int
    trained: bool
    efficiency: float | None = None
    blocked: list[int] = field(default_factory=list)  # classes with too few calibration rows ever to be rejected


@dataclass
class ScreenResult:
    """``scored``: row_key, mol_id, score, cycle. ``predictions``: of the last trained cycle, for all candidates.

    ``history``: of every trained cycle, its number, model and calibration.
    """

    scored: DataFrame
    predictions: DataFrame | None
    calibration: DataFrame | None
    model: LinearModel | None
    cycles: list[Cycle]
    stop_reason: str
    workspace: Workspace
    history: list[tuple[int, LinearModel, conformal.Calibration]] = field(default_factory=list)

    def cycles_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c.cycle, c.sampled, c.labelled, c.trained, c.efficiency) for c in self.cycles]
        ddl = "cycle int, sampled bigint, labelled bigint, trained boolean, efficiency double"
        return spark.createDataFrame(rows, ddl).coalesce(1)


class _Loop:
    def __init__(self, candidates: DataFrame, scorer: Scorer, params: ScreenParams, learner: Learner, ws: Workspace, scorer_columns: list[str]):
        self.spark = candidates.sparkSession
        self.scorer, self.params, self.learner, self.ws = scorer, params, learner, ws
        self.payload = [c for c in scorer_columns if c not in ("row_key", "mol_id", "features")]
        self.pool = self._store_candidates(candidates)
        self.total = self.pool.count()
        self.history: list[tuple[int, LinearModel, conformal.Calibration]] = []
        self.frontier = -1  # hash rank of the last row sampled; everything up to it has been dealt with

    def _store_candidates(self, candidates: DataFrame) -> DataFrame:
        table = candidates.select("row_key", "mol_id", "features", *self.payload)
        if self.params.unique_keys:
            table = table.withColumn("copies", F.lit(1).cast("bigint"))
        else:
            # Equal keys are copies of one record: scored once, counted in full. Combined before the shuffle.
            rest = [c for c in table.columns if c != "row_key"]
            firsts = [F.first(c).alias(c) for c in rest]
            table = table.groupBy("row_key").agg(*firsts, F.count(F.lit(1)).alias("copies"))
        ranked = table.withColumn("u", hash_rank("row_key", self.params.seed)).withColumn("part", F.shiftright("u", HASH_BITS - _RANGE_BITS).cast("int"))
        placed = ranked.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "u").sortWithinPartitions("part", "u")
        path = self.ws.table_path("candidates")
        placed.write.partitionBy("part").parquet(path)
        return self.spark.read.schema(placed.schema).parquet(path)

    def _window(self, low: int, high: int) -> DataFrame:
        """Stored candidates with ``low`` < u <= ``high``; other ranges' files aren't opened."""
        shift = HASH_BITS - _RANGE_BITS
        parts = F.col("part").between(max(low + 1, 0) >> shift, high >> shift)
        return self.pool.filter(parts & (F.col("u") > low) & (F.col("u") <= high))

    def _not_dropped(self, rows: DataFrame) -> DataFrame:
        """``rows`` without those that an earlier cycle predicted poor: its model judges them once more."""
        for _, model, calibration in self.history:
            judged = conformal.with_predictions(conformal.with_p_values(model.with_margin(rows), calibration), self.params.significance)
            rows = judged.filter(F.col("verdict") != "BAD").select(*rows.columns)
        return rows

    def _sample(self, cycle: int, size: int) -> DataFrame:
        """The next ``size`` pool rows in hash order, stored with features and payload."""
        reach = max(1, int(HASH_SPAN * size * _SLACK / max(self.total, 1)))
        attempt = 0
        while True:
            attempt += 1
            high = min(HASH_SPAN - 1, self.frontier + reach)
            window = self._window(self.frontier, high)
            keys = self._not_dropped(window.select("row_key", "u", "features")).select("row_key", "u")
            keys = self.ws.write(keys, f"window/cycle={cycle}-{attempt}")
            if high >= HASH_SPAN - 1 or keys.count() >= size:
                break
            reach *= 4
        last = cut_at(keys.select(F.col("u").alias("_rank")), size)
        self.frontier = HASH_SPAN if last is None else last[0]  # keys are unique: all rows up to it are taken
        chosen = keys.filter(F.col("u") <= self.frontier)
        rows = window.filter(F.col("u") <= self.frontier).drop("part").join(chosen.select("row_key"), "row_key")
        return self.ws.write(rows, f"sample/cycle={cycle}")

    def _score(self, rows: DataFrame, cycle: int) -> DataFrame:
        """Scores rows once and stores them; later reads never run the scorer again."""
        given = rows.select("row_key", "mol_id", *self.payload)
        scores = score_rows_with(self.scorer, given)
        scored = rows.select("row_key", "mol_id").join(scores, "row_key").withColumn("cycle", F.lit(cycle))
        return self.ws.write(scored, f"scored/cycle={cycle}")

    def _scored(self, upto: int) -> DataFrame:
        out = self.ws.read("scored/cycle=1")
        for cycle in range(2, upto + 1):
            out = out.unionByName(self.ws.read(f"scored/cycle={cycle}"))
        return out

    def _label(self, sample: DataFrame, scored: DataFrame, cycle: int) -> DataFrame:
        p = self.params
        edges_from = self._scored(cycle) if p.edges == "cumulative" else None
        labels = label_extremes(scored, p.bad_bin, p.good_bin, edges_from=edges_from).select("row_key", "label")
        rows = sample.select("row_key", "features").join(labels, "row_key")
        return self.ws.write(rows, f"labelled/cycle={cycle}")

    def _labelled(self, upto: int) -> DataFrame:
        """All training rows so far, each on its side of the split."""
        p = self.params
        rows = self.ws.read("labelled/cycle=1")
        for cycle in range(2, upto + 1):
            rows = rows.unionByName(self.ws.read(f"labelled/cycle={cycle}"))
        if p.stratified:
            return with_stratified_split(rows, "row_key", "label", p.calibration, p.seed + 1)
        return with_split(rows, "row_key", p.calibration, p.seed + 1)

    def _train(self, cycle: int) -> tuple[LinearModel, DataFrame, dict[int, int]] | None:
        """Model and stored calibration table; None while a class has no training row."""
        sides = self._labelled(cycle)
        counts = sides.groupBy("side", "label").count().collect()
        proper = {r["label"] for r in counts if r["side"] == "proper"}
        if proper != {0.0, 1.0}:
            return None
        model = self.learner.fit(sides.filter(F.col("side") == "proper"))
        held = sides.filter(F.col("side") == "calibration")
        table = conformal.calibration_table(model.with_margin(held), F.col("margin"))
        calibration = self.ws.write(table, f"calibration/cycle={cycle}")
        sizes = {int(r["label"]): r["count"] for r in counts if r["side"] == "calibration"}
        return model, calibration, sizes

    def _predicted(self, model: LinearModel, calibration: conformal.Calibration, cycle: int) -> DataFrame:
        """Predictions of all candidates, one pass without a shuffle."""
        rows = model.with_margin(self.pool).select("row_key", "mol_id", "u", "copies", "margin")
        with_p = conformal.with_p_values(rows, calibration)
        return conformal.with_predictions(with_p, self.params.significance).drop("margin").withColumn("cycle", F.lit(cycle))

    def run(self) -> ScreenResult:
        p = self.params
        self.cycles: list[Cycle] = []
        decisive, reason = 0, "max_cycles"
        for cycle in itertools.count(1) if p.max_cycles is None else range(1, p.max_cycles + 1):
            sample = self._sample(cycle, p.initial_size if cycle == 1 else p.increment_size)
            sampled = sample.count()
            if sampled == 0:
                reason = "pool empty"
                break
            scored = self._score(sample, cycle)
            labelled = self._label(sample, scored, cycle)
            entry = Cycle(cycle, sampled, labelled.count(), trained=False)
            self.cycles.append(entry)
            trained = self._train(cycle)
            if trained is not None:
                model, table, sizes = trained
                calibration = conformal.Calibration.of(table)
                entry.trained = True
                entry.blocked = [c for c in conformal.CLASSES if 1.0 / (sizes.get(c, 0) + 1) > p.significance]
                entry.efficiency = conformal.efficiency(self._predicted(model, calibration, cycle), F.col("copies")).first()["efficiency"]
                self.history.append((cycle, model, calibration))
                decisive = decisive + 1 if (entry.efficiency or 0.0) >= p.efficiency_target else 0
            if decisive >= p.decisive_cycles:
                reason = "converged"
                break
            if p.single_cycle:
                reason = "single cycle"
                break
        predictions = calibration = model = None
        if self.history:
            cycle, model, known = self.history[-1]
            predictions = self.ws.write(self._predicted(model, known, cycle), "predictions")
            calibration = known.table
        scored = self._finish(predictions)
        self.ws.remove("candidates", "window", "sample", "labelled", "final_good")
        return ScreenResult(scored, predictions, calibration, model, self.cycles, reason, self.ws, self.history)

    def _finish(self, predictions: DataFrame | None) -> DataFrame:
        """Scores what the last predictions call good and is not scored yet; returns all scores."""
        last = len(self.cycles)
        if last == 0:
            none = self.pool.select("row_key", "mol_id", F.lit(None).cast("double").alias("score"), F.lit(0).alias("cycle"))
            return self.ws.write(none.limit(0), "scored/none")
        scored = self._scored(last)
        if predictions is None:
            return scored
        good = predictions.filter(F.col("verdict") == "GOOD").select("row_key", "mol_id")
        fresh = good.join(scored.select("row_key"), "row_key", "left_anti")
        if self.payload:
            fresh = fresh.select("row_key").join(self.pool.select("row_key", "mol_id", *self.payload), "row_key")
        final = self._score(self.ws.write(fresh, "final_good"), last + 1)
        return scored.unionByName(final)


def screen(
    candidates: DataFrame,
    scorer: Scorer,
    params: ScreenParams | None = None,
    learner: Learner | None = None,
    scorer_columns: list[str] | None = None,
    workspace: Workspace | None = None,
) -> ScreenResult:
    """Runs the loop on candidates (row_key, mol_id, features). ``scorer_columns``: further columns the scorer reads."""
    schemas.require(candidates, "candidate")
    ws = workspace or Workspace(candidates.sparkSession, "screen")
    loop = _Loop(candidates, scorer, params or ScreenParams(), learner or LinearSVM(), ws, scorer_columns or [])
    return loop.run()
