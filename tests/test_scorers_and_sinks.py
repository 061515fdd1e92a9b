import sys
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions.descriptors import with_descriptors
from gleaner.functions.names import file_stem
from gleaner.functions.vectors import from_dense
from gleaner.operators import program, scorers
from gleaner.operators.conformal import calibration_table
from gleaner.operators.learner import LinearModel
from gleaner.plans import recipes
from gleaner.session import broadcast_within
from gleaner.sources import models, rules, sdf, sinks
from tests.test_records import IONS, LISTED, WATER

ECHO = [sys.executable, "-c", "import sys\nfor l in sys.stdin:\n  k, v = l.rstrip('\\n').split('\\t')\n  if v != 'skip': print(k, v, sep='\\t')"]


@pytest.fixture
def batch(spark):
    return spark.createDataFrame([(1, "2.5"), (2, "skip"), (3, "none"), (4, "7\n"), (5, None)], "row_key long, v string")


def test_external_scorer(spark, batch):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("10000", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = scorers.score_rows_with(scorers.external_scorer(ECHO, "v"), batch)
        assert {r.row_key: r.score for r in out.collect()} == {1: 2.5, 2: None, 3: None, 4: 7.0, 5: None}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize(
    "command, timeout", [([sys.executable, "-c", "import sys; sys.exit('broken')"], 60), ([sys.executable, "-c", "import time; time.sleep(60)"], 1)]
)
def test_a_failing_program_stops_the_job(spark, batch, command, timeout):
    run = scorers.external_scorer(command, "v", timeout=timeout)
    with pytest.raises(Exception):
        run(batch).collect()


def test_the_record_at_which_a_program_dies_is_named(spark):
    code = "import sys\nfor l in sys.stdin:\n  k, v = l.rstrip().split('\\t')\n  if v == 'poison': sys.exit('cannot read it')\n  print(k, 1.0, sep='\\t', flush=True)"
    df = spark.range(200).selectExpr("id AS row_key", "IF(id = 137, 'poison', 'food') AS v").coalesce(1)
    with pytest.raises(Exception, match="(?s)status 1 at the record with key '137'.*cannot read it"):
        scorers.external_scorer([sys.executable, "-c", code], "v")(df).collect()


def run(code, records, timeout=20.0):
    p = program.started([sys.executable, "-c", code], iter(records), timeout)
    return p, [] if p is None else p.lines()


def test_a_program_takes_and_gives_without_end():
    """Far more than any buffer holds, in and out, with memory for a few records."""
    handed = [0]

    def records():
        for i in range(200_000):
            handed[0] = i
            yield str(i), f"{i}\t{'x' * 100}\n"

    p, lines = run("import sys\nfor l in sys.stdin: sys.stdout.write(l)", records())
    furthest = 0
    for i, line in enumerate(lines):
        assert line.startswith(f"{i}\t")
        p.answered(str(i))
        furthest = max(furthest, len(p.waiting))
    assert i == 199_999 and furthest < 10_000


def test_programs_that_answer_late_out_of_order_or_not_at_all():
    late = "import sys\nfor l in reversed(sys.stdin.readlines()): sys.stdout.write(l)"
    p, lines = run(late, [(str(i), f"{i}\n") for i in range(5000)])
    assert [x.strip() for x in lines] == [str(i) for i in range(5000)][::-1]
    assert list(run("pass", [("1", "a\n")])[1]) == []
    assert program.started(["/no/such/program"], iter([]), 1.0) is None  # nothing to do, so nothing is started
    with pytest.raises(program.ProgramFailed, match="did nothing for 1.0 seconds at the record with key 'a'"):
        list(run("import time; time.sleep(60)", [("a", "x\n")], 1.0)[1])

    def slow():
        time.sleep(2.5)
        yield "a", "x\n"
        time.sleep(2.5)  # the program waits for its input, which is no fault of its own

    assert list(run("import sys\nfor l in sys.stdin: print(l.strip(), flush=True)", slow(), 1.0)[1]) == ["x\n"]

    def broken():
        yield "a", "x\n"
        raise KeyError("source")

    with pytest.raises(KeyError):
        list(run("import sys\nfor l in sys.stdin: pass", broken())[1])


def test_an_append_is_there_once(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("p", "c", "m 1", 2.0), ("q", "c", "m 2", 3.0)], schemas.DB_SCORES)
    assert sinks.read_appended(spark, path, schemas.DB_SCORES).count() == 0
    rows.limit(1).write.partitionBy("r_name").parquet(f"{path}/rows/run=b")  # a run that was killed half-way
    assert sinks.append_once(rows, path, "a") and not sinks.append_once(rows, path, "a")
    assert sinks.committed_runs(spark, path) == {"a"}
    assert sinks.append_once(rows, path, "b")
    got = sinks.read_appended(spark, path, schemas.DB_SCORES)
    assert sorted(map(tuple, got.select("run", "l_id", "r_name", "l_score").collect())) == [(r, m, p, s) for r in "ab" for m, p, s in (("m 1", "p", 2.0), ("m 2", "q", 3.0))]
    with pytest.raises(ValueError):
        sinks.append_once(rows, path, "a/b")


def test_the_same_by_sql():
    con = duckdb.connect()
    con.execute('CREATE TABLE scores ("l_id" VARCHAR, "l_score" DOUBLE)')
    for run_name, values in (("a", "('x', 1), ('x', 1)"), ("b", "('y', 2)")):
        for _ in range(2):
            con.execute(f"CREATE OR REPLACE TABLE staging AS SELECT *, '{run_name}' AS run FROM (VALUES {values}) v(l_id, l_score)")
            con.execute("BEGIN")
            for sql in sinks.merge_statements("scores", "staging", ["l_id", "l_score"]):
                con.execute(sql)
            con.execute("COMMIT")
    assert sorted(con.execute("SELECT * FROM scores").fetchall()) == [("x", 1.0), ("x", 1.0), ("y", 2.0)]


def test_best_of_several_answers(spark, batch):
    answers = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, float("nan"))], "row_key long, score double")
    out = scorers.score_rows_with(lambda b: answers, batch)
    assert {r.row_key: r.score for r in out.collect()} == {1: 3.0, 2: None, 3: None, 4: None, 5: None}


def test_stage_checks(spark):
    a = spark.createDataFrame([("k", "m", 1.0)], "row_key string, mol_id string, score double")
    assert schemas.union_stage([a, a, a], "pose").count() == 3
    with pytest.raises(ValueError):
        schemas.union_stage([a.drop("score")], "pose")
    with pytest.raises(ValueError):
        schemas.union_stage([], "pose")
    with pytest.raises(ValueError):
        schemas.require(a.withColumn("features", F.lit(1)), "candidate")


def test_output_tables(spark, tmp_path):
    poses = spark.createDataFrame([("m 1", 2.0), ("m 2", None)], "mol_id string, score double")
    out = sinks.score_rows(poses, "/data/x/prot.v2.bin", "1abc")
    assert out.columns == schemas.DB_SCORES.names and not any(f.nullable for f in out.schema.fields)
    assert [tuple(r) for r in out.orderBy("l_id").collect()] == [("prot.v2", "1abc", "m 1", 2.0), ("prot.v2", "1abc", "m 2", -1.7976931348623157e308)]
    for _ in range(2):
        sinks.append_parquet(out, str(tmp_path / "t"))
    assert sinks.read_table(spark, str(tmp_path / "t")).count() == 4
    with pytest.raises(Exception, match="l_id is missing"):
        sinks.score_rows(poses.withColumn("mol_id", F.lit(None).cast("string")), "x", "1abc").collect()
    names = spark.createDataFrame([("a/b.c.d",), ("plain",), ("dir/.hidden",)], "p string").select(file_stem(F.col("p")).alias("n"))
    assert [r.n for r in names.collect()] == ["b.c", "plain", ".hidden"]


def test_single_part_report(spark, tmp_path):
    sinks.write_single(spark.range(100).orderBy(F.desc("id")).limit(3), str(tmp_path / "top"), F.col("id").cast("string"))
    parts = list((tmp_path / "top").glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text() == "99\n98\n97\n"


def test_model_table(spark, tmp_path):
    path = str(tmp_path / "models")
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (2, [0.0, -3.0], 0.0)], "row_key long, x array<double>, label double")
    rows = rows.select("row_key", "label", from_dense(F.col("x")).alias("features"))
    model = LinearModel.dense(spark, [1.0, 0.5], -0.25)
    cal = calibration_table(model.with_margin(rows), F.col("margin"))
    for version in (1, 2, 2):  # storing a version again replaces it
        models.save_model(path, models.StoredModel("t", "c", version, model, 0.2, 2, cal))
    stored = models.load_model(spark, path, "t", "c")
    assert (stored.version, stored.model.intercept, stored.calibration.count()) == (2, -0.25, 2)
    assert sorted(map(tuple, stored.model.weights.collect())) == [(0, 1.0), (1, 0.5)]
    assert models.load_model(spark, path, "t", "c", 1).version == 1
    out = {r.row_key: (r.margin, r.p0, r.p1) for r in models.predict_with(stored, rows).collect()}
    assert out == {1: (1.75, 0.5, 1.0), 2: (-1.75, 1.0, 0.5)}
    with pytest.raises(LookupError):
        models.load_model(spark, path, "t", "other")


def test_broadcast_bound(spark):
    df = spark.range(5)
    assert "ResolvedHint" in broadcast_within(df, 5)._jdf.queryExecution().analyzed().toString()
    assert broadcast_within(df, 4) is df


def test_recipes_on_files(spark, tmp_path):
    text = "".join(f"{r}$$$$\n" for r in (WATER, IONS, LISTED, WATER.replace("-6.5", "-3.0")))
    a, b = tmp_path / "a.sdf", tmp_path / "b.sdf"
    a.write_text(text)
    b.write_text(f"{WATER}$$$$\n")
    hits = recipes.top_of_file(spark, str(a), "Chemgauss4", 1).collect()
    assert [(h.mol_id, h.score) for h in hits] == [("water 1", -3.0)] and hits[0].raw.startswith("water 1")
    assert tuple(recipes.compare_files(spark, str(a), str(b), 10).first()) == (2, 1, 20.0)
    assert recipes.sample_records(spark, str(a), 2).count() == 2
    mols = sdf.read_molecules(spark, str(a))
    scores = mols.select("row_key", F.size("atoms").cast("double").alias("score"))
    top = recipes.filter_score_sort(
        with_descriptors(mols), rules.parse_rules("MAX_SUM_FORMAL_CRG 0"), scorers.table_scorer(scores), 2, str(tmp_path / "kept")
    )
    assert [r.score for r in top.collect()] == [3.0, 3.0]
