"""Blocks of plain records, read and written column by column, against the expressions that do the others."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import blocks
from gleaner.plans import recipes
from gleaner.plans import stand_in as S
from gleaner.sources import sdf, sinks

SF = "/root/testdata/sf0.001"


def changed(texts, seed=7):
    """The records with other line ends, and with characters and lines changed, cut off, added and taken out."""
    rnd, out = random.Random(seed), []
    for k, text in enumerate(texts):
        lines = text.replace("\n", "\r\n" if k % 6 == 1 else "\n").split("\n")
        for _ in range(rnd.randint(1, 3)):
            i, how = rnd.randrange(rnd.choice([6, len(lines)])), rnd.random()
            j = rnd.randrange(len(lines[i]) + 1)
            put = rnd.choice("0123456789 .eENMé\t\r+" + "-" * (i != 3))
            lines[i] = {0: lines[i][:j] + put + lines[i][j + 1 :], 1: lines[i][:j], 2: lines[i][:j] + put + lines[i][j:]}.get(int(how * 4), "M  CHG  1   1  -1" if i > 3 else lines[i])
        out.append("\n".join(lines))
    return out


@pytest.fixture(scope="module")
def records(spark):
    texts = [r.raw for r in sdf.explode_records(S.sdf_chunks(spark, SF).limit(150), "chunk").select("raw").collect()]
    atom = lambda x, y, z, rest: f"x\nh\r\n\n  1  0  0  V2000\n{x:>10}{y:>10}{z:>10} {rest}\nM  END"
    odd = ["", "M  END", "a\nb\nc\n", "\n\n\n  0  0  0     1  0  0  0  0  0999 V2000\nM  END\n", "\n\n\n  0  0V2000\nM  END", None, texts[0].replace("M  END", "M  EN")]
    odd += [atom("1.0000", "-2.5", "-0", "Xe  0  3  1  0"), atom("1.", "-.5", "3", "C   0  7  1"), atom("11", "--2.5", "3.2-2", "C   0  0  0"), atom("1e1", "NaN", "3", "C   0  0  0")]
    odd += [atom("1", "2", "3", " C  0  0  0"), atom("1", "2", "3", "C   0        "), atom("1 ", "2", "3", "é   0  1  0"), atom("9999999999", "0.00000001", "-12.345678", "Cl  0  5  0")]
    return texts + changed(texts * 2) + odd


@pytest.mark.parametrize("wanted", [sdf.COLUMNS, ("parse_ok", "header"), ("bonds",), ("atoms", "header")])
@pytest.mark.parametrize("size", [3000, 8 << 20])
def test_plain_records_are_read_as_the_others(spark, records, monkeypatch, wanted, size):
    df = spark.createDataFrame(list(enumerate(records)), "k int, raw string")
    monkeypatch.setattr(blocks, "_PIECE_BYTES", size)
    found = blocks.plain_blocks(pa.array(records), ("atoms", "bonds")).field("plain").to_pylist()
    assert all(found[:300]) and 50 < sum(found[300:]) < len(found[300:]) - 50
    got = {r.k: repr(r) for r in sdf.parse_molecules(df, wanted).collect()}
    known = blocks.plain_blocks
    none = lambda raw, which: known(pa.array([""] * len(raw)), which)
    monkeypatch.setattr(sdf, "plain_blocks", none)
    assert got == {r.k: repr(r) for r in sdf.parse_molecules(df, wanted).collect()}


def test_an_end_across_records_is_none():
    texts = ["x\ny\n\n  0  0  0  V2000\nM  E", "ND\n"]
    assert blocks.plain_blocks(pa.array(texts), ()).field("plain").to_pylist() == [False, False]


def test_lines_of_most_molecules_are_those_of_the_others(spark, tmp_path, monkeypatch):
    """Orders without a date, a price or a priority, and with more digits than there are lines for."""
    orders, key = spark.read.parquet(f"{SF}/orders.parquet"), F.col("o_orderkey")
    orders = orders.withColumn("o_totalprice", F.when(key % 5 == 1, 9e16).when(key % 5 != 2, F.col("o_totalprice")))
    orders = orders.withColumn("o_orderdate", F.when(key % 7 != 1, F.col("o_orderdate"))).withColumn("o_orderpriority", F.when(key % 9 != 1, F.col("o_orderpriority")))
    orders.withColumn("o_orderkey", F.when(key % 11 != 1, key)).write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(map(repr, S.sdf_chunks(spark, str(tmp_path)).collect()))
    known = S.block_lines
    monkeypatch.setattr(S, "block_lines", lambda texts: known(pa.array(["-"] * len(texts))))
    assert got == sorted(map(repr, S.sdf_chunks(spark, str(tmp_path)).collect())) and len(got) == orders.count()
    odd = known(pa.array(["12", "1", "", None, "1-2", "1" * 63, "1" * 64]))
    assert odd.field("plain").to_pylist() == [True, False, False, False, False, True, False]


def test_the_top_of_a_file_parses_it_once(spark, tmp_path):
    """The second look at the file, for the hits' texts, needs their keys alone."""
    sinks.write_texts(S.sdf_chunks(spark, SF).select("chunk"), str(tmp_path / "f"), 1000)
    hits = recipes.top_of_file(spark, str(tmp_path / "f"), "Chemgauss4", 10)
    text = hits._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "ArrowEvalPython" not in text
    assert hits.count() == 10 and hits.filter(F.md5("raw") != F.col("row_key")).isEmpty()
