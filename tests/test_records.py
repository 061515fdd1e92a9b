import pytest
from pyspark.sql import functions as F

from gleaner.functions import records as R
from gleaner.sources import sdf, sinks


def atom(x, element, code=0, parity=0):
    return f"{x:10.4f}{0:10.4f}{0:10.4f} {element:<3} 0{code:3d}{parity:3d}  0  0  0"


def bond(a, b, order=1):
    return f"{a:3d}{b:3d}{order:3d}  0"


def record(title, atoms, bonds, items=(), extra=(), end="M  END"):
    lines = [title, "  hand made", "", f"{len(atoms):3d}{len(bonds):3d}  0     1  0  0  0  0  0999 V2000"]
    lines += atoms + bonds + list(extra) + ([end] if end else [])
    for name, value in items:
        lines += [f"> <{name}>", *value.split("\n"), ""]
    return "\n".join(lines) + "\n"


WATER = record("water 1", [atom(0, "O"), atom(1, "H"), atom(2, "H")], [bond(1, 2), bond(1, 3)], [("Chemgauss4", "-6.5")])
IONS = record("ions", [atom(0, "N", 3), atom(1, "O", 5)], [bond(1, 2)], [("Chemgauss4", "")])
LISTED = record("listed", [atom(0, "N", 3), atom(1, "O"), atom(2, "C")], [bond(1, 2), bond(2, 3)], extra=["M  CHG  2   2  -1   3   2"])
NO_COUNTS = "water 1\n  hand made\n\n" + atom(0, "O") + "\n"
NO_END = record("open", [atom(0, "O")], [], end=None)
BLANK_TITLE = record("", [atom(0, "C")], [], [("A", "first\nsecond"), ("B", "x"), ("A", "last")])


def parsed(spark, *texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return sdf.parse_molecules(spark.createDataFrame(rows, "i int, raw string")).orderBy("i").collect()


def test_good_record(spark):
    (row,) = parsed(spark, WATER)
    assert row.parse_ok and row.mol_id == "water 1" and row.header == "  hand made"
    assert [a.element for a in row.atoms] == ["O", "H", "H"] and [a.x for a in row.atoms] == [0.0, 1.0, 2.0]
    assert [(b.a, b.b, b.ord) for b in row.bonds] == [(1, 2, 1), (1, 3, 1)]
    assert row.tags == {"Chemgauss4": "-6.5"}


def test_charges_from_codes_and_from_lines(spark):
    ions, listed = parsed(spark, IONS, LISTED)
    assert [a.charge for a in ions.atoms] == [1, -1]
    assert [a.charge for a in listed.atoms] == [0, -1, 2]  # charge lines replace every code


def test_unreadable_records_stay(spark):
    rows = parsed(spark, NO_COUNTS, NO_END)
    assert [r.parse_ok for r in rows] == [False, False]
    assert [r.mol_id for r in rows] == ["water 1", "open"]
    assert all(r.atoms == [] and r.bonds == [] for r in rows)


def test_blank_title_and_repeated_items(spark):
    (row,) = parsed(spark, BLANK_TITLE)
    assert row.mol_id is None and row.parse_ok
    assert row.tags == {"A": "last", "B": "x"}


def test_multi_line_item(spark):
    (row,) = parsed(spark, record("m", [atom(0, "C")], [], [("Note", "one\ntwo")]))
    assert row.tags == {"Note": "one\ntwo"}


def test_wide_counts_and_coordinates_have_no_separator(spark):
    atoms = [f"{-1000.5:10.4f}{-2000.25:10.4f}{-3000.125:10.4f} Cl  0  0  0" for _ in range(120)]
    bonds = [bond(i, i + 1) for i in range(1, 101)] + [bond(100, 102)] * 10
    (row,) = parsed(spark, record("big", atoms, bonds))
    assert row.parse_ok and len(row.atoms) == 120 and len(row.bonds) == 110
    assert (row.atoms[0].x, row.atoms[0].y, row.atoms[0].z) == (-1000.5, -2000.25, -3000.125)


def test_splitting_text(spark):
    text = f"{WATER}$$$$\n{IONS}$$$$\n\n$$$$\n{LISTED}"
    df = spark.createDataFrame([(text,), ("",), (" \n ",)], "chunk string")
    assert [r.raw for r in sdf.explode_records(df, "chunk").collect()] == [WATER, IONS, LISTED]


def test_file_scan_is_the_same_for_any_split_and_line_end(spark, tmp_path):
    body = "$$$$\n".join(record(f"mol {i}", [atom(i, "C")], [], [("Chemgauss4", str(-i))]) for i in range(200))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, text in {"lf": body + "$$$$\n", "crlf": (body + "$$$$\n").replace("\n", "\r\n"), "open": body}.items():
        path = tmp_path / f"{name}.sdf"
        path.write_bytes(text.encode())
        for size in ("128m", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            poses = sdf.read_poses(spark, str(path), "Chemgauss4").select("mol_id", "score", "parse_ok")
            assert sorted((r.mol_id, r.score) for r in poses.collect()) == sorted((f"mol {i}", float(-i)) for i in range(200))
            assert poses.filter("parse_ok").count() == 200
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        ends = 199 if name == "open" else 200
        assert sdf.count_records(spark, str(path)).first().n_records == ends


def test_write_and_read_again(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(WATER,), (IONS,)], "raw string")
    mols = sdf.parse_molecules(df).withColumn("tags", R.set_tag(F.col("tags"), "Signature", F.lit("(9,[1,4],[2.0,1.0])")))
    sinks.write_sdf(mols.withColumn("tags", R.set_tag(F.col("tags"), "Label", F.lit("1.0"))), path)
    back = sdf.read_featured(spark, path).orderBy("mol_id").collect()
    assert [r.mol_id for r in back] == ["ions", "water 1"]
    assert all(r.label == 1.0 and r.features.ids == [1, 4] and r.features.vals == [2.0, 1.0] for r in back)
    assert back[1].tags["Chemgauss4"] == "-6.5"


def test_a_value_line_may_begin_with_the_header_sign(spark):
    (row,) = parsed(spark, record("t", [atom(0, "C")], [], [("A", "first\n> quoted\nlast"), ("B", "x")]))
    assert row.tags == {"A": "first\n> quoted\nlast", "B": "x"}


def test_layers_agree_with_the_whole_record(spark, tmp_path):
    broken = WATER.replace("V2000", "V3000"), WATER.replace("M  END", "M  ENT"), WATER.replace("0.0000", "0.0x00", 1), "x\n\n\nno counts", WATER[:40]
    path = tmp_path / "some.sdf"
    path.write_text("".join(f"{r}$$$$\n" for r in (WATER, IONS, LISTED, *broken)))
    whole = sdf.read_poses(spark, str(path), "Chemgauss4")
    for wanted in (("row_key", "mol_id"), ("mol_id",), ("header", "parse_ok"), ("tags",), ("parse_ok", "mol_id", "tags", "row_key")):
        some = sdf.read_poses(spark, str(path), "Chemgauss4", wanted)
        assert set(some.columns) == {*wanted, "raw", "score"}
        pick = lambda df: sorted((str(r.asDict()) for r in df.select("raw", "score", *wanted).collect()))  # noqa: E731, B023
        assert pick(some) == pick(whole)
    assert whole.filter("parse_ok").count() == 3
    with pytest.raises(ValueError):
        sdf.parse_molecules(whole.select("raw"), ("nothing",))


def test_layers_alone_are_those_of_the_whole(spark, tmp_path):
    path = tmp_path / "in.sdf"
    whole = "a\r\n  h\r\n\r\n  1  0  0  0  0  0  0  0  0  0999 V2000\r\n    0.0000    0.0000    0.0000 C   0  0\r\nM  END\r\n> <S>\r\n1\r\n\r\n$$$$\r\n"
    path.write_bytes((whole + whole.replace("\r", "") + whole.replace(" C ", "   ") + whole.replace("  1  0", "  2  0")).encode())
    full = sdf.read_molecules(spark, str(path)).orderBy("raw")
    for wanted in (["mol_id", "bonds"], ["header", "atoms"], ["bonds", "tags", "parse_ok"], ["tags"], ["parse_ok", "row_key"]):
        part = sdf.read_molecules(spark, str(path), wanted).orderBy("raw")
        assert set(part.columns) == {*wanted, "raw"}
        assert part.collect() == full.select(part.columns).collect()
    text = sdf.read_molecules(spark, str(path), ["mol_id", "bonds"])._jdf.queryExecution().executedPlan().toString()
    assert "parity" not in text and "M  CHG" not in text and "md5" not in text


def test_written_records_are_compressed_and_read_alike(spark, tmp_path):
    mols = spark.range(3000).selectExpr("concat('m', id, repeat('\n    0.0000    0.0000', 40), '\nM  END\n') AS raw", "map('S', string(id)) AS tags").coalesce(1)
    sinks.write_sdf(mols, str(tmp_path / "packed"))
    sinks.write_sdf(mols, str(tmp_path / "plain"), compression="none")
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("part-*"))
    assert size("packed") * 10 < size("plain")
    texts = [sorted(r.raw for r in sdf.scan_records(spark, str(tmp_path / name)).collect()) for name in ("packed", "plain")]
    assert texts[0] == texts[1] and len(texts[0]) == 3000
    sinks.write_texts(mols.select("raw"), str(tmp_path / "several"), 1000)
    assert len(list((tmp_path / "several").glob("part-*"))) == 3
