import pytest
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions import descriptors as D
from gleaner.functions import signatures
from gleaner.functions.motifs import path_pattern
from gleaner.functions.signatures import with_atom_signatures, with_ngrams
from gleaner.functions.staging import staged
from gleaner.operators import rules as ops
from gleaner.sources import rules as files
from gleaner.sources import smiles


def graph(key, elements, bonds, charges=None):
    atoms = [(i + 1, 0.0, 0.0, 0.0, e, (charges or {}).get(i + 1, 0), 0) for i, e in enumerate(elements)]
    return (key, key, atoms, [(a, b, o, 0) for a, b, o in bonds])


RING6 = graph("ring", ["C"] * 6, [(i, i % 6 + 1, 1) for i in range(1, 7)])
SINGLE = graph("single", ["O"], [])
TWO_PARTS = graph("parts", ["N", "H", "C", "O"], [(1, 2, 1), (3, 4, 2)], {1: 1, 4: -1})
CHAIN = graph("chain", ["N", "C", "S", "C", "N"], [(1, 2, 2), (2, 3, 2), (3, 4, 1), (4, 5, 3)])
OXYGENS = graph("oxygens", ["O", "O", "O"], [(1, 2, 1), (2, 3, 1)])


@pytest.fixture
def mols(spark):
    atoms, bonds = schemas.ATOM.simpleString(), schemas.BOND.simpleString()
    ddl = f"row_key string, mol_id string, atoms array<{atoms}>, bonds array<{bonds}>"
    return spark.createDataFrame([RING6, SINGLE, TWO_PARTS, CHAIN, OXYGENS], ddl)


def by_key(df):
    return {r.row_key: r for r in df.collect()}


def test_signatures(mols):
    out = by_key(with_atom_signatures(mols))
    assert out["single"].signatures == []
    ring = [(s.height, s.signature) for s in out["ring"].signatures]
    assert ring == [(1, "C(1C,1C)")] * 6 + [(2, "C(1C(1C,1C),1C(1C,1C))")] * 6 + [
        (3, "C(1C(1C(1C,1C),1C(1C,1C)),1C(1C(1C,1C),1C(1C,1C)))")
    ] * 6
    assert {s.height for s in out["oxygens"].signatures} == {1, 2}  # no higher than atoms - 1
    assert out["parts"].signatures[0].signature == "N(1H)"


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_signatures_of_odd_molecules(spark, monkeypatch, most):
    """Bonds to atoms that aren't there, without an order or to the atom itself, numbers that repeat or are missing, and no lists."""
    monkeypatch.setattr(signatures, "_PIECE_ATOMS", most)
    rows = [
        ("gone", [(1, "C"), (2, "N")], [(1, 2, 11), (2, 9, 1), (0, 1, 1), (1, 2, None), (None, 2, 1)]),
        ("self", [(1, "C"), (2, "N")], [(1, 1, 2)]),
        ("twice", [(1, "C"), (1, "N"), (3, "O")], [(1, 3, 1)]),
        ("unnumbered", [(None, "C"), (2, "Cl")], [(1, 2, 1)]),
        ("no element", [(1, None), (2, "N")], [(1, 2, 1)]),
        ("no atoms", None, [(1, 2, 1)]),
        ("no bonds", [(1, "C"), (2, "N")], None),
        ("empty", [], []),
    ]
    ddl = "row_key string, atoms array<struct<idx:int,element:string>>, bonds array<struct<a:int,b:int,ord:int>>"
    out = by_key(with_atom_signatures(spark.createDataFrame(rows, ddl), stop=1))
    got = {k: r.signatures and [s.signature for s in r.signatures] for k, r in out.items()}
    assert got == {
        "gone": ["C(11N)", "N(11C)"], "self": ["C(2C,2C)", "N()"], "twice": ["C(1O)", "N(1O)", "O(1C)"], "unnumbered": ["C()", "Cl(1C)"],
        "no element": [None, "N()"], "no atoms": None, "no bonds": [None, None], "empty": [],
    }


def test_ngrams(spark):
    df = spark.createDataFrame([("d", "a b\n\ta  b "), ("e", "")], "row_key string, text string")
    out = by_key(with_ngrams(df, "text"))
    assert [s.signature for s in out["d"].signatures] == ["a", "b", "a", "b", "a b", "b a", "a b", "a b a", "b a b"]
    assert out["e"].signatures == []


def test_descriptors(mols):
    out = by_key(D.with_descriptors(mols))
    assert out["ring"].rings == 1 and out["parts"].rings == 0 and out["single"].rings == 0
    parts = out["parts"]
    assert (parts.charge_sum, parts.charge_count, parts.donors, parts.acceptors) == (0, 2, 1, 2)
    assert (parts.heavy_atoms, parts.carbons, parts.hetero_atoms, parts.hetero_carbon_ratio) == (3, 1, 2, 2.0)
    assert parts.elements == ["C", "H", "N", "O"]
    assert abs(out["ring"].mol_weight - 72.066) < 1e-9
    assert out["single"].hetero_carbon_ratio is None


def test_unknown_element_has_no_weight(spark, mols):
    odd = mols.filter("row_key = 'single'").withColumn(
        "atoms", F.transform("atoms", lambda a: a.withField("element", F.lit("Xx")))
    )
    assert D.with_descriptors(odd).first().mol_weight is None


def test_motifs(mols):
    patterns = {"oo": "OO", "ncs": "N=C=[S,O]", "scn": "SC#N", "ccc": "CCC", "hetero": "[#7,#8,#16]", "cccc": "CCCC"}
    out = by_key(ops.motif_counts(mols, patterns, ["row_key"]))
    assert (out["oxygens"].oo, out["ring"].ccc, out["ring"].cccc) == (2, 6, 6)
    assert (out["chain"].ncs, out["chain"].scn, out["chain"].hetero) == (1, 1, 3)


def test_only_chains_are_patterns():
    assert path_pattern("N=C=N") and path_pattern("[P,S][Cl,Br]") and path_pattern("F")
    for text in ("C(=O)O", "c1ccccc1", "[N+]#[C-]", "[CD1]C", "=C", "[#999]", ""):
        assert path_pattern(text) is None
    with pytest.raises(ValueError):
        ops.motif_counts(None, {"branched": "C(=O)O"}, [])


RULES = """
# comment
MIN_MOLWT\t60\t"at least this heavy"
MAX_SSSR_RINGS 0 "rings"
MAX_XLOGP 6.0 "unknown"
SOME_SWITCH_TRUE "a switch"
ALLOWED_ELEMENTS H,C,N,O
ELIMINATE_METALS Fe,Cu
NEWRULE charged 0 CC[N+]C[O-]
NEWRULE 1 doubled OO
RULE 0 peroxide
RULE\t4\tamide
"""


def test_rule_parser():
    rules = files.parse_rules(RULES)
    assert [(r.kind, r.name) for r in rules] == [
        ("limit", "MIN_MOLWT"), ("limit", "MAX_SSSR_RINGS"), ("limit", "MAX_XLOGP"), ("allowed", "ALLOWED_ELEMENTS"),
        ("denied", "ELIMINATE_METALS"), ("pattern", "charged"), ("pattern", "doubled"), ("named", "peroxide"), ("named", "amide"),
    ]
    assert (rules[6].max, rules[6].pattern) == (1.0, "OO")
    with pytest.raises(ValueError):
        files.parse_rules("MIN_MOLWT many")
    with pytest.raises(ValueError):
        files.parse_rules("RULE peroxide")


def test_rules_on_molecules(mols):
    rules = files.parse_rules(RULES)
    described = D.with_descriptors(mols)
    assert [r.name for r in ops.not_evaluated(described, rules)] == ["MAX_XLOGP", "charged", "amide"]
    broken = {(r.row_key, r.rule) for r in ops.rule_violations(described, rules, ["row_key"]).collect()}
    assert broken == {
        ("ring", "MAX_SSSR_RINGS"), ("single", "MIN_MOLWT"), ("parts", "MIN_MOLWT"), ("chain", "ALLOWED_ELEMENTS"),
        ("oxygens", "MIN_MOLWT"), ("oxygens", "doubled"), ("oxygens", "peroxide"),
    }
    assert ops.rule_filter(described, rules).count() == 0
    assert ops.rule_filter(described, files.parse_rules("MAX_NUM_HVY 3")).count() == 3
    assert ops.rule_filter(described, []).count() == 5


def test_presets():
    assert all(files.preset_rules(p) for p in files.PRESETS)
    with pytest.raises(ValueError):
        files.preset_rules("other")


def test_rule_file_and_table(spark, tmp_path):
    path = tmp_path / "rules.txt"
    path.write_text(RULES)
    rules = files.read_rules(spark, str(path))
    assert rules == files.parse_rules(RULES)
    assert files.rules_table(spark, rules).filter("kind = 'limit'").count() == 3


def test_smiles(spark, tmp_path):
    path = tmp_path / "m.smi"
    path.write_text("OC1CCC2C(C1)CCC2N two part title\n\nBrCC[N-]c1cc%10cc1%10.[Cl-].[Fe+3]\tsalt\n[13CH4]\n")
    df = smiles.read_smiles(spark, str(path))
    assert sorted((r.title or "") for r in df.collect()) == ["", "salt", "two part title"]
    out = {r.title: r for r in D.with_smiles_descriptors(df).collect()}
    bicycle = out["two part title"]
    assert (bicycle.heavy_atoms, bicycle.carbons, bicycle.hetero_atoms, bicycle.rings) == (11, 9, 2, 2)
    salt = out["salt"]
    assert salt.elements == ["Br", "C", "Cl", "Fe", "N"]
    assert (salt.charge_sum, salt.charge_count, salt.rings) == (1, 3, 2)
    assert out[None].elements == ["C"]
    rules = files.parse_rules("MAX_MOLWT 500\nMAX_NUM_HVY 12")
    described = D.with_smiles_descriptors(df)
    assert [r.name for r in ops.not_evaluated(described, rules)] == ["MAX_MOLWT"]


def test_staged_columns_are_not_pushed(spark):
    df = staged(spark.range(5).selectExpr("id", "id AS y"), {"x": F.col("id") * 2, "y": F.col("y") + 1})
    assert [(r.id, r.x, r.y) for r in df.filter("x > 4").orderBy("id").collect()] == [(3, 6, 4), (4, 8, 5)]
