"""Numeric properties of one molecule, from its atom and bond arrays or from its line notation. No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.chem import ATOMIC_WEIGHTS
from gleaner.functions.staging import staged

# Descriptor columns a molecule table gets, and those its line notation can give.
MOLECULE_DESCRIPTORS = (
    "mol_weight",
    "heavy_atoms",
    "carbons",
    "hetero_atoms",
    "hetero_carbon_ratio",
    "charge_sum",
    "charge_count",
    "donors",
    "acceptors",
    "rings",
    "chiral_centers",
)
SMILES_DESCRIPTORS = (
    "heavy_atoms",
    "carbons",
    "hetero_atoms",
    "hetero_carbon_ratio",
    "charge_sum",
    "charge_count",
    "rings",
)


def _count(array: Column, predicate) -> Column:
    return F.size(F.filter(array, predicate))


def _sum(array: Column, zero: Column, value) -> Column:
    return F.aggregate(array, zero, lambda total, x: total + value(x))


def molecular_weight(atoms: Column) -> Column:
    """NULL when an element has no entry in the weight table."""
    weights = F.create_map(*[F.lit(v) for pair in ATOMIC_WEIGHTS.items() for v in pair])
    return _sum(atoms, F.lit(0.0), lambda a: F.try_element_at(weights, a["element"]))


def heavy_atoms(atoms: Column) -> Column:
    return _count(atoms, lambda a: a["element"] != "H")


def carbons(atoms: Column) -> Column:
    return _count(atoms, lambda a: a["element"] == "C")


def hetero_atoms(atoms: Column) -> Column:
    return _count(atoms, lambda a: ~a["element"].isin("C", "H"))


def charge_sum(atoms: Column) -> Column:
    return _sum(atoms, F.lit(0), lambda a: a["charge"])


def charge_count(atoms: Column) -> Column:
    return _count(atoms, lambda a: a["charge"] != 0)


def acceptors(atoms: Column) -> Column:
    return _count(atoms, lambda a: a["element"].isin("N", "O"))


def donors(atoms: Column, bonds: Column) -> Column:
    """Nitrogen and oxygen atoms with at least one hydrogen atom attached."""
    element = lambda i: F.get(atoms, i - 1)["element"]
    holders = F.transform(
        bonds,
        lambda b: F.when((element(b["a"]) == "H") & element(b["b"]).isin("N", "O"), b["b"]).when(
            (element(b["b"]) == "H") & element(b["a"]).isin("N", "O"), b["a"]
        ),
    )
    return F.size(F.array_distinct(F.array_compact(holders)))


def rings(atoms: Column, bonds: Column) -> Column:
    """Independent cycles: bonds - atoms + fragments.

    The fragment names of all atoms stand in one text, eight characters each, the first a blank. Each bond replaces the
    name of one of its atoms by that of the other, wherever it occurs.
    """
    width = 8
    name = lambda names, atom: F.substring(names, (atom - 1) * width + 1, width)
    start = F.array_join(F.transform(atoms, lambda a: F.concat(F.lit(" "), F.lpad(a["idx"].cast("string"), width - 1, "0"))), "")
    names = F.aggregate(bonds, start, lambda t, b: F.replace(t, name(t, b["b"]), name(t, b["a"])))
    fragments = F.filter(F.array_distinct(F.split(names, " ")), lambda x: x != "")
    return F.size(bonds) - F.size(atoms) + F.size(fragments)


def elements(atoms: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(atoms, lambda a: a["element"])))


def _ratio(hetero: Column, carbon: Column) -> Column:
    return F.when(carbon > 0, hetero / carbon)


def with_descriptors(molecules: DataFrame) -> DataFrame:
    """Adds MOLECULE_DESCRIPTORS and ``elements`` to a table with ``atoms`` and ``bonds``."""
    a, b = F.col("atoms"), F.col("bonds")
    return staged(
        molecules,
        {
            "mol_weight": molecular_weight(a),
            "heavy_atoms": heavy_atoms(a),
            "carbons": carbons(a),
            "hetero_atoms": hetero_atoms(a),
            "charge_sum": charge_sum(a),
            "charge_count": charge_count(a),
            "donors": donors(a, b),
            "acceptors": acceptors(a),
            "rings": rings(a, b),
            "chiral_centers": _count(a, lambda x: x["parity"] > 0),
            "elements": elements(a),
        },
    ).withColumn("hetero_carbon_ratio", _ratio(F.col("hetero_atoms"), F.col("carbons")))


# Atoms of a line notation: bracketed, two-letter, then one-letter (lower case = aromatic).
_ATOM = r"\[[^\]]*\]|Br|Cl|[BCNOPSFI]|[bcnops]"
_BRACKET = r"\[[^\]]*\]"
_BRACKET_SYMBOL = r"^\[\d*([A-Z][a-z]?|[a-z][a-z]?)"
_RING_CLOSURE = r"%\d\d|\d"


def smiles_atoms(smiles: Column) -> Column:
    """Element symbols in order, aromatic atoms in upper case; bracketed hydrogen included."""
    tokens = F.regexp_extract_all(smiles, F.lit(f"({_ATOM})"), F.lit(1))
    symbol = lambda t: F.when(t.startswith("["), F.regexp_extract(t, _BRACKET_SYMBOL, 1)).otherwise(t)
    return F.transform(tokens, lambda t: F.initcap(symbol(t)))


def smiles_charges(smiles: Column) -> Column:
    """Charges of the bracketed atoms: ``+2``, ``--`` and the like."""
    brackets = F.regexp_extract_all(smiles, F.lit(f"({_BRACKET})"), F.lit(1))

    def charge(t: Column) -> Column:
        signs = F.regexp_extract(t, r"([+-]+)\d*(?::\d+)?\]$", 1)
        digits = F.regexp_extract(t, r"[+-](\d+)(?::\d+)?\]$", 1)
        size = F.when(digits != "", digits.cast("int")).otherwise(F.length(signs))
        return F.when(signs == "", 0).when(signs.startswith("-"), -size).otherwise(size)

    return F.transform(brackets, charge)


def smiles_rings(smiles: Column) -> Column:
    """Every ring has two closure marks outside brackets."""
    bare = F.regexp_replace(smiles, _BRACKET, "")
    return F.floor(F.regexp_count(bare, F.lit(_RING_CLOSURE)) / 2).cast("int")


def with_smiles_descriptors(df: DataFrame) -> DataFrame:
    """Adds SMILES_DESCRIPTORS and ``elements``. Hydrogens are implicit, so neither weight nor donors are given."""
    tokens = df.withColumns({"_symbols": smiles_atoms(F.col("smiles")), "_charges": smiles_charges(F.col("smiles"))})
    symbols, charges = F.col("_symbols"), F.col("_charges")
    return (
        staged(
            tokens,
            {
                "heavy_atoms": _count(symbols, lambda s: s != "H"),
                "carbons": _count(symbols, lambda s: s == "C"),
                "hetero_atoms": _count(symbols, lambda s: ~s.isin("C", "H")),
                "charge_sum": _sum(charges, F.lit(0), lambda c: c),
                "charge_count": _count(charges, lambda c: c != 0),
                "rings": smiles_rings(F.col("smiles")),
                "elements": F.sort_array(F.array_distinct(symbols)),
            },
        )
        .withColumn("hetero_carbon_ratio", _ratio(F.col("hetero_atoms"), F.col("carbons")))
        .drop("_symbols", "_charges")
    )
