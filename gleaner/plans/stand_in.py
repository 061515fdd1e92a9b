"""Molecule-shaped data derived from the given tables, which hold no molecules.

Every order is one molecule. The digits of its key, its price in cents and its date are the atoms, in order; atoms
next to each other are bonded, and an even last digit closes a ring between the last atom and the first. One row
makes one molecule, so nothing is gathered across rows. The same rules are written in SQL in ``oracles``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.scores import FAILED_TEXT
from gleaner.functions.staging import staged
from gleaner.operators.sets import fill_cores

# Orders whose molecules one task builds: few bytes, but each makes thousands and takes about a millisecond.
TASK_ORDERS = 20_000

# Element of each digit 0..9.
DIGIT_ELEMENTS = ("C", "N", "O", "S", "Cl", "C", "P", "C", "F", "H")
DIGIT_SMILES = ("C", "N", "O", "S", "Cl", "c", "P", "Br", "[O-]", "[NH3+]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' columns that matter here, and ``_text``, the text of all digits."""
    orders = fill_cores(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"), TASK_ORDERS)
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    text = F.concat(F.col("o_orderkey").cast("string"), cents, F.date_format("o_orderdate", "yyyyMMdd"))
    return orders.withColumn("_text", text).drop("o_orderdate")


def _digits(text: Column) -> Column:
    return F.split(text, "").cast("array<int>")


def order_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and the array of its digits."""
    return staged(_orders(spark, sf_dir), {"digits": _digits(F.col("_text"))}).drop("_text")


def _pick(values: tuple, digit: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), digit)


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_key, mol_id, atoms, bonds."""
    return _graphs(order_digits(spark, sf_dir))


def _graphs(digits: DataFrame, *more: str) -> DataFrame:
    d = F.col("digits")
    n = F.size(d)
    atoms = F.transform(
        d,
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("idx"),
            ((i + 1) * 1.5).alias("x"),
            x.cast("double").alias("y"),
            F.lit(0.0).alias("z"),
            _pick(DIGIT_ELEMENTS, x).alias("element"),
            F.when((x == 1) & ((i + 1) % 5 == 0), F.lit(1))
            .when((x == 2) & ((i + 1) % 7 == 0), F.lit(-1))
            .otherwise(F.lit(0))
            .alias("charge"),
            F.when(x == 7, F.lit(1)).otherwise(F.lit(0)).alias("parity"),
        ),
    )
    bond = lambda a, b, o: F.struct(
        a.cast("int").alias("a"), b.cast("int").alias("b"), o.cast("int").alias("ord"), F.lit(0).alias("stereo")
    )
    chain = F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: bond(i, i + 1, (F.get(d, i - 1) + F.get(d, i)) % 3 + 1),
    )
    ring = F.when(F.element_at(d, -1) % 2 == 0, F.array(bond(F.lit(1), n, F.lit(1)))).otherwise(F.slice(chain, 1, 0))
    graph = staged(digits, {"atoms": atoms, "bonds": F.concat(chain, ring)})
    key = F.col("o_orderkey").cast("string")
    return graph.select(
        key.alias("row_key"),
        F.concat(F.lit("order "), key).alias("mol_id"),
        "atoms",
        "bonds",
        "o_orderkey",
        "o_orderpriority",
        "o_totalprice",
        *more,
    )


_MOST = 64  # more atoms than a key, a price and a date have digits


def _integer_texts() -> Column:
    return F.array(*[F.lit(f"{i:3d}") for i in range(_MOST)])


def _atom_text(place: int, digit: int, shift: float) -> str:
    """The line of the atom at ``place``, from 0 on, behind a line break."""
    charge = 1 if digit == 1 and (place + 1) % 5 == 0 else -1 if digit == 2 and (place + 1) % 7 == 0 else 0
    at = f"{(place + 1) * 1.5:10.4f}{digit + shift:10.4f}{0:10.4f}"
    return f"\n{at} {DIGIT_ELEMENTS[digit]:<3} 0{('  5', '  0', '  3')[charge + 1]}{int(digit == 7):3d}{'  0' * 9}"


def _bond_text(a: int, b: int, order: int) -> str:
    return f"\n{a:3d}{b:3d}{order:3d}{'  0' * 4}"


@lru_cache
def _line_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all lines there can be: atoms of both conformers by place and digit, chain bonds by place and order, ring bonds by size."""
    grid = lambda rows: np.array([[np.frombuffer(t.encode(), np.uint8) for t in row] for row in rows])
    atoms = [grid([[_atom_text(i, d, shift) for d in range(10)] for i in range(_MOST)]) for shift in (0.0, 0.5)]
    chain = grid([[_bond_text(i + 1, i + 2, o) for o in (1, 2, 3)] for i in range(_MOST)])
    return (*atoms, chain, grid([[_bond_text(1, n, 1)] for n in range(_MOST)])[:, 0])


def _joined(lines: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of so many of the lines each, which are equally long."""
    ends = (np.concatenate([[0], np.cumsum(counts)]) * lines.shape[1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends.tobytes()), pa.py_buffer(lines.tobytes()))


def block_lines(texts: pa.Array) -> pa.StructArray:
    """The lines of atoms, for either conformer, and of bonds behind a line break each, of texts of digits; ``plain`` is false for other texts."""
    texts = texts.cast(pa.large_string())
    size = pc.binary_length(texts)
    plain = pc.and_(pc.match_substring_regex(texts, "^[0-9]+$"), pc.and_(pc.greater(size, 1), pc.less(size, _MOST)))
    plain = pc.fill_null(plain, False)
    n = pc.if_else(plain, size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    digits = np.frombuffer("".join(texts.filter(plain).to_pylist()).encode(), np.uint8) - 48
    first = np.cumsum(n) - n
    nth = np.arange(len(digits)) - np.repeat(first, n)
    one, two, chain, rings = _line_tables()
    last = np.zeros(len(n), np.uint8)
    last[n > 0] = digits[(first + n - 1)[n > 0]]
    n_bonds = np.where(n > 0, n - 1 + (last % 2 == 0), 0)
    owner = np.repeat(np.arange(len(n)), n_bonds)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_bonds) - n_bonds, n_bonds)
    left = first[owner] + place
    in_chain = place < n[owner] - 1
    order = (digits[left] + digits[np.where(in_chain, left + 1, left)]) % 3
    bonds = np.where(in_chain[:, None], chain[place, order], rings[n[owner]])
    columns = [plain, _joined(one[nth, digits], n), _joined(two[nth, digits], n), _joined(bonds, n_bonds)]
    sizes = [pa.array(x.astype(np.int32)) for x in (n, n_bonds)]
    return pa.StructArray.from_arrays([*columns, *sizes], ["plain", "atoms1", "atoms2", "bonds", "n_atoms", "n_bonds"])


def _record(conformer: int) -> Column:
    """SDF text of one record of a molecule row, without delimiter; the second conformer is shifted along y.

    The lines of most molecules are there (``_block``); those of others are written here.
    """
    whole = lambda n: F.get(_integer_texts(), n)
    shift = 0.5 * (conformer - 1)
    block, plain = F.col("_block"), F.col("_block")["plain"]
    x_texts = F.array(*[F.lit(f"{i * 1.5:10.4f}") for i in range(_MOST)])
    by_digit = F.array(*[F.lit(f"{d + shift:10.4f}{0:10.4f} {e:<3} 0") for d, e in enumerate(DIGIT_ELEMENTS)])
    charge_codes = F.array(F.lit("  5"), F.lit("  0"), F.lit("  3"))
    atom_lines = F.transform(
        "atoms",
        lambda a: F.concat(
            F.get(x_texts, a["idx"]),
            F.get(by_digit, a["y"].cast("int")),
            F.get(charge_codes, a["charge"] + 1),
            whole(a["parity"]),
            F.lit("  0  0  0  0  0  0  0  0  0"),
        ),
    )
    bond_lines = F.transform("bonds", lambda b: F.concat(whole(b["a"]), whole(b["b"]), whole(b["ord"]), F.lit("  0  0  0  0")))
    counts = lambda a, b: F.concat(whole(a), whole(b), F.lit("  0     1  0  0  0  0  0999 V2000"))
    written = F.concat(counts(block["n_atoms"], block["n_bonds"]), block[f"atoms{conformer}"], block["bonds"])
    score = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(FAILED_TEXT)).otherwise(
        F.when((F.col("o_orderpriority") == "5-LOW") & F.lit(conformer == 2), F.lit("")).otherwise(
            ((F.round(F.col("o_totalprice") * 100).cast("bigint") % 100000 - conformer).cast("string"))
        )
    )
    return F.concat_ws(
        "\n",
        "mol_id",
        F.lit("  rendered"),
        F.lit(""),
        F.when(plain, written).otherwise(counts(F.size("atoms"), F.size("bonds"))),
        F.when(~plain, F.array_join(atom_lines, "\n")),
        F.when(~plain, F.array_join(bond_lines, "\n")),
        F.lit("M  END"),
        F.lit("> <Chemgauss4>"),
        score,
        F.lit(""),
        F.lit("> <Priority>"),
        F.col("o_orderpriority"),
        F.lit(""),
    )


def sdf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and a text that holds two records of the molecule, each ended by the delimiter line."""

    @F.arrow_udf("plain boolean, atoms1 string, atoms2 string, bonds string, n_atoms int, n_bonds int")
    def written(texts: pa.Array) -> pa.Array:
        return block_lines(texts)

    text = F.concat(_record(1), F.lit("\n$$$$\n"), _record(2), F.lit("\n$$$$"))
    rows = _orders(spark, sf_dir).withColumn("_block", written(F.col("_text")))
    others = staged(rows, {"digits": _digits(F.when(~F.col("_block")["plain"], F.col("_text")))}).drop("_text")
    return _graphs(others, "_block").select("o_orderkey", text.alias("chunk"))


def smiles_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of structure and title: the digits as a ring closed by its first and last atom, with a carbon at both ends."""
    body = F.array_join(F.transform("digits", lambda x: _pick(DIGIT_SMILES, x)), "")
    line = F.concat(F.lit("C1"), body, F.lit("C1 order "), F.col("o_orderkey").cast("string"))
    return order_digits(spark, sf_dir).select(line.alias("value"))


# Weights of the fixed linear score on embeddings, and those of the fixed linear model.
SCORE_WEIGHTS = [float((i * 37) % 11 - 5) for i in range(64)]
MODEL_WEIGHTS = [float((i * 29) % 13 - 6) for i in range(64)]
FEATURE_SCALE = 8.0
