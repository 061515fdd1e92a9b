"""Column expressions over the text of one SDF record (V2000) and its data items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file format.
DELIMITER = "$$$$"
END_OF_MOLECULE = "M  END"
CHARGE_CODES = {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}

# A data item: its header line, then the lines up to the next blank one or header.
_ITEM = r"(?m)^>[^<\r\n]*<([^>\r\n]+)>[^\r\n]*(?:\r?\n|\z)((?:(?!>[^<\r\n]*<[^>\r\n]+>)[^\r\n]+(?:\r?\n|\z))*)"


def strip_first_break(raw: Column) -> Column:
    """Drop the line break that the delimiter of the record before left at the start."""
    rest = lambda n: F.substring(raw, n, 2**31 - 1)
    return F.when(raw.startswith("\n"), rest(2)).when(raw.startswith("\r\n"), rest(3)).otherwise(raw)


def without_break(line: Column) -> Column:
    """A line that was cut off at a line feed, without the rest of its break."""
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def is_blank(raw: Column) -> Column:
    return ~raw.rlike(r"\S")


def split_records(text: Column) -> Column:
    """Array of the non-blank records in a text that holds several, without their delimiters."""
    parts = F.transform(F.split(text, r"\$\$\$\$"), strip_first_break)
    return F.filter(parts, lambda r: ~is_blank(r))


def first_line(raw: Column) -> Column:
    """The record's id: its whole first line, NULL when that line is blank."""
    line = F.regexp_replace(F.substring_index(raw, "\n", 1), r"\r$", "")
    return F.when(F.trim(line) != "", line)


def lines(raw: Column) -> Column:
    """A text's lines, whose ends are of either kind. Splitting at a single character needs no regular expression."""
    return F.split(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\n")


def _field(line: Column, start: int, width: int) -> Column:
    return F.trim(F.substring(line, start, width))


def _int(line: Column, start: int, width: int) -> Column:
    return F.substring(line, start, width).try_cast("int")  # the cast drops blanks itself


def _double(line: Column, start: int, width: int) -> Column:
    return F.substring(line, start, width).try_cast("double")


def atom_count(counts: Column) -> Column:
    return _int(counts, 1, 3)


def bond_count(counts: Column) -> Column:
    return _int(counts, 4, 3)


def atom_block(ls: Column, n_atoms: Column) -> Column:
    """Atoms in file order. ``charge`` still holds the block's charge code."""
    return F.transform(
        F.slice(ls, 5, n_atoms),
        lambda line, i: F.struct(
            (i + 1).cast("int").alias("idx"),
            _double(line, 1, 10).alias("x"),
            _double(line, 11, 10).alias("y"),
            _double(line, 21, 10).alias("z"),
            _field(line, 32, 3).alias("element"),
            F.coalesce(_int(line, 37, 3), F.lit(0)).alias("charge"),
            F.coalesce(_int(line, 40, 3), F.lit(0)).alias("parity"),
        ),
    )


def bond_block(ls: Column, n_atoms: Column, n_bonds: Column) -> Column:
    return F.transform(
        F.slice(ls, n_atoms + 5, n_bonds),
        lambda line: F.struct(
            _int(line, 1, 3).alias("a"),
            _int(line, 4, 3).alias("b"),
            _int(line, 7, 3).alias("ord"),
            F.coalesce(_int(line, 10, 3), F.lit(0)).alias("stereo"),
        ),
    )


def charge_entries(ls: Column) -> Column:
    """(atom, charge) pairs of all charge lines, each line holding up to eight."""
    charged = F.filter(ls, lambda line: line.startswith("M  CHG"))
    return F.flatten(
        F.transform(
            charged,
            lambda line: F.transform(
                F.slice(F.sequence(F.lit(0), F.lit(8)), 1, F.coalesce(_int(line, 7, 3), F.lit(0))),
                lambda k: F.struct(
                    F.trim(line.substr(k * 8 + 10, F.lit(4))).try_cast("int").alias("atom"),
                    F.trim(line.substr(k * 8 + 14, F.lit(4))).try_cast("int").alias("charge"),
                ),
            ),
        )
    )


def with_charges(atoms: Column, entries: Column) -> Column:
    """Formal charges: from charge lines when the record has any, else from the atom block's codes."""
    codes = F.create_map(*[F.lit(v) for pair in CHARGE_CODES.items() for v in pair])

    def listed(atom: Column) -> Column:
        hits = F.filter(entries, lambda e: e["atom"] == atom["idx"])
        return F.get(hits, F.lit(0))["charge"]

    def charge(atom: Column) -> Column:
        coded = F.try_element_at(codes, atom["charge"])
        return F.coalesce(F.when(F.size(entries) > 0, listed(atom)).otherwise(coded), F.lit(0))

    same = ("idx", "x", "y", "z", "element")
    return F.transform(
        atoms,
        lambda a: F.struct(*[a[f].alias(f) for f in same], charge(a).alias("charge"), a["parity"].alias("parity")),
    )


def block_is_sound(atoms: Column, bonds: Column, n_atoms: Column, n_bonds: Column) -> Column:
    """All counted lines are there, and every number in them could be read."""
    atom_ok = lambda a: (
        a["x"].isNotNull() & a["y"].isNotNull() & a["z"].isNotNull() & (a["element"] != "")
    )
    bond_ok = lambda b: (
        b["a"].between(1, n_atoms) & b["b"].between(1, n_atoms) & b["ord"].isNotNull()
    )
    return (
        (F.size(atoms) == n_atoms)
        & (F.size(bonds) == n_bonds)
        & F.forall(atoms, lambda a: F.coalesce(atom_ok(a), F.lit(False)))
        & F.forall(bonds, lambda b: F.coalesce(bond_ok(b), F.lit(False)))
    )


def lines_are_sound(ls: Column, n_atoms: Column, n_bonds: Column) -> Column:
    """``block_is_sound`` from the lines themselves, for when the block isn't wanted."""
    atoms = F.slice(ls, 5, F.coalesce(n_atoms, F.lit(0)))
    bonds = F.slice(ls, F.coalesce(n_atoms, F.lit(0)) + 5, F.coalesce(n_bonds, F.lit(0)))
    atom_ok = lambda line: (
        _double(line, 1, 10).isNotNull() & _double(line, 11, 10).isNotNull() & _double(line, 21, 10).isNotNull() & (_field(line, 32, 3) != "")
    )
    bond_ok = lambda line: (
        _int(line, 1, 3).between(1, n_atoms) & _int(line, 4, 3).between(1, n_atoms) & _int(line, 7, 3).isNotNull()
    )
    return (
        (F.size(atoms) == n_atoms)
        & (F.size(bonds) == n_bonds)
        & F.forall(atoms, lambda line: F.coalesce(atom_ok(line), F.lit(False)))
        & F.forall(bonds, lambda line: F.coalesce(bond_ok(line), F.lit(False)))
    )


def tag_map(raw: Column) -> Column:
    """Data items by name. Of a repeated name the last item counts."""
    tail = F.substring_index(raw, END_OF_MOLECULE, -1)
    names = F.regexp_extract_all(tail, F.lit(_ITEM), F.lit(1))
    values = F.transform(
        F.regexp_extract_all(tail, F.lit(_ITEM), F.lit(2)),
        lambda v: F.regexp_replace(v, r"\s+\z", ""),
    )
    pairs = F.reverse(F.arrays_zip(names.alias("k"), values.alias("v")))
    last = F.filter(
        pairs,
        lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1,
    )
    return F.map_from_entries(F.reverse(last))


def set_tag(tags: Column, name: str, value: Column) -> Column:
    return F.map_concat(drop_tag(tags, name), F.create_map(F.lit(name), value))


def drop_tag(tags: Column, name: str) -> Column:
    return F.map_filter(tags, lambda k, _: k != name)


def to_sdf(raw: Column, tags: Column) -> Column:
    """Record text: the molecule block of ``raw`` as it stands, the given data items, the delimiter."""
    block = F.concat(F.substring_index(raw, END_OF_MOLECULE, 1), F.lit(END_OF_MOLECULE + "\n"))
    items = F.transform(
        F.map_entries(tags),
        lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), F.coalesce(e["value"], F.lit("")), F.lit("\n\n")),
    )
    return F.concat(block, F.array_join(items, ""), F.lit(DELIMITER))
