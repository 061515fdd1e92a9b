"""Counting unbranched chains of atoms and bonds, inside the row."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.chem import SYMBOLS

# Bond marks and the bond orders they accept; no mark = single or aromatic.
BOND_ORDERS = {"": (1, 4), "-": (1,), "=": (2,), "#": (3,), ":": (4,)}

_STEP = re.compile(r"([-=#:]?)(\[[A-Za-z0-9#,]+\]|Br|Cl|[BCNOPSFI])")


@dataclass(frozen=True)
class PathPattern:
    """``atoms[i]`` are the symbols allowed at place i, ``bonds[i]`` the orders allowed after it."""

    atoms: tuple[tuple[str, ...], ...]
    bonds: tuple[tuple[int, ...], ...]


def _symbols(token: str) -> tuple[str, ...] | None:
    if not token.startswith("["):
        return (token,)
    found = []
    for part in token[1:-1].split(","):
        if re.fullmatch(r"#\d+", part):
            number = int(part[1:])
            if not 1 <= number <= len(SYMBOLS):
                return None
            found.append(SYMBOLS[number - 1])
        elif part in SYMBOLS:
            found.append(part)
        else:
            return None
    return tuple(found)


def path_pattern(text: str) -> PathPattern | None:
    """The chain that ``text`` describes, or None when it has branches, rings, charges or aromatic atoms."""
    atoms, bonds, at = [], [], 0
    while at < len(text):
        step = _STEP.match(text, at)
        symbols = _symbols(step.group(2)) if step else None
        if symbols is None or (not atoms and step.group(1)):
            return None
        if atoms:
            bonds.append(BOND_ORDERS[step.group(1)])
        atoms.append(symbols)
        at = step.end()
    return PathPattern(tuple(atoms), tuple(bonds)) if atoms else None


def directed_steps(atoms: Column, bonds: Column) -> Column:
    """Every bond both ways, with the elements at its ends. Stage it as a column before counting several patterns."""
    element = lambda i: F.get(atoms, i - 1)["element"]
    one_way = lambda p, q: F.transform(
        bonds,
        lambda b: F.struct(
            b[p].alias("u"), b[q].alias("v"), b["ord"].alias("o"), element(b[p]).alias("eu"), element(b[q]).alias("ev")
        ),
    )
    return F.concat(one_way("a", "b"), one_way("b", "a"))


def count_paths(atoms: Column, steps: Column, pattern: PathPattern) -> Column:
    """Number of distinct chains; one read from either end counts once."""
    if len(pattern.atoms) == 1:
        return F.size(F.filter(atoms, lambda a: a["element"].isin(*pattern.atoms[0])))

    fits = lambda s, k: s["o"].isin(*pattern.bonds[k]) & s["ev"].isin(*pattern.atoms[k + 1])
    first = F.filter(steps, lambda s: s["eu"].isin(*pattern.atoms[0]) & fits(s, 0))
    paths = F.transform(first, lambda s: F.array(s["u"], s["v"]))

    def extend(k: int):
        def one(path: Column) -> Column:
            onward = F.filter(
                steps,
                lambda s: (s["u"] == F.element_at(path, -1)) & ~F.array_contains(path, s["v"]) & fits(s, k),
            )
            return F.transform(onward, lambda s: F.array_append(path, s["v"]))

        return one

    for k in range(1, len(pattern.bonds)):
        paths = F.flatten(F.transform(paths, extend(k)))
    start = lambda p: F.get(p, F.lit(0))
    one_direction = F.transform(paths, lambda p: F.when(start(p) <= F.element_at(p, -1), p).otherwise(F.reverse(p)))
    return F.size(F.array_distinct(one_direction))
