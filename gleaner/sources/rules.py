"""Filter-rule files: property limits, element lists and structural counts, one per line."""

from __future__ import annotations

import re
import shlex
from dataclasses import dataclass
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limit keywords (after MIN_ / MAX_) and the descriptor column each one limits.
LIMIT_COLUMNS = {
    "MOLWT": "mol_weight",
    "NUM_HVY": "heavy_atoms",
    "CARBONS": "carbons",
    "HETEROATOMS": "hetero_atoms",
    "Het_C_Ratio": "hetero_carbon_ratio",
    "SSSR_RINGS": "rings",
    "HBOND_DONORS": "donors",
    "HBOND_ACCEPTORS": "acceptors",
    "COUNT_FORMAL_CRG": "charge_count",
    "SUM_FORMAL_CRG": "charge_sum",
    "CHIRAL_CENTERS": "chiral_centers",
}

# Rules given by name alone whose pattern is an unbranched chain.
NAMED_PATTERNS = {
    "peroxide": "OO",
    "phosphoranes": "C=P",
    "carbodiimide": "N=C=N",
    "iodine": "I",
    "halide": "[F,Cl,Br,I]",
}

PRESETS = ("lead", "drug")


@dataclass(frozen=True)
class Rule:
    """``kind``: limit, allowed, denied, pattern or named. A rule without ``column``/``pattern`` cannot be evaluated."""

    kind: str
    name: str
    column: str | None = None
    min: float | None = None
    max: float | None = None
    pattern: str | None = None
    elements: tuple[str, ...] = ()


def _is_number(text: str) -> bool:
    return re.fullmatch(r"[+-]?\d+(\.\d+)?", text) is not None


def _count_rule(fields: list[str], line: str) -> tuple[str, float]:
    """Name and maximum of a structural rule, whichever comes first."""
    if len(fields) >= 2 and _is_number(fields[0]):
        return fields[1], float(fields[0])
    if len(fields) >= 2 and _is_number(fields[1]):
        return fields[0], float(fields[1])
    raise ValueError(f"rule needs a name and a number: {line!r}")


def parse_rules(text: str) -> list[Rule]:
    """Rules in file order. Lines of other keywords are ignored, as are comments."""
    rules: list[Rule] = []
    for line in text.splitlines():
        stripped = line.strip()
        if not stripped or stripped.startswith("#"):
            continue
        keyword, *rest = re.split(r"\s+", stripped, maxsplit=1)
        body = rest[0] if rest else ""
        bound, _, what = keyword.partition("_")
        if bound in ("MIN", "MAX") and what:
            value = shlex.split(body)[0]
            if not _is_number(value):
                raise ValueError(f"limit is not a number: {line!r}")
            low, high = (float(value), None) if bound == "MIN" else (None, float(value))
            rules.append(Rule("limit", keyword, LIMIT_COLUMNS.get(what), low, high))
        elif keyword in ("ALLOWED_ELEMENTS", "ELIMINATE_METALS"):
            kind = "allowed" if keyword == "ALLOWED_ELEMENTS" else "denied"
            symbols = tuple(s for s in re.split(r"[,\s]+", body) if s)
            rules.append(Rule(kind, keyword, "elements", elements=symbols))
        elif keyword == "NEWRULE":
            fields = body.split()
            name, top = _count_rule(fields, line)
            if len(fields) < 3:
                raise ValueError(f"rule needs a pattern: {line!r}")
            rules.append(Rule("pattern", name, max=top, pattern=fields[2]))
        elif keyword == "RULE":
            name, top = _count_rule(body.split(), line)
            rules.append(Rule("named", name, max=top, pattern=NAMED_PATTERNS.get(name)))
    return rules


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a file, or of the files of a folder in order of their names, on any file system Spark can read.

    A rule file has a few hundred lines at most.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return [rule for row in files.orderBy("file").collect() for rule in parse_rules(row["value"])]


def preset_rules(name: str) -> list[Rule]:
    if name not in PRESETS:
        raise ValueError(f"unknown preset '{name}'; known: {', '.join(PRESETS)}")
    return parse_rules(resources.files("gleaner").joinpath("presets", f"{name}.txt").read_text())


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table: kind, name, min, max, pattern, elements."""
    rows = [(r.kind, r.name, r.min, r.max, r.pattern, list(r.elements)) for r in rules]
    ddl = "kind string, name string, min double, max double, pattern string, elements array<string>"
    return spark.createDataFrame(rows, ddl)
