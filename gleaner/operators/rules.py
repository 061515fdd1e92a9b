"""Applying filter rules to a table of descriptors. One pass over the rows; no join, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.motifs import PathPattern, count_paths, directed_steps, path_pattern
from gleaner.functions.staging import explode_once, staged
from gleaner.sources.rules import Rule

_VIOLATIONS = "array<struct<rule:string,value:double,low:double,high:double>>"


@dataclass(frozen=True)
class _Check:
    rule: Rule
    pattern: PathPattern | None = None


def _checks(df: DataFrame, rules: list[Rule]) -> list[_Check]:
    """The rules this table has the columns for."""
    has_graph = {"atoms", "bonds"} <= set(df.columns)
    found = []
    for rule in rules:
        if rule.column:
            if rule.column in df.columns:
                found.append(_Check(rule))
        elif rule.pattern and has_graph:
            pattern = path_pattern(rule.pattern)
            if pattern:
                found.append(_Check(rule, pattern))
    return found


def not_evaluated(df: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules that cannot be checked on ``df``: an unknown keyword, a missing column, or a pattern that is no chain."""
    checked = {id(c.rule) for c in _checks(df, rules)}
    return [r for r in rules if id(r) not in checked]


def _value(check: _Check, steps: Column) -> Column:
    """What the rule limits, as a double; for an element list the number of elements that offend."""
    rule = check.rule
    if rule.kind in ("allowed", "denied"):
        listed = F.array(*[F.lit(e) for e in rule.elements]).cast("array<string>")
        clash = F.array_except if rule.kind == "allowed" else F.array_intersect
        return F.size(clash(F.col("elements"), listed)).cast("double")
    if check.pattern:
        return count_paths(F.col("atoms"), steps, check.pattern).cast("double")
    return F.col(rule.column).cast("double")


def _violation(check: _Check, value: Column) -> Column:
    """Struct that describes the violation, NULL where the rule holds. An unknown weight breaks every limit on it."""
    rule = check.rule
    low = F.lit(rule.min).cast("double")
    high = F.lit(0.0 if rule.kind in ("allowed", "denied") else rule.max).cast("double")
    unknown = F.lit(rule.column == "mol_weight") & value.isNull()
    broken = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False)) | unknown
    body = F.struct(F.lit(rule.name).alias("rule"), value.alias("value"), low.alias("low"), high.alias("high"))
    return F.when(broken, body)


def with_violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``violations``, an array of (rule, value, low, high)."""
    checks = _checks(df, rules)
    if not checks:
        return df.withColumn("violations", F.array().cast(_VIOLATIONS))
    ready = df
    if any(c.pattern for c in checks):
        ready = staged(df, {"_steps": directed_steps(F.col("atoms"), F.col("bonds"))})
    values = staged(ready, {f"_v{i}": _value(c, F.col("_steps")) for i, c in enumerate(checks)})
    found = F.array_compact(F.array(*[_violation(c, F.col(f"_v{i}")) for i, c in enumerate(checks)]))
    return values.withColumn("violations", found).select(*df.columns, "violations")


def rule_filter(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that break no rule."""
    return with_violations(df, rules).filter(F.size("violations") == 0).drop("violations")


def rule_violations(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """One row per broken rule: the keys, rule, value, low, high."""
    return explode_once(with_violations(df, rules), keys, "violations", "_v").select(*keys, "_v.*")


def motif_counts(df: DataFrame, patterns: dict[str, str], keys: list[str]) -> DataFrame:
    """The keys plus one count column per named chain pattern."""
    parsed = {name: path_pattern(text) for name, text in patterns.items()}
    wrong = [name for name, pattern in parsed.items() if pattern is None]
    if wrong:
        raise ValueError(f"not an unbranched chain: {wrong}")
    ready = staged(df, {"_steps": directed_steps(F.col("atoms"), F.col("bonds"))})
    counts = [count_paths(F.col("atoms"), F.col("_steps"), p).alias(n) for n, p in parsed.items()]
    return ready.select(*keys, *counts)
