"""JSON-like rules compiled to one boolean column; missing, NaN and infinite features always fail."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.operators.binning import finite

COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b}


def atom(feature: str, operator: str, threshold: float) -> Column:
    if operator not in COMPARE:
        raise ValueError(f"unknown comparison {operator}")
    c = F.col(feature).cast("double")
    return F.coalesce(finite(c) & COMPARE[operator](c, F.lit(float(threshold))), F.lit(False))


def conjunction(predicates: list[dict]) -> Column:
    return reduce(and_, (atom(p["feature"], p["operator"], p["threshold"]) for p in predicates), F.lit(True))


def compile_rules(rules: dict) -> Column:
    """rules: {"allOf": [{"alternatives": [[predicate, ...], ...]}, ...]}: all groups, of each any alternative, of it all predicates."""
    return reduce(and_, (reduce(or_, map(conjunction, g["alternatives"]), F.lit(False)) for g in rules["allOf"]), F.lit(True))


def validated(names: list[str], known: list[str]) -> list[str]:
    """The names in order; unknown and repeated ones are errors."""
    unknown = [n for n in names if n not in known]
    if unknown or len(set(names)) != len(names):
        raise ValueError(f"unknown or repeated names: {unknown or names}")
    return names
