"""Nested predicates as columns."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {"=": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}


def compile_predicate(tree: Mapping) -> Column:
    """A column from nested ``{"AND": [...]}``, ``{"OR": [...]}``, ``{"NOT": {...}}``, ``{"IN": {field: [...]}}`` and
    ``{op: {field: value}}``; several fields of one comparison must all hold.  Spark pushes it down to the scan."""
    parts = []
    for key, body in tree.items():
        if key in ("AND", "OR"):
            join = Column.__and__ if key == "AND" else Column.__or__
            parts.append(functools.reduce(join, map(compile_predicate, body)))
        elif key == "NOT":
            parts.append(~compile_predicate(body))
        elif key == "IN":
            parts += [F.col(f).isin(list(v)) for f, v in body.items()]
        elif key in COMPARISONS:
            parts += [COMPARISONS[key](F.col(f), F.lit(v)) for f, v in body.items()]
        else:
            raise ValueError(f"no such operator: {key}")
    return functools.reduce(Column.__and__, parts)


def from_fields(**fields: object) -> dict:
    """A conjunction: lists are sets, pairs of numbers ranges, other values equal."""
    out: list[dict] = []
    for name, value in fields.items():
        if value is None:
            continue
        if isinstance(value, tuple):
            out += [{">=": {name: value[0]}}, {"<=": {name: value[1]}}]
        elif isinstance(value, list):
            out.append({"IN": {name: value}})
        else:
            out.append({"=": {name: value}})
    return {"AND": out}
