"""Names, options and units as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths in nanometres.
UNITS = {"m": 1e9, "cm": 1e7, "mm": 1e6, "µm": 1e3, "nm": 1.0, "Å": 0.1}
SHEET_LETTERS = 25


def with_extension(name: Column, extension: str) -> Column:
    """The name with another extension in place of all that follows its first dot."""
    return F.concat(F.regexp_replace(name, r"\..*$", ""), F.lit(extension))


def has_extension(name: Column, extensions: list[str]) -> Column:
    """Whether the name ends with one of the extensions, in any case."""
    lower = F.lower(name)
    out = F.lit(False)
    for e in extensions:
        out = out | F.endswith(lower, F.lit(e.lower()))
    return out


def plain_name(name: Column) -> Column:
    """A feature's name without special characters."""
    out = F.replace(F.replace(name, F.lit("°"), F.lit("_deg_")), F.lit("/"), F.lit("_per_"))
    out = F.replace(F.replace(out, F.lit("^2"), F.lit("_sqd_")), F.lit("^3"), F.lit("_cubed_"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[^0-9a-zA-Z]+", "_"), "_+", "_"), "^_", "")


def sheet_name(name: Column) -> Column:
    return F.substring(name, 1, SHEET_LETTERS)


def image_name(base: Column, row: Column, column: Column, padding: int = 3, **planes: Column) -> Column:
    """``base_y000_x000...`` with a part for each plane (z, c, t) that is given."""
    number = lambda c: F.lpad(c.cast("string"), F.greatest(F.length(c.cast("string")), F.lit(padding)), "0")
    parts = [base, F.lit("_y"), number(row), F.lit("_x"), number(column)]
    for k, c in planes.items():
        parts += [F.lit(f"_{k}"), number(c)]
    return F.concat(*parts, F.lit(".ome.tif"))


def options(text: Column) -> Column:
    """The parts of a list that commas part, without blanks around them and without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def option_value(text: Column) -> Column:
    """``KEY=VALUE`` as ``key``, ``raw`` and the first of ``whole``, ``number``, ``flag`` that the value can be read as;
    null without an equals sign."""
    key, raw = F.trim(F.regexp_extract(text, "^([^=]*)=", 1)), F.trim(F.regexp_extract(text, "^[^=]*=(.*)$", 1))
    whole, number = raw.try_cast("long"), raw.try_cast("double")
    is_whole = raw.rlike("^[+-]?[0-9]+$")
    flag = F.when(F.lower(raw).isin("true", "false"), F.lower(raw) == "true")
    found = F.struct(key.alias("key"), raw.alias("raw"), F.when(is_whole, whole).alias("whole"), F.when(~is_whole, number).alias("number"), F.when(number.isNull(), flag).alias("flag"))
    return F.when(F.contains(text, F.lit("=")), found)


def text_of(column: Column, kind: str) -> Column:
    """Lists joined by blanks, everything else cast to text."""
    return F.array_join(column.cast("array<string>"), " ") if kind.startswith("array") else column.cast("string")


def converted(value: Column, unit: Column, to: str) -> Column:
    """A length in another unit; null for an unknown one."""
    factor = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])
    return value * F.try_element_at(factor, unit) / UNITS[to]


def common_spacing(x: Column, x_unit: Column, y: Column, y_unit: Column) -> Column:
    """Mean of two lengths, in the smaller of their units: ``value``, ``unit``."""
    factor = F.create_map(*[F.lit(v) for k, n in UNITS.items() for v in (k, n)])
    fx, fy = F.try_element_at(factor, x_unit), F.try_element_at(factor, y_unit)
    mean = (x * fx + y * fy) / 2
    return F.struct((mean / F.least(fx, fy)).alias("value"), F.when(fx < fy, x_unit).otherwise(y_unit).alias("unit"))


def expanded(asked: list[str], groups: dict[str, list[str]]) -> list[str]:
    """Features by name or by group (``*GROUP*``), each once, in order; an unknown one is an error.  Plans are made of it."""
    known = {f for fs in groups.values() for f in fs}
    out: list[str] = []
    for name in (part.strip() for item in asked for part in item.split(",")):
        found = groups.get(name.strip("*")) if name.startswith("*") and name.endswith("*") else [name] if name in known else None
        if found is None:
            raise ValueError(f"no such feature or group: {name}")
        out += [f for f in found if f not in out]
    return out


def checked(name: str, values: list[str], allowed: set[str]) -> Column:
    """Whether a column has one of some values, all of which must be among those allowed."""
    if wrong := sorted(set(values) - allowed):
        raise ValueError(f"{name} cannot be {wrong}")
    return F.col(name).isin(values)


def best_grouping(counts: dict[str, int], limit: int, start: str | None = None) -> tuple[list[str], int]:
    """The variables whose numbers of values, multiplied, come nearest to a limit from below.

    It begins with a variable (that with most values within the limit, else that with fewest) and tries every set of others
    beside it; the counts are those of a plan, so this runs on the driver.
    """
    if start is None:
        able = [v for v in counts if counts[v] <= limit]
        start = max(able, key=lambda v: counts[v]) if able else min(counts, key=lambda v: counts[v])
    best = {(start,): counts[start]}
    for v in (v for v in counts if v != start):
        best |= {(*group, v): n * counts[v] for group, n in best.items() if n * counts[v] <= limit}
    group, n = max(best.items(), key=lambda g: (g[1], -len(g[0])))
    return list(group), n
