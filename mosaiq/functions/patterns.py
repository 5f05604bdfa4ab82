"""File-name patterns: names as typed variables.

A pattern such as ``x{x:ddd}_y{y:d+}_{chan:c+}.tif`` has literal text and variables.  ``d`` stands for one digit and
``c`` for one letter; ``+`` after it for one or more.  Patterns are compiled when a plan is made; what runs is a regular
expression inside the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.ranks import ranked

VARIABLE = re.compile(r"\{(\w+):([dc]+\+?)\}")


@dataclass(frozen=True)
class Variable:
    name: str
    spec: str

    @property
    def numeric(self) -> bool:
        return self.spec[0] == "d"

    @property
    def width(self) -> int | None:
        return None if self.spec.endswith("+") else len(self.spec)

    @property
    def regex(self) -> str:
        unit = "[0-9]" if self.numeric else "[a-zA-Z]"
        return f"({unit}+)" if self.width is None else f"({unit}{{{self.width}}})"


class FilePattern:
    def __init__(self, text: str):
        self.text = text
        self.variables = [Variable(m[1], m[2]) for m in VARIABLE.finditer(text)]
        if len({v.name for v in self.variables}) < len(self.variables):
            raise ValueError(f"a variable comes twice in {text}")
        literals, at = [], 0
        for m in VARIABLE.finditer(text):
            literals.append(text[at : m.start()])
            at = m.end()
        self.literals = [*literals, text[at:]]

    @property
    def regex(self) -> str:
        parts = [re.escape(self.literals[0])]
        for v, literal in zip(self.variables, self.literals[1:], strict=True):
            parts += [v.regex, re.escape(literal)]
        return "^" + "".join(parts) + "$"

    def extract(self, name: Column) -> dict[str, Column]:
        """A column for each variable: numbers as long, else text; null where the name does not match."""
        hit, out = name.rlike(self.regex), {}
        for i, v in enumerate(self.variables, 1):
            got = F.when(hit, F.regexp_extract(name, self.regex, i))
            out[v.name] = got.try_cast("long") if v.numeric else got
        return out

    def parse(self, files: DataFrame, column: str = "file") -> DataFrame:
        """The matching files with their variables."""
        return files.filter(F.col(column).rlike(self.regex)).withColumns(self.extract(F.col(column)))

    def format(self, values: dict[str, Column]) -> Column:
        """A name from values; numbers are padded with zeros to the variable's width."""
        parts: list[Column] = [F.lit(self.literals[0])]
        for v, literal in zip(self.variables, self.literals[1:], strict=True):
            value = values[v.name].cast("string")
            if v.numeric and v.width:
                value = F.lpad(value, F.greatest(F.length(value), F.lit(v.width)), F.lit("0"))
            parts += [value, F.lit(literal)]
        return F.concat(*parts)


def letters_to_numbers(files: DataFrame, variable: str) -> DataFrame:
    """A letter variable as its rank: shorter values first, then alphabetical, from 0."""
    values = files.select(variable).distinct()
    return files.join(ranked(values, [F.length(variable), F.col(variable)], f"{variable}_rank"), variable)


def rename(files: DataFrame, source: FilePattern, target: FilePattern, column: str = "file") -> DataFrame:
    """``new_name`` of each file that matches; letters become numbers where the target asks for them."""
    out = source.parse(files, column)
    numeric = {v.name for v in source.variables if v.numeric}
    values: dict[str, Column] = {}
    for v in target.variables:
        if v.numeric and v.name not in numeric:
            out = letters_to_numbers(out, v.name)
            values[v.name] = F.col(f"{v.name}_rank")
        else:
            values[v.name] = F.col(v.name)
    return out.withColumn("new_name", target.format(values))
