"""What users add: their own steps, table functions, and descriptions of operators."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator
from typing import get_type_hints

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def with_retries(step: Callable[[pd.DataFrame], pd.DataFrame], tries: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A user's step for ``mapInPandas`` that is tried again when it fails; after the last time its error stands."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for left in range(tries - 1, -1, -1):
                try:
                    out = step(frame)
                    break
                except Exception:
                    if not left:
                        raise
            yield out

    return run


def apply_step(df: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, tries: int = 3) -> DataFrame:
    """A user's step over all rows in batches.  It may run more than once on a batch, so it should have no effect but its
    result."""
    return df.mapInPandas(with_retries(step, tries), schema)


class Tiles:
    """``y0, y1, x0, x1`` of the tiles of an image, for SQL: ``SELECT * FROM tiles(height, width, size)``."""

    def eval(self, height: int, width: int, size: int):
        for y in range(0, height, size):
            for x in range(0, width, size):
                yield y, min(y + size, height), x, min(x + size, width)


def register(spark: SparkSession) -> None:
    """Table functions under their names in SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("tiles", udtf(Tiles, returnType="y0 long, y1 long, x0 long, x1 long"))


#: Types of parameters in a description.
KINDS = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array", dict: "object"}


def described(operator: Callable) -> dict:
    """An operator's name, first sentence, inputs and parameters, read off its signature."""
    hints, inputs, properties, required = get_type_hints(operator), [], {}, []
    for name, p in inspect.signature(operator).parameters.items():
        hint = hints.get(name)
        if hint is DataFrame:
            inputs.append(name)
            continue
        kind = KINDS.get(getattr(hint, "__origin__", hint), "object")
        properties[name] = {"type": kind} | ({} if p.default is inspect.Parameter.empty or not isinstance(p.default, (int, float, str, bool)) else {"default": p.default})
        if p.default is inspect.Parameter.empty:
            required.append(name)
    text = (inspect.getdoc(operator) or "").split(".")[0].replace("\n", " ")
    return {"name": operator.__name__, "description": text, "inputs": inputs, "parameters": {"type": "object", "properties": properties, "required": required}}


def manifest(operators: list[Callable]) -> str:
    """Descriptions of operators as one JSON document."""
    return json.dumps([described(o) for o in operators], indent=2)
