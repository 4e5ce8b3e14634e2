"""A small algebra of stages: what turns one value per row into another, put together with | and compiled into one plan.

A stage reads a column and adds one. Expressions stay expressions of the plan, plain Python functions become Arrow UDFs, and a stage that
needs a join (a retriever) or a model is a function of tables. Nothing runs before the result is asked for.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.template import Template

_numbers = itertools.count()


class Stage:
    """into(rows, column, name): rows with the further column `name`, made of `column`. Rows and their number stay."""

    def __init__(self, into: Callable[[DataFrame, str, str], DataFrame]):
        self.into = into

    def __or__(self, after: Stage | Callable | Template) -> Stage:
        after = staged(after)

        def both(rows: DataFrame, column: str, name: str) -> DataFrame:
            between = f"_stage{next(_numbers)}"
            return after.into(self.into(rows, column, between), between, name).drop(between)

        return Stage(both)

    def __ror__(self, before: Callable | Template) -> Stage:
        return staged(before) | self

    def over(self, rows: DataFrame, column: str, name: str = "value") -> DataFrame:
        """rows with the chain's result as the column `name`."""
        return self.into(rows, column, name)


def passed() -> Stage:
    """The value as it is."""
    return expression(lambda c: c)


def expression(f: Callable[[Column], Column]) -> Stage:
    """A function of Columns: built-in functions, part of the plan."""
    return Stage(lambda rows, column, name: rows.withColumn(name, f(F.col(column))))


def lifted(f: Callable, returns: str) -> Stage:
    """A plain Python function of one value, lifted to a column by an Arrow UDF; `returns` is the type of its result. Nulls are passed to it."""
    return Stage(lambda rows, column, name: rows.withColumn(name, F.udf(f, returns, useArrow=True)(F.col(column))))


def table(f: Callable[[DataFrame, str, str], DataFrame]) -> Stage:
    """A function of tables: (rows, column, name) to rows with the further column `name`."""
    return Stage(f)


def field(name_: str) -> Stage:
    """One field of a record."""
    return expression(lambda c: c[name_])


def record(**branches: Stage | Callable) -> Stage:
    """All branches over the same value, side by side: a struct with a field for each."""
    stages = {k: staged(v) for k, v in branches.items()}

    def into(rows: DataFrame, column: str, name: str) -> DataFrame:
        made = {k: f"_stage{next(_numbers)}" for k in stages}
        for k, stage in stages.items():
            rows = stage.into(rows, column, made[k])
        return rows.withColumn(name, F.struct(*(F.col(c).alias(k) for k, c in made.items()))).drop(*made.values())

    return Stage(into)


def filled(template: Template) -> Stage:
    """A record whose fields fill the template's slots; a slot without a field is an error, other fields are passed over."""

    def into(rows: DataFrame, column: str, name: str) -> DataFrame:
        fields = rows.schema[column].dataType.fieldNames()
        return rows.withColumn(name, template.column(**{s: F.col(column)[s] for s in template.slots if s in fields}))

    return Stage(into)


def staged(x: Stage | Callable | Template) -> Stage:
    """What may stand in a chain as a stage: a stage, a template, or a function with an annotated result (str, int, float, bool), which is lifted."""
    if isinstance(x, Stage):
        return x
    if isinstance(x, Template):
        return filled(x)
    kinds = {"str": "string", "int": "long", "float": "double", "bool": "boolean"}
    result = getattr(x, "__annotations__", {}).get("return")
    kind = kinds.get(result if isinstance(result, str) else getattr(result, "__name__", ""))
    if not kind:
        raise TypeError("say what the function returns: annotate it, or use lifted(f, type)")
    return lifted(x, kind)
