"""Tools that the reasoning loop can call, as functions of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import calc

#: Fixed value: what an unknown tool answers, before its name.
UNKNOWN = "未找到工具: "


class Tools:
    """Tools by name; one that is registered again takes the place of the first."""

    def __init__(self):
        self._tools: dict[str, tuple[str, Callable[[Column], Column]]] = {}

    def register(self, name: str, about: str, run: Callable[[Column], Column]) -> Tools:
        """``run`` makes the result's column from that of the argument, a text."""
        self._tools[name] = (about, run)
        return self

    def names(self) -> list[str]:
        return [*self._tools]

    def schema(self) -> list[dict]:
        """The tools as a model with native calls wants them named."""
        argument = {"type": "object", "properties": {"argument": {"type": "string"}}, "required": ["argument"]}
        return [{"type": "function", "function": {"name": name, "description": about, "parameters": argument}} for name, (about, _) in self._tools.items()]

    def call(self, name: Column, argument: Column) -> Column:
        """The result of the named tool for each row; an unknown name gives a message."""
        out = F.concat(F.lit(UNKNOWN), F.coalesce(name, F.lit("")))
        for known, (_, run) in self._tools.items():
            out = F.when(name == known, run(argument).cast("string")).otherwise(out)
        return out


def standard(retrieve: Callable[[Column], Column] | None = None) -> Tools:
    """The calculator (sums and products of two numbers) and the date; retrieval if given."""
    tools = Tools()
    if retrieve is not None:
        tools.register("retrieve", "Find passages for a question.", retrieve)
    return tools.register("calculator", "Two numbers with + - * or / between them.", _calculated).register("datetime", "Date, year or weekday of a time.", _dated)


def _calculated(argument: Column) -> Column:
    part = lambda k: F.regexp_extract(argument, r"^\s*(-?\d+(?:\.\d+)?)\s*([-+*/])\s*(-?\d+(?:\.\d+)?)\s*$", k)
    a, op, b = part(1).try_cast("double"), part(2), part(3).try_cast("double")
    return calc.shown(F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b)))


def _dated(argument: Column) -> Column:
    return F.date_format(F.try_to_timestamp(argument), "yyyy-MM-dd EEEE")
