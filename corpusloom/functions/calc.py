"""A calculator for arithmetic: a whitelist of syntax, turned into a Spark expression; numbers as text."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Pow: F.pow,
    ast.Mod: lambda a, b: F.when(b != 0, F.pmod(a, b)),
}
_CALLS = {"abs": F.abs, "min": F.least, "max": F.greatest, "pow": F.pow, "sqrt": F.sqrt, "round": lambda x, n=None: F.bround(x, 0), "floor": F.floor, "ceil": F.ceil, "exp": F.exp, "log": F.ln}


def compiled(expression: str, **columns: Column) -> Column:
    """A column for an arithmetic expression over the named ``columns``.

    Numbers, + - * / % **, parentheses and a few functions; anything else is a ValueError, so
    no code of the expression ever runs.
    """

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in columns:
            return columns[node.id].cast("double")
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return -walk(node.operand) if isinstance(node.op, ast.USub) else walk(node.operand)
        if isinstance(node, ast.Call) and not node.keywords:
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id == "math" else None
            if name in _CALLS:
                return _CALLS[name](*map(walk, node.args))
        raise ValueError(f"not allowed: {ast.unparse(node)}")

    return walk(ast.parse(expression.strip(), mode="eval"))


def _shown(numbers: pa.Array) -> pa.Array:
    return pa.array([None if x is None else repr(x) for x in numbers.to_pylist()], pa.string())


def shown(number: Column) -> Column:
    """A double as text, as Python and SQL write it: the fewest digits that tell it from others, with an
    exponent only from 1e16 upwards and below 1e-4.  (Java's text has one from 1e7, and often a digit too many.)"""
    return F.arrow_udf(_shown, "string")(number)


def rounded(number: Column, digits: int) -> Column:
    """A double rounded as in C and SQL: the multiple of its power of ten half away from zero.  (Spark rounds the number's
    text, which differs where the number lies next to the middle of two.)"""
    scaled = number * F.lit(10.0**digits)
    whole = F.floor(F.abs(scaled)).cast("double")
    near = F.signum(scaled) * (whole + F.when(F.abs(scaled) - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)
    return F.when(F.abs(scaled) < float(1 << 52), near).otherwise(number)
