"""Typed column handles: the same expressions, with the column's type checked when the plan is built."""

from __future__ import annotations

from collections.abc import Callable

from quillon.expr import Expr, col
from quillon.functions.rowwise import function

#: Spark types that each handle accepts.
KINDS = {
    "int": ("tinyint", "smallint", "int", "bigint"),
    "int32": ("int",),
    "float": ("float", "double"),
    "float32": ("float",),
    "str": ("string",),
    "bool": ("boolean",),
}


@function("typed")
def _typed(ctx, p, a):
    found = ctx.kind(a).simpleString()
    if found not in KINDS[p[0]]:
        raise TypeError(f"the column is {found}, not {p[0]}")
    return a


def _handle(kind: str) -> Callable[[str], Expr]:
    def make(name: str) -> Expr:
        return Expr("typed", (col(name),), (kind,))

    return make


Int, Int32, Float, Float32, Str, Bool = (_handle(k) for k in KINDS)
