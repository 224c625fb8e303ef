"""Column selectors: functions from a schema to column names, in schema order."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import types as T

Selector = Callable[[T.StructType], list[str]]


def where(test: Callable[[T.StructField], bool]) -> Selector:
    return lambda schema: [f.name for f in schema.fields if test(f)]


def everything() -> Selector:
    return where(lambda f: True)


def named(*names: str) -> Selector:
    return lambda schema: [n for n in names if n in schema.names]


def exclude(*names: str) -> Selector:
    return where(lambda f: f.name not in names)


def by_dtype(*kinds: str) -> Selector:
    return where(lambda f: f.dataType.simpleString() in kinds)


def numeric() -> Selector:
    return where(lambda f: isinstance(f.dataType, T.NumericType))


def integers() -> Selector:
    return where(lambda f: isinstance(f.dataType, T.IntegralType))


def floats() -> Selector:
    return where(lambda f: isinstance(f.dataType, (T.FloatType, T.DoubleType)))


def strings() -> Selector:
    return where(lambda f: isinstance(f.dataType, T.StringType))


def starts_with(prefix: str) -> Selector:
    return where(lambda f: f.name.startswith(prefix))


def ends_with(suffix: str) -> Selector:
    return where(lambda f: f.name.endswith(suffix))


def contains(part: str) -> Selector:
    return where(lambda f: part in f.name)


def matching(pattern: str) -> Selector:
    return where(lambda f: re.search(pattern, f.name) is not None)


def union(*sels: Selector) -> Selector:
    return lambda schema: [n for n in schema.names if any(n in s(schema) for s in sels)]


def intersect(*sels: Selector) -> Selector:
    return lambda schema: [n for n in schema.names if all(n in s(schema) for s in sels)]


def minus(a: Selector, *rest: Selector) -> Selector:
    return lambda schema: [n for n in a(schema) if not any(n in s(schema) for s in rest)]
