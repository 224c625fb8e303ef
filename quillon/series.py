"""Single columns with a name, outside a frame.

A ``Series`` is a frame of one column: it is lazy, has the frame's row order
and null rules, and gives scalars, positions and new series.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

from quillon import stats
from quillon.expr import Expr, col, lit
from quillon.frame import Frame, concat
from quillon.functions.rowwise import TYPES

_ARROW = {"i8": pa.int8(), "i16": pa.int16(), "i32": pa.int32(), "i64": pa.int64(), "f32": pa.float32(), "f64": pa.float64(), "bool": pa.bool_(), "str": pa.string(), "date": pa.date32(), "datetime": pa.timestamp("us")}


class Series:
    def __init__(self, frame: Frame):
        (self.name,) = frame.columns
        self.frame = frame

    # --- construction

    @classmethod
    def of(cls, frame: Frame, name: str) -> Series:
        """A column of a frame."""
        if name not in frame.columns:
            raise KeyError(f"no column {name}")
        return cls(frame.select(name))

    @classmethod
    def from_values(cls, spark: SparkSession, name: str, values: list, dtype: str | None = None, valid: list[bool] | None = None) -> Series:
        """From values; where ``valid`` is false the value is null."""
        if valid is not None and len(valid) != len(values):
            raise ValueError("values and validity differ in length")
        data = values if valid is None else [v if ok else None for v, ok in zip(values, valid, strict=True)]
        return cls.from_arrow(spark, name, pa.array(data, _ARROW[dtype] if dtype else None))

    @classmethod
    def from_times(cls, spark: SparkSession, name: str, ticks: list[int | None], unit: str = "us") -> Series:
        """From counts of seconds, milli- or microseconds since 1970; the unit of the column is microseconds."""
        step = {"s": 1_000_000, "ms": 1_000, "us": 1}[unit]
        epoch = dt.datetime(1970, 1, 1)
        return cls.from_values(spark, name, [None if t is None else epoch + dt.timedelta(microseconds=t * step) for t in ticks], "datetime")

    @classmethod
    def from_arrow(cls, spark: SparkSession, name: str, *chunks: pa.Array | pa.ChunkedArray) -> Series:
        """From Arrow arrays of one type, one after the other."""
        return cls(Frame.from_arrow(spark, pa.table({name: pa.chunked_array([c for x in chunks for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])])})))

    # --- properties

    @property
    def dtype(self) -> str:
        return self.frame.dtypes[0][1]

    def __len__(self) -> int:
        return self.frame.height()

    def null_count(self) -> int:
        return self.frame.null_count().collect()[0][0]

    def has_nulls(self) -> bool:
        return stats.has_nulls(self.frame, self.name)

    def to_list(self) -> list:
        return [r[0] for r in self.frame.collect()]

    def to_arrow(self) -> pa.ChunkedArray:
        return self.frame.to_arrow().column(0)

    def get(self, at: int) -> Any:
        return self.frame.row(at)[0]

    def equals(self, other: Series) -> bool:
        return self.frame.equals(other.frame)

    # --- new series

    def rename(self, name: str) -> Series:
        return Series(self.frame.rename(self.name, name))

    def expr(self, f: Callable[[Expr], Expr]) -> Series:
        """Any expression of the column, such as ``lambda c: c.str.upper()``."""
        return Series(self.frame.select(f(col(self.name)).alias(self.name)))

    def _with(self, other: Any, f: Callable[[Expr, Expr], Expr]) -> Series:
        if not isinstance(other, Series):
            return self.expr(lambda c: f(c, lit(other)))
        right = other.rename("?other").frame
        return Series(self.frame.hstack(right).select(f(col(self.name), col("?other")).alias(self.name)))

    def apply(self, f: Callable[[Any], Any], to: str | None = None) -> Series:
        """Host function on the non-null values."""
        return Series(self.frame.map_values(self.name, f, TYPES.get(to, to) if to else None))

    def filter(self, mask: Series) -> Series:
        """Values where ``mask`` is true."""
        return Series(self.frame.hstack(mask.rename("?mask").frame).filter(col("?mask")).select(self.name))

    def append(self, *others: Series) -> Series:
        return Series(concat(self.frame, *[o.rename(self.name).frame for o in others]))

    def __add__(self, o: Any) -> Series: return self._with(o, lambda a, b: a + b)
    def __sub__(self, o: Any) -> Series: return self._with(o, lambda a, b: a - b)
    def __mul__(self, o: Any) -> Series: return self._with(o, lambda a, b: a * b)
    def __truediv__(self, o: Any) -> Series: return self._with(o, lambda a, b: a / b)
    def __lt__(self, o: Any) -> Series: return self._with(o, lambda a, b: a < b)
    def __le__(self, o: Any) -> Series: return self._with(o, lambda a, b: a <= b)
    def __gt__(self, o: Any) -> Series: return self._with(o, lambda a, b: a > b)
    def __ge__(self, o: Any) -> Series: return self._with(o, lambda a, b: a >= b)

    def __getattr__(self, name: str) -> Any:
        if name in ("sum", "mean", "min", "max", "median", "std", "var", "product", "skew", "kurtosis"):
            return lambda: stats.series_agg(self.frame, self.name, name)
        if name in ("search_sorted", "index_of", "is_sorted", "first_non_null"):
            return lambda *a, **k: getattr(stats, name)(self.frame, self.name, *a, **k)
        if not name.startswith("_") and callable(getattr(Expr, name, None)):
            return lambda *a, **k: self.expr(lambda c: getattr(c, name)(*a, **k))
        raise AttributeError(name)
