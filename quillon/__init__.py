"""A Spark-native frame, SQL and data-processing engine."""

from quillon.expr import Expr, all_of, any_of, coalesce, col, concat_str, int_range, lit, ones, when, zeros
from quillon.frame import Frame, concat
from quillon.series import Series

__all__ = ["Expr", "Frame", "Series", "all_of", "any_of", "coalesce", "col", "concat", "concat_str", "int_range", "lit", "ones", "when", "zeros"]
