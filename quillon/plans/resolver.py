"""Turns expressions into Columns over a frame's DataFrame.

Row-local parts become plain columns.  Aggregates become scalar subqueries, or
one grouped aggregation joined back for ``over`` (a grouped aggregation has
map-side combine, a window doesn't).  Order-dependent functions run over
partition windows for ``over`` and over blocks of rows otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import order
from quillon.expr import AGGREGATES, ORDERED, RESHAPING, Expr, contains, walk
from quillon.functions import aggregates, rowwise
from quillon.runtime import quoted

if TYPE_CHECKING:
    from quillon.frame import Frame

#: (hidden column, descending, nulls first)
Order = tuple[tuple[str, bool, bool], ...]
ROW = "__row"


def sort_columns(spec: Order) -> list[Column]:
    return [{(0, 0): c.asc_nulls_last, (0, 1): c.asc_nulls_first, (1, 0): c.desc_nulls_last, (1, 1): c.desc_nulls_first}[(d, n)]() for name, d, n in spec for c in [F.col(name)]]


class Resolver:
    """Resolves expressions one after the other, adding hidden columns as needed."""

    def __init__(self, frame: Frame):
        self.df: DataFrame = frame.df
        self.order: Order | None = frame.order
        self.dense: bool = frame.dense
        self._n = 0
        self._ready: dict[int, Column] = {}

    # --- helpers

    def kind(self, c: Column) -> T.DataType:
        return self.df.select(c).schema[0].dataType

    def put(self, c: Column) -> str:
        """Add a hidden column."""
        self._n += 1
        name = f"__t{self._n}"
        while name in self.df.columns:
            self._n += 1
            name = f"__t{self._n}"
        self.df = self.df.withColumn(name, c)
        return name

    def ordered(self) -> Order:
        """Make the input order explicit."""
        if self.order is None:
            self.df = self.df.withColumn(ROW, F.monotonically_increasing_id())
            self.order = ((ROW, False, False),)
        return self.order

    def indexed(self) -> None:
        """Number the rows densely."""
        if not self.dense:
            spec = self.ordered()  # may add a column
            self.df = order.dense_index(self.df.drop(order.INDEX), sort_columns(spec))
            self.order, self.dense = ((order.INDEX, False, False),), True

    def order_key(self) -> Column:
        """One sortable column for the row order."""
        spec = self.ordered()
        if all(not desc and not first for _, desc, first in spec):
            return F.col(spec[0][0]) if len(spec) == 1 else F.struct(*[n for n, _, _ in spec])
        self.indexed()
        return F.col(order.INDEX)

    # --- expressions

    def prepare(self, exprs: list[Expr]) -> None:
        """Evaluate the order-dependent parts of several expressions in one pass each:
        those that look at neighbours, and cumulative ones forward and backward."""
        found: list[Expr] = []

        def look(e: Expr) -> None:
            if e.op == "over":
                return
            if e.op in ORDERED and not any(contains(a, ORDERED | AGGREGATES | {"over"}) for a in e.args):
                found.append(e)
                return
            for a in e.args:
                look(a)

        for e in exprs:
            look(e)
        near = [e for e in found if is_bounded(e)]
        runs = {b: [e for e in found if is_running(e) and (e.op == "backward_fill") == b] for b in (False, True)}
        if len(near) + len(runs[False]) + len(runs[True]) < 2:
            return
        inputs = {id(e): F.col(self.put(self.column(e.args[0]))) for e in (*near, *runs[False], *runs[True])}
        self.indexed()
        if near:
            parts = [(e, *bounded(e.op, inputs[id(e)], e.params, self.kind(inputs[id(e)]))) for e in near]
            outs = {self.fresh(): build for _, _, _, build in parts}
            self.df = order.neighbours(self.df, max(p[1] for p in parts), max(p[2] for p in parts), outs)
            self._ready |= {id(e): F.col(n) for (e, *_), n in zip(parts, outs, strict=True)}
        for backward, es in runs.items():
            if es:
                forms = [self._running_form(e.op, inputs[id(e)]) for e in es]
                outs = {self.fresh(): r for r, _ in forms}
                self.df = order.carried(self.df, outs, backward)
                self._ready |= {id(e): finish(F.col(n)) for e, n, (_, finish) in zip(es, outs, forms, strict=True)}

    def fresh(self) -> str:
        self._n += 1
        return f"__r{self._n}"

    def column(self, e: Expr, keys: tuple[str, ...] | None = None) -> Column:
        if e.op == "col":
            return F.col(quoted(e.params[0]))
        if e.op == "lit":
            return rowwise.literal(e.params[0])
        if e.op == "alias":
            return self.column(e.args[0], keys)
        if e.op == "over":
            return self._over(e.args[0], e.params)
        if e.op in RESHAPING:
            raise ValueError(f"{e.op} changes the length: select it alone")
        if e.op in AGGREGATES:
            return self._scalar(e) if keys is None else F.col(self._grouped([e], keys)[0])
        if e.op in ORDERED:
            return self._ready[id(e)] if id(e) in self._ready and keys is None else self._ordered(e, keys)
        return rowwise.FUNCTIONS[e.op](self, e.params, *[self.column(a, keys) for a in e.args])

    def _over(self, inner: Expr, keys: tuple[str, ...]) -> Column:
        aggs = [x for x in walk(inner) if x.op in AGGREGATES and not any(contains(a, AGGREGATES | ORDERED) for a in x.args)]
        if not aggs:
            return self.column(inner, keys)
        names = dict(zip(map(id, aggs), self._grouped(aggs, keys), strict=True))

        def swap(e: Expr) -> Expr:
            if id(e) in names:
                return Expr("col", (), (names[id(e)],))
            return Expr(e.op, tuple(swap(a) for a in e.args), e.params)

        return self.column(swap(inner), keys)

    def aggregate_column(self, e: Expr) -> Column:
        """Aggregate for use in ``agg``; its argument must be row-local."""
        c = self.column(e.args[0])
        needs = e.op in ("first", "last", "arg_min", "arg_max")
        if e.op in ("arg_min", "arg_max"):
            self.indexed()
        key = self.order_key() if needs else None
        return aggregates.aggregate(e.op, c, self.kind(c), e.params, key)

    def _scalar(self, e: Expr) -> Column:
        if e.op == "entropy":
            c = F.col(self.put(self.column(e.args[0])))
            counts = self.df.filter(c.isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            return counts.agg(entropy_of("n", e.params[0])).scalar()
        if e.op in ("median", "quantile"):
            name = self.put(self.column(e.args[0]))
            return order.quantile_frame(self.df.select(name), name, 0.5 if e.op == "median" else float(e.params[0])).scalar()
        c = self.aggregate_column(e)
        return self.df.agg(c).scalar()

    def _grouped(self, aggs: list[Expr], keys: tuple[str, ...]) -> list[str]:
        """Aggregates per key, joined back as hidden columns."""
        names = [f"__g{self._n}_{i}" for i in range(len(aggs))]
        self._n += 1
        self.attach(self.per_key([(n, e) for n, e in zip(names, aggs, strict=True)], keys), keys)
        return names

    def per_key(self, aggs: list[tuple[str, Expr]], keys: tuple[str, ...], *more: Column) -> DataFrame:
        """Aggregates by key: ``(__k0, ..., names...)`` and the columns of ``more``.

        Quantiles and entropy have no small buffer; they come from counts of
        values per key and are joined on.
        """
        by = [F.col(quoted(k)).alias(f"__k{j}") for j, k in enumerate(keys)]
        wide = [(n, e) for n, e in aggs if e.op in ("median", "quantile", "entropy") and keys]
        plain = [self.aggregate_column(e).alias(n) for n, e in aggs if (n, e) not in wide]
        # inputs first: they may add columns
        inputs = {n: self.put(self.column(e.args[0])) for n, e in wide}
        out = self.df.groupBy(*by).agg(*plain, *more) if plain or more else self.df.select(*by).distinct()
        key = F.struct(*[F.col(f"__k{j}") for j in range(len(keys))])
        for n, e in wide:
            rows = self.df.select(*by, F.col(inputs[n]).alias("__v")).select(key.alias("__key"), "__v")
            if e.op == "entropy":
                counts = rows.filter("__v is not null").groupBy("__key", "__v").agg(F.count(F.lit(1)).alias("n"))
                found = counts.groupBy("__key").agg(entropy_of("n", e.params[0]).alias(n))
            else:
                found = order.quantiles_by(rows, "__key", "__v", [0.5 if e.op == "median" else float(e.params[0])]).withColumnRenamed("q0", n)
            out = out.withColumn("__key", key).join(found, "__key", "left").drop("__key")
        return out

    def attach(self, per_key: DataFrame, keys: tuple[str, ...]) -> None:
        """Join a table with columns __k0.. back on the keys, null equal to null."""
        if not keys:
            self.df = self.df.join(F.broadcast(per_key))  # one row
            return
        on = reduce(and_, [self.df[quoted(k)].eqNullSafe(per_key[f"__k{j}"]) for j, k in enumerate(keys)])
        self.df = self.df.join(per_key, on, "left").drop(*[f"__k{j}" for j in range(len(keys))])

    # --- order-dependent functions

    def _ordered(self, e: Expr, keys: tuple[str, ...] | None) -> Column:
        op, p = e.op, e.params
        c = F.col(self.put(self.column(e.args[0], keys)))
        if op == "rank":
            return self._rank(c, p[0], keys)
        if op in ("is_duplicated", "is_unique", "is_first_distinct", "is_last_distinct"):
            return self._occurrence(op, c, keys)
        if op.startswith("ewm_"):
            return self._ewm(op, c, float(p[0]), keys)
        if is_running(e):
            return self._running(op, c, keys)
        back, ahead, build = bounded(op, c, p, self.kind(c))
        if keys is not None:
            return build(Window.partitionBy(*[F.col(quoted(k)) for k in keys]).orderBy(*sort_columns(self.ordered())))
        self.indexed()
        out = self.fresh()
        self.df = order.neighbours(self.df, back, ahead, {out: build})
        return F.col(out)

    def _running_form(self, op: str, c: Column) -> tuple[order.Running, Callable[[Column], Column]]:
        """A cumulative function and what finishes its value."""
        kind = self.kind(c)
        double = c.cast("double")
        at = F.col(order.INDEX)
        forms = {
            "cum_sum": (F.sum(c), F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b),
            "cum_min": (F.min(c), F.min, F.least),
            "cum_max": (F.max(c), F.max, F.greatest),
            "cum_prod": (F.product(double), F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * b),
            "cum_count": (F.count(c), F.sum, lambda a, b: F.coalesce(a, F.lit(0).cast("long")) + b),
            "forward_fill": (F.max_by(c, F.when(c.isNotNull(), at)), None, lambda a, b: F.coalesce(b, a)),
            "backward_fill": (F.min_by(c, F.when(c.isNotNull(), at)), None, lambda a, b: F.coalesce(b, a)),
        }
        total, over, join = forms[op]
        fill = over is None
        local_f = {"cum_count": F.count, "cum_prod": lambda _: F.product(double)}.get(op, over)
        local = (lambda w: F.last(c, ignorenulls=True).over(w)) if fill else (lambda w: local_f(c).over(w))
        guard = (lambda x: x) if fill or op == "cum_count" else (lambda x: F.when(c.isNotNull(), x))
        typed = (lambda x: x.cast(kind)) if op == "cum_sum" and rowwise.is_int(kind) else (lambda x: x)
        carry = (lambda t, w: F.last(t, ignorenulls=True).over(w)) if fill else (lambda t, w: over(t).over(w))
        return order.Running(total, carry, local, join), lambda x: typed(guard(x))

    def _running(self, op: str, c: Column, keys: tuple[str, ...] | None) -> Column:
        form, finish = self._running_form(op, c)
        if keys is not None:
            w = Window.partitionBy(*[F.col(quoted(k)) for k in keys]).orderBy(*sort_columns(self.ordered()))
            if op == "backward_fill":
                return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
            return finish(form.local(w.rowsBetween(Window.unboundedPreceding, 0)))
        self.indexed()
        out = self.fresh()
        self.df = order.carried(self.df, {out: form}, op == "backward_fill")
        return finish(F.col(out))

    def _rank(self, c: Column, method: str, keys: tuple[str, ...] | None) -> Column:
        if keys is not None:
            by = [F.col(quoted(k)) for k in keys]
            w = Window.partitionBy(*by, c.isNull()).orderBy(c.asc())
            same = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
            low = F.rank().over(w)
            forms = {"min": low, "max": low + same - 1, "average": low + (same - 1) / 2, "dense": F.dense_rank().over(w)}
            value = F.row_number().over(w.orderBy(c.asc(), *sort_columns(self.ordered()))) if method == "ordinal" else forms[method]
            return F.when(c.isNotNull(), value.cast("double"))
        name = self.df.select(c).columns[0]
        if method == "ordinal":
            # positions by value, then by row order; nulls go last and get none
            spec = self.ordered()
            self.df = order.dense_index(self.df, [c.asc_nulls_last(), *sort_columns(spec)], f"__o{self._n}")
            return F.when(c.isNotNull(), (F.col(f"__o{self._n}") + 1).cast("double"))
        v = order.value_positions(self.df.select(name), name)
        low, n = F.col("before") + 1, F.col("n")
        value = {"min": low, "max": F.col("before") + n, "average": low + (n - 1) / 2, "dense": F.col("dense") + 1}[method]
        self._n += 1
        self.attach(v.select(F.col(name).alias("__k0"), value.cast("double").alias(f"__r{self._n}")), (name,))
        return F.col(f"__r{self._n}")

    def _occurrence(self, op: str, c: Column, keys: tuple[str, ...] | None) -> Column:
        name = self.df.select(c).columns[0]
        by = (*(keys or ()), name)
        count = op in ("is_duplicated", "is_unique")
        key = None if count else F.col(self.put(self.order_key()))
        self._n += 1
        out = f"__r{self._n}"
        agg = F.count(F.lit(1)) if count else (F.min(key) if op == "is_first_distinct" else F.max(key))
        self.attach(self.df.groupBy(*[F.col(quoted(k)).alias(f"__k{j}") for j, k in enumerate(by)]).agg(agg.alias(out)), by)
        if count:
            return F.col(out) > 1 if op == "is_duplicated" else F.col(out) == 1
        return key == F.col(out)

    def _ewm(self, op: str, c: Column, alpha: float, keys: tuple[str, ...] | None) -> Column:
        """Exponential moments by the recursion, in Arrow batches per key or block.

        A block's moments are linear in those before it, so blocks run apart
        and the carries are added up over one row a block.
        """
        name = self.df.select(c).columns[0]
        spec = self.ordered()
        self._n += 1
        out = f"__r{self._n}"
        schema = T.StructType([*self.df.schema.fields, T.StructField(out, T.DoubleType())])
        if keys is not None:
            by, flags = list(keys), [not d for _, d, _ in spec]

            def per_key(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values([n for n, _, _ in spec], ascending=flags, kind="stable")
                return pdf.assign(**{out: ewm(pdf[name].to_numpy(dtype=float, na_value=np.nan), alpha, op, np.zeros(4))[0]})

            self.df = self.df.groupBy(*[F.col(quoted(k)) for k in by]).applyInPandas(per_key, schema)
            return F.col(out)
        self.indexed()
        schema = T.StructType([*self.df.schema.fields, T.StructField(out, T.DoubleType())])
        blocks = self.df.withColumn("__b", F.floor(F.col(order.INDEX) / order.BLOCK_ROWS))

        def ends(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order.INDEX)
            x = pdf[name].to_numpy(dtype=float, na_value=np.nan)
            return pd.DataFrame({"b": [pdf["__b"].iloc[0]], "m": [ewm(x, alpha, op, np.zeros(4))[1].tolist()], "n": [int((~np.isnan(x)).sum())]})

        def carries(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("b")
            state, rows = np.zeros(4), []
            for m, n in zip(pdf["m"], pdf["n"], strict=True):
                rows.append(state.tolist())
                decay = (1 - alpha) ** n
                state = state * np.array([decay, decay, decay, decay * decay]) + np.array(m)
            return pd.DataFrame({"__cb": pdf["b"].to_numpy(), "__carry": rows})

        own = blocks.select(order.INDEX, name, "__b").groupBy("__b").applyInPandas(ends, "b long, m array<double>, n long")
        carry = own.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(carries, "__cb long, __carry array<double>")

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order.INDEX)
            state = np.array(pdf["__carry"].iloc[0], dtype=float)
            got = ewm(pdf[name].to_numpy(dtype=float, na_value=np.nan), alpha, op, state)[0]
            return pdf.drop(columns=["__b", "__cb", "__carry"]).assign(**{out: got})

        self.df = blocks.join(carry, F.col("__b") == F.col("__cb")).groupBy("__b").applyInPandas(finish, schema)
        return F.col(out)


def entropy_of(n: str, base: float) -> Column:
    """Shannon entropy from counts: ln N - sum(n ln n) / N, in the base."""
    c = F.col(n).cast("double")
    total = F.sum(c)
    return (F.ln(total) - F.sum(c * F.ln(c)) / total) / F.lit(rowwise.ln_base(base))


def ewm(x: np.ndarray, alpha: float, op: str, state: np.ndarray) -> tuple[list, np.ndarray]:
    """Adjusted exponential mean, variance or deviation; nulls neither count nor decay.

    ``state``: sums of weights, weighted values, weighted squares, squared weights.
    """
    keep = 1 - alpha
    w, wx, wxx, ww = state.tolist()
    out: list = []
    for v in x.tolist():
        if v != v:
            out.append(None)
            continue
        w, wx, wxx, ww = keep * w + 1, keep * wx + v, keep * wxx + v * v, keep * keep * ww + 1
        mean = wx / w
        if op == "ewm_mean":
            out.append(mean)
            continue
        free = w * w - ww
        var = max(0.0, wxx / w - mean * mean) * w * w / free if free > 1e-12 * w * w else 0.0
        out.append(var if op == "ewm_var" else var**0.5)
    return out, np.array([w, wx, wxx, ww])


def is_running(e: Expr) -> bool:
    return e.op.startswith("cum_") or (e.op.endswith("ward_fill") and not (e.params and e.params[0]))


def is_bounded(e: Expr) -> bool:
    return e.op in ("shift", "diff", "pct_change", "peak_max", "peak_min") or e.op.startswith("rolling_") or (e.op.endswith("ward_fill") and not is_running(e))


def bounded(op: str, c: Column, p: tuple, kind: T.DataType) -> tuple[int, int, object]:
    """Reach back, reach ahead, and the column over an ordered window."""
    lag = lambda n: (lambda w: F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w))
    if op in ("shift", "diff", "pct_change"):
        n = p[0]
        reach = (max(n, 0), max(-n, 0))
        before = lag(n)
        if op == "shift":
            return *reach, before
        if op == "diff":
            return *reach, lambda w: c - before(w)
        return *reach, lambda w: c.cast("double") / F.nullif(before(w).cast("double"), F.lit(0.0)) - 1
    if op in ("peak_max", "peak_min"):
        above = (lambda a, b: a > b) if op == "peak_max" else (lambda a, b: a < b)
        return 1, 1, lambda w: F.coalesce(above(c, F.lag(c, 1).over(w)) & above(c, F.lead(c, 1).over(w)), F.lit(False))
    if op == "forward_fill":
        return p[0], 0, lambda w: F.last(c, ignorenulls=True).over(w.rowsBetween(-p[0], 0))
    if op == "backward_fill":
        return 0, p[0], lambda w: F.first(c, ignorenulls=True).over(w.rowsBetween(0, p[0]))
    size, least = p
    x = c.cast("double")
    f = {"rolling_sum": F.sum, "rolling_mean": F.avg, "rolling_min": F.min, "rolling_max": F.max, "rolling_std": F.stddev_samp, "rolling_var": F.var_samp}[op]

    def rolling(w):
        frame = w.rowsBetween(-(size - 1), 0)
        value = f(x).over(frame)
        if op in ("rolling_std", "rolling_var"):
            value = F.when(F.count(x).over(frame) < 2, F.lit(float("nan"))).otherwise(value)
        return F.when(F.count(x).over(frame) >= max(least, 1), value)

    return size - 1, 0, rolling
