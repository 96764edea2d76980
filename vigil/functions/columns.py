"""Null-safe arithmetic, warm-up gates and window specs.

Conventions (decided once for every operator):

* NaN never survives a boundary: it becomes NULL, so comparisons in ``when``
  chains fall through the way a NaN comparison does in the reference.
* ANSI mode is on; every division that can meet a zero goes through
  ``try_divide`` and yields NULL.
* A rolling statistic over ``w`` rows is NULL until the frame holds ``w``
  non-null values (the reference's ``min_periods = window`` default).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SQRT_252 = math.sqrt(252.0)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def series_window(keys: Sequence[str], order: str = "date") -> WindowSpec:
    """Window over one series: partition by the series keys, order by date."""
    return Window.partitionBy(*keys).orderBy(order)


def full_frame(keys: Sequence[str]) -> WindowSpec:
    """The whole series, for per-series constants (min/max of a column)."""
    return Window.partitionBy(*keys)


def nan_to_null(c: Column | str) -> Column:
    """NaN and +/-inf become NULL."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero or either side is NULL (never NaN / inf)."""
    return F.try_divide(_col(a), _col(b))


def gated(value: Column, x: Column | str, spec: WindowSpec, width: int) -> Column:
    """``value`` only where the trailing ``width``-row frame of ``x`` is full."""
    frame = spec.rowsBetween(-(width - 1), 0)
    return F.when(F.count(_col(x)).over(frame) == width, value)


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (``greatest``/``least`` would skip it)."""
    c = _col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 INT with NULL counted as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def row_mean(cols: Iterable[Column], default: float | None = None) -> Column:
    """Mean over the non-null inputs of one row; ``default`` when all are NULL."""
    cols = list(cols)
    if not cols:
        return F.lit(default) if default is not None else F.lit(None).cast("double")
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    present = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    mean = F.try_divide(total, present.cast("double"))
    return F.coalesce(mean, F.lit(default)) if default is not None else mean


#: Fewest partitions to which :func:`spread` limits a session, whatever its cores.
SPREAD_LEAST = 64


def spread(df, keys: Sequence[str]):
    """Hash-partition ``df`` by the series keys into the session's shuffle
    partition count, at most four a core, before a chain of window operators.

    Window stages are CPU-bound on few bytes; AQE would coalesce such a
    small shuffle into a single partition and run every series in one task.
    An explicit repartition is kept as is, and the windows reuse it (same
    keys), so this adds no exchange of its own. Each task sets up the whole
    chain, over half a second even for an empty partition, so a count chosen
    for the raw rows must not give as many tasks here; long partitions spill.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(n, max(SPREAD_LEAST, 4 * spark.sparkContext.defaultParallelism)), *keys)
