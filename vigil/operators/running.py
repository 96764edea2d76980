"""Running figures over a series of any length.

A window without a bound to the past puts a series into one task. Here a series
is cut by its order first and the parts work side by side:

* :func:`running_sums`: the order's approximate quantiles (a mergeable
  aggregate) cut each series into slices; sums run inside the slices and the
  slices' totals, a handful of rows, give what lies before each of them. The
  cuts only set how even the slices are, never the result.
* :func:`numbered`: row positions that way, and segments of so many rows.
* :func:`running`: running maximum, minimum, last known value over segments,
  carried from segment to segment in the same way.
* :func:`with_halo`: segments with copies of the rows around them, so that
  every window of bounded reach sees the rows it would see in the whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding
POS, SEG, HALO = "_pos", "_seg", "_halo"
_SLICE = "_slice"

#: Most slices of a series: the cuts are searched for every row.
MOST_SLICES = 256


def with_columns_of(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``other``, one row per ``keys``; NULL keys meet."""
    there = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                         *[c for c in other.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = df.join(there, on, "left")
    return out.drop(*[f"_k_{k}" for k in keys])


def sliced(df: DataFrame, keys: Sequence[str], order: Column, slices: int | None = None) -> DataFrame:
    """Adds ``_slice``: rows of a series with a smaller ``order`` (a number) are
    in the same or an earlier slice, equal ones in the same; NULL comes first."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(2, min(MOST_SLICES, slices or conf))
    cuts = F.percentile_approx(order.cast("double"), [i / n for i in range(1, n)], 40 * n)
    found = df.groupBy(*keys).agg(cuts.alias("_cuts"))
    x = order.cast("double")
    at = F.when(x.isNull() | F.col("_cuts").isNull(), F.lit(0)).otherwise(
        F.size(F.filter("_cuts", lambda c: c <= x)))
    return with_columns_of(df, found, keys).withColumn(_SLICE, at).drop("_cuts")


def running_sums(df: DataFrame, keys: Sequence[str], order: Column, sums: dict[str, Column],
                 totals: dict[str, Column] | None = None, slices: int | None = None) -> DataFrame:
    """Adds for each ``name: x`` of ``sums`` the sum of x over the series' rows
    up to this one by ``order`` (NULL x counts as 0; equal orders in any
    sequence), and for ``totals`` the sum over the whole series."""
    keys, totals = list(keys), totals or {}
    cut = sliced(df, keys, order, slices)
    parts = cut.groupBy(*keys, _SLICE).agg(
        *[F.sum(F.coalesce(x, F.lit(0))).alias(f"_p_{n}") for n, x in {**sums, **totals}.items()])
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(UNB, -1)
    whole = Window.partitionBy(*keys)
    parts = parts.select(*keys, _SLICE,
                         *[F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
                         *[F.sum(f"_p_{n}").over(whole).alias(n) for n in totals])
    inside = Window.partitionBy(*keys, _SLICE).orderBy(order.asc_nulls_first()).rowsBetween(UNB, 0)
    out = cut.withColumns({f"_r_{n}": F.sum(F.coalesce(x, F.lit(0))).over(inside) for n, x in sums.items()})
    out = with_columns_of(out, parts, [*keys, _SLICE])
    return out.withColumns({n: F.col(f"_r_{n}") + F.col(f"_b_{n}") for n in sums}).drop(
        _SLICE, *[f"_{p}_{n}" for n in sums for p in ("r", "b")])


def numbered(df: DataFrame, keys: Sequence[str], rows: int, order: str = "date",
             where: Column | None = None, slices: int | None = None) -> DataFrame:
    """Adds the 0-based position ``_pos`` among the series' rows (among those
    ``where`` holds; the others are dropped) and its segment ``_seg`` of ``rows``
    positions. ``order`` (a date) is unique within a series."""
    counts = F.lit(1) if where is None else F.when(where, 1).otherwise(0)
    out = running_sums(df, keys, F.unix_date(order), {POS: counts}, slices=slices)
    out = out if where is None else out.where(where)
    return out.withColumn(POS, F.col(POS) - 1).withColumn(SEG, F.floor(F.col(POS) / F.lit(rows)))


def running(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, Column]],
            strict: bool = False) -> DataFrame:
    """Adds for each ``name: (kind, x)`` the running 'max', 'min' or 'last'
    (non-null) of x over the series, this row included unless ``strict``;
    ``df`` is numbered and has no halo."""
    keys = list(keys)

    def told(kind: str, x: Column) -> Column:
        return F.when(x.isNotNull(), F.struct(F.col(POS).alias("p"), x.alias("v"))) if kind == "last" else x

    def best(kind: str) -> object:
        return F.min if kind == "min" else F.max

    parts = df.groupBy(*keys, SEG).agg(*[best(k)(told(k, x)).alias(f"_t_{n}") for n, (k, x) in wanted.items()])
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(UNB, -1)
    parts = parts.select(*keys, SEG, *[best(k)(f"_t_{n}").over(before).alias(f"_b_{n}")
                                       for n, (k, _) in wanted.items()])
    inside = Window.partitionBy(*keys, SEG).orderBy(POS).rowsBetween(UNB, -1 if strict else 0)
    out = df.withColumns({f"_r_{n}": best(k)(told(k, x)).over(inside) for n, (k, x) in wanted.items()})
    out = with_columns_of(out, parts, [*keys, SEG])
    both = {"max": F.greatest, "min": F.least, "last": F.greatest}
    made = {n: both[k](F.col(f"_r_{n}"), F.col(f"_b_{n}")) for n, (k, _) in wanted.items()}
    made = {n: c["v"] if wanted[n][0] == "last" else c for n, c in made.items()}
    return out.withColumns(made).drop(*[f"_{p}_{n}" for n in wanted for p in ("r", "b")])


def with_halo(df: DataFrame, rows: int, back: int, ahead: int = 0) -> DataFrame:
    """Segments of ``rows`` positions with copies, marked ``_halo``, of the last
    ``back`` rows of the segment before and the first ``ahead`` of the next."""
    if max(back, ahead) > rows:
        raise ValueError(f"segments of {rows} rows cannot hold a halo of {max(back, ahead)}")
    at = F.col(POS) % F.lit(rows)
    places = F.array(
        F.struct(F.col(SEG).alias("s"), F.lit(False).alias("h")),
        F.when(at >= rows - back, F.struct((F.col(SEG) + 1).alias("s"), F.lit(True).alias("h"))),
        F.when((at < ahead) & (F.col(SEG) > 0), F.struct((F.col(SEG) - 1).alias("s"), F.lit(True).alias("h"))))
    out = df.withColumn("_place", F.explode(F.filter(places, lambda p: p.isNotNull())))
    return out.withColumns({SEG: F.col("_place.s"), HALO: F.col("_place.h")}).drop("_place")


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO)
