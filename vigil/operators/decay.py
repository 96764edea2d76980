"""Exponentially weighted moments over the whole history of a series (WF-3, SC-6).

The moments of weighted rows (weight w, products of two different rows' weights
f, mean m, squared deviations s) merge exactly, whatever lies between: rows are
cut into blocks of positions, moments run inside a block, and what came before
joins them by the parallel-variance rule, decayed by the distance of the two last
values. s and f grow by positive terms only (a value's deviation from the mean
before it); no squares of levels and no nearly equal weights are subtracted, so
neither a long gap nor a high level costs digits.

Two earlier non-empty blocks are enough: a third one's newest value is more than
a block older than the first one's, and a block is chosen so long that such a
weight is below 1e-30 of the newer ones, far beyond a double's digits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import series_window
from vigil.operators.running import POS, SEG, UNB, running, with_columns_of

#: Natural log of the decay over one block.
_BLOCK_LOG = 69.0


def decay_of(span: float) -> float:
    return max(1.0 - 2.0 / (span + 1.0), 1e-30)


def block_rows(span: float) -> int:
    """Rows of a block: the decay over it is 1e-30 at least."""
    return max(2, math.ceil(_BLOCK_LOG / -math.log(decay_of(span))))


def _merged(old: Column, new: Column, r: float) -> Column:
    """Moments of both, ``old`` decayed by the rows between their last values."""
    d = F.pow(F.lit(r), (new["p"] - old["p"]).cast("double"))
    w = old["w"] * d
    total, gap = w + new["w"], new["m"] - old["m"]
    both = F.struct(total.alias("w"), (old["f"] * d * d + new["f"] + F.lit(2.0) * w * new["w"]).alias("f"),
                    (new["m"] - gap * w / total).alias("m"),
                    (old["s"] * d + new["s"] + gap * gap * w * new["w"] / total).alias("s"), new["p"].alias("p"))
    return F.when(old.isNull(), new).otherwise(F.when(new.isNotNull(), both))


def _inside(df: DataFrame, x: Column, keys: Sequence[str], span: float, pos: Column) -> DataFrame:
    """``_own``: a non-null row's moments over its block up to it; ``_blk``;
    ``_end``: the block's last non-null row."""
    r, n = decay_of(span), block_rows(span)
    df = df.withColumn("_blk", F.floor(pos / F.lit(n))).withColumn("_off", (pos % F.lit(n)).cast("double"))
    part = Window.partitionBy(*keys, "_blk").orderBy(pos if POS in df.columns else F.col("date"))
    past, before = part.rowsBetween(UNB, 0), part.rowsBetween(UNB, -1)
    df = df.withColumns({"_c": F.first(x, ignorenulls=True).over(past),
                         "_end": x.isNotNull() & (F.count(x).over(part.rowsBetween(1, Window.unboundedFollowing)) == 0)})
    up, down = F.when(x.isNotNull(), F.pow(F.lit(r), -F.col("_off"))), F.pow(F.lit(r), F.col("_off"))
    d = x - F.col("_c")
    df = df.withColumns({"_w": F.sum(up).over(past), "_d": F.sum(up * d).over(past),
                         "_w0": F.sum(up).over(before), "_d0": F.sum(up * d).over(before)})
    step = d - F.col("_d0") / F.col("_w0")
    df = df.withColumns({"_f": F.sum(up * F.col("_w0")).over(past),
                         "_s": F.sum(up * F.col("_w0") / F.col("_w") * step * step).over(past)})
    zero = F.lit(0.0)
    own = F.struct((down * F.col("_w")).alias("w"),
                   (F.lit(2.0) * down * down * F.coalesce("_f", zero)).alias("f"),
                   (F.col("_c") + F.col("_d") / F.col("_w")).alias("m"),
                   (down * F.coalesce("_s", zero)).alias("s"), pos.alias("p"))
    return df.withColumn("_own", F.when(x.isNotNull(), own)).drop("_off", "_c", "_w", "_d", "_w0", "_d0", "_f", "_s")


def moments(df: DataFrame, x: Column, keys: Sequence[str], span: float, out: str) -> DataFrame:
    """Adds the struct ``out`` (w, f, m, s and the position p of the newest
    value) over all non-null x up to each row; a row without x has those of the
    row before. NULL before any value.

    A frame numbered by :func:`vigil.operators.running.numbered` is worked on in
    blocks side by side, any other in one window per series."""
    keys, r = list(keys), decay_of(span)
    if SEG in df.columns:
        df = _inside(df, x, keys, span, F.col(POS))
        order = Window.partitionBy(*keys).orderBy("_blk")
        ends = df.where("_end").select(*keys, "_blk", "_own").withColumn("_last", F.lag("_own").over(order))
        ends = ends.withColumn("_full", _merged(F.col("_last"), F.col("_own"), r)).select(
            *keys, "_blk", F.lag("_full").over(order).alias("_past"))
        df = with_columns_of(df, ends, [*keys, "_blk"])
        df = df.withColumn("_now", _merged(F.col("_past"), F.col("_own"), r))
        return running(df, keys, {out: ("last", F.col("_now"))}).drop("_blk", "_end", "_own", "_past", "_now")
    w = series_window(keys)
    before, past = w.rowsBetween(UNB, -1), w.rowsBetween(UNB, 0)
    df = df.withColumn("_ew", F.row_number().over(w) - 1)
    df = _inside(df, x, keys, span, F.col("_ew"))
    ended = F.col("_end")
    df = df.withColumn("_last", F.last(F.when(ended, F.col("_own")), ignorenulls=True).over(before))
    df = df.withColumn("_full", F.when(ended, _merged(F.col("_last"), F.col("_own"), r)))
    df = df.withColumn("_past", F.last("_full", ignorenulls=True).over(before))
    df = df.withColumn("_now", _merged(F.col("_past"), F.col("_own"), r))
    return df.withColumn(out, F.last("_now", ignorenulls=True).over(past)).drop(
        "_ew", "_blk", "_end", "_own", "_last", "_full", "_past", "_now")


def ewm_mean(df: DataFrame, x: Column | str, keys: Sequence[str], span: float, out: str) -> DataFrame:
    """Adjusted exponentially weighted mean; weights follow row positions, so a
    NULL ages the rows before it and takes no weight itself."""
    x = F.col(x) if isinstance(x, str) else x
    df = moments(df, x, keys, span, "_em")
    return df.withColumn(out, F.col("_em.m")).drop("_em")


def ewm_std(df: DataFrame, x: Column | str, keys: Sequence[str], span: float, out: str) -> DataFrame:
    """Bias-corrected exponentially weighted standard deviation, sqrt(s w / f):
    NULL until there are two values whose weights a double can hold together."""
    x = F.col(x) if isinstance(x, str) else x
    df = moments(df, x, keys, span, "_es")
    var = F.when(F.col("_es.f") > 0, F.col("_es.s") * F.col("_es.w") / F.col("_es.f"))
    return df.withColumn(out, F.sqrt(var)).drop("_es")
