"""Per-symbol analysis and recommendations (ST-1 ... ST-10).

Everything is grouped by (universe, symbol): one sort per series to take the
latest ``window`` rows, a running sum / running max for the drawdown of the
cumulative return, then a single aggregation. The market score joins per
universe (one row per universe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import clip, safe_div, spread
from vigil.functions.columns import SQRT_252

EPS = 1e-9
# Recommendation bounds and reason texts.
BUY, HOLD = 70.0, 45.0
MARKET_OK = 50.0
REASON_VOL = "High volatility (%.1f%% annualised)"
REASON_BETA = "High market sensitivity (β = %.2f)"
REASON_DD = "Deep drawdown (%.1f%% over %dd)"
REASON_CORR = "Strongly correlated with market stress"
REASON_MOM = "Negative momentum — falling trend"
REASON_NONE = "Low volatility, solid momentum, healthy beta"
INDEX_SYMBOL = "INDEX"


def align_returns(returns: DataFrame, calendar: DataFrame, keys: Sequence[str] = ("universe",),
                  include_index: bool = False) -> DataFrame:
    """ST-1 input: every symbol's return on every calendar day of its
    universe (missing -> 0), plus the index return of that day.

    ``calendar`` is (keys..., date, index_ret). The grid is the equi-join of
    the calendar with the universe's symbols. ST-9: with ``include_index``
    the index itself is added as one more symbol.
    """
    keys = list(keys)
    symbols = returns.select(*keys, "symbol").distinct()
    grid = calendar.join(symbols, keys)
    out = (grid.join(returns.select(*keys, "symbol", "date", "ret"), [*keys, "symbol", "date"],
                     "left")
           .select(*keys, "symbol", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"),
                   F.coalesce("index_ret", F.lit(0.0)).alias("index_ret")))
    if include_index:
        idx = calendar.select(*keys, F.lit(INDEX_SYMBOL).alias("symbol"), "date",
                              F.coalesce("index_ret", F.lit(0.0)).alias("ret"),
                              F.coalesce("index_ret", F.lit(0.0)).alias("index_ret"))
        out = out.unionByName(idx)
    return out


def summary_stats(aligned: DataFrame, keys: Sequence[str] = ("universe",),
                  window: int = 20) -> DataFrame:
    """ST-1 ... ST-3: statistics over the latest ``window`` rows per symbol:
    ann_ret, ann_vol, sharpe, beta, corr, mom and max_dd (drawdown of the
    cumulative return, peak starting at the first value), plus n_rows."""
    keys = [*keys, "symbol"]
    w = Window.partitionBy(*keys).orderBy("date")
    d = spread(aligned, keys).withColumns({"_rn": F.row_number().over(w),
                             "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    last = d.where(F.col("_rn") > F.col("_n") - window)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("_cum", F.sum("ret").over(run))
    last = last.withColumn("_gap", F.col("_cum") - F.max("_cum").over(run))
    r, ir = F.col("ret"), F.col("index_ret")
    agg = last.groupBy(*keys).agg(
        F.first("_n").alias("n_rows"),
        (F.avg(r) * F.lit(252.0)).alias("ann_ret"),
        (F.stddev_samp(r) * F.lit(SQRT_252)).alias("ann_vol"),
        F.covar_samp(r, ir).alias("_cov"),
        F.var_samp(ir).alias("_var"),
        F.stddev_samp(r).alias("_sr"), F.stddev_samp(ir).alias("_si"),
        F.sum(r).alias("mom"),
        F.min("_gap").alias("max_dd"))
    return agg.select(
        *keys, "n_rows", "ann_ret", "ann_vol",
        (F.col("ann_ret") / (F.col("ann_vol") + F.lit(EPS))).alias("sharpe"),
        (F.col("_cov") / (F.col("_var") + F.lit(EPS))).alias("beta"),
        safe_div(F.col("_cov"), F.col("_sr") * F.col("_si")).alias("corr"),
        "mom", "max_dd")


def stock_score(market: Column) -> Column:
    """ST-4: market score minus penalties plus bounded rewards, clipped 0-100."""
    zero = F.lit(0.0)
    vol_pen = clip(F.greatest(zero, F.col("ann_vol") - F.lit(0.25)) * F.lit(50.0), 0.0, 20.0)
    beta_pen = F.greatest(zero, F.col("beta") - F.lit(1.1)) * F.lit(10.0)
    dd_pen = clip(F.abs(F.col("max_dd")) * F.lit(50.0), 0.0, 20.0)
    corr_pen = F.greatest(zero, F.col("corr") - F.lit(0.7)) * F.lit(10.0)
    score = (market - vol_pen - beta_pen - dd_pen - corr_pen
             + clip(F.col("sharpe") * F.lit(2.0), -10.0, 10.0)
             + clip(F.col("mom") * F.lit(50.0), -10.0, 10.0))
    return clip(score, 0.0, 100.0)


def recommendation(score: Column, market: Column) -> tuple[Column, Column]:
    """ST-5: BUY needs score >= 70 and market >= 50; NULL falls to AVOID."""
    rec = (F.when((score >= BUY) & (market >= MARKET_OK), "BUY")
           .when(score >= HOLD, "HOLD").otherwise("AVOID"))
    conf = (F.when(rec == "BUY", F.when(score >= 80, "HIGH").otherwise("MODERATE"))
            .when(rec == "HOLD", "MODERATE")
            .otherwise(F.when(score < 25, "HIGH").otherwise("MODERATE")))
    return rec, conf


def reasons(window: int) -> Column:
    """ST-6: the list of triggered reasons, or the default sentence."""
    items = F.array(
        F.when(F.col("ann_vol") > 0.25, F.format_string(REASON_VOL, F.col("ann_vol") * 100)),
        F.when(F.col("beta") > 1.2, F.format_string(REASON_BETA, F.col("beta"))),
        F.when(F.col("max_dd") < -0.10,
               F.format_string(REASON_DD, F.col("max_dd") * 100, F.lit(window))),
        F.when(F.col("corr") > 0.85, F.lit(REASON_CORR)),
        F.when(F.col("mom") < 0, F.lit(REASON_MOM)))
    kept = F.filter(items, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(REASON_NONE)))


def score_all_stocks(aligned: DataFrame, market: DataFrame, keys: Sequence[str] = ("universe",),
                     window: int = 20) -> DataFrame:
    """ST-8: every symbol scored, rounded (ST-7) and ranked by score.

    ``market`` is (keys..., market_score). Symbols with fewer than
    ``window + 5`` rows get an ``error`` and no figures.
    """
    keys = list(keys)
    s = summary_stats(aligned, keys, window).join(market, keys)
    m = F.col("market_score")
    s = s.withColumn("_score", stock_score(m))
    rec, conf = recommendation(F.col("_score"), m)
    ok = F.col("n_rows") >= window + 5
    val = lambda c: F.when(ok, c)
    out = s.select(
        *keys, "symbol",
        F.when(~ok, F.lit("insufficient data")).alias("error"),
        val(F.round("_score", 1)).alias("stock_score"),
        val(rec).alias("recommendation"), val(conf).alias("confidence"),
        val(F.round(F.col("ann_ret") * 100, 2)).alias("ann_return"),
        val(F.round(F.col("ann_vol") * 100, 2)).alias("ann_volatility"),
        val(F.round("sharpe", 2)).alias("sharpe"),
        val(F.round("beta", 2)).alias("beta"),
        val(F.round(F.col("max_dd") * 100, 2)).alias("max_drawdown_pct"),
        val(F.round(F.col("mom") * 100, 2)).alias("momentum"),
        val(F.round("corr", 3)).alias("corr_with_index"),
        val(reasons(window)).alias("reasons"))
    rank = Window.partitionBy(*keys).orderBy(F.col("stock_score").desc_nulls_last(), "symbol")
    return out.withColumn("rank", F.row_number().over(rank))
