"""Rolling time-series features (WF-1 ... WF-21) as window expressions.

Every operator is ``DataFrame -> DataFrame``: it adds columns computed over
``Window.partitionBy(*keys).orderBy("date")`` frames of the last *w* rows
(positional, never calendar ranges). A statistic is NULL until its frame
holds *w* non-null inputs. Stacked statistics (volatility of volatility,
RSI on differences, trends of correlations) are successive ``Window``
operators on the same partitioning and ordering, so Spark sorts each series
once. Only the cross-symbol correlation aggregates across series.

Per-key data volume: a series has one row per calendar day, whatever the
raw volume behind it, so a window partition is bounded by the calendar. Series
that are longer than one task should hold (intraday rows, say) go through
``market_features(..., segment_rows=n)``: the same windows over segments of n
rows with the rows before them, and running figures carried between segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import clip, flag, gated, nan_to_null, safe_div, series_window, spread
from vigil.functions.columns import SQRT_252
from vigil.operators import running as rn
from vigil.operators.decay import ewm_std
from vigil.session import cut_lineage

UNB = Window.unboundedPreceding
EPS = 1e-9

# Output columns of the market feature matrix, in order.
# ``corr_trend`` is the trend of the cross-symbol correlation and
# ``bm_corr_trend`` the trend of the sector-market correlation (the reference
# gives both the same name and keeps the first).
FEATURE_COLUMNS = [
    "vol_5d", "vol_10d", "vol_20d", "ewma_vol", "vol_of_vol",
    "max_drawdown", "underwater_dur", "current_drawdown",
    "bank_market_corr", "cross_bank_corr", "corr_trend", "bm_corr_trend",
    "rsi", "roc_5d", "ma_spread",
    "vix_level", "vix_change", "vix_zscore", "vix_spike",
    "fx_level", "fx_change", "fx_zscore",
    "cvar_5pct", "return_skew", "return_kurt",
    "bank_rel_return", "bank_beta", "bank_rel_vol",
]
VOLUME_COLUMNS = ["vol_zscore", "vol_spike"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _frame(keys: Sequence[str], width: int):
    return series_window(keys).rowsBetween(-(width - 1), 0)


# --------------------------------------------------------------------------
# WF-1 returns
# --------------------------------------------------------------------------

def log_returns(df: DataFrame, price: str, keys: Sequence[str], out: str = "ret") -> DataFrame:
    """WF-1: ln(p / previous non-null p) on the series' own non-null rows."""
    w = series_window(keys)
    prev = F.last(price, ignorenulls=True).over(w.rowsBetween(UNB, -1))
    return df.withColumn(out, F.when(F.col(price).isNotNull(), F.ln(safe_div(F.col(price), prev))))


# --------------------------------------------------------------------------
# Volatility
# --------------------------------------------------------------------------

def rolling_std(x: Column | str, keys: Sequence[str], width: int) -> Column:
    """Sample standard deviation of the last ``width`` rows, gated."""
    w = series_window(keys)
    return gated(F.stddev_samp(_c(x)).over(_frame(keys, width)), x, w, width)


def rolling_mean(x: Column | str, keys: Sequence[str], width: int) -> Column:
    w = series_window(keys)
    return gated(F.avg(_c(x)).over(_frame(keys, width)), x, w, width)


def rolling_volatility(df: DataFrame, ret: str, keys: Sequence[str],
                       windows: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """WF-2: annualised rolling volatility ``vol_{w}d`` for each window."""
    return df.withColumns({f"vol_{w}d": rolling_std(ret, keys, w) * F.lit(SQRT_252)
                           for w in windows})


def ewma_volatility(df: DataFrame, ret: str, keys: Sequence[str], span: float = 20,
                    out: str = "ewma_vol") -> DataFrame:
    """WF-3: exponentially weighted volatility over the whole history, annualised."""
    df = ewm_std(df, ret, keys, span, f"_{out}")
    return df.withColumn(out, F.col(f"_{out}") * F.lit(SQRT_252)).drop(f"_{out}")


def vol_of_vol(df: DataFrame, ret: str, keys: Sequence[str], window: int = 20,
               inner: int = 5, out: str = "vol_of_vol") -> DataFrame:
    """WF-4: sample sd over ``window`` rows of the ``inner``-row sd (not annualised)."""
    tmp = f"_{out}_inner"
    df = df.withColumn(tmp, rolling_std(ret, keys, inner))
    return df.withColumn(out, rolling_std(tmp, keys, window)).drop(tmp)


# --------------------------------------------------------------------------
# Drawdown
# --------------------------------------------------------------------------

def drawdown(df: DataFrame, price: str, keys: Sequence[str], window: int = 60) -> DataFrame:
    """WF-5/6/7: ``max_drawdown`` (gap to the trailing ``window``-row max, partial
    frames allowed), ``underwater_dur`` (running streak of negative gaps) and
    ``current_drawdown`` (gap to the running all-time high).

    The streak is a gaps-and-islands count done with one running max: the
    row number of the last non-negative row is subtracted from the current
    row number, so no second partitioning is needed.
    """
    w = series_window(keys)
    p = F.col(price)
    roll_max = F.max(p).over(_frame(keys, window))
    peak = F.max(p).over(w.rowsBetween(UNB, 0))
    df = df.withColumns({
        "max_drawdown": safe_div(p - roll_max, roll_max),
        "current_drawdown": safe_div(p - peak, peak),
        "_rn": F.row_number().over(w),
    })
    under = F.coalesce(F.col("max_drawdown") < 0, F.lit(False))
    last_dry = F.max(F.when(~under, F.col("_rn"))).over(w.rowsBetween(UNB, 0))
    df = df.withColumn("underwater_dur",
                       F.when(under, F.col("_rn") - F.coalesce(last_dry, F.lit(0))).otherwise(0))
    return df.drop("_rn")


# --------------------------------------------------------------------------
# Volume, correlation
# --------------------------------------------------------------------------

def zscore(x: Column | str, keys: Sequence[str], window: int) -> Column:
    """(x - rolling mean) / (rolling sd + 1e-9), gated on a full frame."""
    x = _c(x)
    f = _frame(keys, window)
    w = series_window(keys)
    return gated((x - F.avg(x).over(f)) / (F.stddev_samp(x).over(f) + F.lit(EPS)), x, w, window)


def volume_stress(df: DataFrame, volume: str, keys: Sequence[str], window: int = 20,
                  spike: float = 2.0) -> DataFrame:
    """WF-8: ``vol_zscore`` and ``vol_spike`` (z > 2, NULL counts as 0)."""
    df = df.withColumn("vol_zscore", zscore(volume, keys, window))
    return df.withColumn("vol_spike", flag(F.col("vol_zscore") > F.lit(spike)))


def _pair_frame_stats(a: Column, b: Column, keys: Sequence[str], window: int):
    both = a.isNotNull() & b.isNotNull()
    aa, bb = F.when(both, a), F.when(both, b)
    f = _frame(keys, window)
    n = F.count(F.when(both, F.lit(1))).over(f)
    return aa, bb, f, n


def rolling_corr(a: Column | str, b: Column | str, keys: Sequence[str], window: int) -> Column:
    """WF-9: Pearson correlation over rows where both inputs are present.
    ``covar / (sd * sd)`` with a safe division: a constant frame gives NULL."""
    aa, bb, f, n = _pair_frame_stats(_c(a), _c(b), keys, window)
    corr = safe_div(F.covar_samp(aa, bb).over(f),
                    F.stddev_samp(aa).over(f) * F.stddev_samp(bb).over(f))
    return F.when(n == window, corr)


def correlation_trend(c: Column | str, keys: Sequence[str], window: int = 10) -> Column:
    """WF-11: difference to ``window`` rows back."""
    c = _c(c)
    return c - F.lag(c, window).over(series_window(keys))


def bank_market_corr(df: DataFrame, a: str, b: str, keys: Sequence[str], window: int = 30,
                     out: str = "bank_market_corr") -> DataFrame:
    return df.withColumn(out, rolling_corr(a, b, keys, window))


def cross_symbol_corr(returns: DataFrame, calendar: DataFrame, keys: Sequence[str],
                      window: int = 20, out: str = "cross_bank_corr") -> DataFrame:
    """WF-10: mean over all symbol pairs of the rolling pairwise correlation.

    No pair is materialised. Within each frame, with z the per-symbol
    standardised returns (frame mean and sample sd) and S_t = sum_i z_i,t:

        sum_{i<j} corr_ij = (sum_t S_t^2 / (w - 1) - n) / 2

    so the mean pair correlation is (sum_t S_t^2 / (w-1) - n) / (n (n-1)).
    Each symbol contributes its z-vector of ``window`` values; S is a plain
    grouped sum with map-side combine. Cost is O(symbols x dates x window).

    Semantics kept from the reference: returns are placed on ``calendar``
    (days off the calendar are dropped, days without a return are NULL);
    symbols with no return on the calendar drop out; a date is NULL unless
    every remaining symbol has a full, non-constant frame; fewer than two
    symbols give 0.0.
    """
    keys = list(keys)
    parts = [c for c in (rn.SEG, rn.HALO) if c in calendar.columns]
    r = calendar.select(*keys, "date", *parts).join(returns.select(*keys, "symbol", "date", "ret"),
                                                    [*keys, "date"])
    if parts:  # a segmented calendar with its halo: windows stay inside a segment
        calendar = rn.without_halo(calendar)
    skeys = [*keys, "symbol", *parts[:1]]
    r = spread(r, skeys)
    # PF-3: only symbols with some return on the calendar count; the others
    # never produce a full frame, so they need no filtering of their rows.
    n_sym = (r.where(F.col("ret").isNotNull()).groupBy(*keys)
             .agg(F.countDistinct("symbol").alias("_n")))
    f = _frame(skeys, window)
    stats = r.select(*keys, "symbol", "date", *parts,
                     F.collect_list("ret").over(f).alias("_lst"),
                     F.count("ret").over(f).alias("_cnt"),
                     F.avg("ret").over(f).alias("_mu"),
                     F.stddev_samp("ret").over(f).alias("_sd"))
    if parts:
        stats = rn.without_halo(stats)
    z = F.when((F.col("_cnt") == window) & (F.col("_sd") > 0),
               F.transform("_lst", lambda x: (x - F.col("_mu")) / F.col("_sd")))
    # S_t of a date's frame, one grouped sum per place in the frame.
    sums = stats.withColumn("_z", z).groupBy(*keys, "date").agg(
        F.count("_z").alias("_c"), *[F.sum(F.col("_z")[k]).alias(f"_s{k}") for k in range(window)])
    d = sums.select(*keys, "date", "_c", sum((F.col(f"_s{k}") * F.col(f"_s{k}") for k in range(1, window)),
                                             F.col("_s0") * F.col("_s0")).alias("_ss"))
    res = (calendar.select(*keys, "date").join(d, [*keys, "date"], "left")
           .join(n_sym, keys, "left"))
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("double")
    value = (F.when(n < 2, F.lit(0.0))
             .when(F.col("_c") == n,
                   (F.col("_ss") / F.lit(float(window - 1)) - n) / (n * (n - F.lit(1.0)))))
    return res.select(*keys, "date", value.alias(out))


# --------------------------------------------------------------------------
# Momentum
# --------------------------------------------------------------------------

def rsi(df: DataFrame, price: str, keys: Sequence[str], window: int = 14,
        out: str = "rsi") -> DataFrame:
    """WF-12: simple-mean RSI, 100 - 100 / (1 + gain / (loss + 1e-9))."""
    w = series_window(keys)
    tmp = f"_{out}_delta"
    df = df.withColumn(tmp, F.col(price) - F.lag(price).over(w))
    d = F.col(tmp)
    gain = gated(F.avg(clip(d, lo=0.0)).over(_frame(keys, window)), d, w, window)
    loss = gated(F.avg(-clip(d, hi=0.0)).over(_frame(keys, window)), d, w, window)
    rs = gain / (loss + F.lit(EPS))
    return df.withColumn(out, F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)).drop(tmp)


def rate_of_change(df: DataFrame, price: str, keys: Sequence[str], window: int = 5) -> DataFrame:
    """WF-13: p / p[-window] - 1 as ``roc_{window}d``."""
    p = F.col(price)
    return df.withColumn(f"roc_{window}d",
                         safe_div(p, F.lag(p, window).over(series_window(keys))) - F.lit(1.0))


def moving_avg_spread(df: DataFrame, price: str, keys: Sequence[str], short: int = 10,
                      long: int = 50, out: str = "ma_spread") -> DataFrame:
    """WF-14: (MA_short - MA_long) / (MA_long + 1e-9)."""
    ma_s = rolling_mean(price, keys, short)
    ma_l = rolling_mean(price, keys, long)
    return df.withColumn(out, (ma_s - ma_l) / (ma_l + F.lit(EPS)))


# --------------------------------------------------------------------------
# Macro series
# --------------------------------------------------------------------------

def level_features(df: DataFrame, x: str, keys: Sequence[str], prefix: str,
                   window: int = 20, spike: float | None = None) -> DataFrame:
    """WF-15 / WF-16: ``{prefix}_level``, ``_change`` (1 row), ``_zscore`` and,
    when ``spike`` is given, ``_spike`` = z > spike (NULL counts as 0)."""
    v = F.col(x)
    cols = {
        f"{prefix}_level": v,
        f"{prefix}_change": v - F.lag(v).over(series_window(keys)),
        f"{prefix}_zscore": zscore(v, keys, window),
    }
    df = df.withColumns(cols)
    if spike is not None:
        df = df.withColumn(f"{prefix}_spike", flag(F.col(f"{prefix}_zscore") > F.lit(spike)))
    return df


def vix_features(df: DataFrame, x: str, keys: Sequence[str], window: int = 20) -> DataFrame:
    return level_features(df, x, keys, "vix", window, spike=1.5)


def fx_features(df: DataFrame, x: str, keys: Sequence[str], window: int = 20) -> DataFrame:
    return level_features(df, x, keys, "fx", window)


# --------------------------------------------------------------------------
# Tail risk
# --------------------------------------------------------------------------

def list_quantile(sorted_list: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending list (numpy's default)."""
    n = F.size(sorted_list)
    pos = (n - 1).cast("double") * F.lit(q)
    lo = F.floor(pos).cast("int")
    frac = pos - lo.cast("double")
    a = F.element_at(sorted_list, lo + 1)
    b = F.element_at(sorted_list, F.least(lo + 2, n))
    return a + (b - a) * frac


def cvar(df: DataFrame, ret: str, keys: Sequence[str], window: int = 60, alpha: float = 0.05,
         out: str = "cvar_5pct") -> DataFrame:
    """WF-17: mean of the returns at or below the ``alpha`` quantile of the frame.

    The quantile and the tail are materialised as columns so that the
    interpreted list lambdas evaluate each only once per row.
    """
    tmp = f"_{out}"
    f = _frame(keys, window)
    df = df.withColumn(f"{tmp}_s", F.when(F.count(ret).over(f) == window,
                                         F.sort_array(F.collect_list(ret).over(f))))
    df = df.withColumn(f"{tmp}_q", list_quantile(F.col(f"{tmp}_s"), alpha))
    df = df.withColumn(f"{tmp}_t", F.filter(F.col(f"{tmp}_s"), lambda x: x <= F.col(f"{tmp}_q")))
    mean = safe_div(F.aggregate(f"{tmp}_t", F.lit(0.0), lambda a, x: a + x),
                    F.size(f"{tmp}_t").cast("double"))
    return df.withColumn(out, mean).drop(f"{tmp}_s", f"{tmp}_q", f"{tmp}_t")


def skew_kurt(df: DataFrame, ret: str, keys: Sequence[str], window: int = 30) -> DataFrame:
    """WF-18: population skewness and excess kurtosis (NULL on a constant frame)."""
    w = series_window(keys)
    f = _frame(keys, window)
    return df.withColumns({
        "return_skew": gated(F.skewness(ret).over(f), ret, w, window),
        "return_kurt": gated(F.kurtosis(ret).over(f), ret, w, window),
    })


# --------------------------------------------------------------------------
# Relative risk and per-symbol features
# --------------------------------------------------------------------------

def relative_risk(df: DataFrame, a: str, b: str, keys: Sequence[str], window: int = 20,
                  prefix: str = "bank") -> DataFrame:
    """WF-19: 252 x (mean a - mean b), beta = cov / (var b + 1e-9),
    sd a - sd b (not annualised)."""
    aa, bb, f, n = _pair_frame_stats(F.col(a), F.col(b), keys, window)
    full = (F.count(F.col(a)).over(f) == window) & (F.count(F.col(b)).over(f) == window)
    return df.withColumns({
        f"{prefix}_rel_return": F.when(full, (F.avg(a).over(f) - F.avg(b).over(f)) * F.lit(252.0)),
        f"{prefix}_beta": F.when(n == window, F.covar_samp(aa, bb).over(f)
                                 / (F.var_samp(bb).over(f) + F.lit(EPS))),
        f"{prefix}_rel_vol": F.when(full, F.stddev_samp(a).over(f) - F.stddev_samp(b).over(f)),
    })


def stock_features(returns: DataFrame, index_returns: DataFrame, keys: Sequence[str] = ("universe",),
                   window: int = 20) -> DataFrame:
    """WF-20: per (universe, symbol) rolling annual return, volatility, Sharpe,
    beta and correlation to the index, and the ``window``-row return sum.

    ``index_returns`` is (keys..., date, index_ret); it joins by date onto
    each symbol row (an equi-join on the universe keys and date).
    """
    keys = list(keys)
    df = returns.join(index_returns.select(*keys, "date", "index_ret"), [*keys, "date"])
    skeys = [*keys, "symbol"]
    w = series_window(skeys)
    f = _frame(skeys, window)
    r, ir = F.col("ret"), F.col("index_ret")
    aa, bb, _, n = _pair_frame_stats(r, ir, skeys, window)
    full_r = F.count(r).over(f) == window
    mu = F.when(full_r, F.avg(r).over(f) * F.lit(252.0))
    sig = F.when(full_r, F.stddev_samp(r).over(f) * F.lit(SQRT_252))
    out = df.withColumns({
        "annualised_return": mu,
        "volatility": sig,
        "beta": F.when(n == window, F.covar_samp(aa, bb).over(f)
                       / (F.when(F.count(ir).over(f) == window, F.var_samp(ir).over(f))
                          + F.lit(EPS))),
        "corr_with_index": rolling_corr(r, ir, skeys, window),
        "momentum": F.when(full_r, F.sum(r).over(f)),
    })
    del w
    return out.withColumn("sharpe", F.col("annualised_return") / (F.col("volatility") + F.lit(EPS)))


# --------------------------------------------------------------------------
# WF-21: the whole market feature matrix
# --------------------------------------------------------------------------

def common_calendar(panel: DataFrame, keys: Sequence[str] = ("universe",),
                    sector: str = "sector", market: str = "market") -> DataFrame:
    """Sector and market returns on their own rows, kept where both exist;
    the macro series are carried forward on those rows only (values on
    dropped days are never carried)."""
    keys = list(keys)
    df = log_returns(spread(panel, keys), sector, keys, "bank_ret")
    df = log_returns(df, market, keys, "mkt_ret")
    cal = df.where(F.col("bank_ret").isNotNull() & F.col("mkt_ret").isNotNull())
    unb = series_window(keys).rowsBetween(UNB, 0)
    extra = {"price": F.col(sector)}
    if "fear" in panel.columns:
        extra["vix"] = F.last("fear", ignorenulls=True).over(unb)
    if "fx" in panel.columns:
        extra["fxr"] = F.last("fx", ignorenulls=True).over(unb)
    return cal.withColumns(extra)


def market_features(panel: DataFrame, returns: DataFrame | None = None,
                    keys: Sequence[str] = ("universe",), use_volume: bool = False,
                    clean: bool = True, segment_rows: int | None = None) -> DataFrame:
    """WF-21: the full feature matrix per (universe, date).

    ``panel`` is the index panel (sector, market, optional fear / fx /
    volume); ``returns`` the per-symbol return panel (complete-date rule
    applied). Clean-up as in the reference: non-finite -> NULL, forward fill
    of at most 5 rows, then rows with any NULL feature are dropped.
    """
    keys = list(keys)
    if segment_rows:
        return _segmented_features(panel, returns, keys, use_volume, clean, segment_rows)
    cal = common_calendar(panel, keys)
    if returns is not None:
        cross = cross_symbol_corr(returns, cal.select(*keys, "date"), keys)
        cal = spread(cal.join(cross, [*keys, "date"], "left"), keys)
    df = ewma_volatility(cal, "bank_ret", keys)
    df = drawdown(df, "price", keys)
    df, cols = _bounded_features(df, keys, use_volume)
    out = df.select(*keys, "date", "bank_ret", "mkt_ret", *cols)
    return clean_features(out, cols, keys) if clean else out


def _bounded_features(df: DataFrame, keys: Sequence[str], use_volume: bool) -> tuple[DataFrame, list[str]]:
    """The features whose windows reach back a fixed number of rows, and the
    feature columns at hand in their order."""
    df = rolling_volatility(df, "bank_ret", keys)
    df = vol_of_vol(df, "bank_ret", keys)
    df = bank_market_corr(df, "bank_ret", "mkt_ret", keys)
    df = df.withColumn("bm_corr_trend", correlation_trend("bank_market_corr", keys))
    if "cross_bank_corr" in df.columns:
        df = df.withColumn("corr_trend", correlation_trend("cross_bank_corr", keys))
    else:
        df = df.withColumn("corr_trend", F.col("bm_corr_trend"))
    df = rsi(df, "price", keys)
    df = rate_of_change(df, "price", keys)
    df = moving_avg_spread(df, "price", keys)
    if "vix" in df.columns:
        df = vix_features(df, "vix", keys)
    if "fxr" in df.columns:
        df = fx_features(df, "fxr", keys)
    df = cvar(df, "bank_ret", keys)
    df = skew_kurt(df, "bank_ret", keys)
    df = relative_risk(df, "bank_ret", "mkt_ret", keys)
    cols = [c for c in FEATURE_COLUMNS if c in df.columns]
    if use_volume and "volume" in df.columns:
        df = volume_stress(df, "volume", keys)
        cols += VOLUME_COLUMNS
    return df, cols


#: Rows that the deepest chain of windows reaches back: 60 for the tail of
#: returns and the drawdown, then 5 for the fill.
HALO_ROWS = 66


def segmented_calendar(panel: DataFrame, keys: Sequence[str], rows: int, sector: str = "sector",
                       market: str = "market") -> DataFrame:
    """:func:`common_calendar` numbered and cut into segments of ``rows``
    positions, with the running high ``_peak`` of the price."""
    df = cut_lineage(rn.numbered(cut_lineage(panel), keys, rows))
    df = rn.running(df, keys, {"_ps": ("last", F.col(sector)), "_pm": ("last", F.col(market))}, strict=True)
    ret = lambda p, q: F.when(F.col(p).isNotNull(), F.ln(safe_div(F.col(p), F.col(q))))
    df = df.withColumns({"bank_ret": ret(sector, "_ps"), "mkt_ret": ret(market, "_pm"), "price": F.col(sector)})
    df = cut_lineage(df.drop("_ps", "_pm", rn.POS, rn.SEG))
    cal = rn.numbered(df, keys, rows, where=F.col("bank_ret").isNotNull() & F.col("mkt_ret").isNotNull())
    known = {out: ("last", F.col(c)) for c, out in (("fear", "vix"), ("fx", "fxr")) if c in panel.columns}
    return rn.running(cut_lineage(cal), keys, {**known, "_peak": ("max", F.col("price"))})


def _segmented_features(panel: DataFrame, returns: DataFrame | None, keys: list[str], use_volume: bool,
                        clean: bool, rows: int) -> DataFrame:
    """WF-21 over segments: every window stays inside a segment and its halo;
    what runs over a whole series is carried between segments. Each stage is
    written once, because the next one reads it two or three times."""
    cal = cut_lineage(segmented_calendar(panel, keys, rows))
    cal = ewma_volatility(cal, "bank_ret", keys)
    peak = F.col("_peak")
    cal = cut_lineage(cal.withColumn("current_drawdown", safe_div(F.col("price") - peak, peak)).drop("_peak"))
    if returns is not None:
        days = rn.with_halo(cal.select(*keys, "date", rn.POS, rn.SEG), rows, HALO_ROWS)
        cal = cal.join(cross_symbol_corr(returns, days, keys), [*keys, "date"], "left")
    skeys = [*keys, rn.SEG]
    df = spread(rn.with_halo(cal, rows, HALO_ROWS), skeys)
    top = F.max("price").over(_frame(skeys, 60))
    df = df.withColumns({"max_drawdown": safe_div(F.col("price") - top, top), "underwater_dur": F.lit(0)})
    under = F.coalesce(F.col("max_drawdown") < 0, F.lit(False))
    df, cols = _bounded_features(df.withColumn("_under", under), skeys, use_volume)
    df = df.select(*keys, "date", rn.POS, rn.SEG, rn.HALO, "_under", "bank_ret", "mkt_ret", *cols)
    if clean:
        df = clean_features(df, [c for c in cols if c != "underwater_dur"], skeys, drop=False)
    df = cut_lineage(rn.without_halo(df))
    df = rn.running(df, keys, {"_dry": ("max", F.when(~F.col("_under"), F.col(rn.POS)))})
    df = df.withColumn("underwater_dur", F.when(F.col("_under"), F.col(rn.POS) - F.coalesce("_dry", F.lit(-1)))
                       .otherwise(0).cast("int"))
    out = df.select(*keys, "date", "bank_ret", "mkt_ret", *cols)
    return out.dropna(subset=cols) if clean else out


def clean_features(df: DataFrame, cols: Sequence[str], keys: Sequence[str],
                   fill_limit: int = 5, drop: bool = True) -> DataFrame:
    """PF-4, PF-5, PF-2: non-finite -> NULL, forward fill up to ``fill_limit``
    rows, then ``drop`` rows with any NULL feature."""
    f = series_window(keys).rowsBetween(-fill_limit, 0)
    df = df.withColumns({c: nan_to_null(c) for c in cols})
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(f) for c in cols})
    return df.dropna(subset=list(cols)) if drop else df
