"""Feature operators against pandas / plain loops on small hand-made series."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from vigil.operators import features as fe

K = ["universe"]


def _frame(spark, values, universe="U", start=dt.date(2020, 1, 1), col="x"):
    rows = [(universe, start + dt.timedelta(days=i), None if v is None else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"universe string, date date, {col} double")


def _col(df, name):
    return [r[name] for r in df.orderBy("universe", "date").collect()]


def _close(a, b, tol=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            assert y is None or (isinstance(y, float) and math.isnan(y)), (x, y)
        else:
            assert y is not None and abs(x - y) <= tol * max(1.0, abs(x)), (x, y)


def _pd(values):
    return pd.Series([np.nan if v is None else v for v in values], dtype=float)


def test_rolling_volatility_gates(spark):
    rng = np.random.default_rng(1)
    vals = list(rng.normal(0, 0.01, 21))
    out = fe.rolling_volatility(_frame(spark, vals), "x", K, windows=(20,))
    got = _col(out, "vol_20d")
    exp = (_pd(vals).rolling(20).std() * math.sqrt(252)).tolist()
    assert got[18] is None and got[19] is not None
    _close([None if math.isnan(v) else v for v in exp], got)


def test_ewma_matches_pandas(spark):
    rng = np.random.default_rng(2)
    vals = list(rng.normal(0, 0.01, 120))
    out = fe.ewma_volatility(_frame(spark, vals), "x", K)
    exp = (_pd(vals).ewm(span=20).std() * math.sqrt(252)).tolist()
    _close([None if math.isnan(v) else v for v in exp], _col(out, "ewma_vol"), 1e-8)


def test_ewma_ages_over_gaps_and_long_spans(spark):
    """Calm after an early storm, with missing rows: no row is forgotten. The
    expectation sums the weights of all earlier rows directly."""
    rng = np.random.default_rng(9)
    vals = list(rng.normal(0, 0.05, 40)) + list(rng.normal(0, 0.001, 700))
    vals[5] = vals[300] = vals[301] = None
    for span in (3, 400):
        got = _col(fe.ewma_volatility(_frame(spark, vals), "x", K, span), "ewma_vol")
        r = 1 - 2 / (span + 1)
        for t in (1, 6, 39, 300, 500, 739):
            x = np.array([v for v in vals[:t + 1] if v is not None])
            w = np.array([r ** (t - i) for i in range(t + 1) if vals[i] is not None])
            mean = (w * x).sum() / w.sum()
            var = (w * (x - mean) ** 2).sum() / w.sum() / (1 - (w * w).sum() / w.sum() ** 2)
            assert got[t] == pytest.approx(math.sqrt(var * 252), rel=1e-7), (span, t)
        assert got[0] is None


def test_drawdown_and_streak(spark):
    prices = [10, 11, 10, 9, 12, 12, 11, 10, 13]
    out = fe.drawdown(_frame(spark, prices, col="p"), "p", K, window=3)
    worked = [0, 0, -1 / 11, -2 / 11, 0, 0, -1 / 12, -2 / 12, 0]
    _close(worked, _col(out, "max_drawdown"))
    _close(worked, _col(out, "current_drawdown"))
    assert _col(out, "underwater_dur") == [0, 0, 1, 2, 0, 0, 1, 2, 0]
    # A peak that has left the window still counts for the running gap only.
    out = fe.drawdown(_frame(spark, [20, 10, 11, 12], col="p"), "p", K, window=2)
    _close([0, -0.5, 0, 0], _col(out, "max_drawdown"))
    _close([0, -0.5, -0.45, -0.4], _col(out, "current_drawdown"))


def test_rsi_roc_ma(spark):
    """Two up, one down in turn: 100, 102, 101, 103, 102, ... (50 rows)."""
    prices = [100 + i / 2 + (1.5 if i % 2 else 0) for i in range(50)]
    df = _frame(spark, prices, col="p")
    out = fe.moving_avg_spread(fe.rate_of_change(fe.rsi(df, "p", K), "p", K), "p", K).cache()
    rsi, roc, ma = (_col(out, c) for c in ("rsi", "roc_5d", "ma_spread"))
    assert rsi[13] is None and rsi[14] == pytest.approx(200 / 3, abs=1e-6)  # 14 of gain, 7 of loss
    assert roc[4] is None and roc[5] == pytest.approx(0.04) and roc[6] == pytest.approx(1 / 102)
    assert ma[48] is None and ma[49] == pytest.approx(10 / 113, abs=1e-9)  # means 123 and 113


def test_cvar_and_moments(spark):
    rng = np.random.default_rng(4)
    vals = list(rng.normal(0, 0.02, 90))
    out = fe.skew_kurt(fe.cvar(_frame(spark, vals), "x", K), "x", K)
    got_c, got_s, got_k = _col(out, "cvar_5pct"), _col(out, "return_skew"), _col(out, "return_kurt")
    arr = np.array(vals)
    for i in range(len(vals)):
        if i < 59:
            assert got_c[i] is None
        else:
            w = arr[i - 59:i + 1]
            q = np.percentile(w, 5)
            assert abs(got_c[i] - w[w <= q].mean()) < 1e-12
        if i >= 29:
            w = arr[i - 29:i + 1]
            m = w.mean()
            m2, m3, m4 = ((w - m) ** 2).mean(), ((w - m) ** 3).mean(), ((w - m) ** 4).mean()
            assert abs(got_s[i] - m3 / m2 ** 1.5) < 1e-9
            assert abs(got_k[i] - (m4 / m2 ** 2 - 3)) < 1e-9


def test_constant_series_gives_null_correlation(spark):
    rows = [("U", dt.date(2020, 1, 1) + dt.timedelta(days=i), 1.0, float(i % 3))
            for i in range(40)]
    df = spark.createDataFrame(rows, "universe string, date date, a double, b double")
    out = fe.bank_market_corr(df, "a", "b", K)
    assert all(v is None for v in _col(out, "bank_market_corr"))


def test_cross_symbol_corr_equals_pairwise_mean(spark):
    rng = np.random.default_rng(5)
    n, syms = 60, ["A", "B", "C", "D"]
    data = {s: rng.normal(0, 0.01, n) for s in syms}
    data["B"] = data["B"] + 0.5 * data["A"]
    dates = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    rows = [("U", s, d, float(data[s][i])) for s in syms for i, d in enumerate(dates)]
    rets = spark.createDataFrame(rows, "universe string, symbol string, date date, ret double")
    cal = spark.createDataFrame([("U", d) for d in dates], "universe string, date date")
    got = _col(fe.cross_symbol_corr(rets, cal, K), "cross_bank_corr")
    wide = pd.DataFrame(data)
    pairs = [(a, b) for i, a in enumerate(syms) for b in syms[i + 1:]]
    exp = sum(wide[a].rolling(20).corr(wide[b]) for a, b in pairs) / len(pairs)
    _close([None if math.isnan(v) else v for v in exp.tolist()], got, 1e-9)


def test_single_symbol_cross_corr_is_zero(spark):
    dates = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(25)]
    rets = spark.createDataFrame([("U", "A", d, 0.01 * i) for i, d in enumerate(dates)],
                                 "universe string, symbol string, date date, ret double")
    cal = spark.createDataFrame([("U", d) for d in dates], "universe string, date date")
    assert set(_col(fe.cross_symbol_corr(rets, cal, K), "cross_bank_corr")) == {0.0}


def test_two_universes_do_not_leak(spark):
    rng = np.random.default_rng(6)
    a, b = list(rng.normal(0, 0.01, 30)), list(rng.normal(0, 0.05, 30))
    both = _frame(spark, a, "A").unionByName(_frame(spark, b, "B"))
    out = fe.rolling_volatility(both, "x", K, windows=(10,))
    alone = fe.rolling_volatility(_frame(spark, a, "A"), "x", K, windows=(10,))
    got = [r["vol_10d"] for r in out.where("universe = 'A'").orderBy("date").collect()]
    _close(_col(alone, "vol_10d"), got)


def test_window_tasks_do_not_follow_the_partitions_of_raw_rows(spark):
    from vigil.functions import spread
    from vigil.functions.columns import SPREAD_LEAST
    df = spark.range(40).selectExpr("CAST(id % 5 AS STRING) AS universe", "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, most in ((600, max(SPREAD_LEAST, 4 * spark.sparkContext.defaultParallelism)), (8, 8)):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            dealt = spread(df, ["universe"])
            assert dealt.rdd.getNumPartitions() == min(n, most)
            places = dealt.selectExpr("universe", "spark_partition_id() AS at").distinct()
            assert dealt.count() == 40 and places.count() == 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
