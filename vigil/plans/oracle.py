"""DuckDB SQL oracles, written independently of the Spark operators.

Each oracle rebuilds the same derived panels from the raw tables as CTEs and
computes the operator with plain window functions. Where the Spark side uses
an algebraic shortcut (the cross-symbol correlation), the oracle uses the
direct definition (all symbol pairs), so the shortcut itself is checked.
All computed columns are rounded in both engines to the same digits.
"""

from __future__ import annotations

from vigil.sources.panels import SECTOR_REGION

R_DIGITS = 6


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _w(part: str, lo: int | str, hi: int | str = 0) -> str:
    def bound(b, side):
        if b == "unb":
            return "UNBOUNDED PRECEDING" if side == "lo" else "UNBOUNDED FOLLOWING"
        if b == 0:
            return "CURRENT ROW"
        return f"{abs(b)} PRECEDING" if b < 0 else f"{b} FOLLOWING"
    return (f"(PARTITION BY {part} ORDER BY date ROWS BETWEEN {bound(lo, 'lo')} "
            f"AND {bound(hi, 'hi')})")


def _gate(expr: str, x: str, part: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(part, -(n - 1))} = {n} THEN {expr} END"


def _roll(fn: str, x: str, part: str, n: int) -> str:
    return _gate(f"{fn}({x}) OVER {_w(part, -(n - 1))}", x, part, n)


def base_ctes(sector_region: str = SECTOR_REGION) -> list[str]:
    r = sector_region
    return [
        f"""ord AS (
  SELECT c.c_mktsegment AS universe, rg.r_name AS region,
         CAST(o.o_orderdate AS DATE) AS date, CAST(o.o_totalprice AS DOUBLE) AS price,
         o.o_orderkey
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region rg ON n.n_regionkey = rg.r_regionkey)""",
        """macro AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(100.0 AS DOUBLE) * avg(l_discount) AS fear,
         avg(l_extendedprice / nullif(l_quantity, 0)) AS fx
  FROM lineitem GROUP BY 1)""",
        f"""panel AS (
  SELECT d.universe, d.date, d.sector, d.market, m.fear, m.fx, d.volume FROM (
    SELECT universe, date,
           avg(CASE WHEN region = '{r}' THEN price END) AS sector,
           avg(price) AS market,
           CAST(nullif(count(CASE WHEN region = '{r}' THEN 1 END), 0) AS DOUBLE) AS volume
    FROM ord GROUP BY 1, 2) d LEFT JOIN macro m ON d.date = m.date)""",
    ]


def symbol_ctes() -> list[str]:
    """Per-symbol closes carried onto the market calendar, and returns with
    the complete-date rule."""
    return [
        """prices AS (
  SELECT universe, region AS symbol, date, arg_min(price, o_orderkey) AS open,
         max(price) AS high, min(price) AS low, avg(price) AS close
  FROM ord GROUP BY 1, 2, 3)""",
        """mcal AS (SELECT universe, date FROM panel WHERE market IS NOT NULL)""",
        """syms AS (SELECT DISTINCT universe, symbol FROM prices)""",
        """closes AS (
  SELECT g.universe, g.symbol, g.date,
         last_value(p.close IGNORE NULLS) OVER (PARTITION BY g.universe, g.symbol ORDER BY g.date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close
  FROM (SELECT m.universe, s.symbol, m.date FROM mcal m JOIN syms s ON m.universe = s.universe) g
  LEFT JOIN prices p ON p.universe = g.universe AND p.symbol = g.symbol AND p.date = g.date)""",
        """sret0 AS (
  SELECT *, ln(close / nullif(lag(close) OVER (PARTITION BY universe, symbol ORDER BY date), 0))
            AS ret0
  FROM closes)""",
        """sret AS (
  SELECT universe, symbol, date,
         CASE WHEN count(ret0) OVER (PARTITION BY universe, date)
                   = count(*) OVER (PARTITION BY universe, date) THEN ret0 END AS ret
  FROM sret0)""",
    ]


def calendar_ctes() -> list[str]:
    u = "universe"
    prev = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return [
        f"""rets AS (
  SELECT *,
    CASE WHEN sector IS NOT NULL THEN ln(sector / last_value(sector IGNORE NULLS)
         OVER (PARTITION BY {u} ORDER BY date {prev})) END AS bank_ret,
    CASE WHEN market IS NOT NULL THEN ln(market / last_value(market IGNORE NULLS)
         OVER (PARTITION BY {u} ORDER BY date {prev})) END AS mkt_ret
  FROM panel)""",
        f"""cal AS (
  SELECT universe, date, sector AS price, bank_ret, mkt_ret, volume,
    last_value(fear IGNORE NULLS) OVER (PARTITION BY {u} ORDER BY date {run}) AS vix,
    last_value(fx IGNORE NULLS) OVER (PARTITION BY {u} ORDER BY date {run}) AS fxr
  FROM rets WHERE bank_ret IS NOT NULL AND mkt_ret IS NOT NULL)""",
    ]


def cross_ctes(window: int = 20) -> list[str]:
    """Mean pairwise rolling correlation by brute force over symbol pairs."""
    w = _w("universe, s1, s2", -(window - 1))
    return [
        """scal AS (
  SELECT r.universe, r.symbol, r.date, r.ret FROM cal c
  JOIN sret r ON r.universe = c.universe AND r.date = c.date
  QUALIFY count(r.ret) OVER (PARTITION BY r.universe, r.symbol) > 0)""",
        """nsym AS (SELECT universe, count(DISTINCT symbol) AS n FROM scal GROUP BY 1)""",
        """pairs AS (
  SELECT a.universe, a.date, a.symbol AS s1, b.symbol AS s2, a.ret AS ra, b.ret AS rb
  FROM scal a JOIN scal b ON a.universe = b.universe AND a.date = b.date
   AND a.symbol < b.symbol)""",
        f"""pcorr AS (
  SELECT universe, date,
    CASE WHEN count(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1 END) OVER {w} = {window}
         THEN covar_samp(ra, rb) OVER {w}
              / nullif(stddev_samp(ra) OVER {w} * stddev_samp(rb) OVER {w}, 0) END AS c
  FROM pairs)""",
        """cross_c AS (
  SELECT c.universe, c.date,
    CASE WHEN coalesce(n.n, 0) < 2 THEN CAST(0.0 AS DOUBLE)
         WHEN p.k = p.m THEN p.s END AS cross_bank_corr
  FROM cal c LEFT JOIN nsym n ON n.universe = c.universe
  LEFT JOIN (SELECT universe, date, avg(c) AS s, count(c) AS k, count(*) AS m
             FROM pcorr GROUP BY 1, 2) p ON p.universe = c.universe AND p.date = c.date)""",
    ]


FEATURES = [
    "vol_5d", "vol_10d", "vol_20d", "ewma_vol", "vol_of_vol",
    "max_drawdown", "underwater_dur", "current_drawdown",
    "bank_market_corr", "cross_bank_corr", "corr_trend", "bm_corr_trend",
    "rsi", "roc_5d", "ma_spread",
    "vix_level", "vix_change", "vix_zscore", "vix_spike",
    "fx_level", "fx_change", "fx_zscore",
    "cvar_5pct", "return_skew", "return_kurt",
    "bank_rel_return", "bank_beta", "bank_rel_vol",
]


def feature_ctes(with_cross: bool = True, use_volume: bool = False) -> list[str]:
    """CTEs ending in ``feat`` (cleaned feature matrix per universe, date)."""
    u = "universe"
    uw = f"(PARTITION BY {u} ORDER BY date)"
    sq = _dbl(252 ** 0.5)
    r_ew = 1.0 - 2.0 / 21.0
    both = "CASE WHEN bank_ret IS NOT NULL AND mkt_ret IS NOT NULL THEN 1 END"
    w30, w20 = _w(u, -29), _w(u, -19)
    ctes = base_ctes() + calendar_ctes()
    if with_cross:
        ctes += symbol_ctes() + cross_ctes()
        join = "LEFT JOIN cross_c x ON x.universe = cal.universe AND x.date = cal.date"
        cross_col = "x.cross_bank_corr"
    else:
        join, cross_col = "", "CAST(NULL AS DOUBLE)"
    ctes.append(f"""calx AS (SELECT cal.*, {cross_col} AS cross_bank_corr FROM cal {join})""")
    ctes.append(f"""f1 AS (
  SELECT *,
    {_roll('stddev_samp', 'bank_ret', u, 5)} * {sq} AS vol_5d,
    {_roll('stddev_samp', 'bank_ret', u, 10)} * {sq} AS vol_10d,
    {_roll('stddev_samp', 'bank_ret', u, 20)} * {sq} AS vol_20d,
    list(bank_ret) OVER {_w(u, 'unb')} AS ewl,
    {_roll('stddev_samp', 'bank_ret', u, 5)} AS sd5,
    (price - max(price) OVER {_w(u, -59)}) / nullif(max(price) OVER {_w(u, -59)}, 0)
      AS max_drawdown,
    (price - max(price) OVER {_w(u, 'unb')}) / nullif(max(price) OVER {_w(u, 'unb')}, 0)
      AS current_drawdown,
    row_number() OVER {uw} AS rn,
    CASE WHEN count({both}) OVER {w30} = 30
         THEN covar_samp(bank_ret, mkt_ret) OVER {w30}
              / nullif(stddev_samp(bank_ret) OVER {w30} * stddev_samp(mkt_ret) OVER {w30}, 0)
         END AS bank_market_corr,
    price - lag(price) OVER {uw} AS delta,
    price / nullif(lag(price, 5) OVER {uw}, 0) - 1 AS roc_5d,
    {_roll('avg', 'price', u, 10)} AS ma10,
    {_roll('avg', 'price', u, 50)} AS ma50,
    {_gate(f"(volume - avg(volume) OVER {w20}) / (stddev_samp(volume) OVER {w20} + 1e-9)", 'volume', u, 20)}
      AS vol_zscore,
    vix AS vix_level, vix - lag(vix) OVER {uw} AS vix_change,
    {_gate(f"(vix - avg(vix) OVER {w20}) / (stddev_samp(vix) OVER {w20} + 1e-9)", 'vix', u, 20)}
      AS vix_zscore,
    fxr AS fx_level, fxr - lag(fxr) OVER {uw} AS fx_change,
    {_gate(f"(fxr - avg(fxr) OVER {w20}) / (stddev_samp(fxr) OVER {w20} + 1e-9)", 'fxr', u, 20)}
      AS fx_zscore,
    CASE WHEN count(bank_ret) OVER {_w(u, -59)} = 60
         THEN list_sort(list(bank_ret) OVER {_w(u, -59)}) END AS cvl,
    CASE WHEN count(bank_ret) OVER {w30} = 30 THEN list(bank_ret) OVER {w30} END AS skl,
    CASE WHEN count(bank_ret) OVER {w20} = 20 AND count(mkt_ret) OVER {w20} = 20
         THEN (avg(bank_ret) OVER {w20} - avg(mkt_ret) OVER {w20}) * 252 END AS bank_rel_return,
    CASE WHEN count({both}) OVER {w20} = 20
         THEN covar_samp(bank_ret, mkt_ret) OVER {w20} / (var_samp(mkt_ret) OVER {w20} + 1e-9)
         END AS bank_beta,
    CASE WHEN count(bank_ret) OVER {w20} = 20 AND count(mkt_ret) OVER {w20} = 20
         THEN stddev_samp(bank_ret) OVER {w20} - stddev_samp(mkt_ret) OVER {w20} END
      AS bank_rel_vol
  FROM calx)""")
    ctes.append(f"""f2 AS (
  SELECT *,
    len(ewl) AS ewn,
    {_roll('stddev_samp', 'sd5', u, 20)} AS vol_of_vol,
    coalesce(max_drawdown < 0, false) AS under,
    bank_market_corr - lag(bank_market_corr, 10) OVER {uw} AS bm_corr_trend,
    {'cross_bank_corr - lag(cross_bank_corr, 10) OVER ' + uw if with_cross
     else 'bank_market_corr - lag(bank_market_corr, 10) OVER ' + uw} AS corr_trend,
    {_roll('avg', 'greatest(delta, 0)', u, 14).replace('count(greatest(delta, 0))', 'count(delta)')}
      AS gain,
    {_roll('avg', '-least(delta, 0)', u, 14).replace('count(-least(delta, 0))', 'count(delta)')}
      AS loss,
    (ma10 - ma50) / (ma50 + 1e-9) AS ma_spread,
    CASE WHEN vix_zscore > 1.5 THEN 1 ELSE 0 END AS vix_spike,
    CASE WHEN vol_zscore > 2.0 THEN 1 ELSE 0 END AS vol_spike,
    (len(cvl) - 1) * {_dbl(0.05)} AS qpos,
    list_avg(skl) AS skm
  FROM f1)""")
    ctes.append(f"""f3 AS (
  SELECT *,
    (1 - pow({_dbl(r_ew)}, CAST(ewn AS DOUBLE))) / {_dbl(1.0 - r_ew)} AS ew_sw,
    (1 - pow({_dbl(r_ew * r_ew)}, CAST(ewn AS DOUBLE))) / {_dbl(1.0 - r_ew * r_ew)} AS ew_sw2,
    list_reduce(ewl, lambda acc, x: acc * {_dbl(r_ew)} + x) AS ew_swx,
    list_reduce(list_transform(ewl, lambda x: x * x), lambda acc, x: acc * {_dbl(r_ew)} + x)
      AS ew_swxx,
    CASE WHEN under THEN rn - coalesce(max(CASE WHEN NOT under THEN rn END)
         OVER {_w(u, 'unb')}, 0) ELSE 0 END AS underwater_dur,
    100 - 100 / (1 + gain / (loss + 1e-9)) AS rsi,
    cvl[CAST(floor(qpos) AS INTEGER) + 1]
      + (cvl[least(CAST(floor(qpos) AS INTEGER) + 2, len(cvl))]
         - cvl[CAST(floor(qpos) AS INTEGER) + 1]) * (qpos - floor(qpos)) AS cq,
    list_avg(list_transform(skl, lambda x: (x - skm) * (x - skm))) AS m2,
    list_avg(list_transform(skl, lambda x: (x - skm) * (x - skm) * (x - skm))) AS m3,
    list_avg(list_transform(skl, lambda x: (x - skm) * (x - skm) * (x - skm) * (x - skm))) AS m4
  FROM f2)""")
    ctes.append(f"""f4 AS (
  SELECT *,
    greatest(ew_swxx / ew_sw - (ew_swx / ew_sw) * (ew_swx / ew_sw), 0) AS ew_vb,
    list_avg(list_filter(cvl, lambda x: x <= cq)) AS cvar_5pct,
    m3 / nullif(pow(m2, 1.5), 0) AS return_skew,
    m4 / nullif(m2 * m2, 0) - 3 AS return_kurt
  FROM f3)""")
    ctes.append(f"""f5 AS (
  SELECT *, sqrt(ew_vb * ew_sw * ew_sw / nullif(ew_sw * ew_sw - ew_sw2, 0)) * {sq} AS ewma_vol
  FROM f4)""")
    names = FEATURES + (["vol_zscore", "vol_spike"] if use_volume else [])
    fill = ",\n    ".join(
        f"last_value({c} IGNORE NULLS) OVER {_w(u, -5)} AS {c}" for c in names)
    ctes.append(f"""f6 AS (
  SELECT universe, date, bank_ret, mkt_ret,
    {fill}
  FROM f5)""")
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in names)
    ctes.append(f"""feat AS (SELECT * FROM f6 WHERE {notnull})""")
    return ctes


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def rnd(expr: str, digits: int = R_DIGITS, alias: str | None = None) -> str:
    # "+ 0.0" turns a rounded -0.0 into 0.0, as Spark's decimal rounding does.
    out = f"(round({expr}, {digits}) + 0.0)"
    return f"{out} AS {alias}" if alias else out


def _scaled(x: str, part: str = "universe") -> str:
    p = f"(PARTITION BY {part})"
    lo, hi = f"min({x}) OVER {p}", f"max({x}) OVER {p}"
    return (f"CASE WHEN ({x}) IS NULL THEN NULL WHEN {hi} = {lo} THEN CAST(100.0 AS DOUBLE) "
            f"ELSE (1 - (({x}) - {lo}) / ({hi} - {lo})) * 100 END")


def score_ctes(use_volume: bool = False) -> list[str]:
    """CTEs ending in ``scores`` (features + component and risk scores)."""
    u = "universe"
    uw = f"(PARTITION BY {u} ORDER BY date)"
    stab = [_scaled(x) for x in ("vol_20d", "ewma_vol", "vol_of_vol", "abs(max_drawdown)",
                                 "abs(current_drawdown)", "CAST(underwater_dur AS DOUBLE)")]
    net = [_scaled(x) for x in ("abs(bank_market_corr)", "abs(cross_bank_corr)", "corr_trend")]
    ext = [_scaled("vix_level"), _scaled("vix_zscore"), "100 - vix_spike * CAST(30.0 AS DOUBLE)",
           _scaled("fx_zscore")]
    vol = [_scaled("abs(vol_zscore)"), "100 - vol_spike * CAST(30.0 AS DOUBLE)"]
    volume = (f"least(greatest(({' + '.join(vol)}) / 2.0, 0), 100)" if use_volume
              else "CAST(50.0 AS DOUBLE)")
    half = _dbl(0.5)
    return feature_ctes(use_volume=use_volume) + [
        f"""s1 AS (
  SELECT *,
    ({' + '.join(stab)}) / {len(stab)}.0 AS stability_score,
    {volume} AS volume_score,
    ({' + '.join(net)}) / {len(net)}.0 AS network_score,
    least(greatest(({' + '.join(ext)}) / {len(ext)}.0, 0), 100) AS external_score
  FROM feat)""",
        f"""s2 AS (
  SELECT *, list(0.4 * stability_score + 0.2 * volume_score + 0.2 * network_score
                 + 0.2 * external_score) OVER {_w(u, 'unb')} AS rsl
  FROM s1)""",
        f"""s3 AS (
  SELECT * EXCLUDE (rsl),
    list_reduce(rsl, lambda acc, x: acc * {half} + x)
      / list_reduce(list_transform(rsl, lambda x: CAST(1.0 AS DOUBLE)),
                    lambda acc, x: acc * {half} + x) AS risk_score
  FROM s2)""",
        f"""scores AS (
  SELECT *, risk_score - lag(risk_score) OVER {uw} AS risk_velocity,
         risk_score - lag(risk_score, 5) OVER {uw} AS risk_momentum
  FROM s3)""",
    ]


def state_sql(score: str = "risk_score") -> str:
    return (f"CASE WHEN {score} >= 80 THEN 'Stable' WHEN {score} >= 65 THEN 'Low Risk' "
            f"WHEN {score} >= 40 THEN 'Stress' ELSE 'Crisis' END")


def state_ctes(window_recovery: int = 5, use_volume: bool = False) -> list[str]:
    """CTEs ending in ``states``: scores + market_state (with Recovery)."""
    uw = "(PARTITION BY universe ORDER BY date)"
    return score_ctes(use_volume) + [
        f"""st1 AS (
  SELECT *, coalesce(risk_score >= 40 AND risk_score < 65
                     AND risk_score > lag(risk_score) OVER {uw}, false) AS rising
  FROM scores)""",
        f"""st2 AS (
  SELECT *, sum(CASE WHEN rising THEN 0 ELSE 1 END) OVER (PARTITION BY universe ORDER BY date
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM st1)""",
        f"""states AS (
  SELECT * EXCLUDE (rising, island),
    CASE WHEN rising
          AND coalesce(first_value(risk_score) OVER (PARTITION BY universe, island ORDER BY date)
                       < 40, true)
          AND row_number() OVER (PARTITION BY universe, island ORDER BY date) - 1
              >= {window_recovery}
         THEN 'Recovery' ELSE {state_sql()} END AS market_state
  FROM st2)""",
    ]


def label_ctes(threshold: float = 40.0, horizon: int = 3) -> list[str]:
    """CTEs ending in ``labelled``: states + y (crisis within the horizon)."""
    f = (f"(PARTITION BY universe ORDER BY date ROWS BETWEEN 1 FOLLOWING AND "
         f"{horizon} FOLLOWING)")
    return state_ctes() + [
        f"""lab AS (
  SELECT *, max(CASE WHEN risk_score < {threshold} THEN 1 ELSE 0 END) OVER {f} AS y,
            count(*) OVER {f} AS n_next
  FROM states)""",
        """labelled AS (SELECT * EXCLUDE (n_next) FROM lab WHERE n_next = """ + str(horizon) + ")",
    ]
