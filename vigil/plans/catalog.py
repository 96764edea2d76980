"""Query registry: name -> (Spark query, DuckDB oracle SQL or None).

Each Spark query takes (spark, sf_dir) and returns a lazy DataFrame over the
whole derived panels. Computed columns carry the same names in both engines;
DOUBLE outputs are rounded to the same digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import decay
from vigil.operators import features as fe
from vigil.operators import running as rn
from vigil.operators import scoring as scr
from vigil.plans import frames
from vigil.plans import oracle as o
from vigil.plans.params import SEGMENT_ROWS
from vigil.session import cut_lineage
from vigil.sources import panels

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

K = list(frames.KEYS)
D = o.R_DIGITS


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _round_sql(cols: list[str], digits: int = D) -> str:
    return ", ".join(o.rnd(c, digits, c) for c in cols)


# --------------------------------------------------------------------------
# Sources
# --------------------------------------------------------------------------

PANEL_COLS = ["sector", "market", "fear", "fx", "volume"]


@register("index_panel", o.with_ctes(
    o.base_ctes(), f"SELECT universe, date, {_round_sql(PANEL_COLS)} FROM panel"))
def q_index_panel(spark: SparkSession, sf: str) -> DataFrame:
    """IO-2 / JN-1 / PF-1: the wide index panel per (universe, date)."""
    return frames.round_doubles(frames.index_panel(spark, sf))


PRICE_COLS = ["open", "high", "low", "close"]


@register("prices_panel", o.with_ctes(
    o.base_ctes(),
    f"""SELECT universe, region AS symbol, date,
  {', '.join(o.rnd(x, D, c) for x, c in [('arg_min(price, o_orderkey)', 'open'),
                                          ('max(price)', 'high'), ('min(price)', 'low'),
                                          ('avg(price)', 'close')])},
  round(sum(q.qty), {D}) AS volume
FROM ord LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) q
  ON q.l_orderkey = ord.o_orderkey
GROUP BY 1, 2, 3"""))
def q_prices_panel(spark: SparkSession, sf: str) -> DataFrame:
    """IO-1: daily OHLCV per (universe, symbol)."""
    return frames.round_doubles(panels.prices_panel(spark, sf))


@register("events_prices_panel", f"""
SELECT 'EVENTS' AS universe, event_type AS symbol, CAST(ts AS DATE) AS date,
  round(arg_min(value, event_id), {D}) AS open, round(max(value), {D}) AS high,
  round(min(value), {D}) AS low, round(avg(value), {D}) AS close,
  CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2, 3""")
def q_events_prices(spark: SparkSession, sf: str) -> DataFrame:
    """IO-1 on the event stream: event type as symbol, daily buckets."""
    return frames.round_doubles(panels.events_prices_panel(spark, sf))


@register("symbol_returns", o.with_ctes(
    o.base_ctes() + o.symbol_ctes(),
    f"SELECT universe, symbol, date, {o.rnd('ret', D, 'ret')} FROM sret"))
def q_symbol_returns(spark: SparkSession, sf: str) -> DataFrame:
    """PF-6 + WF-1 per symbol with the complete-date rule (PF-2 on the wide frame)."""
    return frames.round_doubles(frames.symbol_returns(spark, sf))


# --------------------------------------------------------------------------
# Features
# --------------------------------------------------------------------------

FLAGSHIP_COLS = ["bank_ret", "vol_5d", "vol_10d", "vol_20d", "max_drawdown",
                 "current_drawdown", "rsi"]


@register("rolling_volatility", o.with_ctes(
    o.feature_ctes(with_cross=False),
    f"SELECT universe, date, {_round_sql(FLAGSHIP_COLS)}, underwater_dur FROM f3"))
def q_rolling_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """Minimum slice: WF-1, WF-2, WF-5/6/7 and WF-12 on the common calendar
    (before the clean-up), one row per (universe, date)."""
    cal = fe.common_calendar(frames.index_panel(spark, sf), K)
    df = fe.rolling_volatility(cal, "bank_ret", K)
    df = fe.drawdown(df, "price", K)
    df = fe.rsi(df, "price", K)
    return frames.round_doubles(df.select(*K, "date", *FLAGSHIP_COLS, "underwater_dur"))


EWMA_SPANS = [3, 20, 120, 400]


def _ewma_sql() -> str:
    """Whole-history weights by pairing every row with all rows up to it."""
    sums, cols = [], []
    for n in EWMA_SPANS:
        r = 1.0 - 2.0 / (n + 1.0)
        sums.append(f"""sum(pow({r!r}::DOUBLE, t.i - p.i)) AS w{n}, sum(pow({r * r!r}::DOUBLE, t.i - p.i)) AS v{n},
    sum(pow({r!r}::DOUBLE, t.i - p.i) * p.x) AS x{n}, sum(pow({r!r}::DOUBLE, t.i - p.i) * p.x * p.x) AS y{n}""")
        var = f"(y{n} / w{n} - (x{n} / w{n}) * (x{n} / w{n})) * w{n} * w{n} / (w{n} * w{n} - v{n})"
        cols.append(o.rnd(f"CASE WHEN k > 1 THEN sqrt(greatest({var}, 0)) * sqrt(252) END", D, f"ewma_{n}"))
    return f"""SELECT universe, date, {', '.join(cols)} FROM (
  SELECT t.universe, t.date, count(p.x) AS k, {', '.join(sums)}
  FROM num t LEFT JOIN num p ON p.universe = t.universe AND p.i <= t.i AND p.x IS NOT NULL
  GROUP BY 1, 2)"""


@register("ewma_spans", o.with_ctes(
    o.base_ctes() + o.calendar_ctes()[:1] + [
        """num AS (SELECT universe, date, bank_ret AS x,
  row_number() OVER (PARTITION BY universe ORDER BY date) AS i FROM rets)"""], _ewma_sql()))
def q_ewma_spans(spark: SparkSession, sf: str) -> DataFrame:
    """WF-3 for short and long spans on series with gaps (sector returns are
    NULL on days without sector orders)."""
    df = fe.log_returns(frames.index_panel(spark, sf), "sector", K, "bank_ret")
    for n in EWMA_SPANS:
        df = fe.ewma_volatility(df, "bank_ret", K, n, out=f"ewma_{n}")
    return frames.round_doubles(df.select(*K, "date", *[f"ewma_{n}" for n in EWMA_SPANS]))


def _two_pass_sql(names: list[str], span: int) -> str:
    """Mean and deviation of each series of ``num`` by direct sums in two
    passes, ages counted from the newest value."""
    r, parts = 1.0 - 2.0 / (span + 1.0), []
    for n in names:
        parts.append(f"""{n}_p AS (
  SELECT t.universe, t.i, p.x, pow({r!r}::DOUBLE, max(p.i) OVER (PARTITION BY t.universe, t.i) - p.i) AS w
  FROM num t JOIN (SELECT universe, i, {n} AS x FROM num WHERE {n} IS NOT NULL) p
    ON p.universe = t.universe AND p.i <= t.i),
{n}_m AS (SELECT universe, i, sum(w * x) / sum(w) AS m, sum(w) AS w, 2 * sum(w * older) AS f, count(*) AS k
  FROM (SELECT *, sum(w) OVER (PARTITION BY universe, i ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        AS older FROM {n}_p) GROUP BY 1, 2),
{n}_s AS (SELECT m.universe, m.i, any_value(m.m) AS m,
  CASE WHEN any_value(k) > 1 THEN sqrt(sum(p.w * (p.x - m.m) * (p.x - m.m)) * any_value(m.w)
       / any_value(f)) END AS sd
  FROM {n}_m m JOIN {n}_p p ON p.universe = m.universe AND p.i = m.i GROUP BY 1, 2)""")
    joins = " ".join(f"LEFT JOIN {n}_s ON {n}_s.universe = num.universe AND {n}_s.i = num.i" for n in names)
    cols = ", ".join(f"{o.rnd(f'{n}_s.{c}', D, f'{n}_{c}')}" for n in names for c in ("m", "sd"))
    return ",\n".join(parts) + f"\nSELECT num.universe, num.date, {cols} FROM num {joins}"


@register("ewma_gap_and_level", "WITH " + ",\n".join(
    o.base_ctes() + o.calendar_ctes()[:1] + [
        """num AS (SELECT universe, date, i, CASE WHEN i NOT BETWEEN 100 AND 349 THEN bank_ret END AS gapped,
  1000000 + 0.001 * bank_ret AS raised FROM (
    SELECT *, row_number() OVER (PARTITION BY universe ORDER BY date) - 1 AS i FROM rets))"""])
    + ",\n" + _two_pass_sql(["gapped", "raised"], 20))
def q_ewma_gap_and_level(spark: SparkSession, sf: str) -> DataFrame:
    """WF-3 / SC-6 in blocks side by side, over 250 missing rows and on a level
    that is a billion times the spread."""
    df = fe.log_returns(frames.index_panel(spark, sf), "sector", K, "bank_ret")
    df = cut_lineage(rn.numbered(cut_lineage(df), K, SEGMENT_ROWS))
    gap, x = F.col(rn.POS).between(100, 349), F.col("bank_ret")
    df = df.withColumns({"gapped": F.when(~gap, x), "raised": F.lit(1e6) + F.lit(0.001) * x})
    for c in ("gapped", "raised"):
        df = decay.ewm_std(decay.ewm_mean(df, c, K, 20, f"{c}_m"), c, K, 20, f"{c}_sd")
    return frames.round_doubles(df.select(*K, "date", "gapped_m", "gapped_sd", "raised_m", "raised_sd"))


@register("cross_symbol_corr", o.with_ctes(
    o.base_ctes() + o.calendar_ctes() + o.symbol_ctes() + o.cross_ctes(),
    f"SELECT universe, date, {o.rnd('cross_bank_corr', D, 'cross_bank_corr')} FROM cross_c"))
def q_cross_symbol_corr(spark: SparkSession, sf: str) -> DataFrame:
    """WF-10: mean pairwise 20-row correlation of the symbol returns."""
    daily = frames.daily_orders(spark, sf)
    panel = panels.index_panel(spark, sf, daily=daily)
    cal = fe.common_calendar(panel, K).select(*K, "date")
    rets = frames.symbol_returns(spark, sf, panel, daily)
    return frames.round_doubles(fe.cross_symbol_corr(rets, cal, K))


FEATURE_OUT = ["bank_ret", "mkt_ret", *fe.FEATURE_COLUMNS]


@register("market_features", o.with_ctes(
    o.feature_ctes(), f"SELECT universe, date, {_round_sql(FEATURE_OUT)} FROM feat"))
def q_market_features(spark: SparkSession, sf: str) -> DataFrame:
    """WF-21 (with WF-1 ... WF-19, PF-4/5/2): the cleaned feature matrix."""
    return frames.round_doubles(frames.features(spark, sf))


@register("segmented_features", REGISTRY["market_features"][1])
def q_segmented_features(spark: SparkSession, sf: str) -> DataFrame:
    """WF-21 over segments of SEGMENT_ROWS rows, as for series too long for one task."""
    return frames.round_doubles(frames.features(spark, sf, segment_rows=SEGMENT_ROWS))


STOCK_FEAT = ["annualised_return", "volatility", "sharpe", "beta", "corr_with_index", "momentum"]


def _stock_feature_sql() -> str:
    w = "(PARTITION BY universe, symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    both = "CASE WHEN ret IS NOT NULL AND index_ret IS NOT NULL THEN 1 END"
    full = f"count(ret) OVER {w} = 20"
    body = f"""sf AS (
  SELECT s.universe, s.symbol, s.date, s.ret, c.bank_ret AS index_ret
  FROM sret s JOIN cal c ON s.universe = c.universe AND s.date = c.date),
sf2 AS (
  SELECT universe, symbol, date,
    CASE WHEN {full} THEN avg(ret) OVER {w} * 252 END AS annualised_return,
    CASE WHEN {full} THEN stddev_samp(ret) OVER {w} * {o._dbl(252 ** 0.5)} END AS volatility,
    CASE WHEN count({both}) OVER {w} = 20 THEN covar_samp(ret, index_ret) OVER {w}
         / (CASE WHEN count(index_ret) OVER {w} = 20 THEN var_samp(index_ret) OVER {w} END
            + 1e-9) END AS beta,
    CASE WHEN count({both}) OVER {w} = 20 THEN covar_samp(ret, index_ret) OVER {w}
         / nullif(stddev_samp(CASE WHEN index_ret IS NOT NULL THEN ret END) OVER {w}
                  * stddev_samp(CASE WHEN ret IS NOT NULL THEN index_ret END) OVER {w}, 0)
         END AS corr_with_index,
    CASE WHEN {full} THEN sum(ret) OVER {w} END AS momentum
  FROM sf)
SELECT universe, symbol, date, {_round_sql(['annualised_return', 'volatility', 'beta',
                                            'corr_with_index', 'momentum'])},
  {o.rnd('annualised_return / (volatility + 1e-9)', D, 'sharpe')}
FROM sf2"""
    ctes = o.base_ctes() + o.calendar_ctes() + o.symbol_ctes()
    return "WITH " + ",\n".join(ctes) + ",\n" + body


@register("stock_features", _stock_feature_sql())
def q_stock_features(spark: SparkSession, sf: str) -> DataFrame:
    """WF-20: per-symbol rolling return, volatility, Sharpe, beta, correlation
    and momentum against the sector index return."""
    daily = frames.daily_orders(spark, sf)
    panel = panels.index_panel(spark, sf, daily=daily)
    cal = fe.common_calendar(panel, K).select(*K, "date", F.col("bank_ret").alias("index_ret"))
    rets = frames.symbol_returns(spark, sf, panel, daily)
    out = fe.stock_features(rets, cal, K)
    return frames.round_doubles(out.select(*K, "symbol", "date", *STOCK_FEAT))


# --------------------------------------------------------------------------
# Scores, states, labels
# --------------------------------------------------------------------------

SCORE_COLS = ["stability_score", "volume_score", "network_score", "external_score",
              "risk_score", "risk_velocity", "risk_momentum"]


def scores_frame(spark: SparkSession, sf: str, use_volume: bool = False,
                 daily: DataFrame | None = None) -> DataFrame:
    return scr.compute_scores(frames.features(spark, sf, use_volume=use_volume, daily=daily), K)


def states_frame(spark: SparkSession, sf: str, use_volume: bool = False) -> DataFrame:
    return scr.classify_state(scores_frame(spark, sf, use_volume), K)


@register("risk_scores", o.with_ctes(
    o.score_ctes(), f"SELECT universe, date, {_round_sql(SCORE_COLS)} FROM scores"))
def q_risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """SC-1 ... SC-6: component scores and the smoothed composite score."""
    return frames.round_doubles(scores_frame(spark, sf).select(*K, "date", *SCORE_COLS))


@register("risk_scores_with_volume", o.with_ctes(
    o.score_ctes(use_volume=True), f"SELECT universe, date, {_round_sql(SCORE_COLS)} FROM scores"))
def q_risk_scores_volume(spark: SparkSession, sf: str) -> DataFrame:
    """SC-3 with WF-8: the volume component from volume stress, not its neutral value."""
    return frames.round_doubles(scores_frame(spark, sf, use_volume=True).select(*K, "date", *SCORE_COLS))


@register("market_states_with_volume", o.with_ctes(
    o.state_ctes(use_volume=True),
    f"SELECT universe, date, {o.rnd('risk_score', D, 'risk_score')}, market_state FROM states"))
def q_market_states_volume(spark: SparkSession, sf: str) -> DataFrame:
    """SC-7 on the scores with volume."""
    return frames.round_doubles(states_frame(spark, sf, use_volume=True).select(
        *K, "date", "risk_score", "market_state"))


@register("market_states", o.with_ctes(
    o.state_ctes(), f"""SELECT universe, date, {o.rnd('risk_score', D, 'risk_score')},
  market_state, {o.state_sql('round(risk_score, 1)')} AS simple_state,
  CASE market_state WHEN 'Stable' THEN '#00c853' WHEN 'Low Risk' THEN '#76ff03'
    WHEN 'Stress' THEN '#ffab00' WHEN 'Crisis' THEN '#d50000' WHEN 'Recovery' THEN '#00b8d4'
    ELSE '#9e9e9e' END AS state_color
FROM states"""))
def q_market_states(spark: SparkSession, sf: str) -> DataFrame:
    """SC-7 (with Recovery), SC-8 (stateless, on 1-decimal scores), SC-9 colour."""
    df = states_frame(spark, sf)
    return frames.round_doubles(df.select(
        *K, "date", "risk_score", "market_state",
        scr.state_of(F.round("risk_score", 1)).alias("simple_state"),
        scr.state_color(F.col("market_state")).alias("state_color")))


@register("segmented_states", o.with_ctes(
    o.label_ctes(), f"""SELECT universe, date, {o.rnd('risk_score', D, 'risk_score')},
  {o.rnd('risk_momentum', D, 'risk_momentum')}, market_state, y FROM labelled"""))
def q_segmented_states(spark: SparkSession, sf: str) -> DataFrame:
    """SC-1 ... SC-7 and SC-10 over segments, from the raw tables on."""
    made = scr.compute_scores(frames.features(spark, sf, segment_rows=SEGMENT_ROWS), K, SEGMENT_ROWS)
    made = scr.classify_state(made, K, segment_rows=SEGMENT_ROWS)
    made = scr.crisis_label(made, K, segment_rows=SEGMENT_ROWS)
    return frames.round_doubles(made.select(*K, "date", "risk_score", "risk_momentum", "market_state", "y"))


@register("crisis_labels", o.with_ctes(
    o.label_ctes(), f"""SELECT universe, date, y,
  CASE market_state WHEN 'Stable' THEN 0 WHEN 'Low Risk' THEN 1 WHEN 'Stress' THEN 2
    WHEN 'Crisis' THEN 3 WHEN 'Recovery' THEN 4 END AS state_code
FROM labelled"""))
def q_crisis_labels(spark: SparkSession, sf: str) -> DataFrame:
    """SC-10 (3-row-ahead crisis label, tail dropped) and SC-11 (state code)."""
    df = scr.crisis_label(states_frame(spark, sf), K)
    return df.select(*K, "date", "y", scr.state_code(F.col("market_state")).alias("state_code"))


def _latest_sql() -> str:
    return """latest AS (
  SELECT universe, arg_max(date, date) AS date, arg_max(risk_score, date) AS risk_score,
         arg_max(market_state, date) AS market_state,
         arg_max(risk_velocity, date) AS risk_velocity,
         arg_max(risk_momentum, date) AS risk_momentum
  FROM states GROUP BY 1)"""


def _transition_values_sql() -> str:
    """Fixed values, written out apart from the Spark module: probability of the
    next state, columns Stable, Low Risk, Stress, Crisis, Recovery."""
    names = ["Stable", "Low Risk", "Stress", "Crisis", "Recovery"]
    table = """
        0.90 0.08 0.02 0.00 0.00
        0.15 0.70 0.13 0.02 0.00
        0.05 0.15 0.55 0.20 0.05
        0.00 0.05 0.30 0.45 0.20
        0.10 0.35 0.35 0.05 0.15"""
    rows = ", ".join(f"('{a}', '{b}', CAST({p} AS DOUBLE))"
                     for a, line in zip(names, table.split("\n")[1:]) for b, p in zip(names, line.split()))
    return f"tm AS (SELECT * FROM (VALUES {rows}) t(from_state, to_state, prob))"


@register("next_state_probs", o.with_ctes(
    o.state_ctes() + [_latest_sql(), _transition_values_sql()],
    f"""SELECT l.universe, l.market_state AS from_state, t.to_state,
  CAST(t.prob AS DOUBLE) AS prob
FROM latest l JOIN tm t ON t.from_state = l.market_state"""))
def q_next_state_probs(spark: SparkSession, sf: str) -> DataFrame:
    """SC-12 + JN-9: next-state distribution for each universe's latest state."""
    latest = latest_snapshot(states_frame(spark, sf))
    out = scr.next_state_probs(latest, scr.transition_table(spark))
    return out.select(*K, "from_state", "to_state", "prob")


def latest_snapshot(states: DataFrame) -> DataFrame:
    """ST-10: latest row per universe by ``max_by`` (one pass, no sort)."""
    cols = ["risk_score", "market_state", "risk_velocity", "risk_momentum"]
    return states.groupBy(*K).agg(F.max("date").alias("date"),
                                  *[F.max_by(c, "date").alias(c) for c in cols])


@register("latest_snapshot", o.with_ctes(
    o.state_ctes() + [_latest_sql(), _transition_values_sql()],
    f"""SELECT l.universe, l.date, {_round_sql(['risk_score', 'risk_velocity', 'risk_momentum'])},
  l.market_state,
  CASE l.market_state WHEN 'Stable' THEN '#00c853' WHEN 'Low Risk' THEN '#76ff03'
    WHEN 'Stress' THEN '#ffab00' WHEN 'Crisis' THEN '#d50000' WHEN 'Recovery' THEN '#00b8d4'
    ELSE '#9e9e9e' END AS state_color,
  round(least(greatest(100 - 1.05 * l.risk_score, 0), 98), 0) AS crisis_prob,
  round(coalesce((SELECT sum(prob) FROM tm WHERE tm.from_state = coalesce(
      (SELECT DISTINCT from_state FROM tm WHERE from_state = l.market_state), 'Stress')
      AND tm.to_state IN ('Stable', 'Low Risk', 'Recovery')), 0) * 100, 0) AS recovery_chance
FROM latest l"""))
def q_latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """ST-10 / SC-9 / SC-13 / SC-14: latest score, state, colour, crisis
    probability and recovery chance per universe."""
    latest = latest_snapshot(states_frame(spark, sf))
    latest = latest.select(*K, "date", "risk_score", "risk_velocity", "risk_momentum",
                           "market_state",
                           scr.state_color(F.col("market_state")).alias("state_color"),
                           scr.crisis_probability(F.col("risk_score")).alias("crisis_prob"))
    out = scr.recovery_chance(latest, scr.transition_table(spark), K)
    return frames.round_doubles(out)


@register("estimated_transitions", o.with_ctes(
    o.state_ctes(), f"""SELECT universe, from_state, to_state, n,
  {o.rnd('n / sum(n) OVER (PARTITION BY universe, from_state)', D, 'prob')}
FROM (SELECT universe, from_state, to_state, count(*) AS n FROM (
  SELECT universe, market_state AS from_state,
         lead(market_state) OVER (PARTITION BY universe ORDER BY date) AS to_state
  FROM states) WHERE to_state IS NOT NULL GROUP BY 1, 2, 3)"""))
def q_estimated_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """SC-12 (estimated from data): empirical next-state frequencies."""
    return frames.round_doubles(scr.estimated_transitions(states_frame(spark, sf), K))


# --------------------------------------------------------------------------
# Catalogue, alignment, volume
# --------------------------------------------------------------------------

@register("symbol_catalogue", o.with_ctes(
    o.base_ctes() + o.symbol_ctes() + [
        "cat AS (SELECT r_name AS symbol, 'stock' AS role FROM region UNION ALL "
        "SELECT * FROM (VALUES ('sector', 'index'), ('market', 'index'), ('fear', 'index'), "
        "('fx', 'index')) t(symbol, role))"],
    f"""SELECT p.universe, p.symbol, c.role, count(*) AS n_days, {o.rnd('avg(p.close)', D, 'avg_close')}
FROM prices p LEFT JOIN cat c ON c.symbol = p.symbol GROUP BY 1, 2, 3"""))
def q_symbol_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """IO-3: prices summarised per symbol, with the role of the symbol
    catalogue (NULL for a symbol it lacks)."""
    p = panels.prices_panel(spark, sf).groupBy(*K, "symbol").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("close").alias("avg_close"))
    out = p.join(panels.symbol_catalogue(spark, sf), "symbol", "left")
    return frames.round_doubles(out.select(*K, "symbol", "role", "n_days", "avg_close"))


@register("aligned_panel", o.with_ctes(
    o.base_ctes() + o.symbol_ctes(),
    f"""SELECT p.universe, p.date, r.symbol, {o.rnd('p.sector', D, 'sector')},
  {o.rnd('p.market', D, 'market')}, {o.rnd('r.ret', D, 'ret')}
FROM panel p JOIN sret r ON r.universe = p.universe AND r.date = p.date
WHERE r.ret IS NOT NULL"""))
def q_aligned_panel(spark: SparkSession, sf: str) -> DataFrame:
    """JN-2 / JN-3: index panel and symbol returns on their common dates
    (inner equi-join on universe and date)."""
    daily = frames.daily_orders(spark, sf)
    panel = panels.index_panel(spark, sf, daily=daily)
    rets = frames.symbol_returns(spark, sf, panel, daily).where(F.col("ret").isNotNull())
    out = panel.join(rets, [*K, "date"]).select(*K, "date", "symbol", "sector", "market", "ret")
    return frames.round_doubles(out)


@register("volume_stress", o.with_ctes(
    o.base_ctes() + o.calendar_ctes(),
    f"""SELECT universe, date, {o.rnd('z', D, 'vol_zscore')},
  CASE WHEN z > 2 THEN 1 ELSE 0 END AS vol_spike
FROM (SELECT universe, date,
  {o._gate('(volume - avg(volume) OVER ' + o._w('universe', -19) + ') / (stddev_samp(volume) OVER '
           + o._w('universe', -19) + ' + 1e-9)', 'volume', 'universe', 20)} AS z FROM cal)"""))
def q_volume_stress(spark: SparkSession, sf: str) -> DataFrame:
    """WF-8: volume z-score and spike flag of the sector index on the common calendar."""
    cal = fe.common_calendar(frames.index_panel(spark, sf), K)
    out = fe.volume_stress(cal, "volume", K)
    return frames.round_doubles(out.select(*K, "date", "vol_zscore", "vol_spike"))
