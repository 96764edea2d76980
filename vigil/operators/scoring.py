"""Scores, states and labels (SC-1 ... SC-14).

All operators work on the cleaned feature matrix keyed by (universe, date)
and stay on the same ``partitionBy(universe).orderBy(date)`` layout as the
features. Per-series constants (min / max for the 0-100 scaling) are a grouped
aggregate, combined before the shuffle and joined back, so no task holds a
series. With ``segment_rows`` the running figures work on segments too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions import clip, flag, row_mean, safe_div, series_window
from vigil.operators import running as rn
from vigil.operators.decay import ewm_mean
from vigil.session import cut_lineage

# State bounds (score >= bound), component weights, colours and
# the rule-based transition matrix.
STABLE, LOW_RISK, STRESS = 80.0, 65.0, 40.0
STATE_CODES = {"Stable": 0, "Low Risk": 1, "Stress": 2, "Crisis": 3, "Recovery": 4}
COMPONENT_WEIGHTS = {"stability": 0.40, "volume": 0.20, "network": 0.20, "external": 0.20}
STATE_COLORS = {
    "Stable": "#00c853",
    "Low Risk": "#76ff03",
    "Stress": "#ffab00",
    "Crisis": "#d50000",
    "Recovery": "#00b8d4",
}
DEFAULT_COLOR = "#9e9e9e"
TRANSITION_MATRIX = {
    "Stable":   {"Stable": 0.90, "Low Risk": 0.08, "Stress": 0.02, "Crisis": 0.00, "Recovery": 0.00},
    "Low Risk": {"Stable": 0.15, "Low Risk": 0.70, "Stress": 0.13, "Crisis": 0.02, "Recovery": 0.00},
    "Stress":   {"Stable": 0.05, "Low Risk": 0.15, "Stress": 0.55, "Crisis": 0.20, "Recovery": 0.05},
    "Crisis":   {"Stable": 0.00, "Low Risk": 0.05, "Stress": 0.30, "Crisis": 0.45, "Recovery": 0.20},
    "Recovery": {"Stable": 0.10, "Low Risk": 0.35, "Stress": 0.35, "Crisis": 0.05, "Recovery": 0.15},
}


# --------------------------------------------------------------------------
# SC-1 ... SC-5 component scores
# --------------------------------------------------------------------------

def scale_columns(df: DataFrame, keys: Sequence[str],
                  wanted: dict[str, tuple[str, bool]]) -> DataFrame:
    """SC-1 for each ``name: (column, invert)``: min-max over the whole series
    x 100 (100 - that when inverted). A constant series scales to 0 (100
    inverted); NULL stays NULL, and so do rows whose series key is NULL."""
    if not wanted:
        return df
    ends = df.groupBy(*keys).agg(*[g(c).alias(f"_{e}_{n}") for n, (c, _) in wanted.items()
                                   for g, e in ((F.min, "lo"), (F.max, "hi"))])

    def unit(n: str, c: str, invert: bool) -> Column:
        lo, rng = F.col(f"_lo_{n}"), F.col(f"_hi_{n}") - F.col(f"_lo_{n}")
        u = F.when(F.col(c).isNotNull(), F.when(rng == 0, F.lit(0.0)).otherwise(safe_div(F.col(c) - lo, rng)))
        return ((F.lit(1.0) - u) if invert else u) * F.lit(100.0)

    df = df.join(ends, list(keys), "left")
    return df.withColumns({n: unit(n, c, inv) for n, (c, inv) in wanted.items()}).drop(
        *[f"_{e}_{n}" for n in wanted for e in ("lo", "hi")])


def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def component_scores(df: DataFrame, keys: Sequence[str] = ("universe",)) -> DataFrame:
    """SC-2 ... SC-5: stability, volume, network and external scores (0-100,
    higher = safer). Absent inputs are skipped; a component with no inputs
    is the constant 50."""
    keys = list(keys)
    known = [c for c in ("vol_20d", "ewma_vol", "vol_of_vol", "vix_level") if _has(df, c)]
    if rn.SEG in df.columns:
        df = rn.running(df, keys, {f"_kn_{c}": ("last", F.col(c)) for c in known}) if known else df
    else:
        unb = series_window(keys).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"_kn_{c}": F.last(c, ignorenulls=True).over(unb) for c in known})
    ffill = lambda c: F.col(f"_kn_{c}")
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    # (input name, prepared input, scaled?) per component
    parts: dict[str, list[tuple[str, Column, bool]]] = {
        "stability": [], "volume": [], "network": [], "external": []}
    for c in ("vol_20d", "ewma_vol", "vol_of_vol"):
        if _has(df, c):
            parts["stability"].append((c, ffill(c), True))
    for c in ("max_drawdown", "current_drawdown"):
        if _has(df, c):
            parts["stability"].append((c, zero(F.abs(F.col(c))), True))
    if _has(df, "underwater_dur"):
        parts["stability"].append(("underwater_dur",
                                   zero(F.col("underwater_dur").cast("double")), True))
    if _has(df, "vol_zscore"):
        parts["volume"].append(("vol_zscore", zero(F.abs(F.col("vol_zscore"))), True))
    if _has(df, "vol_spike"):
        parts["volume"].append(("vol_spike", F.lit(100.0) - F.coalesce(
            F.col("vol_spike"), F.lit(0)) * F.lit(30.0), False))
    for c in ("bank_market_corr", "cross_bank_corr"):
        if _has(df, c):
            parts["network"].append((c, F.abs(zero(F.col(c))), True))
    if _has(df, "corr_trend"):
        parts["network"].append(("corr_trend", zero(F.col("corr_trend")), True))
    if _has(df, "vix_level"):
        parts["external"].append(("vix_level", ffill("vix_level"), True))
    if _has(df, "vix_zscore"):
        parts["external"].append(("vix_zscore", zero(F.col("vix_zscore")), True))
    if _has(df, "vix_spike"):
        parts["external"].append(("vix_spike", F.lit(100.0) - F.coalesce(
            F.col("vix_spike"), F.lit(0)) * F.lit(30.0), False))
    if _has(df, "fx_zscore"):
        parts["external"].append(("fx_zscore", zero(F.col("fx_zscore")), True))

    prepared = {f"_in_{k}_{name}": expr for k, lst in parts.items() for name, expr, _ in lst}
    df = df.withColumns(prepared)
    df = scale_columns(df, keys, {f"_sc_{k}_{name}": (f"_in_{k}_{name}", True)
                                  for k, lst in parts.items() for name, _, sc in lst if sc})
    subs = {k: [F.col(f"_{'sc' if sc else 'in'}_{k}_{name}") for name, _, sc in lst] for k, lst in parts.items()}
    df = df.withColumns({
        "stability_score": row_mean(subs["stability"], 50.0),
        "volume_score": clip(row_mean(subs["volume"], 50.0), 0.0, 100.0),
        "network_score": row_mean(subs["network"], 50.0),
        "external_score": clip(row_mean(subs["external"], 50.0), 0.0, 100.0),
    })
    return df.drop(*prepared, *[c for c in df.columns if c.startswith(("_sc_", "_kn_"))])


def _lags(df: DataFrame, keys: list[str], lags: dict[str, tuple[str, int]], rows: int | None) -> DataFrame:
    """``name: (column, n)``: the value n rows back, over segments of a numbered frame."""
    if rn.SEG not in df.columns:
        spec = series_window(keys)
        return df.withColumns({n: F.lag(c, k).over(spec) for n, (c, k) in lags.items()})
    spec = series_window([*keys, rn.SEG])
    df = rn.with_halo(df, rows, max(k for _, k in lags.values()))
    return rn.without_halo(df.withColumns({n: F.lag(c, k).over(spec) for n, (c, k) in lags.items()}))


def risk_score(df: DataFrame, keys: Sequence[str] = ("universe",), span: float = 3,
               segment_rows: int | None = None) -> DataFrame:
    """SC-6: weighted composite, smoothed by an adjusted exponential mean of
    ``span`` over the whole history, then ``risk_velocity`` (1-row difference)
    and ``risk_momentum`` (5 rows)."""
    keys = list(keys)
    w = COMPONENT_WEIGHTS
    composite = (F.lit(w["stability"]) * F.col("stability_score")
                 + F.lit(w["volume"]) * F.col("volume_score")
                 + F.lit(w["network"]) * F.col("network_score")
                 + F.lit(w["external"]) * F.col("external_score"))
    df = ewm_mean(df.withColumn("_composite", composite), "_composite", keys, span,
                  "risk_score").drop("_composite")
    df = _lags(df, keys, {"_back1": ("risk_score", 1), "_back5": ("risk_score", 5)}, segment_rows)
    return df.withColumns({"risk_velocity": F.col("risk_score") - F.col("_back1"),
                           "risk_momentum": F.col("risk_score") - F.col("_back5")}).drop("_back1", "_back5")


def compute_scores(features: DataFrame, keys: Sequence[str] = ("universe",),
                   segment_rows: int | None = None) -> DataFrame:
    """SC-2 ... SC-6 in one go: features + the seven score columns. With
    ``segment_rows`` a series of any length is worked on in segments (the frame
    keeps its position and segment columns for :func:`classify_state`)."""
    keys = list(keys)
    if not segment_rows:
        return risk_score(component_scores(features, keys), keys)
    df = cut_lineage(rn.numbered(cut_lineage(features), keys, segment_rows))
    df = cut_lineage(component_scores(df, keys))
    return cut_lineage(risk_score(df, keys, segment_rows=segment_rows))


# --------------------------------------------------------------------------
# SC-7 ... SC-9 states
# --------------------------------------------------------------------------

def state_of(score: Column) -> Column:
    """SC-8: stateless map; NULL falls through to Crisis."""
    return (F.when(score >= STABLE, "Stable").when(score >= LOW_RISK, "Low Risk")
            .when(score >= STRESS, "Stress").otherwise("Crisis"))


def classify_state(df: DataFrame, keys: Sequence[str] = ("universe",), score: str = "risk_score",
                   window_recovery: int = 5, out: str = "market_state",
                   segment_rows: int | None = None) -> DataFrame:
    """SC-7: states with Recovery, without a sequential loop.

    A row is *rising* when it is in the Stress band and above the previous
    row. Islands start at every non-rising row (running count of non-rising
    rows). Inside an island that starts with a Crisis row (score < 40 or
    NULL), the rising rows from the ``window_recovery``-th on are Recovery.
    """
    keys = list(keys)
    s = F.col(score)
    df = _lags(df, keys, {"_prev": (score, 1)}, segment_rows)
    df = df.withColumn("_rising", F.coalesce((s >= STRESS) & (s < LOW_RISK) & (s > F.col("_prev")), F.lit(False)))
    # The island head is the last non-rising row; a struct keeps a NULL score.
    if rn.SEG in df.columns:
        at = F.col(rn.POS)
        heads = F.when(~F.col("_rising"), F.struct(s.alias("v"), at.alias("rn")))
        df = rn.running(cut_lineage(df), keys, {"_head": ("last", heads)})
    else:
        spec = series_window(keys)
        df, at = df.withColumn("_rn", F.row_number().over(spec)), F.col("_rn")
        heads = F.when(~F.col("_rising"), F.struct(s.alias("v"), at.alias("rn")))
        df = df.withColumn("_head", F.last(heads, ignorenulls=True).over(
            spec.rowsBetween(Window.unboundedPreceding, 0)))
    head_crisis = F.coalesce(F.col("_head.v") < STRESS, F.lit(True))
    depth = at - F.col("_head.rn")
    state = F.when(F.col("_rising") & head_crisis & (depth >= window_recovery), "Recovery") \
        .otherwise(state_of(s))
    return df.withColumn(out, state).drop("_prev", "_rising", "_rn", "_head")


def state_color(state: Column) -> Column:
    """SC-9: colour lookup with a grey default."""
    m = F.create_map(*[x for k, v in STATE_COLORS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[state], F.lit(DEFAULT_COLOR))


def state_code(state: Column) -> Column:
    """SC-11: state -> 0..4, unknown -> NULL."""
    m = F.create_map(*[x for k, v in STATE_CODES.items() for x in (F.lit(k), F.lit(v))])
    return m[state]


# --------------------------------------------------------------------------
# SC-10 labels
# --------------------------------------------------------------------------

def crisis_label(df: DataFrame, keys: Sequence[str] = ("universe",), score: str = "risk_score",
                 threshold: float = 40.0, horizon: int = 3, out: str = "y",
                 segment_rows: int | None = None) -> DataFrame:
    """SC-10: 1 if any of the next ``horizon`` rows is below ``threshold``;
    the last ``horizon`` rows of each series have no label and are dropped."""
    cut = rn.SEG in df.columns
    spec = series_window([*keys, rn.SEG] if cut else keys).rowsBetween(1, horizon)
    below = flag(F.col(score) < F.lit(threshold))
    df = rn.with_halo(df, segment_rows, 0, horizon) if cut else df
    df = df.withColumns({out: F.max(below).over(spec), "_n_next": F.count(F.lit(1)).over(spec)})
    df = rn.without_halo(df) if cut else df
    return df.where(F.col("_n_next") == horizon).drop("_n_next")


# --------------------------------------------------------------------------
# SC-12 ... SC-14 transitions and dashboard figures
# --------------------------------------------------------------------------

def transition_table(spark: SparkSession) -> DataFrame:
    """SC-12: the fixed 5 x 5 table as (from_state, to_state, prob)."""
    rows = [(a, b, p) for a, row in TRANSITION_MATRIX.items() for b, p in row.items()]
    return spark.createDataFrame(rows, "from_state string, to_state string, prob double")


def estimated_transitions(states: DataFrame, keys: Sequence[str] = ("universe",),
                          state: str = "market_state") -> DataFrame:
    """SC-12 (estimated): empirical next-state frequencies per universe."""
    spec = series_window(keys)
    pairs = (states.select(*keys, F.col(state).alias("from_state"),
                           F.lead(state).over(spec).alias("to_state"))
             .where(F.col("to_state").isNotNull()))
    counts = pairs.groupBy(*keys, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    tot = Window.partitionBy(*keys, "from_state")
    return counts.select(*keys, "from_state", "to_state", "n",
                         (F.col("n") / F.sum("n").over(tot)).alias("prob"))


def next_state_probs(latest: DataFrame, transitions: DataFrame,
                     state: str = "market_state") -> DataFrame:
    """JN-9: next-state distribution for each row's state (no rows for an
    unknown state). The transition table has at most 25 rows, so it is
    broadcast."""
    return latest.join(F.broadcast(transitions), latest[state] == transitions["from_state"])


def crisis_probability(score: Column) -> Column:
    """SC-13: round(clip(100 - 1.05 x score, 0, 98))."""
    return F.round(clip(F.lit(100.0) - F.lit(1.05) * score, 0.0, 98.0), 0)


def recovery_chance(latest: DataFrame, transitions: DataFrame, keys: Sequence[str] = ("universe",),
                    state: str = "market_state") -> DataFrame:
    """SC-14: sum of next Stable + Low Risk + Recovery probabilities, as a
    rounded percentage; an unknown state uses the Stress row."""
    known = F.broadcast(transitions.select("from_state").distinct())
    fixed = latest.join(known, latest[state] == known["from_state"], "left").select(
        *latest.columns, F.coalesce(F.col("from_state"), F.lit("Stress")).alias("_from"))
    good = transitions.where(F.col("to_state").isin("Stable", "Low Risk", "Recovery"))
    agg = good.groupBy("from_state").agg(F.sum("prob").alias("_good"))
    out = fixed.join(F.broadcast(agg), fixed["_from"] == agg["from_state"], "left")
    return out.select(*latest.columns,
                      F.round(F.coalesce(F.col("_good"), F.lit(0.0)) * F.lit(100.0), 0)
                      .alias("recovery_chance"))
