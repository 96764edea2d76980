"""Export shaping (EX-1 ... EX-9): nested documents built with struct /
collect_list per universe, written by the JSON sink. Arrays are ordered by
date with ``array_sort`` on (date, value) structs, never by a driver sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.scoring import state_of

# Defaults of the dashboard document.
DEFAULT_VIX = 15.0
DEFAULT_FX = 83.0
DEFAULT_CORR = 0.85


def dec_round(c: Column, digits: int) -> Column:
    """Round on the decimal value (half away from zero) and return DOUBLE,
    so a value printed as 34.55 rounds to 34.6 in every engine."""
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def last_rows(df: DataFrame, n: int = 90, keys: Sequence[str] = ("universe",)) -> DataFrame:
    """EX-4: the latest ``n`` rows of each series (a report window)."""
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def timeline(scores: DataFrame, n: int = 90, keys: Sequence[str] = ("universe",)) -> DataFrame:
    """EX-4 / EX-5 / SC-8: date label 'MMM dd', score to 1 decimal, stateless state."""
    last = last_rows(scores, n, keys)
    s1 = dec_round(F.col("risk_score"), 1)
    return last.select(*keys, "date", F.date_format("date", "MMM dd").alias("label"),
                       s1.alias("score"), state_of(s1).alias("state"))


def snapshot(scores: DataFrame, panel: DataFrame, n: int = 90,
             keys: Sequence[str] = ("universe",)) -> DataFrame:
    """EX-6 / EX-7: latest and previous rounded score, 1-row velocity and
    5-row momentum (within the last ``n`` rows), latest components, fear
    level and raw fx level with their defaults."""
    keys = list(keys)
    t = last_rows(scores, n, keys)
    w = Window.partitionBy(*keys).orderBy("date")
    s1 = dec_round(F.col("risk_score"), 1)
    t = t.withColumns({"_s": s1, "_prev": F.lag(s1, 1).over(w), "_back5": F.lag(s1, 5).over(w)})
    comps = ["stability_score", "volume_score", "network_score", "external_score"]
    vix = F.col("vix_level") if "vix_level" in t.columns else F.lit(None).cast("double")
    agg = t.groupBy(*keys).agg(
        F.max("date").alias("date"),
        F.max_by("_s", "date").alias("latest_score"),
        F.max_by(F.coalesce("_prev", "_s"), "date").alias("prev_score"),
        F.max_by(F.coalesce(F.col("_s") - F.col("_back5"), F.lit(0.0)), "date").alias("_mom5"),
        F.max_by(vix, "date").alias("_vix"),
        *[F.max_by(c, "date").alias(c) for c in comps])
    fx = panel.where(F.col("fx").isNotNull()).groupBy(*keys).agg(
        F.max_by("fx", "date").alias("_fx"))
    out = agg.join(fx, keys, "left")
    return out.select(
        *keys, "date", "latest_score", state_of(F.col("latest_score")).alias("latest_state"),
        "prev_score",
        dec_round(F.col("latest_score") - F.col("prev_score"), 2).alias("velocity"),
        dec_round(F.col("_mom5"), 2).alias("momentum5"),
        *comps,
        dec_round(F.coalesce("_vix", F.lit(DEFAULT_VIX)), 2).alias("vix"),
        dec_round(F.coalesce("_fx", F.lit(DEFAULT_FX)), 2).alias("usd_inr"))


def stocks_payload(stocks: DataFrame, keys: Sequence[str] = ("universe",)) -> DataFrame:
    """EX-2: the per-stock records of the document (renamed, rounded,
    drawdown as a negative number, correlation default 0.85)."""
    return stocks.select(
        *keys, F.col("symbol").alias("name"), F.col("symbol").alias("ticker"),
        F.bround(F.col("stock_score").cast("decimal(38,10)"), 0).cast("long").alias("score"),
        F.col("recommendation").alias("rec"), F.col("confidence").alias("conf"),
        dec_round(F.col("ann_volatility"), 1).alias("vol"),
        dec_round(F.col("beta"), 2).alias("beta"),
        dec_round(F.col("sharpe"), 2).alias("sharpe"),
        dec_round(F.col("momentum"), 1).alias("mom"),
        (-F.abs(dec_round(F.col("max_drawdown_pct"), 1))).alias("dd"),
        dec_round(F.coalesce(F.col("corr_with_index"), F.lit(DEFAULT_CORR)), 2).alias("corr"),
        F.col("reasons"))


def models_payload(comparison: DataFrame) -> DataFrame:
    """EX-1: model records (renamed, DOUBLE, delay / stability default 0)."""
    d = lambda c: F.col(c).cast("double")
    return comparison.select(
        "universe", F.col("model").alias("name"), d("precision").alias("prec"),
        d("recall").alias("recall"), d("f1").alias("f1"), d("roc_auc").alias("auc"),
        d("event_detection_rate").alias("evDetect"),
        F.coalesce(d("avg_delay_days"), F.lit(0.0)).alias("delay"),
        d("false_alarm_rate").alias("falseAlarm"),
        F.coalesce(d("stability_score"), F.lit(0.0)).alias("stability"))


def parse_reasons(text: Column) -> Column:
    """EX-3: a JSON list of strings back to ARRAY<STRING> (no ``eval``)."""
    return F.from_json(text, "array<string>")


def document(timeline_df: DataFrame, snap: DataFrame, stocks: DataFrame, models: DataFrame,
             keys: Sequence[str] = ("universe",)) -> DataFrame:
    """EX-8 / EX-9: one nested document per universe; stocks by falling score
    (then name), models by their columns in order. A document holds every
    symbol of its universe, so it grows with them."""
    keys = list(keys)
    tl = timeline_df.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("date", "label", "score", "state"))).alias("_tl"))
    tl = tl.select(*keys, F.struct(
        F.transform("_tl", lambda r: r["score"]).alias("scores"),
        F.transform("_tl", lambda r: r["state"]).alias("states"),
        F.transform("_tl", lambda r: r["label"]).alias("dates")).alias("timeline"))
    own = [c for c in stocks.columns if c not in keys]
    best = F.struct((-F.col("score")).alias("_order"), F.col("name").alias("_name"), F.struct(*own).alias("v"))
    st = stocks.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(best)), lambda r: r["v"]).alias("STOCKS"))
    md = models.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        *[c for c in models.columns if c not in keys]))).alias("MODEL_RESULTS"))
    s = snap.select(
        *keys, F.col("latest_score").alias("latestScore"),
        F.col("latest_state").alias("latestState"), F.col("prev_score").alias("prevScore"),
        "velocity", "momentum5",
        F.struct(F.col("stability_score").alias("stability"),
                 F.col("volume_score").alias("volume"),
                 F.col("network_score").alias("network"),
                 F.col("external_score").alias("external")).alias("components"),
        F.struct(F.col("vix"), F.lit(0).alias("vixDelta"), F.col("usd_inr").alias("usdInr"),
                 F.lit(0).alias("usdDelta")).alias("macroData"))
    return (s.join(tl, keys, "left").join(st, keys, "left").join(md, keys, "left"))
