"""Event-aware evaluation (EV-1 ... EV-15) and rule-based predictions.

Input is the long table ``predictions(model, universe, date, pos, y, pred,
proba)`` (NULL = no prediction); every metric groups by (model, universe),
so all models and series are scored by one job. Episode logic is
gaps-and-islands over windows; the alert-to-episode match is an equi-join on
a precomputed "next alert at or after this row" column, so no range join and
no alert x episode pairs are formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import clip, safe_div
from vigil.operators.running import running_sums
from vigil.session import cut_lineage

MK = ["model", "universe"]


def _w(keys: Sequence[str], order: str = "pos"):
    return Window.partitionBy(*keys).orderBy(order)


# --------------------------------------------------------------------------
# Split, rule-based model, prediction table
# --------------------------------------------------------------------------

def split_dates(df: DataFrame, split_date: str, keys: Sequence[str] = ("universe",)) -> DataFrame:
    """PF-12: per series, the row date nearest to ``split_date`` (a tie goes
    to the later date). One small row per series."""
    target = F.to_date(F.lit(split_date))
    dist = F.abs(F.datediff(F.col("date"), target))
    return df.groupBy(*keys).agg(
        F.min_by("date", F.struct(dist, -F.unix_date(F.col("date")))).alias("split_at"))


def chrono_split(df: DataFrame, split_date: str | None, keys: Sequence[str] = ("universe",),
                 fraction: float = 0.15) -> DataFrame:
    """Adds ``part`` = 'train' before the split row, 'test' from it on. Without a
    split date the first ``fraction`` of each series' rows (rounded down) train."""
    keys = list(keys)
    if split_date is None:
        rows = running_sums(cut_lineage(df), keys, F.unix_date("date"), {"_n": F.lit(1)}, {"_all": F.lit(1)})
        first = F.col("_n") <= F.floor(F.col("_all") * F.lit(fraction))
        return rows.withColumn("part", F.when(first, "train").otherwise("test")).drop("_n", "_all")
    cut = split_dates(df, split_date, keys)
    out = df.join(cut, keys)
    return out.withColumn("part", F.when(F.col("date") < F.col("split_at"), "train")
                          .otherwise("test")).drop("split_at")


def static_threshold(score: Column, threshold: float = 40.0) -> tuple[Column, Column]:
    """ML-9: pred = score < threshold; proba = clip((t - score) / t, 0, 1),
    a NULL score counting as 50."""
    pred = (score < F.lit(threshold)).cast("int")
    pred = F.coalesce(pred, F.lit(0))
    proba = clip((F.lit(threshold) - F.coalesce(score, F.lit(50.0))) / F.lit(threshold), 0.0, 1.0)
    return pred, proba


def with_positions(df: DataFrame, keys: Sequence[str] = MK) -> DataFrame:
    """0-based row position per (model, universe) series."""
    return df.withColumn("pos", F.row_number().over(_w(keys, "date")) - 1)


# --------------------------------------------------------------------------
# EV-1 / EV-2 classification metrics
# --------------------------------------------------------------------------

def classification_metrics(preds: DataFrame, min_rows: int = 10) -> DataFrame:
    """EV-1 + EV-2 per (model, universe): precision, recall, F1 (0 on empty
    denominators), n_test, crisis_rate_pct over rows with a prediction;
    ROC-AUC and average precision when more than ``min_rows`` rows have
    both a prediction and a probability and both classes occur."""
    has = F.col("pred").isNotNull()
    tp = F.count(F.when(has & (F.col("pred") == 1) & (F.col("y") == 1), 1))
    fp = F.count(F.when(has & (F.col("pred") == 1) & (F.col("y") == 0), 1))
    fn = F.count(F.when(has & (F.col("pred") == 0) & (F.col("y") == 1), 1))
    base = preds.groupBy(*MK).agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.count(F.when(has, 1)).alias("n_test"),
        F.avg(F.when(has, F.col("y"))).alias("_rate"))
    m = base.select(
        *MK,
        F.round(F.coalesce(safe_div(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), 4)
        .alias("precision"),
        F.round(F.coalesce(safe_div(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)), 4)
        .alias("recall"),
        F.round(F.coalesce(safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
                           F.lit(0.0)), 4).alias("f1"),
        "n_test",
        F.round(F.col("_rate") * F.lit(100.0), 2).alias("crisis_rate_pct"))
    return m.join(ranking_metrics(preds, min_rows), MK, "left")


def _score_groups(preds: DataFrame) -> DataFrame:
    """Counts of positives / negatives per distinct probability, with running
    sums in descending probability order (one row per threshold). The thresholds
    of a model are cut into slices by their order, so one very large model is
    summed by many tasks; they are written once, as three steps read them."""
    ok = F.col("pred").isNotNull() & F.col("proba").isNotNull()
    g = (preds.where(ok).groupBy(*MK, "proba")
         .agg(F.count(F.when(F.col("y") == 1, 1)).alias("p"),
              F.count(F.when(F.col("y") == 0, 1)).alias("n")))
    both = {"pos_total": F.col("p"), "neg_total": F.col("n")}
    return running_sums(cut_lineage(g), MK, -F.col("proba"), {"tp": F.col("p"), "fp": F.col("n")}, both)


def ranking_metrics(preds: DataFrame, min_rows: int = 10) -> DataFrame:
    """EV-2: ROC-AUC (ties count half) and average precision (sum of recall
    steps x precision), gated on size and on both classes being present."""
    g = _score_groups(preds)
    below_neg = F.col("neg_total") - F.col("fp")  # negatives with a strictly lower score
    auc_term = F.col("p") * (below_neg + F.col("n") / F.lit(2.0))
    ap_term = F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    agg = g.groupBy(*MK).agg(F.sum(auc_term).alias("_auc"), F.sum(ap_term).alias("_ap"),
                             F.first("pos_total").alias("_P"), F.first("neg_total").alias("_N"))
    ok = ((F.col("_P") + F.col("_N")) > min_rows) & (F.col("_P") > 0) & (F.col("_N") > 0)
    return agg.select(
        *MK,
        F.when(ok, F.round(F.col("_auc") / (F.col("_P") * F.col("_N")), 4)).alias("roc_auc"),
        F.when(ok, F.round(F.col("_ap") / F.col("_P"), 4)).alias("avg_precision"))


def pr_curve(preds: DataFrame) -> DataFrame:
    """EV-3: precision and recall at every distinct threshold."""
    g = _score_groups(preds)
    return g.select(*MK, F.col("proba").alias("threshold"), "tp", "fp",
                    F.coalesce(safe_div(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
                    .alias("precision"),
                    F.coalesce(safe_div(F.col("tp"), F.col("pos_total")), F.lit(1.0)).alias("recall"))


def roc_curve(preds: DataFrame) -> DataFrame:
    """EV-4: false- and true-positive rates at every distinct threshold."""
    g = _score_groups(preds)
    return g.select(*MK, F.col("proba").alias("threshold"),
                    safe_div(F.col("fp"), F.col("neg_total")).alias("fpr"),
                    safe_div(F.col("tp"), F.col("pos_total")).alias("tpr"))


def best_f1_threshold(preds: DataFrame) -> DataFrame:
    """ML-16: threshold of the first F1 maximum over the PR curve (F1 with a
    1e-9 guard, ties to the lowest threshold)."""
    c = pr_curve(preds)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")
                                                     + F.lit(1e-9))
    c = c.withColumn("f1", f1)
    return c.groupBy(*MK).agg(
        F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"),
        F.max("f1").alias("best_f1"))


# --------------------------------------------------------------------------
# EV-5 ... EV-9 time-aware metrics
# --------------------------------------------------------------------------

def crisis_episodes(labels: DataFrame, keys: Sequence[str] = ("universe",),
                    min_gap: int = 5) -> DataFrame:
    """EV-5: runs of y = 1 (by position), merged when the next run starts
    less than ``min_gap`` rows after the previous one ends.
    Output (keys..., ep_id, start_pos, end_pos)."""
    keys = list(keys)
    w = _w(keys)
    starts = F.when((F.col("y") == 1) & (F.coalesce(F.lag("y").over(w), F.lit(0)) != 1), 1) \
        .otherwise(0)
    runs = (labels.withColumn("_run", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .where(F.col("y") == 1)
            .groupBy(*keys, "_run").agg(F.min("pos").alias("s"), F.max("pos").alias("e")))
    rw = Window.partitionBy(*keys).orderBy("s")
    new_ep = F.when(F.lag("e").over(rw).isNull() | ((F.col("s") - F.lag("e").over(rw)) >= min_gap),
                    1).otherwise(0)
    runs = runs.withColumn("ep_id", F.sum(new_ep).over(rw.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "ep_id").agg(F.min("s").alias("start_pos"),
                                            F.max("e").alias("end_pos"))


def detection_delay(preds: DataFrame, episodes: DataFrame, before: int = 10,
                    after: int = 5) -> DataFrame:
    """EV-6 per (model, universe): the first alert in [start - before,
    end + after) of each episode, its delay to the start, and the summary
    (n_episodes, detected, missed, event_detection_rate, avg_delay_days,
    early_warning_pct = share of episodes alerted before they start).

    ``next_alert`` (first alert at or after each row) is a reverse running
    minimum, so each episode needs one equi-join row per model.
    """
    per_ep = episode_delays(preds, episodes, before, after)
    summary = per_ep.groupBy(*MK).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.count("delay").alias("detected"),
        F.round(F.avg("delay"), 2).alias("avg_delay_days"),
        F.count(F.when(F.col("delay") < 0, 1)).alias("_early"))
    series = preds.select(*MK).distinct()
    out = series.join(summary, MK, "left").fillna(0, ["n_episodes", "detected", "_early"])
    denom = F.greatest(F.col("n_episodes"), F.lit(1)).cast("double")
    return out.select(*MK, "n_episodes", "detected",
                      (F.col("n_episodes") - F.col("detected")).alias("missed"),
                      F.round(F.col("detected") / denom, 4).alias("event_detection_rate"),
                      "avg_delay_days",
                      F.round(F.col("_early") / denom, 4).alias("early_warning_pct"))


def episode_delays(preds: DataFrame, episodes: DataFrame, before: int = 10,
                   after: int = 5) -> DataFrame:
    """EV-6 detail: one row per (model, universe, episode) with its delay."""
    w = _w(MK).rowsBetween(0, Window.unboundedFollowing)
    p = preds.select(*MK, "pos",
                     F.min(F.when(F.col("pred") == 1, F.col("pos"))).over(w).alias("next_alert"),
                     F.count(F.lit(1)).over(Window.partitionBy(*MK)).alias("n_rows"))
    ep = episodes.select("universe", "ep_id", "start_pos", "end_pos",
                         F.greatest(F.col("start_pos") - before, F.lit(0)).alias("pos"))
    j = ep.join(p, ["universe", "pos"])
    win_end = F.least(F.col("n_rows"), F.col("end_pos") + after)
    return j.select(*MK, "ep_id", "start_pos", "end_pos",
                    F.when(F.col("next_alert") < win_end,
                           F.col("next_alert") - F.col("start_pos")).alias("delay"))


def false_alarms(preds: DataFrame, window: int = 5) -> DataFrame:
    """EV-7: an alert is true when any y = 1 in rows [i, i + window)."""
    w = _w(MK).rowsBetween(0, window - 1)
    a = preds.withColumn("_future", F.max("y").over(w)).where(F.col("pred") == 1)
    agg = a.groupBy(*MK).agg(F.count(F.lit(1)).alias("total_alerts"),
                             F.count(F.when(F.col("_future") > 0, 1)).alias("true_alarms"))
    series = preds.select(*MK).distinct()
    out = series.join(agg, MK, "left").fillna(0, ["total_alerts", "true_alarms"])
    denom = F.greatest(F.col("total_alerts"), F.lit(1)).cast("double")
    return out.select(*MK, "total_alerts", "true_alarms",
                      (F.col("total_alerts") - F.col("true_alarms")).alias("false_alarms"),
                      F.round((F.col("total_alerts") - F.col("true_alarms")) / denom, 4)
                      .alias("false_alarm_rate"),
                      F.round(F.col("true_alarms") / denom, 4).alias("precision_at_window"))


def stability(preds: DataFrame) -> DataFrame:
    """EV-9: 1 - share of flips between consecutive non-null predictions;
    1.0 for fewer than two predictions."""
    p = preds.where(F.col("pred").isNotNull())
    flip = (F.col("pred") != F.lag("pred").over(_w(MK))).cast("double")
    agg = p.withColumn("_flip", flip).groupBy(*MK).agg(F.count(F.lit(1)).alias("_n"),
                                                       F.avg("_flip").alias("_f"))
    series = preds.select(*MK).distinct()
    out = series.join(agg, MK, "left")
    return out.select(*MK, F.when(F.coalesce(F.col("_n"), F.lit(0)) < 2, F.lit(1.0))
                      .otherwise(F.round(F.lit(1.0) - F.col("_f"), 4)).alias("stability_score"))


def transition_accuracy(df: DataFrame, true_col: str, pred_col: str,
                        keys: Sequence[str] = ("universe",)) -> DataFrame:
    """EV-8: precision / recall / F1 of predicted change points against true
    ones (a change point: the state differs from the previous row; the first
    row is excluded)."""
    w = Window.partitionBy(*keys).orderBy("date")
    t = (F.col(true_col) != F.lag(true_col).over(w)).cast("int")
    p = (F.col(pred_col) != F.lag(pred_col).over(w)).cast("int")
    x = df.select(*keys, t.alias("t"), p.alias("p")).where(F.col("t").isNotNull())
    agg = x.groupBy(*keys).agg(
        F.count(F.when((F.col("t") == 1) & (F.col("p") == 1), 1)).alias("tp"),
        F.count(F.when((F.col("t") == 0) & (F.col("p") == 1), 1)).alias("fp"),
        F.count(F.when((F.col("t") == 1) & (F.col("p") == 0), 1)).alias("fn"),
        F.sum("t").alias("n_true_transitions"), F.sum("p").alias("n_pred_transitions"))
    prec = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)).cast("double")
    rec = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)).cast("double")
    agg = agg.withColumns({"_p": prec, "_r": rec})
    f1 = 2 * F.col("_p") * F.col("_r") / F.greatest(F.col("_p") + F.col("_r"), F.lit(1e-9))
    return agg.select(*keys, F.round("_p", 4).alias("transition_precision"),
                      F.round("_r", 4).alias("transition_recall"),
                      F.round(f1, 4).alias("transition_f1"),
                      "n_true_transitions", "n_pred_transitions")


def alert_timeline(preds: DataFrame, scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """EV-12: per (universe, date) the score, the truth and one alert column per
    model of ``models``, named after it; NULL where a model gave none."""
    names = {m: "".join(c if c.isalnum() else "_" for c in m.lower()).strip("_") for m in models}
    wide = preds.groupBy("universe", "date").agg(
        F.max("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(n) for m, n in names.items()])
    return wide.join(scores.select("universe", "date", "risk_score"), ["universe", "date"]).select(
        "universe", "date", "risk_score", "y", *names.values())


# --------------------------------------------------------------------------
# EV-10 ... EV-14 reports
# --------------------------------------------------------------------------

COMPARE_COLUMNS = ["precision", "recall", "f1", "roc_auc", "event_detection_rate",
                   "avg_delay_days", "false_alarm_rate", "stability_score"]


def evaluate_models(preds: DataFrame, labels_keys: Sequence[str] = ("universe",)) -> DataFrame:
    """EV-10: all metric groups joined per (model, universe)."""
    labels = preds.select("universe", "pos", "y").distinct()
    eps = crisis_episodes(labels, labels_keys)
    out = classification_metrics(preds)
    for part in (detection_delay(preds, eps), false_alarms(preds), stability(preds)):
        out = out.join(part, MK, "left")
    return out


def compare_models(evaluated: DataFrame) -> DataFrame:
    """EV-11: the 9-column comparison table, 4 decimals, missing -> NULL."""
    cols = [F.round(F.col(c).cast("double"), 4).alias(c) if c in evaluated.columns
            else F.lit(None).cast("double").alias(c) for c in COMPARE_COLUMNS]
    return evaluated.select(*MK, *cols)


def best_model(evaluated: DataFrame) -> DataFrame:
    """EV-14: model with the highest F1 per universe (ties: first model name)."""
    w = Window.partitionBy("universe").orderBy(F.col("f1").desc_nulls_last(), F.col("model"))
    return (evaluated.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("universe", "model", "f1"))
