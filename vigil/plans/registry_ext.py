"""Registers the evaluation, stock, detector and export queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import evaluation as ev
from vigil.operators import features as fe
from vigil.operators import scoring as scr
from vigil.plans import frames
from vigil.plans import oracle as o
from vigil.plans.catalog import K, REGISTRY, register, states_frame
from vigil.plans.params import EVAL_THRESHOLD, HORIZON, SPLIT_DATE, STATIC_MODEL
from vigil.sources import panels

T = EVAL_THRESHOLD

# --------------------------------------------------------------------------
# Prediction table of the rule-based model (ML-9 + PF-12 split)
# --------------------------------------------------------------------------


def labelled_frame(spark: SparkSession, sf: str, threshold: float = T) -> DataFrame:
    """States + crisis label y at ``threshold`` (tail rows dropped)."""
    return scr.crisis_label(states_frame(spark, sf), K, threshold=threshold, horizon=HORIZON)


def split_frame(spark: SparkSession, sf: str) -> DataFrame:
    return ev.chrono_split(labelled_frame(spark, sf), SPLIT_DATE, K)


def static_predictions(spark: SparkSession, sf: str, data: DataFrame | None = None) -> DataFrame:
    data = data if data is not None else split_frame(spark, sf)
    test = data.where(F.col("part") == "test")
    pred, proba = ev.static_threshold(F.col("risk_score"), T)
    p = test.select(F.lit(STATIC_MODEL).alias("model"), *K, "date", "y",
                    pred.alias("pred"), proba.alias("proba"))
    return ev.with_positions(p)


def report_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The prediction table, checkpointed once before a report fans out into
    several metric branches (each branch would otherwise replay the whole
    feature lineage)."""
    from vigil.session import cut_lineage
    return cut_lineage(static_predictions(spark, sf))


def pred_ctes() -> list[str]:
    d = f"DATE '{SPLIT_DATE}'"
    return o.label_ctes(threshold=T, horizon=HORIZON) + [
        f"""cut AS (
  SELECT universe, arg_min(date, abs(date_diff('day', {d}, date)) * 2
                                 + CASE WHEN date < {d} THEN 1 ELSE 0 END) AS split_at
  FROM labelled GROUP BY 1)""",
        f"""preds AS (
  SELECT '{STATIC_MODEL}' AS model, l.universe, l.date,
         row_number() OVER (PARTITION BY l.universe ORDER BY l.date) - 1 AS pos, l.y,
         CASE WHEN l.risk_score < {T} THEN 1 ELSE 0 END AS pred,
         least(greatest(({T} - coalesce(l.risk_score, 50.0)) / {T}, 0), 1) AS proba
  FROM labelled l JOIN cut c ON l.universe = c.universe WHERE l.date >= c.split_at)""",
    ]


@register("static_predictions", o.with_ctes(
    pred_ctes(), f"SELECT model, universe, date, pos, y, pred, {o.rnd('proba', 6, 'proba')} "
                 "FROM preds"))
def q_static_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """ML-9 + PF-12 + PF-14: rule-based predictions on the test part."""
    return frames.round_doubles(static_predictions(spark, sf))


@register("train_test_split", o.with_ctes(
    o.label_ctes(threshold=T, horizon=HORIZON) + pred_ctes()[-2:-1],
    """SELECT l.universe, CASE WHEN l.date < c.split_at THEN 'train' ELSE 'test' END AS part,
  count(*) AS n_rows, CAST(sum(l.y) AS BIGINT) AS n_pos, min(l.date) AS first_date, max(l.date) AS last_date
FROM labelled l JOIN cut c ON l.universe = c.universe GROUP BY 1, 2"""))
def q_train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    """PF-12 / EV-15: chronological split at the nearest row to the split
    date, with row and positive counts per part."""
    s = split_frame(spark, sf)
    return s.groupBy(*K, "part").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.sum("y").cast("long").alias("n_pos"),
                                     F.min("date").alias("first_date"),
                                     F.max("date").alias("last_date"))


# --------------------------------------------------------------------------
# Evaluation queries
# --------------------------------------------------------------------------

CLS_SQL = """cls AS (
  SELECT model, universe,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
    round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
    n_test, round(rate * 100, 2) AS crisis_rate_pct
  FROM (SELECT model, universe,
          count_if(pred = 1 AND y = 1) AS tp, count_if(pred = 1 AND y = 0) AS fp,
          count_if(pred = 0 AND y = 1) AS fn, count(pred) AS n_test,
          avg(CASE WHEN pred IS NOT NULL THEN y END) AS rate
        FROM preds GROUP BY 1, 2))"""

# AUC by brute force over positive x negative pairs (independent of the
# running-sum form used on the Spark side); AP over distinct thresholds.
RANK_SQL = """pp AS (SELECT * FROM preds WHERE pred IS NOT NULL AND proba IS NOT NULL),
cnt AS (SELECT model, universe, count_if(y = 1) AS pos_total, count_if(y = 0) AS neg_total
        FROM pp GROUP BY 1, 2),
auc AS (
  SELECT a.model, a.universe,
         sum(CASE WHEN a.proba > b.proba THEN 1.0 WHEN a.proba = b.proba THEN 0.5 ELSE 0 END)
           AS s
  FROM pp a JOIN pp b ON a.model = b.model AND a.universe = b.universe
   AND a.y = 1 AND b.y = 0
  GROUP BY 1, 2),
grp AS (
  SELECT model, universe, proba, count_if(y = 1) AS p, count_if(y = 0) AS n
  FROM pp GROUP BY 1, 2, 3),
cum AS (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp
  FROM grp WINDOW w AS (PARTITION BY model, universe ORDER BY proba DESC
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap AS (SELECT model, universe, sum(p * tp / (tp + fp)) AS s FROM cum GROUP BY 1, 2),
rank_m AS (
  SELECT c.model, c.universe,
    CASE WHEN c.pos_total + c.neg_total > 10 AND c.pos_total > 0 AND c.neg_total > 0
         THEN round(coalesce(auc.s, 0) / (c.pos_total * c.neg_total), 4) END AS roc_auc,
    CASE WHEN c.pos_total + c.neg_total > 10 AND c.pos_total > 0 AND c.neg_total > 0
         THEN round(ap.s / c.pos_total, 4) END AS avg_precision
  FROM cnt c LEFT JOIN auc ON auc.model = c.model AND auc.universe = c.universe
  LEFT JOIN ap ON ap.model = c.model AND ap.universe = c.universe)"""


@register("classification_metrics", o.with_ctes(
    pred_ctes() + [CLS_SQL, RANK_SQL],
    """SELECT cls.*, r.roc_auc, r.avg_precision FROM cls
LEFT JOIN rank_m r ON r.model = cls.model AND r.universe = cls.universe"""))
def q_classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """EV-1 + EV-2: precision, recall, F1, n, crisis rate, ROC-AUC, AP."""
    return ev.classification_metrics(report_predictions(spark, sf))


CURVE_SQL = """SELECT model, universe, round(proba, 6) AS threshold, tp, fp,
  {extra}
FROM (SELECT *, sum(p) OVER (PARTITION BY model, universe) AS pos_total,
             sum(n) OVER (PARTITION BY model, universe) AS neg_total FROM cum)"""


@register("pr_curve", o.with_ctes(
    pred_ctes() + [RANK_SQL],
    CURVE_SQL.format(extra="round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, "
                           "round(coalesce(tp / nullif(pos_total, 0), 1), 6) AS recall")))
def q_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    """EV-3: precision-recall curve, one point per distinct threshold."""
    return frames.round_doubles(ev.pr_curve(static_predictions(spark, sf)))


@register("roc_curve", o.with_ctes(
    pred_ctes() + [RANK_SQL],
    "SELECT model, universe, round(proba, 6) AS threshold, round(fp / nullif(neg_total, 0), 6) AS fpr, "
    "round(tp / nullif(pos_total, 0), 6) AS tpr FROM (SELECT *, sum(p) OVER (PARTITION BY model, "
    "universe) AS pos_total, sum(n) OVER (PARTITION BY model, universe) AS neg_total FROM cum)"))
def q_roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    """EV-4: ROC curve, one point per distinct threshold."""
    return frames.round_doubles(ev.roc_curve(static_predictions(spark, sf)))


@register("best_threshold", o.with_ctes(
    pred_ctes() + [RANK_SQL],
    """SELECT model, universe, round(arg_max(proba, (f, -proba)), 6) AS threshold, round(max(f), 6) AS best_f1
FROM (SELECT *, 2 * pr * rc / (pr + rc + 1e-9) AS f FROM (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(pos_total, 0), 1) AS rc
  FROM (SELECT *, sum(p) OVER (PARTITION BY model, universe) AS pos_total FROM cum)))
GROUP BY 1, 2"""))
def q_best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """ML-16: the first best-F1 threshold on the PR curve."""
    return frames.round_doubles(ev.best_f1_threshold(static_predictions(spark, sf)))


EPISODE_SQL = """lab1 AS (SELECT DISTINCT universe, pos, y FROM preds),
st0 AS (
  SELECT *, CASE WHEN y = 1 AND coalesce(lag(y) OVER (PARTITION BY universe ORDER BY pos), 0) <> 1
                 THEN 1 ELSE 0 END AS st
  FROM lab1),
runs0 AS (
  SELECT *, sum(st) OVER (PARTITION BY universe ORDER BY pos
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM st0),
runs AS (SELECT universe, run, min(pos) AS s, max(pos) AS e FROM runs0 WHERE y = 1 GROUP BY 1, 2),
runs1 AS (
  SELECT *, CASE WHEN lag(e) OVER (PARTITION BY universe ORDER BY s) IS NULL
                   OR s - lag(e) OVER (PARTITION BY universe ORDER BY s) >= 5 THEN 1 ELSE 0 END
              AS new_ep
  FROM runs),
runs2 AS (
  SELECT *, sum(new_ep) OVER (PARTITION BY universe ORDER BY s
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ep_id
  FROM runs1),
eps AS (SELECT universe, ep_id, min(s) AS start_pos, max(e) AS end_pos FROM runs2 GROUP BY 1, 2)"""


@register("crisis_episodes", o.with_ctes(pred_ctes() + [EPISODE_SQL],
                                         "SELECT universe, ep_id, start_pos, end_pos FROM eps"))
def q_crisis_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """EV-5: label episodes (runs of 1, merged when < 5 rows apart)."""
    p = static_predictions(spark, sf)
    return ev.crisis_episodes(p.select("universe", "pos", "y"), K)


# Brute-force range match for the oracle: every alert inside the window.
DELAY_SQL = """nrows AS (SELECT model, universe, count(*) AS n FROM preds GROUP BY 1, 2),
ep_first AS (
  SELECT p.model, e.universe, e.ep_id, e.start_pos,
         min(CASE WHEN p.pred = 1 AND p.pos >= greatest(e.start_pos - 10, 0)
                   AND p.pos < least(nr.n, e.end_pos + 5) THEN p.pos END) - e.start_pos AS delay
  FROM eps e JOIN preds p ON p.universe = e.universe
  JOIN nrows nr ON nr.model = p.model AND nr.universe = p.universe
  GROUP BY 1, 2, 3, 4),
dd AS (
  SELECT s.model, s.universe, coalesce(x.n_ep, 0) AS n_episodes, coalesce(x.det, 0) AS detected,
    coalesce(x.n_ep, 0) - coalesce(x.det, 0) AS missed,
    round(coalesce(x.det, 0) / greatest(coalesce(x.n_ep, 0), 1), 4) AS event_detection_rate,
    (round(x.avg_d, 2) + 0.0) AS avg_delay_days,
    round(coalesce(x.early, 0) / greatest(coalesce(x.n_ep, 0), 1), 4) AS early_warning_pct
  FROM (SELECT DISTINCT model, universe FROM preds) s
  LEFT JOIN (SELECT model, universe, count(*) AS n_ep, count(delay) AS det, avg(delay) AS avg_d,
                    count_if(delay < 0) AS early FROM ep_first GROUP BY 1, 2) x
    ON x.model = s.model AND x.universe = s.universe)"""


@register("detection_delay", o.with_ctes(pred_ctes() + [EPISODE_SQL, DELAY_SQL],
                                         "SELECT * FROM dd"))
def q_detection_delay(spark: SparkSession, sf: str) -> DataFrame:
    """EV-6: detection rate and delay of alerts against label episodes."""
    p = report_predictions(spark, sf)
    eps = ev.crisis_episodes(p.select("universe", "pos", "y").distinct(), K)
    return ev.detection_delay(p, eps)


FALSE_SQL = """fa AS (
  SELECT s.model, s.universe, coalesce(x.total, 0) AS total_alerts,
    coalesce(x.tru, 0) AS true_alarms, coalesce(x.total, 0) - coalesce(x.tru, 0) AS false_alarms,
    round((coalesce(x.total, 0) - coalesce(x.tru, 0)) / greatest(coalesce(x.total, 0), 1), 4)
      AS false_alarm_rate,
    round(coalesce(x.tru, 0) / greatest(coalesce(x.total, 0), 1), 4) AS precision_at_window
  FROM (SELECT DISTINCT model, universe FROM preds) s
  LEFT JOIN (
    SELECT model, universe, count(*) AS total, count_if(fut > 0) AS tru FROM (
      SELECT *, max(y) OVER (PARTITION BY model, universe ORDER BY pos
                             ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS fut FROM preds)
    WHERE pred = 1 GROUP BY 1, 2) x ON x.model = s.model AND x.universe = s.universe)"""


@register("false_alarms", o.with_ctes(pred_ctes() + [FALSE_SQL], "SELECT * FROM fa"))
def q_false_alarms(spark: SparkSession, sf: str) -> DataFrame:
    """EV-7: alerts with / without a labelled crisis in the next 5 rows."""
    return ev.false_alarms(static_predictions(spark, sf))


STAB_SQL = """stab AS (
  SELECT model, universe,
    CASE WHEN count(*) < 2 THEN CAST(1.0 AS DOUBLE) ELSE round(1 - avg(flip), 4) END
      AS stability_score
  FROM (SELECT *, CAST(pred <> lag(pred) OVER (PARTITION BY model, universe ORDER BY pos)
                       AS DOUBLE) AS flip FROM preds WHERE pred IS NOT NULL)
  GROUP BY 1, 2)"""


@register("stability", o.with_ctes(pred_ctes() + [STAB_SQL], "SELECT * FROM stab"))
def q_stability(spark: SparkSession, sf: str) -> DataFrame:
    """EV-9: 1 - share of prediction flips."""
    return ev.stability(static_predictions(spark, sf))


@register("transition_accuracy", o.with_ctes(
    o.state_ctes(),
    f"""SELECT universe,
  round(tp / greatest(tp + fp, 1), 4) AS transition_precision,
  round(tp / greatest(tp + fn, 1), 4) AS transition_recall,
  round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1))
        / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-9), 4)
    AS transition_f1,
  CAST(nt AS BIGINT) AS n_true_transitions, CAST(np AS BIGINT) AS n_pred_transitions
FROM (SELECT universe, count_if(t = 1 AND p = 1) AS tp, count_if(t = 0 AND p = 1) AS fp,
        count_if(t = 1 AND p = 0) AS fn, sum(t) AS nt, sum(p) AS np
      FROM (SELECT universe,
              CAST(market_state <> lag(market_state) OVER w AS INTEGER) AS t,
              CAST(s8 <> lag(s8) OVER w AS INTEGER) AS p
            FROM (SELECT *, {o.state_sql('round(risk_score, 1)')} AS s8 FROM states)
            WINDOW w AS (PARTITION BY universe ORDER BY date))
      WHERE t IS NOT NULL GROUP BY 1)"""))
def q_transition_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """EV-8: change points of the stateless map (SC-8) against the states
    with Recovery (SC-7)."""
    s = states_frame(spark, sf).withColumn("simple_state",
                                           scr.state_of(F.round("risk_score", 1)))
    return ev.transition_accuracy(s, "market_state", "simple_state", K)


EVAL_SQL = [CLS_SQL, RANK_SQL, EPISODE_SQL, DELAY_SQL, FALSE_SQL, STAB_SQL]
COMPARE_SELECT = """SELECT c.model, c.universe, c.precision, c.recall, c.f1, r.roc_auc,
  d.event_detection_rate, d.avg_delay_days, f.false_alarm_rate, s.stability_score
FROM cls c
LEFT JOIN rank_m r ON r.model = c.model AND r.universe = c.universe
LEFT JOIN dd d ON d.model = c.model AND d.universe = c.universe
LEFT JOIN fa f ON f.model = c.model AND f.universe = c.universe
LEFT JOIN stab s ON s.model = c.model AND s.universe = c.universe"""


@register("model_comparison", o.with_ctes(pred_ctes() + EVAL_SQL, COMPARE_SELECT))
def q_model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """EV-10 + EV-11: the comparison table (rule-based model)."""
    return ev.compare_models(ev.evaluate_models(report_predictions(spark, sf)))


@register("best_model", o.with_ctes(
    pred_ctes() + [CLS_SQL],
    """SELECT universe, arg_min(model, (-f1, model)) AS model, max(f1) AS f1
FROM cls GROUP BY 1"""))
def q_best_model(spark: SparkSession, sf: str) -> DataFrame:
    """EV-14: best model by F1 per universe."""
    return ev.best_model(ev.classification_metrics(report_predictions(spark, sf)))


@register("state_distribution", o.with_ctes(
    o.label_ctes(threshold=T, horizon=HORIZON),
    """SELECT universe, market_state, count(*) AS n_days, round(avg(y), 6) AS crisis_rate
FROM labelled GROUP BY 1, 2"""))
def q_state_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """EV-15: state counts and crisis-label rate per state."""
    lab = labelled_frame(spark, sf)
    return frames.round_doubles(lab.groupBy(*K, "market_state").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("y").alias("crisis_rate")))


@register("fraction_split", o.with_ctes(
    o.label_ctes(threshold=T, horizon=HORIZON),
    """SELECT universe, CASE WHEN r <= floor(n * 0.15) THEN 'train' ELSE 'test' END AS part,
  count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
FROM (SELECT universe, date, row_number() OVER (PARTITION BY universe ORDER BY date) AS r,
             count(*) OVER (PARTITION BY universe) AS n FROM labelled) GROUP BY 1, 2"""))
def q_fraction_split(spark: SparkSession, sf: str) -> DataFrame:
    """PF-12 without a split date: the first 15 % of each series' rows train."""
    s = ev.chrono_split(labelled_frame(spark, sf), None, K)
    return s.groupBy(*K, "part").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
                                     F.max("date").alias("last_date"))


@register("detection_timeline", o.with_ctes(
    pred_ctes(),
    f"""SELECT p.universe, p.date, {o.rnd('l.risk_score', 6, 'risk_score')}, p.y,
  p.pred AS static_threshold
FROM preds p JOIN labelled l ON l.universe = p.universe AND l.date = p.date"""))
def q_detection_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """EV-12: the table behind the detection timeline: score, truth and one
    alert column per model (the rule-based one)."""
    from vigil.session import cut_lineage
    data = cut_lineage(split_frame(spark, sf))
    return frames.round_doubles(ev.alert_timeline(static_predictions(spark, sf, data), data, [STATIC_MODEL]))


# --------------------------------------------------------------------------
# Per-stock analysis
# --------------------------------------------------------------------------

from vigil.operators import stocks as stk  # noqa: E402
from vigil.plans.catalog import scores_frame  # noqa: E402


def stock_table(spark: SparkSession, sf: str, include_index: bool = False,
                window: int = 20, scores: DataFrame | None = None,
                daily: DataFrame | None = None) -> DataFrame:
    """ST-8 on the feature calendar: symbol returns (missing -> 0), index
    return and the latest market score of each universe."""
    daily = daily if daily is not None else frames.daily_orders(spark, sf)
    scores = scores if scores is not None else scores_frame(spark, sf, daily=daily)
    cal = scores.select(*K, "date", F.col("bank_ret").alias("index_ret"))
    market = scores.groupBy(*K).agg(F.max_by("risk_score", "date").alias("market_score"))
    rets = frames.symbol_returns(spark, sf, daily=daily)
    aligned = stk.align_returns(rets, cal, K, include_index=include_index)
    return stk.score_all_stocks(aligned, market, K, window)


def stock_sql(include_index: bool = False) -> str:
    sq = o._dbl(252 ** 0.5)
    idx = ("UNION ALL SELECT universe, 'INDEX' AS symbol, date, coalesce(index_ret, 0), "
           "coalesce(index_ret, 0) FROM cal_f" if include_index else "")
    clip = lambda e, lo, hi: f"CASE WHEN ({e}) IS NOT NULL THEN least(greatest({e}, {lo}), {hi}) END"
    score = (f"market_score - {clip('greatest(0, ann_vol - 0.25) * 50', 0, 20)}"
             f" - greatest(0, beta - 1.1) * 10 - {clip('abs(max_dd) * 50', 0, 20)}"
             f" - greatest(0, corr - 0.7) * 10 + {clip('sharpe * 2', -10, 10)}"
             f" + {clip('mom * 50', -10, 10)}")
    reasons = f"""list_filter([
        CASE WHEN ann_vol > 0.25 THEN printf('{stk.REASON_VOL}', ann_vol * 100) END,
        CASE WHEN beta > 1.2 THEN printf('{stk.REASON_BETA}', beta) END,
        CASE WHEN max_dd < -0.10 THEN printf('{stk.REASON_DD}', max_dd * 100, 20) END,
        CASE WHEN corr > 0.85 THEN '{stk.REASON_CORR}' END,
        CASE WHEN mom < 0 THEN '{stk.REASON_MOM}' END], lambda x: x IS NOT NULL)"""
    ok = "n_rows >= 25"
    body = f"""cal_f AS (SELECT universe, date, bank_ret AS index_ret FROM scores),
sgrid AS (
  SELECT c.universe, s.symbol, c.date, coalesce(r.ret, 0) AS ret,
         coalesce(c.index_ret, 0) AS index_ret
  FROM cal_f c JOIN (SELECT DISTINCT universe, symbol FROM sret) s ON s.universe = c.universe
  LEFT JOIN sret r ON r.universe = c.universe AND r.symbol = s.symbol AND r.date = c.date
  {idx}),
sl AS (SELECT *, row_number() OVER (PARTITION BY universe, symbol ORDER BY date) AS rn,
              count(*) OVER (PARTITION BY universe, symbol) AS n FROM sgrid),
sl2 AS (SELECT *, sum(ret) OVER (PARTITION BY universe, symbol ORDER BY date
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
        FROM sl WHERE rn > n - 20),
sl3 AS (SELECT *, cum - max(cum) OVER (PARTITION BY universe, symbol ORDER BY date
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap
        FROM sl2),
ss AS (SELECT universe, symbol, any_value(n) AS n_rows, avg(ret) * 252 AS ann_ret,
              stddev_samp(ret) * {sq} AS ann_vol, covar_samp(ret, index_ret) AS cv,
              var_samp(index_ret) AS vr, stddev_samp(ret) AS sr, stddev_samp(index_ret) AS si,
              sum(ret) AS mom, min(gap) AS max_dd
       FROM sl3 GROUP BY 1, 2),
mk AS (SELECT universe, arg_max(risk_score, date) AS market_score FROM scores GROUP BY 1),
st AS (SELECT ss.*, ann_ret / (ann_vol + 1e-9) AS sharpe, cv / (vr + 1e-9) AS beta,
              cv / nullif(sr * si, 0) AS corr, mk.market_score
       FROM ss JOIN mk ON mk.universe = ss.universe),
st2 AS (SELECT *, {clip(score, 0, 100)} AS score, {reasons} AS rs FROM st),
st3 AS (SELECT *,
    CASE WHEN score >= 70 AND market_score >= 50 THEN 'BUY' WHEN score >= 45 THEN 'HOLD'
         ELSE 'AVOID' END AS rec FROM st2)
SELECT universe, symbol, CASE WHEN NOT ({ok}) THEN 'insufficient data' END AS error,
  CASE WHEN {ok} THEN round(score, 1) + 0.0 END AS stock_score,
  CASE WHEN {ok} THEN rec END AS recommendation,
  CASE WHEN {ok} THEN CASE WHEN rec = 'BUY' THEN CASE WHEN score >= 80 THEN 'HIGH'
       ELSE 'MODERATE' END WHEN rec = 'HOLD' THEN 'MODERATE'
       WHEN score < 25 THEN 'HIGH' ELSE 'MODERATE' END END AS confidence,
  CASE WHEN {ok} THEN round(ann_ret * 100, 2) + 0.0 END AS ann_return,
  CASE WHEN {ok} THEN round(ann_vol * 100, 2) + 0.0 END AS ann_volatility,
  CASE WHEN {ok} THEN round(sharpe, 2) + 0.0 END AS sharpe,
  CASE WHEN {ok} THEN round(beta, 2) + 0.0 END AS beta,
  CASE WHEN {ok} THEN round(max_dd * 100, 2) + 0.0 END AS max_drawdown_pct,
  CASE WHEN {ok} THEN round(mom * 100, 2) + 0.0 END AS momentum,
  CASE WHEN {ok} THEN round(corr, 3) + 0.0 END AS corr_with_index,
  CASE WHEN {ok} THEN CASE WHEN len(rs) > 0 THEN rs ELSE ['{stk.REASON_NONE}'] END END
    AS reasons,
  row_number() OVER (PARTITION BY universe ORDER BY CASE WHEN {ok} THEN round(score, 1) END
                     DESC NULLS LAST, symbol) AS rank
FROM st3"""
    ctes = o.score_ctes()  # already holds the symbol CTEs
    return "WITH " + ",\n".join(ctes) + ",\n" + body


@register("stock_analysis", stock_sql())
def q_stock_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """ST-1 ... ST-8: per-symbol score, BUY / HOLD / AVOID, confidence,
    rounded figures, reasons and rank."""
    return stock_table(spark, sf)


@register("stock_analysis_with_index", stock_sql(include_index=True))
def q_stock_analysis_idx(spark: SparkSession, sf: str) -> DataFrame:
    """ST-9: the same with the sector index ranked as one more asset."""
    return stock_table(spark, sf, include_index=True)


# --------------------------------------------------------------------------
# Detectors (rows-only checks: iterative fits have no SQL form)
# --------------------------------------------------------------------------

from vigil.operators import detectors as det  # noqa: E402
from vigil.session import cut_lineage  # noqa: E402


def scr_columns() -> list[str]:
    return ["stability_score", "volume_score", "network_score", "external_score", "risk_score",
            "risk_velocity", "risk_momentum"]


def detector_input(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled features + scores with the train / test part, checkpointed to
    the shared checkpoint folder: model fits scan their input many times and
    must not replay the whole feature lineage on each pass (or on the loss
    of an executor)."""
    return cut_lineage(split_frame(spark, sf))


def _preds(df: DataFrame) -> DataFrame:
    return frames.round_doubles(ev.with_positions(df))


@register("logistic_predictions", None)
def q_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """ML-1 + ML-2: scaled, class-balanced logistic regression (6 columns)."""
    preds, _ = det.logistic(detector_input(spark, sf))
    return _preds(preds)


@register("logistic_all_columns_predictions", None)
def q_logistic_all(spark: SparkSession, sf: str) -> DataFrame:
    """ML-3: unscaled logistic regression on all feature and score columns, cut 0.55."""
    data = detector_input(spark, sf)
    skip = {"universe", "date", "y", "part", "market_state", "bank_ret", "mkt_ret"}
    cols = [c for c, t in data.dtypes if c not in skip and t in ("double", "int", "bigint")]
    preds, _ = det.logistic(data, cols, scale=False, max_iter=1000, cut=0.55,
                            model="Logistic (all columns)")
    return _preds(preds)


@register("forest_predictions", None)
def q_forest(spark: SparkSession, sf: str) -> DataFrame:
    """ML-4: balanced random forest, 200 trees of depth 8."""
    preds, _, _ = det.random_forest(detector_input(spark, sf))
    return _preds(preds)


@register("forest_importances", None)
def q_forest_importances(spark: SparkSession, sf: str) -> DataFrame:
    """ML-5 + EV-13: top-15 feature importances of the forest."""
    _, _, imp = det.random_forest(detector_input(spark, sf))
    return frames.round_doubles(det.top_importances(imp, 15))


@register("walk_forward_folds", o.with_ctes(
    o.label_ctes(threshold=T, horizon=HORIZON) + [
        """cal_n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k
  FROM (SELECT DISTINCT date FROM labelled))"""],
    """SELECT l.universe, l.date, CAST((k - 252) // 252 AS INTEGER) AS fold,
  lead(l.date, 3) OVER (PARTITION BY l.universe ORDER BY l.date) AS label_end
FROM labelled l JOIN cal_n c ON c.date = l.date QUALIFY k >= 252"""))
def q_walk_forward_folds(spark: SparkSession, sf: str) -> DataFrame:
    """ML-6: which fold tests each row, and up to which day its label looks."""
    rows, _ = det.fold_rows(labelled_frame(spark, sf), 252, 252, HORIZON)
    return rows.where(F.col("fold").isNotNull()).select(*K, "date", "fold", "label_end")


@register("walk_forward_predictions", None)
def q_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """ML-6: yearly back-test folds, each refitted on the previous 500 days."""
    return _preds(det.walk_forward(detector_input(spark, sf)))


SEQUENCE_AT_HAND = [c for c in det.SEQUENCE_COLUMNS if c in (*scr_columns(), *fe.FEATURE_COLUMNS)]


@register("sequence_windows", o.with_ctes(
    o.label_ctes(threshold=T, horizon=HORIZON) + [
        "num AS (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY date) AS i FROM labelled)"],
    f"""SELECT t.universe, t.date, t.y, CAST(p.i - t.i + 11 AS INTEGER) AS step,
  {', '.join(o.rnd(f'coalesce(p.{c}, 0)', 6, c) for c in SEQUENCE_AT_HAND)}
FROM num t JOIN num p ON p.universe = t.universe AND p.i BETWEEN t.i - 10 AND t.i - 1 WHERE t.i > 10"""))
def q_sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    """ML-14: 10 previous rows of the sequence inputs per (universe, date), a
    row per step; rows without a whole history have none."""
    data = detector_input(spark, sf)
    cols = det.pick_columns(data, det.SEQUENCE_COLUMNS, 8)
    seq = det.sequences(det.filled(data, cols), cols)
    steps = seq.select("universe", "date", "y", F.posexplode("seq").alias("at", "v"))
    return frames.round_doubles(steps.select("universe", "date", "y", (F.col("at") + 1).alias("step"),
                                             *[F.col("v")[i].alias(c) for i, c in enumerate(cols)]))


@register("oversampled_training", o.with_ctes(
    o.label_ctes(threshold=T, horizon=HORIZON) + pred_ctes()[-2:-1],
    """SELECT l.universe, l.y, CAST(sum(CASE WHEN l.y = 1 THEN 11 ELSE 1 END) AS BIGINT) AS n_rows
FROM labelled l JOIN cut c ON l.universe = c.universe WHERE l.date < c.split_at GROUP BY 1, 2"""))
def q_oversampled(spark: SparkSession, sf: str) -> DataFrame:
    """PF-13: training rows with each positive repeated 11 times."""
    train = detector_input(spark, sf).where(F.col("part") == "train")
    return det.oversample(train).groupBy("universe", "y").agg(F.count(F.lit(1)).alias("n_rows"))


@register("sequence_predictions", None)
def q_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """ML-15 + ML-16: perceptron on 10-row histories, best-F1 cut from training rows."""
    preds, _, _ = det.sequence_perceptron(detector_input(spark, sf))
    return _preds(preds)


@register("regime_predictions", None)
def q_regime(spark: SparkSession, sf: str) -> DataFrame:
    """ML-10 ... ML-13 + ML-16: 2-state regime model on the binarised score."""
    preds, _, _ = det.regime_model(detector_input(spark, sf), binarise_below=T + 2.0)
    return _preds(preds)


@register("regime_states", None)
def q_regime_states(spark: SparkSession, sf: str) -> DataFrame:
    """ML-11 / ML-13: regime states labelled by ascending mean score, crisis state flagged."""
    _, states, _ = det.regime_model(detector_input(spark, sf), n_states=3, binarise_below=None)
    return frames.round_doubles(states)


@register("regime_state_sweep", None)
def q_regime_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """ML-17: best F1 of the regime model for 2 and 3 states."""
    return frames.round_doubles(det.state_count_sweep(detector_input(spark, sf),
                                                     binarise_below=T + 2.0))


@register("isolation_predictions", None)
def q_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """ML-7 + ML-8: isolation forest, 200 trees, contamination 0.1."""
    preds, _ = det.isolation_forest(detector_input(spark, sf))
    return _preds(preds)


def all_predictions(spark: SparkSession, sf: str, forest_trees: int = 200,
                    data: DataFrame | None = None) -> DataFrame:
    data = data if data is not None else detector_input(spark, sf)
    parts = [static_predictions(spark, sf, data).drop("pos"),
             det.logistic(data, cols=None)[0],
             det.random_forest(data, n_trees=forest_trees)[0],
             det.isolation_forest(data)[0],
             det.regime_model(data, binarise_below=T + 2.0)[0],
             det.sequence_perceptron(data)[0]]
    out = parts[0].select(*det.OUT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*det.OUT))
    from vigil.session import cut_lineage
    return cut_lineage(ev.with_positions(out))


@register("detection_timeline_all", None)
def q_detection_timeline_all(spark: SparkSession, sf: str) -> DataFrame:
    """EV-12 for every detector at hand: one alert column each."""
    data = detector_input(spark, sf)
    preds = all_predictions(spark, sf, forest_trees=50, data=data)
    models = sorted(r["model"] for r in preds.select("model").distinct().collect())
    return frames.round_doubles(ev.alert_timeline(preds, data, models))


@register("detector_comparison", None)
def q_detector_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """EV-10 / EV-11 over every detector: the model comparison table."""
    return ev.compare_models(ev.evaluate_models(all_predictions(spark, sf)))


# --------------------------------------------------------------------------
# Export shaping and sinks
# --------------------------------------------------------------------------

from vigil.operators import export as exp  # noqa: E402
from vigil.sources import files  # noqa: E402


def _dec(x: str, d: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {d}) AS DOUBLE)"


TIMELINE_SQL = f"""tl AS (
  SELECT universe, date, strftime(date, '%b %d') AS label, {_dec('risk_score', 1)} AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY date DESC) AS r FROM scores)
  WHERE r <= 90)"""


@register("dashboard_timeline", o.with_ctes(
    o.score_ctes() + [TIMELINE_SQL],
    f"SELECT universe, date, label, score, {o.state_sql('score')} AS state FROM tl"))
def q_dashboard_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """EX-4 / EX-5 / SC-8: last 90 rows, 'MMM dd' labels, 1-decimal scores, states."""
    return exp.timeline(scores_frame(spark, sf))


SNAP_COMPS = ["stability_score", "volume_score", "network_score", "external_score"]


@register("dashboard_snapshot", o.with_ctes(
    o.score_ctes() + [
        f"""sn AS (
  SELECT *, {_dec('risk_score', 1)} AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY universe ORDER BY date DESC) AS r FROM scores)
  WHERE r <= 90)""",
        """sn2 AS (
  SELECT *, lag(s) OVER (PARTITION BY universe ORDER BY date) AS prev,
            lag(s, 5) OVER (PARTITION BY universe ORDER BY date) AS back5 FROM sn)""",
        """fxl AS (SELECT universe, arg_max(fx, date) AS fx FROM panel WHERE fx IS NOT NULL
            GROUP BY 1)"""],
    f"""SELECT a.universe, a.date, a.latest_score, {o.state_sql('a.latest_score')} AS latest_state,
  a.prev_score, {_dec('a.latest_score - a.prev_score', 2)} AS velocity,
  {_dec('a.mom5', 2)} AS momentum5,
  {', '.join(f'{o.rnd("a." + c, 6, c)}' for c in SNAP_COMPS)},
  {_dec('coalesce(a.vix, 15.0)', 2)} AS vix, {_dec('coalesce(f.fx, 83.0)', 2)} AS usd_inr
FROM (SELECT universe, max(date) AS date, arg_max(s, date) AS latest_score,
        arg_max(coalesce(prev, s), date) AS prev_score,
        arg_max(coalesce(s - back5, 0), date) AS mom5, arg_max(vix_level, date) AS vix,
        {', '.join(f'arg_max({c}, date) AS {c}' for c in SNAP_COMPS)}
      FROM sn2 GROUP BY 1) a LEFT JOIN fxl f ON f.universe = a.universe"""))
def q_dashboard_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """EX-6 / EX-7: latest, previous, velocity, 5-row momentum, components,
    fear and fx levels per universe."""
    snap = exp.snapshot(scores_frame(spark, sf), frames.index_panel(spark, sf))
    return frames.round_doubles(snap)


@register("stocks_export", "WITH " + stock_sql().split("WITH ", 1)[1].replace(
    "\nSELECT universe, symbol, CASE WHEN NOT", "\n, sa AS (SELECT universe, symbol, CASE WHEN NOT", 1)
    + f""")
SELECT universe, symbol AS name, symbol AS ticker,
  CAST(round_even(CAST(stock_score AS DECIMAL(38,10)), 0) AS BIGINT) AS score,
  recommendation AS rec, confidence AS conf, {_dec('ann_volatility', 1)} AS vol,
  {_dec('beta', 2)} AS beta, {_dec('sharpe', 2)} AS sharpe, {_dec('momentum', 1)} AS mom,
  -abs({_dec('max_drawdown_pct', 1)}) AS dd, {_dec('coalesce(corr_with_index, 0.85)', 2)} AS corr,
  reasons
FROM sa""")
def q_stocks_export(spark: SparkSession, sf: str) -> DataFrame:
    """EX-2: stock records of the dashboard document."""
    return exp.stocks_payload(stock_table(spark, sf))


@register("dashboard_document", None)
def q_dashboard_document(spark: SparkSession, sf: str) -> DataFrame:
    """EX-1 / EX-8 / EX-9: the nested document per universe (rule-based
    model results, stocks, ordered timeline arrays, snapshot, macro data)."""
    from vigil.session import cut_lineage
    daily = frames.daily_orders(spark, sf)
    scores = cut_lineage(scores_frame(spark, sf, daily=daily))
    tl = exp.timeline(scores)
    snap = exp.snapshot(scores, panels.index_panel(spark, sf, daily=daily))
    stocks = exp.stocks_payload(stock_table(spark, sf, scores=scores, daily=daily))
    made = scr.crisis_label(scr.classify_state(scores, K), K, threshold=T, horizon=HORIZON)
    preds = static_predictions(spark, sf, ev.chrono_split(made, SPLIT_DATE, K))
    models = exp.models_payload(ev.compare_models(ev.evaluate_models(cut_lineage(preds))))
    return exp.document(tl, snap, stocks, models)


@register("comparison_csv_roundtrip", REGISTRY["model_comparison"][1])
def q_comparison_csv(spark: SparkSession, sf: str) -> DataFrame:
    """IO-6 + IO-8: write the comparison table as CSV, read it back with its schema."""
    cmp_df = ev.compare_models(ev.evaluate_models(report_predictions(spark, sf)))
    path = files.output_dir(spark, "model_comparison_csv")
    files.write_table(cmp_df.select(*[f.name for f in files.COMPARISON_SCHEMA.fields]),
                      path, "csv")
    return files.read_comparison_csv(spark, path)


@register("stock_csv_roundtrip", "WITH " + stock_sql().split("WITH ", 1)[1].replace(
    "\nSELECT universe, symbol, CASE WHEN NOT", "\n, sa AS (SELECT universe, symbol, CASE WHEN NOT", 1)
    + ")\nSELECT universe, symbol, recommendation, reasons FROM sa")
def q_stock_csv(spark: SparkSession, sf: str) -> DataFrame:
    """IO-7 + EX-3: stock table to CSV (reasons as JSON text), parsed back."""
    path = files.output_dir(spark, "stock_analysis_csv")
    files.write_table(stock_table(spark, sf), path, "csv")
    back = spark.read.option("header", True).csv(path)
    return back.select("universe", "symbol", "recommendation",
                       exp.parse_reasons(F.col("reasons")).alias("reasons"))


@register("features_parquet_roundtrip", REGISTRY["market_features"][1])
def q_features_parquet(spark: SparkSession, sf: str) -> DataFrame:
    """IO-4 / IO-5: the feature matrix written as Parquet partitioned by
    universe and read back."""
    path = files.output_dir(spark, "features_parquet")
    made = REGISTRY["market_features"][0](spark, sf)
    files.write_table(made, path, "parquet", partition_by=["universe"])
    return spark.read.parquet(path).select(*made.columns)


@register("prices_file_source", f"""SELECT * FROM ({REGISTRY["prices_panel"][1]})
WHERE date >= DATE '1996-01-01' AND date < DATE '2001-01-01'""")
def q_prices_files(spark: SparkSession, sf: str) -> DataFrame:
    """IO-1: landed price files read with an explicit schema and a date range."""
    path = files.output_dir(spark, "prices_parquet")
    files.write_table(frames.round_doubles(panels_prices(spark, sf)), path, "parquet")
    return files.read_prices(spark, path, start="1996-01-01", end="2001-01-01")


def land_prices(spark: SparkSession, sf: str) -> str:
    """A folder as vendors leave it: two batches of CSV files per symbol, then a
    correction of every 15th of a month, an empty file, a file with a header
    only, and one with rows that do not parse."""
    import uuid
    root = files.output_dir(spark, f"landed_{uuid.uuid4().hex}")
    made = cut_lineage(frames.round_doubles(panels_prices(spark, sf)).select(
        "universe", "symbol", *[f.name for f in files.LANDED_SCHEMA.fields]))
    early = F.col("date") < F.to_date(F.lit("1995-01-01"))
    fixed = made.where(F.dayofmonth("date") == 15).withColumn("close", F.col("close") + 1)
    wrong = made.where(F.dayofmonth("date") == 15).withColumn("close", F.lit(-1.0))
    for batch, part in (("1", made.where(early)), ("1b", made.where(~early)), ("0", wrong), ("2", fixed)):
        part.write.partitionBy("universe", "symbol").option("header", True).csv(f"{root}/batch={batch}")
    text = lambda lines, where: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(
        f"{root}/batch=3/universe=LATE/symbol={where}")
    head = "Date,Open,High,Low,Close,Volume"
    text([head], "HEADER ONLY")
    text([head, "1996-02-30,1,2,1,2,5", "1996-03-01,1,x,1,2,5", "1996-03-02,1,2,1,2,5", ",1,2,1,2,5"], "BROKEN")
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{root}/batch=3/universe=LATE/symbol=EMPTY")
    return root


LANDED_SQL = f"""landed AS (
  SELECT * REPLACE (close + CASE WHEN day(date) = 15 THEN 1 ELSE 0 END AS close)
  FROM ({REGISTRY["prices_panel"][1]})
  UNION ALL BY NAME SELECT 'LATE' AS universe, 'BROKEN' AS symbol, DATE '1996-03-02' AS date, 1.0::DOUBLE AS open,
    2.0::DOUBLE AS high, 1.0::DOUBLE AS low, 2.0::DOUBLE AS close, 5.0::DOUBLE AS volume)"""


@register("landed_prices", f"""WITH {LANDED_SQL} SELECT * FROM landed
WHERE date >= DATE '1994-06-01' AND date < DATE '2001-01-01'""")
def q_landed_prices(spark: SparkSession, sf: str) -> DataFrame:
    """IO-1: landed files per symbol, later batches over earlier ones, a date range."""
    return files.read_landed(spark, land_prices(spark, sf), start="1994-06-01", end="2001-01-01").rows


@register("landed_report", f"""WITH {LANDED_SQL}
SELECT universe, symbol, count(*) AS n_rows, CASE WHEN universe = 'LATE' THEN 3 ELSE 0 END::BIGINT AS n_bad
FROM landed GROUP BY 1, 2
UNION ALL SELECT 'LATE', x, 0, 0 FROM (VALUES ('HEADER ONLY'), ('EMPTY')) t(x)""")
def q_landed_report(spark: SparkSession, sf: str) -> DataFrame:
    """IO-1 / IO-2: rows and rows set aside per symbol of the catalogue; those
    without any file or row are named, not missed."""
    late = spark.createDataFrame([("LATE", s) for s in ("BROKEN", "HEADER ONLY", "EMPTY")], "universe string, symbol string")
    known = panels_prices(spark, sf).select("universe", "symbol").distinct().unionByName(late)
    got = files.read_landed(spark, land_prices(spark, sf), known)
    n = got.rows.groupBy("universe", "symbol").agg(F.count("*").alias("n_rows"))
    bad = got.quarantine.groupBy("universe", "symbol").agg(F.count("*").alias("n_bad"))
    n = n.unionByName(got.skipped.withColumn("n_rows", F.lit(0).cast("long")))
    return n.join(bad, [*K, "symbol"], "left").fillna(0, ["n_bad"])


@register("landed_panel", f"""WITH {LANDED_SQL}, wide AS (
  SELECT universe, date, {', '.join(f"any_value(close) FILTER (symbol = '{s}') AS {s.lower().replace(' ', '_')}"
                                    for s in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))}
  FROM landed GROUP BY 1, 2)
SELECT * FROM wide WHERE coalesce(africa, america, asia, europe, middle_east) IS NOT NULL""")
def q_landed_panel(spark: SparkSession, sf: str) -> DataFrame:
    """IO-2: closes of the known symbols side by side, from landed files."""
    from vigil.sources.tables import read_table
    names = sorted(r["r_name"] for r in read_table(spark, sf, "region", ["r_name"]).collect())
    wide = files.landed_panel(files.read_landed(spark, land_prices(spark, sf)).rows, names)
    return wide.toDF(*[c.lower().replace(" ", "_") for c in wide.columns])


@register("panel_csv_roundtrip", REGISTRY["index_panel"][1])
def q_panel_csv(spark: SparkSession, sf: str) -> DataFrame:
    """IO-4: the raw index panel written as CSV and read back with its schema."""
    made = REGISTRY["index_panel"][0](spark, sf)
    path = files.output_dir(spark, "panel_csv")
    files.write_table(made, path, "csv")
    return spark.read.schema(made.schema).option("header", True).csv(path)


@register("index_returns", o.with_ctes(o.base_ctes(), "SELECT universe, date, " + ", ".join(
    o.rnd(f"""ln(CASE WHEN {c} IS NOT NULL THEN {c} END / nullif(last_value({c} IGNORE NULLS) OVER (
      PARTITION BY universe ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))""", 6, f"{c}_ret")
    for c in ("sector", "market", "fear", "fx")) + " FROM panel"))
def q_index_returns(spark: SparkSession, sf: str) -> DataFrame:
    """WF-1 for all four index series, each over its own non-null rows."""
    df = frames.index_panel(spark, sf)
    for c in ("sector", "market", "fear", "fx"):
        df = fe.log_returns(df, c, K, f"{c}_ret")
    return frames.round_doubles(df.select(*K, "date", *[f"{c}_ret" for c in ("sector", "market", "fear", "fx")]))


def panels_prices(spark: SparkSession, sf: str) -> DataFrame:
    return panels.prices_panel(spark, sf).select(*[f.name for f in files.PRICE_SCHEMA.fields])


@register("sweep_append", None)
def q_sweep_append(spark: SparkSession, sf: str) -> DataFrame:
    """IO-10: sweep results appended to a table (fresh folder per call)."""
    import uuid
    path = files.output_dir(spark, f"sweep_{uuid.uuid4().hex}")
    data = detector_input(spark, sf)
    for counts in ((2,), (3,), (2,)):  # the third run repeats the first
        files.append_rows(det.state_count_sweep(data, counts, binarise_below=T + 2.0), path, f"k={counts[0]}")
    return frames.round_doubles(spark.read.parquet(path).drop("run"))


@register("model_persistence", o.with_ctes(pred_ctes(), """SELECT m.model, p.universe, count(*) AS n_rows,
  count(*) AS n_same FROM preds p, (VALUES ('Logistic'), ('Logistic (unscaled)'), ('Random Forest'), ('Sequence MLP'),
  ('Isolation Forest')) m(model) GROUP BY 1, 2"""))
def q_model_persistence(spark: SparkSession, sf: str) -> DataFrame:
    """IO-11: every detector saved, loaded and asked again: test rows per model
    and series, and those predicted exactly as by the detector that was saved."""
    from pyspark.ml import PipelineModel

    from vigil.operators.isolation import IsolationForest
    data = detector_input(spark, sf)
    made = [det.logistic(data)[:2], det.logistic(data, scale=False, cut=0.55, model="Logistic (unscaled)")[:2],
            det.random_forest(data, n_trees=20)[:2], det.sequence_perceptron(data, max_iter=60)[:2],
            det.isolation_forest(data, n_trees=50)]
    out = None
    for fresh, fitted in made:
        name = fresh.select("model").first()["model"]
        path = files.output_dir(spark, "model_" + "".join(c if c.isalnum() else "_" for c in name))
        if isinstance(fitted, IsolationForest):
            fitted.save(path)
            test = data.where(F.col("part") == "test")
            back = IsolationForest.load(spark, path).score(test, *K, "date")
            back = back.select(F.lit(name).alias("model"), *K, "date", "y", "pred", "proba")
        else:
            files.save_model(fitted, path)
            back = det.predictions(PipelineModel.load(path), data, name)
        both = back.join(fresh.select(*K, "date", F.col("pred").alias("saved_pred"),
                                      F.col("proba").alias("saved_proba")), [*K, "date"])
        same = F.col("pred").eqNullSafe(F.col("saved_pred")) & F.col("proba").eqNullSafe(F.col("saved_proba"))
        both = cut_lineage(both.groupBy("model", *K).agg(F.count(F.lit(1)).alias("n_rows"),
                                                         F.count(F.when(same, 1)).alias("n_same")))
        out = both if out is None else out.unionByName(both)
    return out


@register("dashboard_json", None)
def q_dashboard_json(spark: SparkSession, sf: str) -> DataFrame:
    """IO-9 / EX-9: the nested document written as JSON (one object per
    universe) and read back with its declared schema."""
    doc = q_dashboard_document(spark, sf)
    path = files.output_dir(spark, "dashboard_json")
    files.write_table(doc, path, "json")
    return spark.read.schema(doc.schema).json(path)
