"""Crisis detectors (ML-1 ... ML-17) on Spark ML and grouped pandas maps.

All detectors consume the labelled frame (features + scores + ``y`` +
``part``) and emit rows of the prediction table
``(model, universe, date, y, pred, proba)`` for the test part, so they are
scored by the same evaluation job. Models are fitted once on the training
rows of all series together (a pooled model); fitted parameters that are
needed in expressions (scaler moments, isolation offsets) are a handful of
numbers returned to the driver, never data rows.
"""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators import isolation
from vigil.operators.artefacts import Alert, FilledScaler, History
from vigil.session import checkpoint_dir, cut_lineage

# The input columns each detector prefers (absent ones skipped).
LOGISTIC_COLUMNS = ["risk_score", "risk_velocity", "vol_20d", "max_drawdown", "vix_level",
                    "bank_market_corr"]
FOREST_COLUMNS = [
    "risk_score", "risk_velocity", "risk_momentum",
    "stability_score", "volume_score", "network_score", "external_score",
    "vol_5d", "vol_10d", "vol_20d", "ewma_vol", "vol_of_vol",
    "max_drawdown", "current_drawdown", "underwater_dur",
    "vol_zscore", "bank_market_corr",
    "vix_level", "vix_zscore", "fx_zscore",
    "rsi", "roc_5d", "ma_spread",
    "cvar_5pct", "return_skew", "bank_beta",
]
ISOLATION_COLUMNS = ["vol_20d", "max_drawdown", "vol_zscore", "vix_level", "bank_market_corr"]
REGIME_COLUMNS = ["risk_score", "risk_velocity", "risk_momentum", "stability_score",
                  "external_score"]
SEQUENCE_COLUMNS = ["risk_score", "risk_velocity", "risk_momentum", "stability_score",
                    "volume_score", "network_score", "external_score", "vol_20d",
                    "max_drawdown", "vix_level", "bank_market_corr"]
REGIME_LABELS = ["Crisis", "Stress", "Low Risk", "Stable", "Recovery"]

OUT = ["model", "universe", "date", "y", "pred", "proba"]


def pick_columns(df: DataFrame, preferred: Sequence[str], fallback: int = 5) -> list[str]:
    """PF-9: the preferred columns present in ``df``, else its first columns."""
    cols = [c for c in preferred if c in df.columns]
    if cols:
        return cols
    skip = {"universe", "date", "y", "part", "model", "market_state"}
    return [c for c in df.columns if c not in skip][:fallback]


def filled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PF-7: NULL -> 0 on the model inputs (cast to DOUBLE)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})


# --------------------------------------------------------------------------
# ML-1 scaler with population sd
# --------------------------------------------------------------------------

def fit_scaler(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population sd per column from one aggregate (2 x k numbers)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = train.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        out[c] = (float(m or 0.0), float(s) if s else 1.0)  # constant column: scale 1
    return out


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


def balanced_weight(train: DataFrame, label: str = "y") -> Column:
    """n / (2 n_class) per row, from one grouped count."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .collect()}
    n = float(sum(counts.values()))
    k = max(len(counts), 1)
    expr = F.lit(1.0)
    for cls, cnt in counts.items():
        expr = F.when(F.col(label) == cls, F.lit(n / (k * cnt))).otherwise(expr)
    return expr


def scaler_stage(train: DataFrame, cols: Sequence[str]) -> FilledScaler:
    """ML-1 as a pipeline stage, fitted on the filled training rows."""
    params = fit_scaler(filled(train, cols), cols)
    return FilledScaler(inputCols=list(cols), means=[params[c][0] for c in cols], sds=[params[c][1] for c in cols])


def predictions(fitted: PipelineModel, labelled: DataFrame, model: str, part: str = "test") -> DataFrame:
    """The prediction table of a detector, fresh or loaded, for one part. It sees
    all rows first, as a history may reach back into the other part."""
    scored = fitted.transform(labelled.drop("pred", "proba")).where(F.col("part") == part)
    return _emit(scored, model, F.col("pred"), F.col("proba"))


def _emit(df: DataFrame, model: str, pred: Column, proba: Column) -> DataFrame:
    return df.select(F.lit(model).alias("model"), "universe", "date", F.col("y").cast("int").alias("y"),
                     pred.cast("int").alias("pred"), proba.cast("double").alias("proba"))


# --------------------------------------------------------------------------
# ML-2 / ML-3 logistic regression, ML-4 / ML-5 random forest
# --------------------------------------------------------------------------

def logistic(labelled: DataFrame, cols: Sequence[str] | None = None, scale: bool = True,
             max_iter: int = 500, cut: float | None = None, model: str = "Logistic"):
    """ML-2 (6 scaled columns) / ML-3 (all columns, unscaled, cut 0.55).

    L2 with C = 1 on balanced weights is, in Spark's normalised objective,
    ``regParam = 1 / sum(weights)`` = 1 / n. Returns (predictions, fitted model).
    """
    cols = list(cols or pick_columns(labelled, LOGISTIC_COLUMNS))
    train = labelled.where(F.col("part") == "train")
    scaler = scaler_stage(train, cols) if scale else FilledScaler(inputCols=cols)
    train = train.withColumn("w", balanced_weight(train)).withColumn("y", F.col("y").cast("double"))
    lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w",
                            maxIter=max_iter, regParam=1.0 / max(train.count(), 1), elasticNetParam=0.0,
                            standardization=False)
    asm = VectorAssembler(inputCols=scaler.outputs(), outputCol="features")
    fitted = Pipeline(stages=[scaler, asm, lr, Alert(cut=cut)]).fit(train)
    return predictions(fitted, labelled, model), fitted


def random_forest(labelled: DataFrame, n_trees: int = 200, max_depth: int = 8, seed: int = 42,
                  model: str = "Random Forest"):
    """ML-4: balanced random forest on the 26 candidate columns (scaled as in
    the reference; trees are scale-invariant). Returns (predictions, model,
    importances DataFrame (ML-5))."""
    cols = pick_columns(labelled, FOREST_COLUMNS)
    train = labelled.where(F.col("part") == "train")
    train = train.withColumn("w", balanced_weight(train)).withColumn("y", F.col("y").cast("double"))
    fitted = forest_pipeline(cols, n_trees, max_depth, seed).fit(train)
    imp = fitted.stages[-2].featureImportances.toArray().tolist()
    importances = labelled.sparkSession.createDataFrame(list(zip(cols, [float(v) for v in imp])),
                                                        "feature string, importance double")
    return predictions(fitted, labelled, model), fitted, importances


def forest_pipeline(cols: Sequence[str], n_trees: int, max_depth: int, seed: int) -> Pipeline:
    """Inputs, forest on weights ``w``, alert."""
    fill = FilledScaler(inputCols=list(cols))
    rf = RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="w",
                                numTrees=n_trees, maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[fill, VectorAssembler(inputCols=fill.outputs(), outputCol="features"), rf, Alert()])


def top_importances(importances: DataFrame, n: int = 15) -> DataFrame:
    """ML-5 / EV-13: importances sorted descending, top ``n`` (a report)."""
    return importances.orderBy(F.col("importance").desc(), "feature").limit(n)


def fold_rows(labelled: DataFrame, stride: int, min_train: int,
              horizon: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``day`` (position of their date among all dates of all series),
    ``fold`` (NULL before ``min_train`` days) and ``label_end`` (the date up to
    which the label looks), and the calendar (date, day). Folds are cut by date,
    so that at a cut no series is ahead of another. The calendar holds one row
    per date, whatever the number of series."""
    days = labelled.select("date").distinct().withColumn(
        "day", F.row_number().over(Window.orderBy("date")) - 1)
    w = Window.partitionBy("universe").orderBy("date")
    rows = labelled.withColumn("label_end", F.lead("date", horizon).over(w)).join(days, "date")
    fold = F.floor((F.col("day") - min_train) / F.lit(stride)).cast("int")
    return rows.withColumn("fold", F.when(F.col("day") >= min_train, fold)), days


def fold_training(rows: DataFrame, days: DataFrame, stride: int, min_train: int,
                  train_window: int) -> DataFrame:
    """Every row once per fold that trains on it, as ``train_fold``: fold f starts
    at day min_train + f * stride and trains on the ``train_window`` days before,
    less the rows whose label looks past its start. A row is in train_window /
    stride folds."""
    starts = days.where((F.col("day") >= min_train) & ((F.col("day") - min_train) % stride == 0)).select(
        F.floor((F.col("day") - min_train) / F.lit(stride)).cast("int").alias("train_fold"),
        F.col("date").alias("cut"))
    ahead = F.col("day") - min_train
    first = F.greatest(F.floor(ahead / F.lit(stride)) + 1, F.lit(0)).cast("int")
    last = F.floor((ahead + train_window) / F.lit(stride)).cast("int")
    out = rows.where(last >= first).withColumn("train_fold", F.explode(F.sequence(first, last)))
    return out.join(starts, "train_fold").where(F.col("label_end") < F.col("cut")).drop("cut")


def walk_forward(labelled: DataFrame, stride: int = 252, min_train: int = 252,
                 train_window: int = 500, n_trees: int = 50, max_depth: int = 8,
                 seed: int = 42, model: str = "Walk-forward RF", horizon: int = 3,
                 path: str | None = None, at_once: int = 4) -> DataFrame:
    """ML-6 (re-aimed): back-test folds of ``stride`` days. Fold k predicts its
    days for every series from a forest fitted on the preceding
    ``train_window`` days, less the rows whose label looks past the cut; folds
    whose training rows hold no positive are skipped.

    The training rows of all folds are written once, a folder per fold, and so
    are the rows to be predicted; ``at_once`` folds are fitted side by side, each
    in a scheduler pool of its own, and write their predictions to one folder,
    which is read as one table: the plan does not grow with the folds, and a
    fold that is fitted again replaces its own rows only."""
    cols = pick_columns(labelled, FOREST_COLUMNS)
    spark = labelled.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/walk-forward-{uuid.uuid4().hex}"
    keep = ["universe", "date", "y", *cols]
    rows, days = fold_rows(labelled.withColumn("y", F.col("y").cast("double")), stride, min_train, horizon)
    rows = cut_lineage(rows.select(*dict.fromkeys([*keep, "day", "fold", "label_end"])))
    train = fold_training(rows, days, stride, min_train, train_window).select(*keep, "train_fold")
    train.repartition("train_fold").write.partitionBy("train_fold").parquet(f"{path}/train")
    tests = rows.where(F.col("fold").isNotNull()).select(*keep, "fold")
    tests.repartition("fold").write.partitionBy("fold").parquet(f"{path}/test")
    schema = "model string, universe string, date date, y int, pred int, proba double, fold int"
    counts: dict[int, dict[float, int]] = {}
    written = spark.read.schema(train.schema).parquet(f"{path}/train") if not rows.isEmpty() else train
    for r in written.groupBy("train_fold", "y").count().collect():
        counts.setdefault(r["train_fold"], {})[r["y"]] = r["count"]

    def fit(fold: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{fold % at_once}")
        n = counts[fold]
        weight = F.when(F.col("y") == 1, sum(n.values()) / (2.0 * n[1.0])).otherwise(
            sum(n.values()) / (2.0 * n.get(0.0, 1)))
        part = spark.read.parquet(f"{path}/train/train_fold={fold}").withColumn("w", weight)
        fitted = forest_pipeline(cols, n_trees, max_depth, seed).fit(part)
        ask = spark.read.parquet(f"{path}/test/fold={fold}")
        _emit(fitted.transform(ask), model, F.col("pred"), F.col("proba")).write.mode("overwrite").parquet(
            f"{path}/scored/fold={fold}")

    asked = {r["fold"] for r in tests.select("fold").distinct().collect()}
    folds = sorted(f for f, n in counts.items() if n.get(1.0) and f in asked)
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(inheritable_thread_target(spark)(fit), folds))
    if not folds:
        return spark.createDataFrame([], schema).drop("fold")
    return spark.read.schema(schema).parquet(f"{path}/scored").drop("fold")


# --------------------------------------------------------------------------
# ML-14 / ML-15 sequence windows and perceptron
# --------------------------------------------------------------------------

def sequences(df: DataFrame, cols: Sequence[str], seq_len: int = 10,
              keys: Sequence[str] = ("universe",)) -> DataFrame:
    """ML-14: the ``seq_len`` previous rows (current excluded) as an array of
    row arrays; rows without a full history get NULL."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-seq_len, -1)
    seq = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w)
    return df.withColumn("seq", F.when(F.size(seq) == seq_len, seq))


def oversample(df: DataFrame, label: str = "y", copies: int = 10) -> DataFrame:
    """PF-13: every positive row kept plus ``copies`` duplicates."""
    n = F.when(F.col(label) == 1, F.lit(copies + 1)).otherwise(F.lit(1))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), n))).drop("_copy")


def sequence_perceptron(labelled: DataFrame, seq_len: int = 10, hidden: int = 32,
                        max_iter: int = 200, seed: int = 42, tune_on: str = "train",
                        model: str = "Sequence MLP"):
    """ML-15 (re-aimed): perceptron on the flattened 10-row history of the
    scaled inputs, positives oversampled after windowing; the probability
    cut is the best-F1 threshold (ML-16) on the training rows (``tune_on =
    'test'`` reproduces the reference's tuning on the test rows).
    Rows without a full history predict 0 with NULL probability."""
    cols = pick_columns(labelled, SEQUENCE_COLUMNS, 8)
    scaler = scaler_stage(labelled.where(F.col("part") == "train"), cols)
    past = History(inputCols=scaler.outputs(), keys=["universe"], rows=seq_len)
    data = past.transform(scaler.transform(labelled))
    train = oversample(data.where((F.col("part") == "train") & F.col("has_history")))
    mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol="y",
                                         layers=[seq_len * len(cols), hidden, hidden, 2],
                                         maxIter=max_iter, seed=seed)
    net = mlp.fit(train.withColumn("y", F.col("y").cast("double")))
    bare = PipelineModel([scaler, past, net, Alert(where="has_history")])
    cut = pooled_cut(predictions(bare, labelled, model, tune_on).where(F.col("proba").isNotNull()))
    fitted = PipelineModel([scaler, past, net, Alert(cut=cut, where="has_history")])
    return predictions(fitted, labelled, model), fitted, cut


def pooled_cut(preds: DataFrame) -> float:
    """ML-16 for a pooled model: the best-F1 threshold over all series together."""
    from vigil.operators.evaluation import best_f1_threshold
    pooled = preds.select("model", F.lit("all").alias("universe"), "date", "y", F.lit(0).alias("pred"), "proba")
    best = best_f1_threshold(pooled).first()
    return float(best["threshold"]) if best else 0.5


# --------------------------------------------------------------------------
# ML-10 ... ML-13 regime model
# --------------------------------------------------------------------------

def _forward_backward(x: np.ndarray, means, covs, weights, trans, start):
    """Scaled forward-backward and Viterbi for one series (Gaussian emissions)."""
    k = len(weights)
    n = x.shape[0]
    logb = np.zeros((n, k))
    for j in range(k):
        cov = covs[j]
        inv = np.linalg.inv(cov)
        _, logdet = np.linalg.slogdet(cov)
        d = x - means[j]
        logb[:, j] = -0.5 * (np.einsum("ij,jk,ik->i", d, inv, d) + logdet
                             + x.shape[1] * math.log(2 * math.pi))
    logb -= logb.max(axis=1, keepdims=True)
    b = np.exp(logb)
    alpha = np.zeros((n, k))
    c = np.zeros(n)
    a = start * b[0]
    c[0] = a.sum() or 1e-300
    alpha[0] = a / c[0]
    for t in range(1, n):
        a = (alpha[t - 1] @ trans) * b[t]
        c[t] = a.sum() or 1e-300
        alpha[t] = a / c[t]
    beta = np.ones((n, k))
    for t in range(n - 2, -1, -1):
        beta[t] = (trans @ (b[t + 1] * beta[t + 1])) / c[t + 1]
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    logt = np.log(trans + 1e-300)
    delta = np.log(start + 1e-300) + np.log(b[0] + 1e-300)
    back = np.zeros((n, k), dtype=int)
    for t in range(1, n):
        cand = delta[:, None] + logt
        back[t] = cand.argmax(axis=0)
        delta = cand.max(axis=0) + np.log(b[t] + 1e-300)
    path = np.zeros(n, dtype=int)
    path[-1] = int(delta.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return post, path


#: Rows of a block of the mixture fit.
BLOCK_ROWS = 32768


def _blocks(rows: Iterable, width: int) -> Iterator[np.ndarray]:
    """The rows of a partition as arrays of up to BLOCK_ROWS rows."""
    rows = iter(rows)
    while chunk := list(islice(rows, BLOCK_ROWS)):
        yield np.array(chunk, dtype=float).reshape(-1, width)


def _mixture_sums(logw: np.ndarray, means: np.ndarray, inverses: np.ndarray, x: np.ndarray) -> np.ndarray:
    """E-step of one block: the log-likelihood, then per component the sums of
    the responsibilities, of the weighted inputs and of their outer products."""
    dev = x[None, :, :] - means[:, None, :]
    logp = logw[:, None] - np.einsum("jia,jab,jib->ji", dev, inverses, dev, optimize=True) / 2
    top = logp.max(axis=0)
    expo = np.exp(logp - top)
    tot = expo.sum(axis=0)
    resp = expo / tot
    return np.concatenate([[(np.log(tot) + top).sum()], resp.sum(axis=1), (resp @ x).ravel(),
                           np.einsum("ji,ia,ib->jab", resp, x, x, optimize=True).ravel()])


class MixtureFit(NamedTuple):
    weights: np.ndarray
    means: list
    covariances: list
    log_likelihood: float
    converged: bool
    iterations: int


def fit_mixture(df: DataFrame, cols: Sequence[str], k: int, max_iter: int = 200,
                tol: float = 1e-7, reg: float = 1e-3):
    """Gaussian mixture (full covariance) by EM. The rows are packed once into
    blocks of numbers, kept by the executors (memory, then disk) and spread over
    tasks by their count, so a step costs what its rows cost, whatever the number
    of partitions ``df`` comes in: each block gives its weighted sums and outer
    products under the current parameters, added up in a tree to 1 + k x (1 + d +
    d^2) numbers for the M-step; a step plans and compiles no query. Rows with a
    NULL input give no sums. Components start at evenly spaced
    points between the minimum and maximum of the first input, the others at
    their mean, with the global covariance; ``reg`` is added to every
    covariance diagonal (a floor, so a component on identical points keeps
    a proper density). Returns a :class:`MixtureFit`, which tells whether the
    likelihood settled within ``max_iter`` steps.
    """
    d = len(cols)
    first = df.agg(F.min(cols[0]), F.max(cols[0]), F.count(F.lit(1)),
                   *[F.avg(c) for c in cols],
                   *[F.covar_pop(a, b) for a in cols for b in cols]).first()
    lo, hi, n = first[0], first[1], first[2]
    mu = np.array(first[3:3 + d], dtype=float)
    cov0 = np.array(first[3 + d:], dtype=float).reshape(d, d) + reg * np.eye(d)
    means = []
    for j in range(k):
        m = mu.copy()
        m[0] = lo + (hi - lo) * (j / (k - 1) if k > 1 else 0.5)
        means.append(m)
    covs = [cov0.copy() for _ in range(k)]
    weights = np.full(k, 1.0 / k)
    whole = df.select(*[F.col(c).cast("double").alias(f"_x{a}") for a, c in enumerate(cols)]).where(
        " AND ".join(f"_x{a} IS NOT NULL" for a in range(d)))
    blocks = whole.coalesce(max(1, math.ceil(n / BLOCK_ROWS))).rdd.mapPartitions(
        partial(_blocks, width=d)).persist(StorageLevel.MEMORY_AND_DISK)
    prev = None
    ll = float("nan")
    try:
        for n_steps in range(1, max_iter + 1):
            inverses = np.array([np.linalg.inv(c) for c in covs])
            logdets = np.array([np.linalg.slogdet(c)[1] for c in covs])
            logw = np.log(weights + 1e-300) - 0.5 * (d * math.log(2 * math.pi) + logdets)
            sums = blocks.map(partial(_mixture_sums, logw, np.array(means), inverses)).treeReduce(np.add)
            ll, counts = float(sums[0]), sums[1:1 + k]
            s = sums[1 + k:1 + k + k * d].reshape(k, d)
            q = sums[1 + k + k * d:].reshape(k, d, d)
            for j in range(k):
                nj = max(float(counts[j]), 1e-12)
                m = s[j] / nj
                weights[j] = nj / n
                means[j] = m
                covs[j] = q[j] / nj - np.outer(m, m) + reg * np.eye(d)
            if prev is not None and abs(ll - prev) <= tol * max(1.0, abs(prev)):
                return MixtureFit(weights, means, covs, ll, True, n_steps)
            prev = ll
    finally:
        blocks.unpersist()
    return MixtureFit(weights, means, covs, ll, False, max_iter)


def mixture_component(cols: Sequence[str], weights, means, covs) -> Column:
    """Index of the most likely component for each row (expression)."""
    d = len(cols)
    x = [F.col(c) for c in cols]
    best_val, best_idx = None, None
    for j in range(len(weights)):
        inv = np.linalg.inv(covs[j])
        _, logdet = np.linalg.slogdet(covs[j])
        dev = [x[a] - F.lit(float(means[j][a])) for a in range(d)]
        quad = sum((dev[a] * dev[b] * F.lit(float(inv[a, b])) for a in range(d)
                    for b in range(d)), F.lit(0.0))
        lp = F.lit(float(math.log(weights[j] + 1e-300) - 0.5 * logdet)) - quad / 2
        if best_val is None:
            best_val, best_idx = lp, F.lit(0)
        else:
            better = lp > best_val
            best_idx = F.when(better, F.lit(j)).otherwise(best_idx)
            best_val = F.greatest(lp, best_val)
    return best_idx


def regime_model(labelled: DataFrame, n_states: int = 2, binarise_below: float | None = 42.0,
                 seed: int = 42, fit_on: str = "all", tune_on: str = "train",
                 model: str = "Regime", crisis_by: str = "flag"):
    """ML-10 ... ML-13, ML-16 (re-aimed regime model).

    Emissions: a Gaussian mixture fitted by EM (:func:`fit_mixture`, one
    pass over packed rows per step) on the (optionally binarised) score inputs,
    fitted on all rows (``fit_on='all'``, as the reference) or the training
    part. Transitions: counts of consecutive most-likely components
    (``lag`` + ``groupBy``). Per series, smoothed posteriors and the Viterbi
    path come from a forward-backward pass in ``applyInPandas`` keyed by
    universe (a series holds one row per day). The crisis state is the one
    with the highest mean of the binarised flag, or with ``crisis_by='score'``
    (and without a flag) the one with the lowest mean score;
    states are also labelled by ascending mean score (ML-11).
    Returns (predictions, state_table, transitions)."""
    spark = labelled.sparkSession
    if binarise_below is not None:
        data = labelled.withColumn("r0", (F.col("risk_score") < binarise_below).cast("double"))
        cols = ["r0"]
    else:
        cols = pick_columns(labelled, REGIME_COLUMNS)
        data = filled(labelled, cols)
    params = fit_scaler(data, cols)
    data = apply_scaler(filled(data, cols), params)
    fit_rows = data if fit_on == "all" else data.where(F.col("part") == "train")
    fit = fit_mixture(fit_rows, cols, n_states)
    if not fit.converged:
        warnings.warn(f"mixture not settled after {fit.iterations} steps", RuntimeWarning, stacklevel=2)
    weights, means, covs = fit.weights, fit.means, fit.covariances
    comp = data.withColumn("comp", mixture_component(cols, weights, means, covs))
    w = Window.partitionBy("universe").orderBy("date")
    pairs = (comp.select(F.lag("comp").over(w).alias("a"), F.col("comp").alias("b"))
             .where(F.col("a").isNotNull()).groupBy("a", "b").count().collect())
    trans = np.full((n_states, n_states), 1e-3)
    for r in pairs:
        trans[r["a"], r["b"]] += r["count"]
    trans /= trans.sum(axis=1, keepdims=True)
    start = np.asarray(weights, dtype=float)
    bc = spark.sparkContext.broadcast((means, covs, list(start), trans, start))

    flag_col = "r0" if binarise_below is not None else "risk_score"
    raw = labelled.select("universe", "date", "y", "part", "risk_score")
    if binarise_below is not None:
        raw = raw.withColumn("r0", (F.col("risk_score") < binarise_below).cast("double"))
    xs = comp.select("universe", "date", F.array(*[F.col(c) for c in cols]).alias("x"))
    series = raw.join(xs, ["universe", "date"])
    k = n_states

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        means_, covs_, weights_, trans_, start_ = bc.value
        pdf = pdf.sort_values("date")
        x = np.vstack(pdf["x"].to_numpy())
        post, path = _forward_backward(x, means_, covs_, weights_, trans_, start_)
        out = pd.DataFrame({"universe": pdf["universe"].to_numpy(), "date": pdf["date"].to_numpy(),
                            "state": path.astype("int32")})
        for j in range(k):
            out[f"p{j}"] = post[:, j]
        return out

    schema = "universe string, date date, state int, " + ", ".join(
        f"p{j} double" for j in range(k))
    smoothed = series.select("universe", "date", "x").groupBy("universe").applyInPandas(
        smooth, schema)
    res = cut_lineage(raw.join(smoothed, ["universe", "date"]))  # read by the state means, the cut and the output
    means_by = res.groupBy("state").agg(F.avg(flag_col).alias("m_flag"),
                                        F.avg("risk_score").alias("m_score")).collect()
    if binarise_below is not None and crisis_by == "flag":
        crisis = max(means_by, key=lambda r: r["m_flag"])["state"]
    else:
        crisis = min(means_by, key=lambda r: r["m_score"])["state"]
    order = sorted(range(k), key=lambda s: next((r["m_score"] for r in means_by
                                                 if r["state"] == s), 50.0))
    labels = {s: REGIME_LABELS[min(i, len(REGIME_LABELS) - 1)] for i, s in enumerate(order)}
    state_table = spark.createDataFrame(
        [(int(s), labels[s], float(next((r["m_score"] for r in means_by if r["state"] == s),
                                        50.0)), int(s) == int(crisis)) for s in range(k)],
        "state int, label string, mean_score double, is_crisis boolean")
    res = res.withColumn("proba", F.col(f"p{crisis}"))
    tune = res.where(F.col("part") == tune_on)
    cut = pooled_cut(tune.select(F.lit(model).alias("model"), "universe", "date", "y", "proba"))
    test = res.where(F.col("part") == "test")
    preds = _emit(test, model, (F.col("proba") >= F.lit(cut)).cast("int"), F.col("proba"))
    tdf = spark.createDataFrame([(int(a), int(b), float(trans[a, b])) for a in range(k)
                                 for b in range(k)], "from_state int, to_state int, prob double")
    return preds, state_table, tdf


def state_count_sweep(labelled: DataFrame, counts: Sequence[int] = (2, 3),
                      binarise_below: float | None = 42.0) -> DataFrame:
    """ML-17: best F1 of the regime model per number of states."""
    from vigil.operators.evaluation import best_f1_threshold, with_positions
    rows = []
    for k in counts:
        preds, _, _ = regime_model(labelled, n_states=k, binarise_below=binarise_below,
                                   model=f"Regime k={k}", crisis_by="score")
        b = best_f1_threshold(with_positions(preds)).agg(F.avg("best_f1")).first()[0]
        rows.append((int(k), float(b) if b is not None else None))
    return labelled.sparkSession.createDataFrame(rows, "n_states int, best_f1 double")


# --------------------------------------------------------------------------
# ML-7 / ML-8 isolation forest
# --------------------------------------------------------------------------

def isolation_forest(labelled: DataFrame, n_trees: int = 200, sample: int = 256,
                     contamination: float = 0.1, seed: int = 42,
                     model: str = "Isolation Forest"):
    """ML-7 / ML-8 (re-aimed isolation forest, :mod:`vigil.operators.isolation`).

    Prediction: anomaly when the score exceeds the training ``1 -
    contamination`` quantile; the probability is the score min-maxed over the
    test rows. Returns (predictions, fitted forest)."""
    cols = pick_columns(labelled, ISOLATION_COLUMNS)
    train, test = (labelled.where(F.col("part") == p) for p in ("train", "test"))
    scaler = fit_scaler(filled(train, cols), cols)
    fitted = isolation.fit(train, test, cols, scaler, n_trees, sample, contamination, seed, "universe", "date")
    scored = fitted.score(test, "universe", "date")
    return _emit(scored, model, F.col("pred"), F.col("proba")), fitted
