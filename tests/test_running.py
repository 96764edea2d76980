"""Running figures, halos and exponential moments against plain loops."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.operators import decay
from vigil.operators import running as rn

K = ["universe"]


def series(spark, values: dict, parts: int = 4):
    rows = [(u, i, x) for u, xs in values.items() for i, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "universe string, i int, x double").repartition(parts)
    return df.withColumn("date", F.date_add(F.lit("1990-01-01").cast("date"), F.col("i")))


def direct(xs: list, span: float) -> list[tuple]:
    """(mean, sd) by summing all weights of all earlier rows in two passes."""
    r, out = 1 - 2 / (span + 1), []
    for t in range(len(xs)):
        seen = [(i, x) for i, x in enumerate(xs[:t + 1]) if x is not None]
        if not seen:
            out.append((None, None))
            continue
        top = seen[-1][0]
        w = [r ** (top - i) for i, _ in seen]
        mean = math.fsum(a * x for a, (_, x) in zip(w, seen)) / math.fsum(w)
        s = math.fsum(a * (x - mean) ** 2 for a, (_, x) in zip(w, seen))
        free = 2 * math.fsum(a * math.fsum(w[:k]) for k, a in enumerate(w))
        out.append((mean, math.sqrt(s * math.fsum(w) / free) if len(seen) > 1 else None))
    return out


rng = random.Random(8)
CASES = {
    "gap": [1.0, 2.0, 3.0] + [None] * 250,
    "gaps": [1.0, 5.0] + [None] * 400 + [2.0] + [None] * 900 + [7.0, 8.0],
    "level": [1e6 + rng.gauss(0, 1e-3) for _ in range(300)],
    "plain": [rng.gauss(0, 1) if rng.random() < 0.9 else None for _ in range(800)],
    "null": [None] * 40,
    "jump": [1e6] * 5 + [rng.gauss(0, 1e-3) for _ in range(300)],
    "late": [None] * 90 + [4.0, 4.5],
}


@pytest.mark.parametrize("span", [3, 20])
@pytest.mark.parametrize("rows", [None, 64])
def test_exponential_moments_equal_direct_sums(spark, span, rows):
    df = series(spark, CASES)
    if rows:
        df = rn.numbered(df, K, rows, slices=5)
    out = decay.ewm_std(decay.ewm_mean(df, "x", K, span, "m"), "x", K, span, "sd")
    got: dict = {}
    for r in out.orderBy("universe", "i").collect():
        got.setdefault(r["universe"], []).append((r["m"], r["sd"]))
    for u, xs in CASES.items():
        for (m, sd), (wm, ws) in zip(got[u], direct(xs, span), strict=True):
            assert (m is None) == (wm is None) and (sd is None) == (ws is None), u
            assert m is None or abs(m - wm) < 1e-9 * max(1, abs(wm)), (u, m, wm)
            # a deviation is as exact as its inputs' own digits allow
            assert sd is None or abs(sd - ws) < 1e-9 * max(1, ws), (u, sd, ws)


def test_known_values_after_a_gap(spark):
    out = decay.ewm_std(decay.ewm_mean(series(spark, {"a": CASES["gap"]}), "x", K, 3, "m"), "x", K, 3, "sd")
    last = out.orderBy(F.desc("i")).first()
    assert round(last["m"], 4) == 2.4286 and round(last["sd"], 4) == 0.9636


def test_running_sums_of_one_long_series_in_even_slices(spark):
    n, slices = 200_000, 16
    df = spark.range(n).select(F.lit("one").alias("universe"), ((F.col("id") * 7919) % n).cast("double").alias("x"),
                               (F.col("id") % 3).alias("v"))
    cut = rn.sliced(df, K, F.col("x"), slices).groupBy("_slice").count().collect()
    assert len(cut) == slices and max(r["count"] for r in cut) < 1.5 * n / slices
    out = rn.running_sums(df, K, -F.col("x"), {"up": F.col("v")}, {"all": F.col("v")}, slices)
    plain = Window.partitionBy("universe").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    both = out.withColumn("want", F.sum("v").over(plain))
    assert both.where("up <> want").isEmpty() and both.count() == n
    assert both.select("all").distinct().collect()[0][0] == sum(i % 3 for i in range(n))


def test_running_sums_take_ties_nulls_and_null_keys(spark):
    rows = [("a", 1.0, 1), ("a", 1.0, 2), ("a", None, 4), ("a", 3.0, None), (None, 2.0, 5), (None, 1.0, 7)]
    df = spark.createDataFrame(rows, "universe string, x double, v int")
    got = sorted(map(tuple, rn.running_sums(df, K, F.col("x"), {"s": F.col("v")}, {"t": F.col("v")}, 4)
                     .select("universe", "x", "s", "t").collect()), key=str)
    assert ("a", None, 4, 7) in got and ("a", 3.0, 7, 7) in got
    assert (None, 1.0, 7, 12) in got and (None, 2.0, 12, 12) in got
    assert rn.running_sums(df.limit(0), K, F.col("x"), {"s": F.col("v")}).isEmpty()


@pytest.mark.parametrize("rows", [7, 50, 10_000])
def test_running_and_halo_equal_plain_windows(spark, rows):
    values = {u: [rng.gauss(0, 1) if rng.random() < 0.7 else None for _ in range(n)]
              for u, n in (("a", 333), ("b", 1), ("c", 49), ("d", 50))}
    df = rn.numbered(series(spark, values), K, rows, slices=6)
    w = Window.partitionBy("universe").orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("x")
    out = rn.running(df, K, {"hi": ("max", x), "lo": ("min", x), "known": ("last", x)})
    out = rn.running(out, K, {"prev": ("last", x)}, strict=True)
    out = rn.with_halo(out, rows, 5, 3)
    seg = Window.partitionBy("universe", rn.SEG).orderBy("date")
    out = rn.without_halo(out.withColumns({"s5": F.sum("x").over(seg.rowsBetween(-4, 0)),
                                           "n3": F.count("x").over(seg.rowsBetween(1, 3))}))
    want = df.select("universe", "date", F.max("x").over(past).alias("w_hi"), F.min("x").over(past).alias("w_lo"),
                     F.last("x", True).over(past).alias("w_known"), (F.row_number().over(w) - 1).alias("w_pos"),
                     F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("w_prev"),
                     F.sum("x").over(w.rowsBetween(-4, 0)).alias("w_s5"), F.count("x").over(w.rowsBetween(1, 3)).alias("w_n3"))
    both = out.withColumnRenamed(rn.POS, "pos").join(want, ["universe", "date"])
    assert both.count() == sum(map(len, values.values()))
    for c in ("hi", "lo", "known", "pos", "prev", "n3"):
        assert both.where(~F.col(c).eqNullSafe(F.col(f"w_{c}"))).isEmpty(), c
    assert both.where(~(F.coalesce(F.abs(F.col("s5") - F.col("w_s5")) < 1e-9,
                                   F.col("s5").isNull() & F.col("w_s5").isNull()))).isEmpty()


def test_a_halo_needs_room(spark):
    with pytest.raises(ValueError):
        rn.with_halo(rn.numbered(series(spark, {"a": [1.0]}), K, 4), 4, 5)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranking_metrics_of_one_large_model(spark):
    """One model of 200,000 rows: slices share its thresholds, no window holds them all."""
    from vigil.operators import evaluation as ev
    n = 200_000
    preds = spark.range(n).select(
        F.lit("m").alias("model"), F.lit("u").alias("universe"), F.col("id").alias("pos"),
        (F.xxhash64("id") % 3 == 0).cast("int").alias("y"), F.lit(1).alias("pred"))
    noise = F.pmod(F.xxhash64("pos", F.lit(1)), F.lit(50_000)) / 50_000.0
    preds = preds.withColumn("proba", F.round((noise + 0.3 * F.col("y")) / 1.3, 5))
    curve = ev.pr_curve(preds)
    windows = [line for line in plan(curve).split("\n") if "Window [" in line and "_p_" not in line]
    assert windows and all("_slice" in line for line in windows)
    got = ev.ranking_metrics(preds).first()
    pos, neg = {}, {}
    for r in preds.groupBy("proba", "y").count().collect():
        (pos if r["y"] else neg)[r["proba"]] = r["count"]
    below = wins = seen = ap = hits = 0
    for p in sorted({*pos, *neg}):
        wins += pos.get(p, 0) * (below + neg.get(p, 0) / 2)
        below += neg.get(p, 0)
    for p in sorted({*pos, *neg}, reverse=True):
        hits, seen = hits + pos.get(p, 0), seen + pos.get(p, 0) + neg.get(p, 0)
        ap += pos.get(p, 0) * hits / seen
    total = sum(pos.values())
    assert got["roc_auc"] == round(wins / total / below, 4) and got["avg_precision"] == round(ap / total, 4)


def test_scores_hold_no_whole_series_in_a_window(spark):
    from vigil.operators import scoring as scr
    df = series(spark, {"a": [1.0, 3.0, 2.0], "b": [5.0, 5.0]}).withColumns(
        {c: F.col("x") for c in ("vol_20d", "vix_zscore", "bank_market_corr")})
    out = scr.component_scores(df, K)
    assert "unboundedfollowing" not in plan(out).lower().replace(" ", "")
    assert {round(r["stability_score"], 3) for r in out.collect()} == {100.0, 0.0, 50.0}
