"""Dense panels, complete dates, folds and documents on worked cases."""

import datetime as dt

from pyspark.sql import functions as F

from vigil.operators import detectors as det
from vigil.operators import export as exp
from vigil.sources import panels

DAY = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)]


def _calendar(spark, n):
    return spark.createDataFrame([("U", DAY[i]) for i in range(n)], "universe string, date date")


def _closes(spark, rows):
    return spark.createDataFrame([("U", s, DAY[i], c) for s, i, c in rows],
                                 "universe string, symbol string, date date, close double")


def test_closes_are_carried_from_the_first_one_on(spark):
    obs = _closes(spark, [("A", 0, 1.0), ("A", 3, 2.0), ("B", 2, 5.0), ("B", 9, 7.0), ("A", 1, None)])
    got = panels.carried_closes(obs, _calendar(spark, 5))
    rows = {(r["symbol"], DAY.index(r["date"])): r["close"] for r in got.collect()}
    assert rows == {("A", 0): 1.0, ("A", 1): 1.0, ("A", 2): 1.0, ("A", 3): 2.0, ("A", 4): 2.0,
                    ("B", 0): None, ("B", 1): None, ("B", 2): 5.0, ("B", 3): 5.0, ("B", 4): 5.0}


def test_a_zero_close_makes_two_days_incomplete(spark):
    obs = _closes(spark, [("A", i, 10.0 + i) for i in range(6)]
                  + [("B", i, 0.0 if i == 3 else 5.0 + i) for i in range(6)])
    got = panels.symbol_returns(panels.carried_closes(obs, _calendar(spark, 6)))
    held = {}
    for r in got.where("ret IS NOT NULL").collect():
        held.setdefault(r["symbol"], set()).add(DAY.index(r["date"]))
    assert held == {"A": {1, 2, 5}, "B": {1, 2, 5}}


def test_no_training_label_looks_past_the_cut(spark):
    """Two series that start 100 days apart: every training row of a fold, and
    the days its label covers, lie before the fold's first test day."""
    rows = [(u, DAY[i], i % 2) for u, first in (("A", 0), ("B", 100)) for i in range(first, 380)]
    data, days = det.fold_rows(spark.createDataFrame(rows, "universe string, date date, y int"), 60, 120, 3)
    for start in (120, 180, 240):
        cut = days.where(F.col("day") == start).first()["date"]
        train = det.fold_training(data, days, 60, 120, 100).where(F.col("train_fold") == (start - 120) // 60)
        last = train.agg(F.max("date"), F.max("label_end")).first()
        assert train.select("universe").distinct().count() == (2 if start > 120 or DAY[103] < cut else 1)
        assert last[0] < cut and last[1] < cut
        test = data.where(F.col("fold") == (start - 120) // 60)
        assert test.agg(F.min("date")).first()[0] == cut


def test_mixture_tells_whether_it_settled(spark):
    df = spark.range(200).select(F.when(F.col("id") % 2 == 0, F.rand(1)).otherwise(9 + F.rand(2)).alias("x"))
    assert det.fit_mixture(df, ["x"], 2).converged
    short = det.fit_mixture(df, ["x"], 2, max_iter=1)
    assert not short.converged and short.iterations == 1


def test_document_lists_stocks_by_score(spark):
    keys = "universe string"
    tl = spark.createDataFrame([("U", DAY[0], "01 Jan", 50.0, "Stress")],
                               f"{keys}, date date, label string, score double, state string")
    snap = spark.createDataFrame(
        [("U", 50.0, "Stress", 49.0, 1.0, 2.0, 1.0, 2.0, 3.0, 4.0, 15.0, 80.0)],
        f"{keys}, latest_score double, latest_state string, prev_score double, velocity double, momentum5 double, "
        "stability_score double, volume_score double, network_score double, external_score double, "
        "vix double, usd_inr double")
    stocks = spark.createDataFrame([("U", n, s) for n, s in (("c", 50), ("a", 70), ("d", 90), ("b", 70))],
                                   f"{keys}, name string, score long").repartition(3)
    models = spark.createDataFrame([("U", "m2", 1.0), ("U", "m1", 2.0)], f"{keys}, name string, prec double")
    row = exp.document(tl, snap, stocks, models).first()
    assert [s["name"] for s in row["STOCKS"]] == ["d", "a", "b", "c"]
    assert [m["name"] for m in row["MODEL_RESULTS"]] == ["m1", "m2"]
