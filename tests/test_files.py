"""Landed files, retried appends, round trips."""

from pyspark.sql import functions as F

from vigil.sources import files


def lines(spark, path, *text):
    spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.text(str(path))


def test_landed_files_are_keyed_corrected_and_set_aside(spark, tmp_path):
    root = tmp_path / "landed"
    lines(spark, root / "b=1/universe=A B/symbol=x+y", "DATE,OPEN,HIGH,LOW,CLOSE,VOLUME",
          "2020-01-01,1,2,1,1.5,10", "2020-01-02,1,2,1,1.6,10", "2020-01-03,1,2,1,,10")
    lines(spark, root / "b=2/universe=A B/symbol=x+y", "date,open,high,low,close,volume", "2020-01-02,1,2,1,9.9,10")
    lines(spark, root / "b=1/universe=A B/symbol=bad", "date,open,high,low,close,volume",
          "2020-01-01,1,2,oops,1,1", "2020-02-30,1,1,1,1,1", "2020-01-05,1,1,1,1,1")
    lines(spark, root / "b=1/universe=A B/symbol=empty")
    lines(spark, root / "loose", "date,open,high,low,close,volume", "2020-01-01,1,1,1,1,1")
    known = spark.createDataFrame([("A B", s) for s in ("x+y", "bad", "empty", "absent")], "universe string, symbol string")
    got = files.read_landed(spark, str(root), known)
    rows = {(r["symbol"], str(r["date"])): r["close"] for r in got.rows.collect()}
    assert rows == {("x+y", "2020-01-01"): 1.5, ("x+y", "2020-01-02"): 9.9, ("x+y", "2020-01-03"): None,
                    ("bad", "2020-01-05"): 1.0}
    aside = sorted((r["symbol"] or "-", r["reason"]) for r in got.quarantine.collect())
    assert aside == [("-", "no key"), ("bad", "malformed"), ("bad", "no date")]
    assert sorted(r["symbol"] for r in got.skipped.collect()) == ["absent", "empty"]
    # fewer columns asked for, the same rows set aside
    assert got.rows.select("symbol").count() == 4
    part = files.read_landed(spark, str(root), start="2020-01-02", end="2020-01-03").rows.collect()
    assert [(r["symbol"], r["close"]) for r in part] == [("x+y", 9.9)]
    wide = files.landed_panel(got.rows, ["x+y", "bad", "none"]).orderBy("date").collect()
    assert [(str(r["date"]), r["x+y"], r["bad"], r["none"]) for r in wide] == [
        ("2020-01-01", 1.5, None, None), ("2020-01-02", 9.9, None, None), ("2020-01-05", None, 1.0, None)]


def test_a_run_written_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "sweep")
    two = spark.createDataFrame([(2, 0.5)], "n int, f1 double")
    files.append_rows(two, path, "k=2")
    files.append_rows(two.withColumn("n", F.lit(3)), path, "k=3")
    files.append_rows(two.withColumn("f1", F.lit(0.75)), path, "k=2")
    assert sorted((r["n"], r["f1"]) for r in spark.read.parquet(path).collect()) == [(2, 0.75), (3, 0.5)]


def test_csv_keeps_types_and_lists(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([("a", ["x, y", 'q"z'], 1.5), ("b", None, None)], "k string, v array<string>, d double")
    files.write_table(df, path, "csv")
    back = {r["k"]: r for r in spark.read.option("header", True).csv(path).withColumn(
        "v", F.from_json("v", "array<string>")).collect()}
    assert back["a"]["v"] == ["x, y", 'q"z'] and back["b"]["v"] is None and back["a"]["d"] == "1.5"


def test_split_by_fraction_and_alert_columns(spark):
    import datetime as dt

    from vigil.operators import evaluation as ev
    rows = [(u, dt.date(2020, 1, 1) + dt.timedelta(days=i)) for u, n in (("a", 40), ("b", 6)) for i in range(n)]
    df = spark.createDataFrame(rows, "universe string, date date")
    got = {(r["universe"], r["part"]): (r["count"], str(r["last"])) for r in ev.chrono_split(df, None).groupBy(
        "universe", "part").agg(F.count("*").alias("count"), F.max("date").alias("last")).collect()}
    assert got == {("a", "train"): (6, "2020-01-06"), ("a", "test"): (34, "2020-02-09"), ("b", "test"): (6, "2020-01-06")}
    d = dt.date(2020, 1, 1)
    preds = spark.createDataFrame([("M 1", "a", d, 1, 1), ("Two", "a", d, 1, 0), ("M 1", "a", d + dt.timedelta(1), 0, 0)],
                                  "model string, universe string, date date, y int, pred int")
    line = ev.alert_timeline(preds, df.withColumn("risk_score", F.lit(1.0)), ["M 1", "Two"]).orderBy("date").collect()
    assert [(r["m_1"], r["two"], r["y"]) for r in line] == [(1, 0, 1), (0, None, 0)]
