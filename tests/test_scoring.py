"""States against a look back per row; labels and scaling by hand."""

import datetime as dt
import random

from vigil.operators import scoring as scr

K = ["universe"]


def state_at(v, i):
    """State of row i by a look back: length of the unbroken rise inside the
    stress band that ends here, and the row before that rise."""
    bands = [(80, "Stable"), (65, "Low Risk")]
    if v[i] is None or v[i] < 40:
        return "Crisis"
    for low, name in bands:
        if v[i] >= low:
            return name

    def rises(j):
        return j > 0 and None not in (v[j], v[j - 1]) and 40 <= v[j] < 65 and v[j] > v[j - 1]

    n = next(k for k in range(i + 2) if not rises(i - k))
    before = v[i - n]
    return "Recovery" if n >= 5 and before is not None and before < 40 else "Stress"


def states(v):
    return [state_at(v, i) for i in range(len(v))]


def _scores_df(spark, series):
    rows = []
    for u, vals in series.items():
        for i, v in enumerate(vals):
            rows.append((u, dt.date(2020, 1, 1) + dt.timedelta(days=i), v))
    return spark.createDataFrame(rows, "universe string, date date, risk_score double")


def test_states_match_look_back_with_nulls(spark):
    rnd = random.Random(7)
    series = {}
    for u in range(12):
        v, vals = 50.0, []
        for _ in range(120):
            v = min(95.0, max(20.0, v + rnd.uniform(-6, 6)))
            vals.append(None if rnd.random() < 0.05 else round(v, 2))
        series[f"U{u}"] = vals
    out = scr.classify_state(_scores_df(spark, series), K)
    got = {}
    for r in out.orderBy("universe", "date").collect():
        got.setdefault(r["universe"], []).append(r["market_state"])
    for u, vals in series.items():
        assert got[u] == states(vals), u


def test_recovery_on_fifth_rising_row_then_cancelled(spark):
    vals = [35.0, 41.0, 42.0, 43.0, 44.0, 45.0, 44.0]
    out = scr.classify_state(_scores_df(spark, {"U": vals}), K)
    got = [r["market_state"] for r in out.orderBy("date").collect()]
    assert got == ["Crisis", "Stress", "Stress", "Stress", "Stress", "Recovery", "Stress"]


def test_crisis_label_drops_tail(spark):
    vals = [50.0, 50.0, 39.0, 50.0, 50.0, 50.0, 50.0]
    out = scr.crisis_label(_scores_df(spark, {"U": vals}), K)
    ys = [r["y"] for r in out.orderBy("date").collect()]
    assert ys == [1, 1, 0, 0]


def test_scaled_constant_and_range(spark):
    df = _scores_df(spark, {"U": [5.0, 5.0, 5.0], "V": [0.0, 5.0, 10.0]})
    out = scr.scale_columns(df, K, {"s": ("risk_score", True)})
    got = {(r["universe"], r["risk_score"]): r["s"] for r in out.collect()}
    assert got[("U", 5.0)] == 100.0
    assert got[("V", 0.0)] == 100.0 and got[("V", 10.0)] == 0.0 and got[("V", 5.0)] == 50.0


def test_transition_table_rows_sum_to_one(spark):
    t = scr.transition_table(spark)
    sums = t.groupBy("from_state").sum("prob").collect()
    assert len(sums) == 5 and all(abs(r[1] - 1.0) < 1e-9 for r in sums)
