"""Hypothesis properties: islands-based operators equal pattern and look-back forms."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.test_evaluation import episode_spans
from tests.test_scoring import states
from vigil.operators import evaluation as ev
from vigil.operators import scoring as scr

SCORES = st.lists(st.one_of(st.none(), st.floats(min_value=20, max_value=95,
                                                 allow_nan=False).map(lambda v: round(v, 1))),
                  min_size=1, max_size=60)
LABELS = st.lists(st.integers(min_value=0, max_value=1), min_size=1, max_size=80)
CFG = settings(max_examples=15, deadline=None,
               suppress_health_check=[HealthCheck.function_scoped_fixture])


@CFG
@given(series=st.lists(SCORES, min_size=1, max_size=3))
def test_states_equal_look_back(spark, series):
    rows = [(f"U{u}", dt.date(2020, 1, 1) + dt.timedelta(days=i), v)
            for u, vals in enumerate(series) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "universe string, date date, risk_score double")
    got = {}
    for r in scr.classify_state(df, ["universe"]).orderBy("universe", "date").collect():
        got.setdefault(r["universe"], []).append(r["market_state"])
    for u, vals in enumerate(series):
        assert got[f"U{u}"] == states(vals)


@CFG
@given(y=LABELS)
def test_episodes_equal_pattern(spark, y):
    df = spark.createDataFrame([("U", i, v) for i, v in enumerate(y)],
                               "universe string, pos int, y int")
    got = [(r["start_pos"], r["end_pos"]) for r in
           ev.crisis_episodes(df, ["universe"]).orderBy("start_pos").collect()]
    assert got == episode_spans(y)


@CFG
@given(scores=SCORES)
def test_scores_in_range_after_clip(spark, scores):
    df = spark.createDataFrame([("U", dt.date(2020, 1, 1) + dt.timedelta(days=i), v)
                                for i, v in enumerate(scores)],
                               "universe string, date date, risk_score double")
    out = scr.scale_columns(df, ["universe"], {"s": ("risk_score", True)}).collect()
    for r in out:
        assert r["s"] is None or 0.0 <= r["s"] <= 100.0
