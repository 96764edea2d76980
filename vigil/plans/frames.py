"""Shared building blocks: the derived frames every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators import features as fe
from vigil.session import cut_lineage
from vigil.sources import panels

KEYS = ("universe",)
DIGITS = 6


def round_doubles(df: DataFrame, digits: int = DIGITS, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every DOUBLE column (output shaping for comparison / export)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType) and f.name not in skip:
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def index_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.index_panel(spark, sf_dir)


def symbol_returns(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None,
                   daily: DataFrame | None = None) -> DataFrame:
    """(universe, symbol, date, ret) on the market calendar, complete-date rule applied."""
    daily = daily if daily is not None else daily_orders(spark, sf_dir)
    panel = panel if panel is not None else panels.index_panel(spark, sf_dir, daily=daily)
    obs = panels.symbol_closes(spark, sf_dir, daily)
    closes = panels.carried_closes(obs, panels.market_calendar(panel, KEYS), KEYS)
    return panels.symbol_returns(closes, KEYS)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders reduced to one row per (universe, region, day), written once:
    panel, closes and calendar read it, so the raw orders are scanned once a job
    (each consumer prunes other columns, and Spark would scan for each)."""
    return cut_lineage(panels.region_daily(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str, use_volume: bool = False,
             with_cross: bool = True, materialize: bool = True,
             segment_rows: int | None = None, daily: DataFrame | None = None) -> DataFrame:
    """The cleaned market feature matrix per (universe, date).

    With ``materialize`` the matrix (one row per universe and day) is
    checkpointed to the shared checkpoint folder: later stages (scores,
    states, stocks, evaluation) then plan against a small leaf instead of
    re-analysing and re-optimising the whole raw-table lineage after every
    adaptive stage, and a lost executor does not replay the raw scans.
    """
    if daily is None:
        daily = daily_orders(spark, sf_dir) if with_cross else panels.region_daily(spark, sf_dir)
    panel = panels.index_panel(spark, sf_dir, daily=daily)
    rets = symbol_returns(spark, sf_dir, panel, daily) if with_cross else None
    out = fe.market_features(panel, rets, KEYS, use_volume=use_volume, segment_rows=segment_rows)
    return cut_lineage(out) if materialize else out
