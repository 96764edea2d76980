"""Price and index panels derived from the landed tables.

Data model (long form, one row per key):

    index_panel  (universe, date, sector, market, fear, fx, volume)
    prices       (universe, symbol, date, open, high, low, close, volume)
    closes       (universe, symbol, date, close)   carried onto the calendar
    returns      (universe, symbol, date, ret)      NULL off complete dates

Derivation from the TPC-H-like tables:

* ``universe``  = the customer's market segment, so every job holds several
  independent series and every window is partitioned by a key.
* ``market``    = average order price per (universe, order day).
* ``sector``    = the same over the customers of one region; days without
  such orders stay NULL.
* ``fear``      = 100 x average line discount per ship day (one global series).
* ``fx``        = average unit price (extended price / quantity) per ship day.
* ``prices``    = per (universe, region, day): close = avg, high = max,
  low = min, open = price of the first order key, volume = sum of the line
  quantities of those orders.

Scale notes: the raw tables are read once, pruned to the needed columns;
all raw rows are reduced with partial (map-side) aggregation to one row per
(universe[, symbol], day) before the daily panels are windowed. Hot
customers or segments therefore never reach a window as raw rows: a series
holds at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions import safe_div, series_window, spread
from vigil.sources.tables import read_table

# Which region's orders make up the "sector" index.
SECTOR_REGION = "ASIA"
# Universe name used when a panel has a single universe.
SINGLE_UNIVERSE = "ALL"


def customer_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, universe, region). Nation and region are the fixed 25 / 5
    row dimension tables, so broadcasting them is size-safe."""
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return (customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey)
            .select("c_custkey", F.col("c_mktsegment").alias("universe"),
                    F.col("r_name").alias("region")))


def segment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders tagged with universe and region: (universe, region, date, price, o_orderkey)."""
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
    cust = customer_geography(spark, sf_dir)
    return (orders.join(cust, orders.o_custkey == cust.c_custkey)
            .select("universe", "region", F.to_date("o_orderdate").alias("date"),
                    F.col("o_totalprice").alias("price"), "o_orderkey"))


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global daily series from the line items: (date, fear, fx)."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_shipdate", "l_discount", "l_extendedprice", "l_quantity"])
    return (li.groupBy(F.to_date("l_shipdate").alias("date"))
            .agg((F.lit(100.0) * F.avg("l_discount")).alias("fear"),
                 F.avg(safe_div("l_extendedprice", "l_quantity")).alias("fx")))


def region_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders reduced once to one row per (universe, region, day): price sum,
    count, max, min and the price of the first order key. Both the index
    panel and the symbol closes are derived from this small frame, so the
    orders x customer join runs once per job."""
    o = segment_orders(spark, sf_dir)
    return (o.groupBy("universe", "region", "date")
            .agg(F.sum("price").alias("p_sum"), F.count("price").alias("p_n"),
                 F.max("price").alias("high"), F.min("price").alias("low"),
                 F.min_by("price", "o_orderkey").alias("open"),
                 F.min("o_orderkey").alias("first_key")))


def index_panel(spark: SparkSession, sf_dir: str, sector_region: str = SECTOR_REGION,
                daily: DataFrame | None = None) -> DataFrame:
    """IO-2 / JN-1: the wide index panel per (universe, date).

    One aggregation of the per-region daily sums produces market and sector
    together (conditional sums), so no outer join of two series is needed;
    the calendar is the set of days with any order in the universe, and the
    sector is NULL on days without sector orders. The global fear / fx
    series join by date.
    """
    d = daily if daily is not None else region_daily(spark, sf_dir)
    in_sector = F.col("region") == F.lit(sector_region)
    agg = (d.groupBy("universe", "date")
           .agg(F.sum("p_sum").alias("m_sum"), F.sum("p_n").alias("m_n"),
                F.sum(F.when(in_sector, F.col("p_sum"))).alias("s_sum"),
                F.sum(F.when(in_sector, F.col("p_n"))).alias("s_n")))
    daily_panel = agg.select(
        "universe", "date",
        safe_div(F.col("s_sum"), F.col("s_n").cast("double")).alias("sector"),
        safe_div(F.col("m_sum"), F.col("m_n").cast("double")).alias("market"),
        F.when(F.col("s_n") > 0, F.col("s_n").cast("double")).alias("volume"))
    return (daily_panel.join(macro_series(spark, sf_dir), "date", "left")
            .select("universe", "date", "sector", "market", "fear", "fx", "volume"))


def symbol_closes(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Daily close per (universe, symbol = region): the average order price.
    Needs no line items."""
    d = daily if daily is not None else region_daily(spark, sf_dir)
    return d.select("universe", F.col("region").alias("symbol"), "date",
                    safe_div(F.col("p_sum"), F.col("p_n").cast("double")).alias("close"))


def prices_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-1: daily OHLCV per (universe, symbol = region)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"])
    qty = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))
    o = segment_orders(spark, sf_dir)
    o = o.join(qty, o.o_orderkey == qty.l_orderkey, "left")
    return (o.groupBy("universe", F.col("region").alias("symbol"), "date")
            .agg(F.min_by("price", "o_orderkey").alias("open"),
                 F.max("price").alias("high"),
                 F.min("price").alias("low"),
                 F.avg("price").alias("close"),
                 F.sum("qty").alias("volume")))


def events_prices_panel(spark: SparkSession, sf_dir: str, bucket: str = "day",
                        universe: str = "EVENTS") -> DataFrame:
    """Price-like panel from the event stream: symbol = event type, one row
    per time bucket; close = avg(value), volume = number of events."""
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type", "value", "event_id"])
    ts = F.col("ts").cast("timestamp")
    key = F.to_date(ts) if bucket == "day" else F.date_trunc(bucket, ts)
    return (ev.groupBy(F.lit(universe).alias("universe"), F.col("event_type").alias("symbol"),
                       key.alias("date"))
            .agg(F.min_by("value", "event_id").alias("open"),
                 F.max("value").alias("high"),
                 F.min("value").alias("low"),
                 F.avg("value").alias("close"),
                 F.count(F.lit(1)).cast("double").alias("volume")))


def market_calendar(panel: DataFrame, keys: tuple[str, ...] = ("universe",)) -> DataFrame:
    """The trading days of each universe (days with a market value)."""
    return panel.where(F.col("market").isNotNull()).select(*keys, "date")


def carried_closes(prices: DataFrame, calendar: DataFrame,
                   keys: tuple[str, ...] = ("universe",)) -> DataFrame:
    """PF-6 / JN-4: each symbol's close on every calendar day of its universe,
    the last close carried forward (NULL before the first one).

    Calendar days get positions; an observed close covers the positions up to
    the symbol's next observation (see :func:`on_calendar`), so no join of days
    with symbols on the universe alone is needed.
    """
    seen = prices.where(F.col("close").isNotNull())
    dense = on_calendar(seen.select(*keys, "symbol", "date", "close"), calendar, keys)
    return dense.select(*keys, "symbol", "date", F.when(~F.col("before"), F.col("close")).alias("close"))


def on_calendar(observed: DataFrame, calendar: DataFrame, keys: tuple[str, ...] = ("universe",)) -> DataFrame:
    """Every (symbol, calendar day) with the latest row of ``observed`` (keys,
    symbol, date, values) on the calendar: adds ``fresh`` (the row is of that
    day) and ``before`` (no row yet: the values are those of the first one).

    Each observed row is exploded over the positions it covers. The joins are on
    (universe, date) and (universe, position); the number of days joins as one
    row per universe. A symbol never seen on a calendar day has no rows.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("date")
    days = calendar.select(*keys, "date").distinct().withColumn("pos", F.row_number().over(w))
    last = days.groupBy(*keys).agg(F.max("pos").alias("n_days"))
    at = spread(observed.join(days, [*keys, "date"]).join(last, keys), [*keys, "symbol"])
    s = Window.partitionBy(*keys, "symbol").orderBy("pos")
    until = F.coalesce(F.lead("pos").over(s) - 1, F.col("n_days"))
    first = F.when(F.lag("pos").over(s).isNull(), F.lit(1)).otherwise(F.col("pos"))
    spans = at.withColumns({"own": F.col("pos"), "from_": first, "to_": until}).drop("date", "pos", "n_days")
    out = spans.withColumn("pos", F.explode(F.sequence("from_", "to_")))
    return out.join(days, [*keys, "pos"]).withColumns({
        "fresh": F.col("pos") == F.col("own"), "before": F.col("pos") < F.col("own")}).drop(
        "own", "from_", "to_", "pos")


def symbol_returns(closes: DataFrame, keys: tuple[str, ...] = ("universe",)) -> DataFrame:
    """WF-1 per symbol plus the complete-date rule of the wide return frame:
    a date keeps its returns only if every symbol of the universe has one.

    ``closes`` is dense (every symbol on every calendar day). A zero close
    gives no return on its day and the next, which then are not complete; the
    days' counts of missing returns are a grouped sum, combined before its
    shuffle, and join back on (universe, date).
    """
    keys = list(keys)
    w = series_window([*keys, "symbol"])
    ratio = safe_div(F.col("close"), F.lag("close").over(w))
    r = closes.withColumn("ret", F.when(ratio > 0, F.ln(ratio)))
    open_days = r.groupBy(*keys, "date").agg(
        F.max(F.col("ret").isNull()).alias("_missing"))
    return r.join(open_days, [*keys, "date"]).select(
        *keys, "symbol", "date", F.when(~F.col("_missing"), F.col("ret")).alias("ret"))


# Names of the index series.
INDEX_SERIES = ["sector", "market", "fear", "fx"]


def symbol_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-3: (symbol, role): the regions of the region table as stocks, and the
    index series."""
    stocks = read_table(spark, sf_dir, "region", ["r_name"]).select(
        F.col("r_name").alias("symbol"), F.lit("stock").alias("role"))
    indices = spark.createDataFrame([(s, "index") for s in INDEX_SERIES], "symbol string, role string")
    return stocks.unionByName(indices)
