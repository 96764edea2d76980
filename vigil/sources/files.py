"""File sources and sinks (IO-1, IO-4 ... IO-11).

Readers always pass an explicit schema (no inference pass over the data) and
push the date range into the scan. Writers go to a folder the caller names;
the default is a subfolder of the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import checkpoint_dir

PRICE_SCHEMA = T.StructType([
    T.StructField("universe", T.StringType()), T.StructField("symbol", T.StringType()),
    T.StructField("date", T.DateType()), T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType()),
])

COMPARISON_SCHEMA = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("universe", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in
       ["precision", "recall", "f1", "roc_auc", "event_detection_rate", "avg_delay_days",
        "false_alarm_rate", "stability_score"]])


def output_dir(spark: SparkSession, name: str, base: str | None = None) -> str:
    root = base or os.path.join(checkpoint_dir(spark), "vigil-out")
    return os.path.join(root, name)


def read_prices(spark: SparkSession, path: str, start: str | None = None,
                end: str | None = None, fmt: str = "parquet") -> DataFrame:
    """IO-1: landed OHLCV files with lower-cased columns, date range pushed
    into the scan (``start`` inclusive, ``end`` exclusive)."""
    reader = spark.read.schema(PRICE_SCHEMA)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    if start:
        df = df.where(F.col("date") >= F.to_date(F.lit(start)))
    if end:
        df = df.where(F.col("date") < F.to_date(F.lit(end)))
    return df


#: Columns of a landed price file, by position; its header may name them in any case.
LANDED_SCHEMA = T.StructType([T.StructField("date", T.DateType())] + [
    T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")])
#: Keys of a file from its path.
LANDED_KEYS = {"universe": r"/universe=([^/]*)/", "symbol": r"/symbol=([^/]*)/"}


class Landed(NamedTuple):
    """Rows by (universe, symbol, date), rows set aside with their reason, and
    the catalogue's symbols that have no row."""

    rows: DataFrame
    quarantine: DataFrame
    skipped: DataFrame


def read_landed(spark: SparkSession, folder: str, catalogue: DataFrame | None = None,
                start: str | None = None, end: str | None = None) -> Landed:
    """IO-1 / IO-2: price files as they land, any number per symbol in any depth
    of folders, keyed by their paths (one scan, no listing of tickers).

    A row that does not parse, or has no date, is set aside with its file, and
    never fails the job; empty files and symbols without files give no rows. Of
    rows of one symbol and date, the file whose path sorts last wins, so a batch
    landed later corrects an earlier one. ``start`` is inclusive, ``end`` not."""
    fields = [T.StructField("told", T.StringType()), *LANDED_SCHEMA.fields[1:], T.StructField("_bad", T.StringType())]
    raw = (spark.read.schema(T.StructType(fields))
           .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
           .option("recursiveFileLookup", True).csv(folder))
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    raw = raw.select("*", path.alias("file")).withColumns(
        {k: F.nullif(F.regexp_extract("file", p, 1), F.lit("")) for k, p in LANDED_KEYS.items()})
    keys = list(LANDED_KEYS)
    # a day that no calendar has (30 February) is not the day next to it
    day = F.try_to_date("told", "yyyy-MM-dd")
    raw = raw.withColumn("date", F.when(F.date_format(day, "yyyy-MM-dd") == F.trim("told"), day))
    # The parser looks at the columns asked for only: all are named here, so that
    # a row is set aside or not whatever the caller selects. (A plain IS NULL on
    # _bad would be pushed into the parser, which has not set it yet.)
    read = F.length(F.concat_ws(",", *[F.col(f.name).cast("string") for f in LANDED_SCHEMA.fields[1:]])) >= 0
    reason = (F.when(read & (F.length(F.coalesce("_bad", F.lit(""))) > 0), "malformed").when(F.col("date").isNull(), "no date")
              .when(F.col("universe").isNull() | F.col("symbol").isNull(), "no key"))
    raw = raw.withColumn("reason", reason)
    quarantine = raw.where(F.col("reason").isNotNull()).select(*keys, "file", "reason",
                                                           F.coalesce("_bad", "told").alias("line"))
    good = raw.where(F.col("reason").isNull())
    if start:
        good = good.where(F.col("date") >= F.to_date(F.lit(start)))
    if end:
        good = good.where(F.col("date") < F.to_date(F.lit(end)))
    values = [f.name for f in LANDED_SCHEMA.fields[1:]]
    newest = good.groupBy(*keys, "date").agg(F.max_by(F.struct(*values), "file").alias("v"))
    rows = newest.select(*keys, "date", *[F.col(f"v.{c}").alias(c) for c in values])
    skipped = (catalogue if catalogue is not None else rows).select(*keys).distinct().join(
        rows.select(*keys).distinct(), keys, "left_anti")
    return Landed(rows, quarantine, skipped)


def landed_panel(rows: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """IO-2: closes side by side per (universe, date); dates without any are dropped."""
    wide = rows.groupBy("universe", "date").pivot("symbol", list(symbols)).agg(F.first("close", ignorenulls=True))
    return wide.dropna(how="all", subset=list(symbols))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """IO-4 / IO-5 / IO-6: write a table; array columns go to CSV as JSON text (IO-7)."""
    if fmt == "csv":
        cols = [F.to_json(F.col(f.name)).alias(f.name)
                if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
                else F.col(f.name) for f in df.schema.fields]
        df = df.select(*cols)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def read_comparison_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO-8: the model comparison CSV with its declared schema."""
    return spark.read.schema(COMPARISON_SCHEMA).option("header", True).csv(path)


def append_rows(df: DataFrame, path: str, run: str) -> str:
    """IO-10: result rows (e.g. of a parameter sweep) added to a table under
    their ``run``; the same run again replaces its rows and no others."""
    (df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run").parquet(path))
    return path


def save_model(model, path: str) -> str:
    """IO-11: Spark ML persistence (overwrite)."""
    model.write().overwrite().save(path)
    return path
