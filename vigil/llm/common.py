"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir

#: White space of the text contracts: blank and the five ASCII controls.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Most rows of a small key table that may be broadcast (times its row width,
#: a few dozen MB); larger ones go through an ordinary shuffled join.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def materialise(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet below the cluster's shared checkpoint folder and
    read it back: lineage ends here and lost executors cost nothing before."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the paths that :func:`materialise` writes inside the block."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)


def release(spark: SparkSession, made: list[str]) -> None:
    """Deletes scratch tables that nothing will read any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while made:
        path = hadoop(made.pop())
        path.getFileSystem(conf).delete(path, True)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, or with underscores added until no column has the name."""
    have = {c.lower() for c in taken}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows stay within ``rows``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(rows: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """``rows`` whose ``on`` is not in ``gone`` (its only column): broadcast
    behind a count (8 bytes a row), a shuffled join beyond it."""
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone.hint("merge"), on, "left_anti")


def words(text: Column) -> Column:
    """Words between runs of SPACE, as an array; null counts as empty."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(
        F.split(body, SPACE + "+"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow hand whole texts to Python in batches of at most ``rows``
    rows, so that a worker holds a few megabytes of them at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
