"""Readers for the landed tables, with explicit schemas and column pruning.

Only the columns an operator needs are selected right after the scan, so the
Parquet reader's ``ReadSchema`` carries just those and filters on them are
pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S, _TS = (T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(),
                       T.TimestampNTZType())

SCHEMAS: dict[str, T.StructType] = {
    "region": T.StructType([T.StructField("r_regionkey", _I), T.StructField("r_name", _S)]),
    "nation": T.StructType([T.StructField("n_nationkey", _I), T.StructField("n_name", _S),
                            T.StructField("n_regionkey", _I)]),
    "customer": T.StructType([T.StructField("c_custkey", _L), T.StructField("c_name", _S),
                              T.StructField("c_nationkey", _I), T.StructField("c_acctbal", _D),
                              T.StructField("c_mktsegment", _S)]),
    "orders": T.StructType([T.StructField("o_orderkey", _L), T.StructField("o_custkey", _L),
                            T.StructField("o_orderstatus", _S), T.StructField("o_totalprice", _D),
                            T.StructField("o_orderdate", _TS),
                            T.StructField("o_orderpriority", _S)]),
    "lineitem": T.StructType([T.StructField("l_orderkey", _L), T.StructField("l_partkey", _L),
                              T.StructField("l_suppkey", _L), T.StructField("l_linenumber", _I),
                              T.StructField("l_quantity", _D),
                              T.StructField("l_extendedprice", _D),
                              T.StructField("l_discount", _D), T.StructField("l_tax", _D),
                              T.StructField("l_returnflag", _S),
                              T.StructField("l_linestatus", _S),
                              T.StructField("l_shipdate", _TS)]),
    "events": T.StructType([T.StructField("event_id", _L), T.StructField("ts", _TS),
                            T.StructField("user_id", _L), T.StructField("event_type", _S),
                            T.StructField("value", _D), T.StructField("props", _S)]),
}


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Scan ``{sf_dir}/{name}.parquet`` with its declared schema."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    df = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
