"""Stages that make a fitted detector one artefact (IO-11).

A detector is a ``PipelineModel``: inputs filled and scaled, features, the Spark
ML model, and the cut that turns its probability into an alert. Spark ML writes
and reads the whole of it, so a loaded detector scores raw feature rows exactly
as the one that was saved; nothing is kept beside it.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Base of the stages: keyword arguments become parameters."""

    inputCols = Param(Params._dummy(), "inputCols", "columns read", TypeConverters.toListString)

    def _take(self, kwargs: dict) -> None:
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def value(self, name: str):
        return self.getOrDefault(name) if self.isDefined(name) else None


class FilledScaler(_Stage):
    """PF-7 + ML-1: NULL -> 0, then (x - mean) / sd of the fitted columns, into
    columns of the prefix ``in_``; the inputs stay as they are."""

    means = Param(Params._dummy(), "means", "subtracted", TypeConverters.toListFloat)
    sds = Param(Params._dummy(), "sds", "divided by", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, means=None, sds=None):
        super().__init__()
        self._take(self._input_kwargs)

    def outputs(self) -> list[str]:
        return [f"in_{c}" for c in self.value("inputCols")]

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.value("inputCols")
        means, sds = self.value("means") or [0.0] * len(cols), self.value("sds") or [1.0] * len(cols)
        return df.withColumns({
            f"in_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
            for c, m, s in zip(cols, means, sds)})


class History(_Stage):
    """ML-14: the rows before each one (it excluded) of a series, flattened into
    ``features``; ``has_history`` tells rows whose history is whole, the others
    get zeros."""

    keys = Param(Params._dummy(), "keys", "series", TypeConverters.toListString)
    rows = Param(Params._dummy(), "rows", "rows back", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, keys=None, rows=None):
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, n = self.value("inputCols"), self.value("rows")
        w = Window.partitionBy(*self.value("keys")).orderBy("date").rowsBetween(-n, -1)
        df = df.withColumn("_x", F.flatten(F.collect_list(F.array(*cols)).over(w)))
        whole = F.size("_x") == n * len(cols)
        zeros = F.array_repeat(F.lit(0.0), n * len(cols))
        return df.withColumns({"has_history": whole, "features": array_to_vector(
            F.when(whole, F.col("_x")).otherwise(zeros))}).drop("_x")


class Alert(_Stage):
    """``pred`` and ``proba`` from the model's columns: an alert from ``cut`` on,
    or the model's own prediction without one. Rows that ``where`` names as
    lacking an input predict 0 without a probability."""

    cut = Param(Params._dummy(), "cut", "probability of an alert", TypeConverters.toFloat)
    where = Param(Params._dummy(), "where", "flag column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, cut=None, where=None):
        super().__init__()
        self._take(self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        proba = vector_to_array("probability")[1]
        df = df.withColumn("proba", F.when(F.col(self.value("where")), proba) if self.value("where") else proba)
        cut = self.value("cut")
        alert = F.col("proba") >= F.lit(cut) if cut is not None else F.col("prediction") == 1
        return df.withColumn("pred", F.coalesce((alert & F.col("proba").isNotNull()).cast("int"), F.lit(0)))
