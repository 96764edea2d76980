"""Isolation forest (ML-7, ML-8) as grouped aggregates and joins.

Every tree takes the training rows whose hash of (row, tree) falls below
``sample / n``. All trees grow together, one level per step: an aggregate finds
each node's size and the range of its inputs, a hash draws the input and the
threshold, and a join sends the rows to the children. Rows are scored by walking
the node table (at most 2 * sample rows per tree, so it is broadcast) level by
level; the sum over trees is combined before it is shuffled.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.running import running_sums
from vigil.session import cut_lineage

_NODE = "tree int, node long, feature int, value double"


def average_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search among n points (Euler's constant is a fixed value)."""
    n = n.cast("double")
    long = F.lit(2.0) * (F.log(F.greatest(n - 1, F.lit(1.0))) + F.lit(0.5772156649015329)) - F.lit(2.0) * (n - 1) / n
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(long)


def _draw(seed: int, *of: str) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)


def sampled(rows: DataFrame, n: int, trees: int, sample: int, seed: int, *keys: str) -> DataFrame:
    """(tree, x) of every tree's rows; a row is repeated for its trees only."""
    limit = int(min(1.0, sample / max(n, 1)) * 2 ** 31)
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                    lambda t: F.pmod(F.xxhash64(*keys, t, F.lit(seed)), F.lit(2 ** 31)) < F.lit(limit))
    return rows.select(F.explode(mine).alias("tree"), "x")


def grow(sample: DataFrame, inputs: int, depth: int, seed: int) -> DataFrame:
    """Node table (tree, node, feature, value): the threshold of an inner node's
    feature, or with feature -1 a leaf's path length. Node n has the children
    2n + 1 and 2n + 2."""
    now, levels = cut_lineage(sample.withColumn("node", F.lit(0).cast("long"))), []
    for level in range(depth + 1):
        spans = [F.struct(F.lit(i).alias("f"), F.min(F.col("x")[i]).alias("lo"), F.max(F.col("x")[i]).alias("hi"))
                 for i in range(inputs)]
        found = now.groupBy("tree", "node").agg(F.count("*").alias("size"), F.array(*spans).alias("spans"))
        wide = F.filter("spans", lambda s: s["hi"] > s["lo"])
        found = found.withColumn("wide", wide)
        split = (F.size("wide") > 0) & F.lit(level < depth)
        pick = F.when(split, F.col("wide")[F.floor(_draw(seed, "tree", "node") * F.size("wide")).cast("int")])
        found = found.withColumn("pick", pick)
        cut = F.col("pick.lo") + _draw(seed + 1, "tree", "node") * (F.col("pick.hi") - F.col("pick.lo"))
        # a threshold above the least value leaves rows on both sides
        cut = F.when(cut > F.col("pick.lo"), cut).otherwise(F.col("pick.hi"))
        nodes = cut_lineage(found.select(
            F.col("tree").cast("int").alias("tree"), "node", F.coalesce(F.col("pick.f"), F.lit(-1)).alias("feature"),
            F.coalesce(cut, F.lit(float(level)) + average_path(F.col("size"))).alias("value")))
        levels.append(nodes)
        inner = nodes.where("feature >= 0")
        if inner.isEmpty():
            break
        right = (F.element_at("x", F.col("feature") + 1) >= F.col("value")).cast("long")
        now = cut_lineage(now.join(inner, ["tree", "node"]).select(
            "tree", "x", (F.col("node") * 2 + 1 + right).alias("node")))
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out


def paths(rows: DataFrame, nodes: DataFrame, trees: int, depth: int, *keys: str) -> DataFrame:
    """(keys, path): mean path length over the trees of rows with inputs ``x``."""
    table = F.broadcast(nodes.select("tree", "node", "feature", "value"))
    at = rows.select(*keys, "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
                     F.lit(0).cast("long").alias("node"))
    for _ in range(depth):
        right = (F.element_at("x", F.greatest("feature", F.lit(0)) + 1) >= F.col("value")).cast("long")
        at = at.join(table, ["tree", "node"]).withColumn(
            "node", F.when(F.col("feature") >= 0, F.col("node") * 2 + 1 + right).otherwise(F.col("node"))
        ).drop("feature", "value")
    return at.join(table, ["tree", "node"]).groupBy(*keys).agg(F.avg("value").alias("path"))


def quantile(df: DataFrame, x: str, q: float) -> float | None:
    """Exact linear-interpolated quantile from ranks that slices count side by side."""
    rows = cut_lineage(df.select(F.lit(0).alias("all"), F.col(x).alias("x")).where(F.col("x").isNotNull()))
    at = q * (rows.count() - 1)
    if at < 0:
        return None
    ranked = running_sums(rows, ["all"], F.col("x"), {"rank": F.lit(1)})
    near = sorted(r["x"] for r in ranked.where(F.col("rank").isin(math.floor(at) + 1, math.floor(at) + 2)).collect())
    return near[0] + (near[-1] - near[0]) * (at - math.floor(at))


class IsolationForest(NamedTuple):
    """A fitted forest: score 2^(-path / c), an anomaly above ``offset``; ``lo``
    and ``hi`` are the scores that become the probabilities 0 and 1."""

    nodes: DataFrame
    cols: list[str]
    means: list[float]
    sds: list[float]
    trees: int
    depth: int
    norm: float
    offset: float
    lo: float
    hi: float

    def inputs(self, df: DataFrame) -> DataFrame:
        """``df`` with its scaled inputs, NULL as 0, as ``x``."""
        return df.withColumn("x", F.array(*[
            (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s)
            for c, m, s in zip(self.cols, self.means, self.sds)]))

    def score(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df`` with ``iso``, ``pred`` and ``proba``; ``keys`` tell its rows apart."""
        found = paths(self.inputs(df).select(*keys, "x"), self.nodes, self.trees, self.depth, *keys)
        iso = F.pow(F.lit(2.0), -F.col("path") / F.lit(self.norm)) if self.norm > 0 else F.lit(0.0)
        out = df.join(found, list(keys)).withColumn("iso", iso).drop("path")
        return out.withColumns({"pred": (F.col("iso") > F.lit(self.offset)).cast("int"),
                                "proba": (F.col("iso") - F.lit(self.lo)) / F.lit(self.hi - self.lo + 1e-9)})

    def save(self, path: str) -> None:
        """Node table and parameters below ``path`` (overwritten)."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        told = json.dumps({k: v for k, v in self._asdict().items() if k != "nodes"})
        self.nodes.sparkSession.createDataFrame([(told,)], "value string").write.mode("overwrite").text(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        told = json.loads(spark.read.text(f"{path}/params").first()["value"])
        return cls(nodes=spark.read.schema(_NODE).parquet(f"{path}/nodes"), **told)


def fit(train: DataFrame, scored: DataFrame, cols: list[str], scaler: dict[str, tuple[float, float]],
        trees: int, sample: int, contamination: float, seed: int, *keys: str) -> IsolationForest:
    """Forest on the training rows; the offset is their ``1 - contamination``
    quantile, the probability spans the scores of ``scored``."""
    depth = int(math.ceil(math.log2(max(sample, 2))))
    made = IsolationForest(train, cols, [scaler[c][0] for c in cols], [scaler[c][1] for c in cols], trees, depth,
                           0.0, 0.0, 0.0, 1.0)
    x = cut_lineage(made.inputs(train).select(*keys, "x"))
    n = x.count()
    nodes = cut_lineage(grow(sampled(x, n, trees, sample, seed, *keys), len(cols), depth, seed))
    norm = train.sparkSession.range(1).select(average_path(F.lit(min(sample, n)))).first()[0]
    grown = {r["tree"] for r in nodes.select("tree").distinct().collect()}
    if len(grown) < trees:  # a tree without any row is a leaf
        spark = train.sparkSession
        nodes = nodes.unionByName(spark.createDataFrame(
            [(t, 0, -1, 0.0) for t in range(trees) if t not in grown], _NODE))
    made = made._replace(nodes=nodes, norm=norm)
    offset = quantile(cut_lineage(made.score(train, *keys).select("iso")), "iso", 1.0 - contamination)
    ends = made.score(scored, *keys).agg(F.min("iso"), F.max("iso")).first()
    return made._replace(offset=offset if offset is not None else 1.0, lo=ends[0] or 0.0, hi=ends[1] or 0.0)
