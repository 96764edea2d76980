"""Hard negatives by slot-decomposed selection.

Every anchor has its first positives: the rows of its label with the highest
scores. A positive of score p asks for the first negatives (rows of another
label) with scores between a share of p and p, so the windows of one anchor
overlap. Its positives' scores, the windows' upper limits, split all scores
into disjoint slots; every row falls in one slot of an anchor. Tasks keep the
first k rows per anchor and slot (a combiner, k numbers whatever the input),
only those lists are shuffled and merged, and a window is answered by merging
the lists of its slot and all lower ones, best first, down to its lower limit.

The anchors meet all rows in blocks of :data:`BLOCK`: one block at a time goes
through the driver to the tasks (BLOCK vectors and BLOCK * positives limits),
the rows are scanned twice a block, and no pair of rows is ever written.

A component x counts as floor(256 x); scores are exact integers.

Defined cases: rows with a null id, label or vector, or with a null, NaN or
infinite component take no part, nor do those with a component of 2^19 or more
either way (their scores could leave 64 bits); vectors meet vectors of their
own length only (empty ones score 0); equal scores are ordered by the smaller
id; rows that repeat an id count once, with their best score in a list, and as
an anchor with the least label and vector; an anchor never meets its own id;
without positives or negatives an anchor gives no rows; empty tables give an
empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Anchors that meet the rows in one scan.
BLOCK = 4096
#: Scores held at a time in a task.
CELLS = 1 << 20
#: Components from here on, either way, take no part.
TOO_LARGE = float(1 << 19)

_PART = "list long, score long, id long"


class FirstLists:
    """The first k (score, id) of numbered lists, higher scores first, then
    smaller ids; an id counts once per list."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.bound = np.full(lists, np.iinfo(np.int64).min)  # score of the kth entry
        self.kept = tuple(np.empty(0, np.int64) for _ in range(3))

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        near = scores >= self.bound[lists]
        if not near.any():
            return
        new = (lists[near], scores[near], ids[near])
        lists, scores, ids = (np.concatenate(x) for x in zip(self.kept, new))
        order = np.lexsort((-scores, ids, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        first = np.ones(len(ids), bool)
        first[1:] = (lists[1:] != lists[:-1]) | (ids[1:] != ids[:-1])
        lists, scores, ids = lists[first], scores[first], ids[first]
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        start = np.ones(len(ids), bool)
        start[1:] = lists[1:] != lists[:-1]
        at = np.arange(len(ids))
        place = at - np.maximum.accumulate(np.where(start, at, 0))
        full = place == self.k - 1
        self.bound[lists[full]] = scores[full]
        self.kept = tuple(x[place < self.k] for x in (lists, scores, ids))


def _whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * vectors.astype(np.float64))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by float64 while every sum stays below 2^53."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole-number matrix) of the vectors of each length."""
    offsets = np.asarray(column.offsets)
    flat = _whole(column.values.to_numpy(zero_copy_only=False))
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[offsets[rows][:, None] + np.arange(n)[None, :]]


def _search(rows: DataFrame, anchors: list, k: int, limits: np.ndarray | None, low: int) -> DataFrame:
    """Lists of each task: the first k rows of every anchor's own label, or,
    with the ``limits`` of its positives, of other labels per slot."""
    sent = rows.sparkSession.sparkContext.broadcast((
        np.array([a["id"] for a in anchors], np.int64), [a["label"] for a in anchors],
        pa.array([list(a["vector"]) for a in anchors], pa.list_(pa.float64())), limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, tops = sent.value
        groups = {m.shape[1]: (at, m) for at, m in _by_length(vectors)}
        codes = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        label = np.array([codes[x] for x in labels], np.int64)
        slots = 1 if tops is None else tops.shape[1]
        best = FirstLists(len(ids) * slots, k)
        if tops is not None:
            # the lowest score any window asks for; negative limits ask for none
            floor = np.where(tops >= 0, low * tops, np.iinfo(np.int64).max).min(axis=1)
        for batch in batches:
            row_id = batch.column(0).to_numpy(zero_copy_only=False)
            row_label = np.array([codes.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            for rows_at, matrix in _by_length(batch.column(2)):
                if matrix.shape[1] not in groups:
                    continue
                at, mine = groups[matrix.shape[1]]
                most, step, done = max(1, CELLS // len(at)), 32, 0
                while done < len(rows_at):
                    part = slice(done, done + min(step, most))
                    done, step = part.stop, step * 4  # few rows first: they set the bounds
                    them = rows_at[part]
                    s = _scores(mine, matrix[part])
                    same = label[at][:, None] == row_label[them][None, :]
                    if tops is None:
                        a, r = np.nonzero(same & (ids[at][:, None] != row_id[them][None, :]))
                        lists = at[a]
                    else:
                        ask = ~same & (s <= tops[at][:, :1]) & (100 * s >= floor[at][:, None])
                        ask &= ids[at][:, None] != row_id[them][None, :]
                        a, r = np.nonzero(ask)
                        lists = at[a] * slots + (s[a, r][:, None] <= tops[at[a]]).sum(axis=1) - 1
                    best.add(lists, s[a, r], row_id[them[r]])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.kept], ["list", "score", "id"])

    return rows.mapInArrow(run, _PART)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The first k of each list over all tasks."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return (parts.repartition("list").groupBy("list", "id").agg(F.max("score").alias("score"))
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))


def mine(rows: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """Hard negatives of the rows that satisfy ``is_anchor``: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score, with
    low * positive_score <= 100 * negative_score <= 100 * positive_score."""
    spark = rows.sparkSession
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= TOO_LARGE))
    sound = rows.where(F.col(id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~odd)
    pick = [F.col(id).cast("long").alias("id"), F.col(label).alias("label"),
            F.col(vector).cast("array<double>").alias("vector")]
    table = sound.select(*pick)
    chosen = sound.where(is_anchor).select(*pick).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v"))
    chosen = materialise(chosen.select("id", "v.label", "v.vector"), "anchors")
    blocks = max(1, -(-chosen.count() // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        anchors = sorted(chosen.where(block == b).collect(), key=lambda a: a["id"])
        if not anchors:
            continue
        found = _merged(_search(table, anchors, positives, None, low), positives)
        names = np.array([a["id"] for a in anchors], np.int64)
        tops = np.full((len(anchors), positives), -1, np.int64)
        near = [(r["list"], r["place"], r["id"], r["score"]) for r in found.collect()]
        for a, place, _, score in near:
            tops[a, place - 1] = score
        # the block's positives, at most BLOCK * positives rows
        asks = spark.createDataFrame(
            [(a, int(names[a]), i, s) for a, _, i, s in near],
            "anchor long, anchor_id long, positive_id long, positive_score long")
        lists = _merged(_search(table, anchors, negatives, tops, low), negatives)
        held = lists.withColumn("anchor", F.expr(f"list div {positives}")).groupBy("anchor").agg(
            F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("held"))
        inside = F.slice(F.filter("held", lambda e: (-e["minus"] <= F.col("positive_score"))
                                  & (-100 * e["minus"] >= low * F.col("positive_score"))), 1, negatives)
        part = (asks.join(held, "anchor").select("*", F.posexplode(inside).alias("at", "e"))
                .select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("negative_id"),
                        "positive_score", (-F.col("e.minus")).alias("negative_score")))
        part = materialise(part, "negatives")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


ORACLE = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
asked AS (
  SELECT n.anchor_id, positive_id, positive_score, p.other AS negative_id, p.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY n.anchor_id, positive_id ORDER BY p.score DESC, p.other) AS INTEGER) AS rank
  FROM near n JOIN pairs p ON p.anchor_id = n.anchor_id AND NOT p.same
   AND 80 * positive_score <= 100 * p.score AND p.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM asked WHERE rank <= 5
"""
