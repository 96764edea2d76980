"""Prefix trie of conversations, screened by a count-min sketch.

A turn counts as the SHA-256 of its role and text, a prefix as a chained
SHA-256 of its turns, so texts leave the job at the first step. The prefixes of
all conversations fill a count-min sketch (four rows of saturating counters,
:data:`MOST_CELLS` at most, merged block by block). The sketch never counts too
few: an estimate of one proves that a prefix, and with it every longer one of
that conversation, has no other member. These tails are emitted where they are;
only prefixes that may be shared are shuffled and grouped exactly, so a full
sketch costs shuffle, never a wrong result.

Sums over subtrees need no walk up the tree. A node belongs to its smallest
member. A conversation owns all its nodes from some depth on, and every node is
owned once; so a sum over the distinct nodes of a subtree is a sum, over the
members of its top, of what each of them owns below. Three grouped aggregates
(combined before the shuffle) give every figure at any depth.

Conversations are streamed in order of turns, row by row; neither a
conversation, nor a node's members, nor its list of ended members is ever held
whole (the latter is hashed from a sorted stream of ids).

Defined cases: rows without a conversation id take no part; null role or text
is empty; null turns come first, equal turns are ordered by their SHA-256;
repeated rows are turns of their own; an empty table gives an empty result, any
other at least the root; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_or_plain

#: Most counters of a sketch row, one byte each, and counters sent as one value.
MOST_CELLS = 1 << 22
CELLS_A_BLOCK = 1 << 16
ROWS = 4
#: Most tasks that fill a sketch of their own: a block is merged from as many.
SKETCH_TASKS = 256

ROOT = bytes(32)
_NOBODY = hashlib.sha256(b"").hexdigest()
_STEP = "conv long, depth long, digest binary, parent binary, before long, length long, total long, " \
        "single boolean, first boolean"


def turn_marks(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """(conv, pos, mark, n_bytes): every turn's place from 1, digest and length of text."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    marked = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)).alias("mark"),
        F.octet_length(said).cast("long").alias("n_bytes"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "mark")
    return marked.select("conv", F.row_number().over(order).alias("pos"), "mark", "n_bytes")


def whole(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they stand: (steps, conversations) for :func:`trie`."""
    convs = marks.groupBy("conv").agg(F.count("*").alias("length"), F.sum("n_bytes").alias("total"))
    return marks.join(convs, "conv"), convs


def branched(marks: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as branches: the first h turns of conversation
    c - c % every (remainders take the sign of c, as in SQL), then c's own after
    its first h, with h = crc32(c) % heads."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    own = materialise(marks.withColumn("h", h), "turns")
    ours = own.groupBy("conv", "h").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("pos") > F.col("h"), F.col("n_bytes")).otherwise(0)).alias("rest"))
    first = (own.where((F.col("conv") % every == 0) & (F.col("pos") < heads)).groupBy("conv")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "mark", "n_bytes"))).alias("turns"))
             .withColumnRenamed("conv", "base"))
    head = F.when(F.col("turns").isNull(), F.array().cast("array<struct<pos:int,mark:binary,n_bytes:bigint>>")) \
        .otherwise(F.slice("turns", 1, F.col("h")))
    made = (ours.withColumn("base", F.col("conv") - F.col("conv") % every).join(first, "base", "left")
            .withColumn("head", head).withColumn("lead", F.size("head"))
            .withColumn("length", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long"))
            .withColumn("total", F.col("rest") + F.aggregate("head", F.lit(0).cast("long"),
                                                             lambda a, t: a + t["n_bytes"])))
    made = materialise(made.select("conv", "h", "head", "lead", "length", "total"), "branches")
    taken = made.select("conv", F.explode("head").alias("t"), "length", "total").select(
        "conv", "t.pos", "t.mark", "t.n_bytes", "length", "total")
    kept = own.where(F.col("pos") > F.col("h")).drop("h").join(made.drop("head"), "conv").select(
        "conv", (F.col("lead") + F.col("pos") - F.col("h")).alias("pos"), "mark", "n_bytes", "length", "total")
    return taken.unionByName(kept), made.select("conv", "length", "total")


def _cells(digests: list[bytes], width: int) -> np.ndarray:
    """One counter number per digest and sketch row."""
    return (np.frombuffer(b"".join(digests), "<u8").reshape(-1, ROWS) & np.uint64(width - 1)).astype(np.int64).T


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list[bytes], list[int]]]:
    """(columns, digests, parents, bytes before) of every batch of sorted steps."""
    conv, digest, before = None, ROOT, 0
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        digests, parents, befores = [], [], []
        for c, _, mark, n, _, _ in zip(*columns):
            if c != conv:
                conv, digest, before = c, ROOT, 0
            parents.append(digest)
            digest = hashlib.sha256(digest + mark).digest()
            digests.append(digest)
            befores.append(before)
            before += n
        if digests:
            yield columns, digests, parents, befores


def sketch(ordered: DataFrame, width: int) -> np.ndarray:
    """Counters of all prefixes, saturating at two: (ROWS, width) bytes."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, width), np.uint8)
        for _, digests, _, _ in _prefixes(batches):
            for row, at in zip(counts, _cells(digests, width)):
                cells, n = np.unique(at, return_counts=True)
                row[cells] = np.minimum(2, row[cells] + np.minimum(2, n))
        blocks = counts.reshape(ROWS, -1, min(width, CELLS_A_BLOCK))
        for r, b in zip(*np.nonzero(blocks.any(axis=2))):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(r)], pa.int32()), pa.array([int(b)], pa.int32()), pa.array([blocks[r, b].tobytes()])],
                ["row", "block", "cells"])

    def merge(key, parts):
        total = np.zeros(min(width, CELLS_A_BLOCK), np.uint8)
        for cells in parts["cells"]:
            total = np.minimum(2, total + np.frombuffer(cells, np.uint8))
        parts = parts.iloc[:1].copy()
        parts["cells"] = [total.tobytes()]
        return parts

    schema = "row int, block int, cells binary"
    out = np.zeros((ROWS, max(1, width // CELLS_A_BLOCK), min(width, CELLS_A_BLOCK)), np.uint8)
    for r in ordered.coalesce(SKETCH_TASKS).mapInArrow(fill, schema).groupBy("row", "block") \
            .applyInPandas(merge, schema).collect():
        out[r["row"], r["block"]] = np.frombuffer(r["cells"], np.uint8)
    return out.reshape(ROWS, width)


def screened(steps: DataFrame) -> DataFrame:
    """Every prefix of every conversation; ``single`` ones have one member,
    ``first`` marks the shortest single prefix of a conversation."""
    steps = materialise(steps.select("conv", "pos", "mark", "n_bytes", "length", "total"), "steps")
    width = CELLS_A_BLOCK >> 4
    while width < MOST_CELLS and width < 4 * steps.count():
        width *= 2
    ordered = steps.repartition("conv").sortWithinPartitions("conv", "pos")
    sent = steps.sparkSession.sparkContext.broadcast(sketch(ordered, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        alone = None  # the conversation whose prefixes are proven single by now
        for (conv, pos, _, _, length, total), digests, parents, befores in _prefixes(batches):
            once = counts[np.arange(ROWS)[:, None], _cells(digests, counts.shape[1])].min(axis=0) <= 1
            single, first = [], []
            for c, one in zip(conv, once.tolist()):
                first.append(one and c != alone)
                alone = c if one else alone
                single.append(c == alone)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(pos, pa.int64()), pa.array(
                digests, pa.binary()), pa.array(parents, pa.binary()), pa.array(befores, pa.int64()), pa.array(
                length, pa.int64()), pa.array(total, pa.int64()), pa.array(single), pa.array(first)],
                ["conv", "depth", "digest", "parent", "before", "length", "total", "single", "first"])

    return materialise(ordered.mapInArrow(run, _STEP), "prefixes")


def _ended(shared: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes at which conversations end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, text = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest != node:
                    if node is not None:
                        done.append((node, text.hexdigest()))
                    node, text = digest, hashlib.sha256(b"%d" % conv)
                else:
                    text.update(b",%d" % conv)
            yield _pairs(done)
        if node is not None:
            yield _pairs([(node, text.hexdigest())])

    return (shared.where("depth = length").select("digest", "conv").repartition("digest")
            .sortWithinPartitions("digest", "conv").mapInArrow(run, "digest binary, ends_sha256 string"))


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.string())],
        ["digest", "ends_sha256"])


def trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix, the root included: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``steps``: conv, pos (from 1 without gaps), mark, n_bytes and the
    conversation's length and total bytes; ``convs``: all of them, turnless ones too."""
    rows = screened(steps)
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), F.lit(ROOT).alias("digest"), F.lit(ROOT).alias("parent"),
                        zero.alias("before"), "length", "total")
    shared = rows.where("NOT single").drop("single", "first").unionByName(root)

    # Owners: for each conversation the depth from which it owns its nodes, the
    # bytes before it, and whether the node at its end is its own and childless.
    groups = shared.groupBy("digest").agg(
        F.min(F.struct("conv", "depth", "before", "length")).alias("o"),
        F.max(F.col("length") > F.col("depth")).alias("goes_on"))
    owners = groups.groupBy(F.col("o.conv").alias("conv")).agg(
        F.min(F.struct("o.depth", "o.before")).alias("own"),
        F.max((F.col("o.depth") == F.col("o.length")) & ~F.col("goes_on")).alias("ends"))
    tails = rows.where("first").select("conv", F.struct("depth", "before").alias("tail"))
    owned = owners.join(tails, "conv", "full").select(
        "conv", F.least("own", "tail").alias("own"),
        (F.coalesce("ends", F.lit(False)) | F.col("tail").isNotNull()).cast("long").alias("leaf"))

    mine = F.when(F.col("own").isNull(), 0).otherwise(
        F.col("total") - F.greatest(F.col("before"), F.col("own.before")))
    child = (F.col("length") > F.col("depth")) & (F.col("own.depth") <= F.col("depth") + 1)
    nodes = materialise(shared.join(owned, "conv", "left").groupBy("digest").agg(
        F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.count("*").alias("n_convs"), F.sum(F.coalesce(child.cast("long"), zero)).alias("n_children"),
        F.sum(F.coalesce("leaf", zero)).alias("n_leaves"),
        F.sum(F.col("total") - F.col("before") - mine).alias("saved_tokens")), "nodes")

    names = small_or_plain(nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    above = F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id")
    parts = (nodes.join(_ended(shared), "digest", "left").join(names, "parent", "left").select(
        "conv_id", "depth", above, "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256")))
    ends = F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(_NOBODY)

    def alone(some: DataFrame, parent) -> DataFrame:
        return some.select(
            F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            (F.col("length") > F.col("depth")).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), ends.alias("ends_sha256"))

    return (parts.unionByName(alone(rows.where("first").join(names, "parent"), F.col("parent_conv_id")))
            .unionByName(alone(rows.where("single AND NOT first"), F.col("conv"))))


#: crc32 of the decimal id, bit by bit; the polynomial is a fixed value.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda x: ascii(x)::BIGINT),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda a, k:
    CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295))"""

ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_CRC.format(c="c")} % 9 AS h FROM (SELECT DISTINCT c FROM own)),
whole AS (SELECT c, list(said ORDER BY pos) AS says FROM own GROUP BY c),
made AS (
  SELECT v.c, list_concat(coalesce(b.says, [])[1:v.h], w.says[v.h + 1:]) AS says
  FROM convs v JOIN whole w USING (c) LEFT JOIN whole b ON b.c = v.c - v.c % 5),
member AS (SELECT c, d, says[1:d] AS path, len(says) AS n FROM made, range(0, len(says) + 1) r(d)),
node AS (
  SELECT path, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '')) AS ends_sha256
  FROM member GROUP BY path),
up AS (SELECT x.*, p.conv_id AS parent_conv_id FROM node x LEFT JOIN node p
       ON x.depth > 0 AND p.depth = x.depth - 1 AND p.path = x.path[1:x.depth - 1]),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT x.path[1:r.d] AS path, count(*) FILTER (k.n IS NULL) AS n_leaves,
         sum((x.n_convs - 1) * CASE WHEN x.depth = 0 THEN 0 ELSE strlen(x.path[-1].t) END) AS saved
  FROM node x LEFT JOIN kids k ON k.path = x.path, range(0, x.depth + 1) r(d) GROUP BY 1)
SELECT u.conv_id, u.depth, u.parent_conv_id, u.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, u.ends_sha256
FROM up u JOIN below b ON b.path = u.path LEFT JOIN kids k ON k.path = u.path
"""
