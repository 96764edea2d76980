"""Near-duplicate detection with bottom-k sketches.

One hash function maps a document's shingles to 64-bit values; the ``k``
smallest distinct values are its sketch (a set of at most ``k`` shingles is its
own sketch). Documents with equal sets are one node from the start. Inverted
lists of retained values bring together nodes whose sketches overlap; the
overlap inside the bottom k of both sketches' union estimates the similarity
and filters, and the exact Jaccard similarity of the full sets decides.

What is indexed. For sets up to k, the retained values are the set: two linked
ones share so many that each node need only index its rarest ones, in an order
common to all nodes (by the number of nodes that retain them), and any linked
pair meets in at least one list. Sets above k, whose values are common in a large
corpus, index pairs of neighbouring retained values instead: neighbours in the
union that both sets hold are neighbours in both sketches, and two unrelated sets
hardly share any. Linked sets share so many of these (8 of 63 at least, at 0.8)
that again only the rarest are indexed. Sets a little above k can link with some
below it and index both. What a set above k must share is a bound on a random
count (of agreeing values, of agreeing neighbours), set from the threshold so
that a link exactly at it is missed with a chance of at most 5e-11 (MISS).

Lists of any length. Nothing is paired within a list at first: every node is
compared with the most typical node of each of its lists. The links found join
nodes into components, and only nodes of different components that share a list
are compared further, with the members of a big component in blocks, where a
node's first link is all that is needed, and with each other if both components
are small (and sizes compatible): in pairs if the list is short, in blocks that
give only links if it is not. A list held by one component makes no pair, and
lists with the same members count once.

Defined cases: null text and text without words have an empty set, no link and
their own component; a null id never is the component's id unless all are null;
repeated rows fall in one component; an empty table gives an empty result;
further columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (BROADCAST_ROWS, free_name, materialise, release, scratch, small_batches,
                     without)
from .graph import components

K = 64
#: Chance with which a link of sets above K, exactly at the threshold, may be missed.
MISS = 5e-11
#: Members from which a component counts as big, of a list whose members are
#: paired, and nodes of a block.
BIG = 8
SHORT = 32
BLOCK = 512

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: An odd multiplier of the rolling word hash.
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int, have: dict[int, np.ndarray]) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = have.get(base)
    if p is None or len(p) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        p = np.ones(size, np.uint64)
        p[1:] = np.uint64(base)
        have[base] = p = np.multiply.accumulate(p)
    return p[:n]


def shingles(raw: bytes, width: int, have: dict[int, np.ndarray]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of UTF-8
    text; with fewer words, the hash of the whole sequence; without, none."""
    b = np.frombuffer(raw.translate(_LOWER), np.uint8)
    blank = _IS_SPACE[b]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        # Hash of word [s, e) = sum of byte * base**(place in the word), by
        # prefix sums of byte * base**place and division by base**s.
        inverse = pow(_BASE, -1, 1 << 64)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(len(b), _BASE, have), out=sums[1:])
        word = _mix((sums[end] - sums[start]) * _powers(len(b), inverse, have)[start]
                    + (end - start).astype(np.uint64))
        n = min(width, len(word))
        out = np.zeros(len(word) - n + 1, np.uint64)
        for k in range(n):
            out = _mix(out * np.uint64(31) + word[k:len(word) - n + 1 + k] + np.uint64(n))
    return np.unique(out.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], width: int, k: int | None) -> Iterator[pa.RecordBatch]:
    """Replaces x_text by the set: x_size, x_set (digest) and x_sketch (k
    smallest, or all of it without k)."""
    import hashlib

    have: dict[int, np.ndarray] = {}
    for batch in batches:
        at = batch.schema.get_field_index("x_text")
        size, digest, lists, ends = [], [], [], [0]
        for t in batch.column(at):
            raw = t.as_py()
            s = shingles(raw, width, have) if raw else np.zeros(0, np.int64)
            size.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            lists.append(s if k is None else s[:k])
            ends.append(ends[-1] + len(lists[-1]))
        values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        rest = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in rest] + [
                pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))],
            names=[batch.schema.names[i] for i in rest] + ["x_size", "x_set", "x_sketch"])


def with_sets(docs: DataFrame, width: int, k: int | None) -> DataFrame:
    """``docs`` (with x_text as UTF-8 binary) with its set in place of the text."""
    schema = T.StructType(docs.drop("x_text").schema.fields + [
        T.StructField("x_size", T.LongType()), T.StructField("x_set", T.BinaryType()),
        T.StructField("x_sketch", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(lambda it: _sets(it, width, k), schema)


def safe_overlap(k: int, threshold: float) -> int:
    """Values of the union's bottom k that two sets at the threshold share, but
    for a chance of MISS: draws of k, taken as independent."""
    chance = [math.comb(k, i) * threshold ** i * (1 - threshold) ** (k - i) for i in range(k + 1)]
    return max(n for n in range(k + 1) if sum(chance[:n]) <= MISS)


def safe_neighbours(k: int, threshold: float) -> int:
    """The same for neighbours of the union's bottom k that both sets hold."""
    chance = {(0, 0): 1.0}  # (last one shared, neighbours so far)
    for _ in range(k):
        after: dict[tuple[int, int], float] = {}
        for (last, n), p in chance.items():
            after[1, n + last] = after.get((1, n + last), 0.0) + p * threshold
            after[0, n] = after.get((0, n), 0.0) + p * (1 - threshold)
        chance = after
    counts = [sum(p for (_, n), p in chance.items() if n == i) for i in range(k)]
    return max(n for n in range(k) if sum(counts[:n]) <= MISS)


def prefix_length(n: int, k: int, need: int, threshold: float) -> int:
    """How many of its rarest retained values a node of set size n indexes."""
    if n > k:
        return k - need + 1
    own = n - int(np.ceil(threshold * n - 1e-9)) + 1
    # A partner larger than k keeps at least k - (1-t)*k/t of the values.
    least = int(np.floor(k - (1 - threshold) * k / threshold))
    return own if n < np.floor(threshold * (k + 1)) else max(own, n - least + 1)


def indexed_values(nodes: DataFrame, k: int, need: int, threshold: float) -> DataFrame:
    """(value, node, size, score) of every node's rarest entries (retained
    values, or pairs of neighbours) that another node has too. Rarity is an
    entry's exact number of nodes; score sums these, so it is highest for the
    most typical node of a group."""
    near = safe_neighbours(k, threshold)
    some = nodes.where(F.col("x_size") <= int(k / threshold)) if near else nodes
    each = some.select("node", "x_size", F.lit(False).alias("pair"), F.explode("x_sketch").alias("value"))
    if near:
        two = F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: F.xxhash64(
            F.get("x_sketch", i), F.get("x_sketch", i + 1), F.lit(2)))
        each = each.unionByName(nodes.where(F.col("x_size") > k).select(
            "node", "x_size", F.lit(True).alias("pair"), F.explode(two).alias("value")))
    counts = each.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    most = F.when(F.col("pair"), F.lit(k - near)).when(F.col("x_size") > k, F.lit(k - need + 1)).otherwise(F.get(
        F.array(*[F.lit(prefix_length(n, k, need, threshold)) for n in range(k + 1)]),
        F.col("x_size").cast("int")))
    entries = F.when(F.col("pair"), F.lit(k - 1)).otherwise(F.least(F.col("x_size"), F.lit(k)))
    # The entries that no other node has are the rarest of all, and of no use.
    mine = Window.partitionBy("node", "pair")
    held = each.join(counts, "value").withColumns({
        "place": F.row_number().over(mine.orderBy("n", "value")), "met": F.count(F.lit(1)).over(mine),
        "score": F.sum("n").over(mine)})
    return held.where(F.col("place") <= most - (entries - F.col("met"))).select(
        "value", "node", F.col("x_size").alias("size"), "score")


def _compatible(a: Column, b: Column, percent: int) -> Column:
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def confirm(pairs: DataFrame, nodes: DataFrame, full: DataFrame, width: int, k: int,
            percent: int, need: int | None = None) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold: first the estimate from the
    sketches' union (``need`` of ``k`` values agreeing pass, as for the lists), then the
    full sets (sketches of small sets are full)."""
    need = safe_overlap(k, percent / 100) if need is None else need
    sk = nodes.select("node", "x_size", "x_sketch")
    two = pairs.join(sk.withColumnsRenamed({"node": "b", "x_size": "n_b", "x_sketch": "s_b"}), "b").join(
        sk.withColumnsRenamed({"node": "a", "x_size": "n_a", "x_sketch": "s_a"}), "a")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    rated = two.where(_compatible(F.col("n_a"), F.col("n_b"), percent)).select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("both"),
        (common / F.size(union)).alias("estimate"))
    rated = materialise(rated.where(
        F.when((F.col("n_a") <= k) & (F.col("n_b") <= k),
               100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both")))
        .otherwise(F.col("estimate") >= need / k)), "estimated")
    small = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    large = rated.where(~small).select("a", "b")
    whole = full_sets(large, full, width)
    joined = large.join(whole.withColumnsRenamed({"node": "b", "set": "w_b"}), "b").join(
        whole.withColumnsRenamed({"node": "a", "set": "w_a"}), "a").select(
        "a", "b", F.size("w_a").alias("n_a"), F.size("w_b").alias("n_b"),
        F.size(F.array_intersect("w_a", "w_b")).alias("both"))
    sure = joined.where(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both")))
    return materialise(rated.where(small).select("a", "b").unionByName(sure.select("a", "b")), "confirmed")


def full_sets(pairs: DataFrame, full: DataFrame, width: int) -> DataFrame:
    """(node, set) of the nodes in ``pairs``, computed anew from their texts."""
    wanted = materialise(pairs.select(F.col("a").alias("node")).unionByName(
        pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    n = wanted.count()
    # 8 bytes a row: bounded by BROADCAST_ROWS, otherwise a shuffled join.
    texts = full.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted.hint("merge"),
                      "node", "left_semi")
    return materialise(with_sets(texts.select("node", "x_text"), width, None).select(
        "node", F.col("x_sketch").alias("set")), "sets")


def link_classes(rows: DataFrame, width: int = 2, percent: int = 80, k: int = K) -> DataFrame:
    """(x_set, root): component of every set that is linked to another one.
    ``rows``: x_row, x_text (binary), x_size, x_set, x_sketch."""
    threshold = percent / 100
    need = safe_overlap(k, threshold)
    # Of equal sets the first row is the node; the others are set aside.
    named = rows.where("x_size > 0").select("x_row", "x_set")
    same = named.groupBy("x_set").agg(F.min("x_row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    extra = materialise(named.join(same, "x_set").where("x_row <> first").select("x_row"), "extra")
    nodes = without(rows.where("x_size > 0").select("x_row", "x_set", "x_size", "x_sketch"), extra,
                    "x_row").withColumnRenamed("x_row", "node")
    full = rows.select(F.col("x_row").alias("node"), "x_text")
    values = indexed_values(nodes, k, need, threshold)
    lists = materialise(values, "values")
    # The most typical node of a list, for the first comparisons.
    heads = lists.groupBy("value").agg(F.max(F.struct(
        "score", (-F.col("node")).alias("neg"), "size")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(lists.join(heads.select(
        "value", (-F.col("head.neg")).alias("head"), F.col("head.size").alias("head_size")), "value"), "lists")
    star = materialise(met.where(
        (F.col("node") != F.col("head")) & _compatible(F.col("size"), F.col("head_size"), percent)).select(
            F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct(), "star")
    links = confirm(star, nodes, full, width, k, percent, need)
    roots = components(links)
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    roots = materialise(roots.join(sizes, "root"), "roots")
    # What still lies in different components of one list.
    at = met.join(roots, "node", "left").select(
        "value", "node", "size", F.coalesce("root", "node").alias("root"),
        (F.coalesce("members", F.lit(1)) > BIG).alias("big"))
    mixed = at.groupBy("value").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2")
    rest = materialise(at.join(mixed.select("value"), "value"), "mixed")
    links = links.unionByName(_within_lists(rest.where("NOT big"), star, nodes, full, width, k, percent, need))
    links = links.unionByName(_against_big(rest, roots, full, width, percent))
    return nodes.select("node", "x_set").join(components(links), "node").select("x_set", "root")


def _within_lists(rest: DataFrame, done: DataFrame, nodes: DataFrame, full: DataFrame, width: int,
                  k: int, percent: int, need: int) -> DataFrame:
    """Links between nodes of different small components that share a list.

    A list is split by size class (partners are of one class or of neighbours),
    and lists with the same members count once. The members of short lists are
    paired, at most SHORT pairs a member; longer ones meet in blocks of full
    sets, and a block gives no more links than it joins components."""
    step = float(np.log(100 / percent))
    own = F.floor(F.log("size") / step).cast("long")
    each = rest.withColumn("own", own).select(
        "value", "node", "size", "root", "own", F.explode(F.array("own", F.col("own") - 1)).alias("cls"))
    # Members are told by their number and two 64-bit hashes of all of them.
    lists = each.groupBy("value", "cls").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.min("own").alias("least"), F.bit_xor(F.xxhash64("node")).alias("h1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")).where("lo < hi AND least = cls")
    kept = lists.groupBy("cls", "n", "h1", "h2").agg(F.min("value").alias("value")).drop("h1", "h2")
    held = materialise(each.join(kept, ["value", "cls"]), "held")
    short = held.where(F.col("n") <= SHORT)
    left = short.where("own = cls").select("value", "cls", F.col("node").alias("a"), F.col("size").alias("n_1"),
                                           F.col("root").alias("r_1"))
    right = short.select("value", "cls", F.col("node").alias("b"), F.col("size").alias("n_2"),
                         F.col("root").alias("r_2"))
    # The smaller set is a (ties by node); b is of a's size class or the next.
    cross = left.join(right, ["value", "cls"]).where(
        (F.col("r_1") != F.col("r_2"))
        & ((F.col("n_1") < F.col("n_2")) | ((F.col("n_1") == F.col("n_2")) & (F.col("a") < F.col("b"))))
        & (100 * F.col("n_1") >= percent * F.col("n_2")))
    pairs = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = confirm(pairs.join(done, ["a", "b"], "left_anti"), nodes, full, width, k, percent, need)
    return links.unionByName(_long_lists(held.where(F.col("n") > SHORT), full, width, percent))


def _long_lists(held: DataFrame, full: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that join components among the members of each list, block by block."""
    if held.isEmpty():
        return held.select(F.col("node").alias("a"), F.col("node").alias("b"))
    whole = full_sets(held.select(F.col("node").alias("a"), F.col("node").alias("b")), full, width)
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = held.where("own = cls").withColumn("i", mine).withColumn("j", every)
    right = held.withColumn("j", mine).withColumn("i", every)
    left, right = (x.join(whole, "node").select(*[F.col(c).alias(f"{c}_{side}") for c in (
        "value", "cls", "i", "j", "node", "root", "set")]).toDF("value", "cls", "i", "j", "node", "root", "set")
        for x, side in ((left, "l"), (right, "r")))

    def meet(u: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.get(x, x) != x:
                x = top[x]
            return x

        if len(u) and len(m):
            nodes, roots = m["node"].to_list(), m["root"].to_list()
            for node, root, good in zip(u["node"], u["root"], _similar(u["set"], m["set"], percent)):
                for at in good:
                    one, two = find(int(root)), find(int(roots[at]))
                    if one != two:
                        top[one] = two
                        found.append((int(node), int(nodes[at])))
        return pd.DataFrame(found, columns=["a", "b"])

    keys = ("value", "cls", "i", "j")
    return materialise(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "a long, b long"), "met")


def _similar(some: pd.Series, those: pd.Series, percent: int) -> Iterator[np.ndarray]:
    """For each set of ``some`` the places in ``those`` of the sets that reach the threshold."""
    sizes = np.array([len(x) for x in those])
    codes, place = np.unique(np.concatenate(those.to_list()), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for s in some:
        at = np.searchsorted(codes, s)
        at = at[at < len(codes)]
        has = np.zeros(len(codes), bool)
        has[at[np.isin(codes[at], s)]] = True
        both = np.add.reduceat(has[place].astype(np.int64), starts)
        yield np.flatnonzero(100 * both >= percent * (sizes + len(s) - both))


def _against_big(rest: DataFrame, roots: DataFrame, full: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of nodes with big components they share a list with. One link joins
    a node to a component, so blocks of nodes meet blocks of members, and each
    gives at most one link a node: no pair is written but links."""
    big = rest.where("big").select("value", F.col("root").alias("to")).distinct()
    asks = materialise(rest.join(big, "value").where(
        (F.col("root") != F.col("to")) & (~F.col("big") | (F.col("root") > F.col("to")))).select(
            "node", "to").distinct(), "asks")
    if asks.isEmpty():
        return asks.select(F.col("node").alias("a"), F.col("node").alias("b"))
    meant = asks.groupBy("to").agg(F.count(F.lit(1)).alias("n_asks"))
    members = roots.join(meant, roots["root"] == meant["to"]).select(
        "to", F.col("node").alias("node"), "members", "n_asks")
    wanted = asks.select(F.col("node").alias("a"), F.col("node").alias("b")).unionByName(
        members.select(F.col("node").alias("a"), F.col("node").alias("b")))
    whole = full_sets(wanted, full, width)

    def blocks(n: str):
        return F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")

    def own(n: str):
        return F.pmod(F.xxhash64("node"), blocks(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    shape = members.select("to", "members", "n_asks").distinct()
    left = asks.join(shape, "to").withColumn("i", own("n_asks")).withColumn("j", every("members")).join(whole, "node")
    right = members.withColumn("j", own("members")).withColumn("i", every("n_asks")).join(whole, "node")

    def meet(u: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(u) and len(m):
            for node, good in zip(u["node"], _similar(u["set"], m["set"], percent)):
                if len(good):
                    found.append((int(m["node"].iloc[int(good[0])]), int(node)))
        return pd.DataFrame(found, columns=["a", "b"])

    # Aliased, as both sides hold columns of the same tables.
    left, right = (x.select(*[F.col(c).alias(f"{c}_{side}") for c in ("to", "i", "j", "node", "set")]).toDF(
        "to", "i", "j", "node", "set") for x, side in ((left, "l"), (right, "r")))
    return materialise(left.groupBy("to", "i", "j").cogroup(
        right.groupBy("to", "i", "j")).applyInPandas(meet, "a long, b long"), "met")


def mark_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2,
              percent: int = 80, carry: list[str] | None = None, k: int = K) -> DataFrame:
    """``carry`` columns (all by default) with n_shingles, component_id, kept
    and ``first_row`` (exactly one row of each component)."""
    small_batches(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    names = {c: f"c{i}_" for i, c in enumerate(carry)}
    rows = _rows(docs, id_col, text_col, width, k, names)
    keyed, least = _classes(rows, width, percent, k, list(names.values()))
    out = keyed.join(least.where("x_n > 1"), "x_class", "left")
    taken = list(carry)
    id_ = F.when(F.col("x_n").isNull(), F.col("x_id")).otherwise(F.col("x_least"))
    return out.select(
        *[F.col(a).alias(c) for c, a in names.items()],
        F.col("x_size").alias(free_name(taken, "n_shingles")), id_.alias(free_name(taken, "component_id")),
        F.col("x_id").eqNullSafe(id_).alias(free_name(taken, "kept")),
        F.coalesce(F.col("x_first.x_row") == F.col("x_row"), F.lit(True)).alias(free_name(taken, "first_row")))


def _rows(docs: DataFrame, id_col: str, text_col: str, width: int, k: int,
          names: dict[str, str]) -> DataFrame:
    """Rows with their text, set size, set digest and sketch, written once."""
    own = docs.select(*[F.col(c).alias(a) for c, a in names.items()], F.col(id_col).alias("x_id"),
                      F.col(text_col).cast("binary").alias("x_copy"),
                      F.monotonically_increasing_id().alias("x_row"))
    return materialise(with_sets(own.withColumn("x_text", F.col("x_copy")), width, k)
                       .withColumnRenamed("x_copy", "x_text"), "rows")


def _classes(rows: DataFrame, width: int, percent: int, k: int,
             carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their class (component, or set) and, per class, its size and
    its least id and row."""
    with scratch() as made:
        linked = link_classes(rows, width, percent, k)
    linked = materialise(linked, "linked")
    release(rows.sparkSession, made)
    # A class: the component's root, or the set itself if it has no link.
    keyed = rows.select(*carried, "x_id", "x_row", "x_size", "x_set").join(linked, "x_set", "left").withColumn(
        "x_class", F.when(F.col("x_size") == 0, F.concat(F.lit("r"), F.col("x_row")))
        .when(F.col("root").isNotNull(), F.concat(F.lit("n"), F.col("root")))
        .otherwise(F.concat(F.lit("s"), F.hex("x_set"))))
    keyed = materialise(keyed.drop("root", "x_set"), "classes")
    least = keyed.groupBy("x_class").agg(
        F.count(F.lit(1)).alias("x_n"), F.min("x_id").alias("x_least"),
        F.min(F.struct(F.col("x_id").isNull().alias("z"), "x_id", "x_row")).alias("x_first"))
    return keyed, least


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
              percent: int = 80) -> DataFrame:
    """One row of each component, with the columns of ``docs``."""
    small_batches(docs.sparkSession)
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    rows = _rows(docs, id_col, text_col, width, K, names)
    keyed, least = _classes(rows, width, percent, K, [])
    gone = materialise(keyed.join(least.where("x_n > 1"), "x_class").where(
        F.col("x_first.x_row") != F.col("x_row")).select("x_row"), "gone")
    return without(rows.select(*names.values(), "x_row"), gone, "x_row").select(
        *[F.col(a).alias(c) for c, a in names.items()])


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b
    ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS doc_id, a AS seen FROM l UNION
    SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen),
m AS (SELECT doc_id, min(seen) AS root FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id,
  w.doc_id = coalesce(m.root, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""
