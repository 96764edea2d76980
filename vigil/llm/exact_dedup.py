"""Exact deduplication with static binary-fuse filters per snapshot.

A snapshot is an immutable batch of documents. Its distinct digests are dealt
into buckets; each bucket gets a binary-fuse filter (8-bit fingerprints, about
9 bits a key). Digests of an incoming batch are first grouped among themselves,
then screened by the filter of their bucket. Positives join the exact bucket of
the snapshot, where all digest bytes, the byte length and a second hash of the
text are compared, so a filter's false positive never merges two texts.
Negatives never meet the snapshot again.

Only one row per digest and batch is ever shuffled to a bucket, so a group of
copies of any size costs one row there. The verdicts return to the rows by a
join on the digest whose large side Spark splits when it is skewed.

Defined cases: null text counts as empty, empty texts form one group; null ids
lose ties against any id; rows repeated in every column share a keep_id and
exactly one of them is kept; an empty table gives an empty result; any further
columns are carried along (clashing names of helper columns get underscores).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_name, materialise, release, scratch, without

#: Digests that one bucket's filter holds on average, and least buckets.
BUCKET_KEYS = 50_000
LEAST_BUCKETS = 64

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class FuseFilter:
    """Static 3-wise binary-fuse filter over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, segments: int, slots: np.ndarray):
        self.seed, self.segment, self.segments, self.slots = seed, segment, segments, slots

    @staticmethod
    def shape(n: int) -> tuple[int, int]:
        """Length of a segment (a power of two) and number of start segments."""
        segment = 4 if n <= 1 else min(1 << 18, 1 << int(np.log(n) / np.log(3.33) + 2.25))
        factor = 1.125 if n <= 1 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        return segment, max(1, int(-(-(n * factor) // segment)) - 2)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three slots (consecutive segments) and the fingerprint of each key."""
        with np.errstate(over="ignore"):
            h = _mix(keys.astype(np.uint64) + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15))
            start = ((h >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64)
            g = _mix(h ^ np.uint64(0xD6E8FEB86659FD93))
        mask = np.uint64(self.segment - 1)
        at = [(start + k) * self.segment + ((g >> np.uint64(18 * k)) & mask).astype(np.int64)
              for k in range(3)]
        return np.stack(at), ((h ^ (g >> np.uint64(55))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peels slots hit by a single key, round by round, then fills them in
        reverse; a seed whose graph does not peel is replaced by the next."""
        keys = np.unique(keys.astype(np.uint64))
        segment, segments = cls.shape(len(keys))
        seed = 0
        while True:
            seed += 1
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            at, mark = made.places(keys)
            hits = np.bincount(at.ravel(), minlength=len(made.slots))
            owner = np.zeros(len(made.slots), np.int64)  # xor of the keys of a slot
            index = np.arange(len(keys))
            for row in at:
                np.bitwise_xor.at(owner, row, index)
            rounds, left = [], len(keys)
            single = np.flatnonzero(hits == 1)
            while len(single):
                key, first = np.unique(owner[single], return_index=True)
                rounds.append((key, single[first]))
                left -= len(key)
                for row in at:
                    np.subtract.at(hits, row[key], 1)
                    np.bitwise_xor.at(owner, row[key], key)
                touched = np.unique(at[:, key])
                single = touched[hits[touched] == 1]
            if left:
                if seed % 10 == 0:
                    segments += 1
                continue
            for key, own in reversed(rounds):
                made.slots[own] = 0
                made.slots[own] = mark[key] ^ np.bitwise_xor.reduce(made.slots[at[:, key]], axis=0)
            return made

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at, mark = self.places(keys)
        return np.bitwise_xor.reduce(self.slots[at], axis=0) == mark


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def buckets_for(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_KEYS))


def best(found: DataFrame) -> DataFrame:
    """One row per digest: size of the group, and the row that stays (most code
    points, then smallest id, then first row)."""
    return found.groupBy("x_digest").agg(
        F.first("x_bytes").alias("x_bytes"), F.first("x_second").alias("x_second"),
        F.count(F.lit(1)).alias("x_n"),
        F.max(F.struct("x_points", (-F.col("x_id")).alias("x_neg"),
                       (-F.col("x_row")).alias("x_first"))).alias("x_best"))


def snapshot_filters(index: DataFrame) -> DataFrame:
    """A filter per bucket of a snapshot's index (x_digest, x_key, x_bucket)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(pdf["x_key"].to_numpy())
        return pd.DataFrame({"x_bucket": [pdf["x_bucket"].iloc[0]], "seed": [f.seed],
                             "segment": [f.segment], "segments": [f.segments],
                             "slots": [f.slots.tobytes()]})

    return index.select("x_bucket", "x_key").groupBy("x_bucket").applyInPandas(
        build, "x_bucket long, seed long, segment long, segments long, slots binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests of ``incoming`` that the filter of their bucket reports."""

    def probe(keys: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if own.empty or keys.empty:
            return keys[["x_digest"]].iloc[:0]
        f = own.iloc[0]
        filt = FuseFilter(int(f["seed"]), int(f["segment"]), int(f["segments"]),
                          np.frombuffer(f["slots"], np.uint8))
        return keys[["x_digest"]][filt.holds(keys["x_key"].to_numpy())]

    return (incoming.select("x_bucket", "x_key", "x_digest").groupBy("x_bucket")
            .cogroup(filters.groupBy("x_bucket")).applyInPandas(probe, "x_digest binary"))


def exact_groups(found: DataFrame, in_snapshot: Column) -> DataFrame:
    """Groups of equal digests over a snapshot and an incoming batch, found by
    filter, exact bucket and grouping of the new batch."""
    n = buckets_for(found.count())

    def indexed(rows: DataFrame) -> DataFrame:
        key = F.xxhash64("x_digest")
        return best(rows).withColumn("x_key", key).withColumn("x_bucket", F.pmod(key, F.lit(n)))

    index = materialise(indexed(found.where(in_snapshot)), "snapshot")
    fresh = materialise(indexed(found.where(~in_snapshot)), "incoming")
    positive = fresh.join(screen(fresh, snapshot_filters(index)), "x_digest", "left_semi")
    old = index.select("x_digest", F.col("x_bytes").alias("o_bytes"),
                       F.col("x_second").alias("o_second"), F.col("x_n").alias("o_n"),
                       F.col("x_best").alias("o_best"))
    same = (F.col("x_bytes") == F.col("o_bytes")) & (F.col("x_second") == F.col("o_second"))
    both = materialise(positive.join(old, "x_digest").where(same), "matched")
    merged = both.select("x_digest", (F.col("x_n") + F.col("o_n")).alias("x_n"),
                         F.greatest("x_best", "o_best").alias("x_best"))
    alone = index.select("x_digest", "x_n", "x_best").unionByName(
        fresh.select("x_digest", "x_n", "x_best"))
    return alone.join(both.select("x_digest"), "x_digest", "left_anti").unionByName(merged)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                in_snapshot: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of every row (all by default), with keep_id,
    group_size, kept and text_sha256. ``in_snapshot`` tells the rows of the
    snapshot from incoming ones (default: by a hash of the id)."""
    carry = docs.columns if carry is None else carry
    names = {c: f"c{i}_" for i, c in enumerate(carry)}
    rows = _digests(docs, id_col, text_col, in_snapshot, names)
    groups = _copied(rows)
    out = rows.join(groups, "x_digest", "left")
    taken = list(carry)
    keep, size, kept, sha = (free_name(taken, c) for c in (
        "keep_id", "group_size", "kept", "text_sha256"))
    return out.select(
        *[F.col(a).alias(c) for c, a in names.items()],
        F.when(F.col("x_n").isNull(), F.col("x_id")).otherwise(-F.col("x_best.x_neg")).alias(keep),
        F.coalesce("x_n", F.lit(1).cast("long")).alias(size),
        F.coalesce(F.col("x_row") == -F.col("x_best.x_first"), F.lit(True)).alias(kept),
        F.lower(F.hex("x_digest")).alias(sha))


def _digests(docs: DataFrame, id_col: str, text_col: str, in_snapshot: Column | None,
             names: dict[str, str]) -> DataFrame:
    split = F.pmod(F.xxhash64(id_col), F.lit(2)) == 0 if in_snapshot is None else in_snapshot
    own = docs.select(*[F.col(c).alias(a) for c, a in names.items()], F.col(id_col).alias("x_id"),
                      split.alias("x_old"), F.coalesce(F.col(text_col), F.lit("")).alias("x_text"))
    return materialise(
        own.withColumn("x_body", normalised(F.col("x_text"))).select(
            *names.values(), "x_id", "x_old",
            F.unhex(F.sha2(F.encode("x_body", "UTF-8"), 256)).alias("x_digest"),
            F.octet_length("x_body").cast("long").alias("x_bytes"),
            F.xxhash64("x_body").alias("x_second"),
            F.length("x_text").cast("long").alias("x_points"),
            F.monotonically_increasing_id().alias("x_row")), "digests")


def _copied(rows: DataFrame) -> DataFrame:
    """(x_digest, x_n, x_best) of groups with more than one row."""
    found = rows.select("x_id", "x_old", "x_digest", "x_bytes", "x_second", "x_points", "x_row")
    with scratch() as made:
        groups = exact_groups(found, F.col("x_old")).where(F.col("x_n") > 1)
        spark = rows.sparkSession
    groups = materialise(groups, "groups")
    release(spark, made)
    return groups


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``. Texts are not shuffled
    but for very many copies: the rows that go are found first."""
    names = {c: f"c{i}_" for i, c in enumerate(docs.columns)}
    rows = _digests(docs, id_col, text_col, None, names)
    gone = materialise(rows.select("x_digest", "x_row").join(_copied(rows), "x_digest").where(
        F.col("x_row") != -F.col("x_best.x_first")).select("x_row"), "gone")
    return without(rows, gone, "x_row").select(*[F.col(a).alias(c) for c, a in names.items()])


def records(filters: DataFrame) -> Iterator[FuseFilter]:
    """The filters of a snapshot as objects (tests and inspection)."""
    for r in filters.toLocalIterator():
        yield FuseFilter(r["seed"], r["segment"], r["segments"], np.frombuffer(r["slots"], np.uint8))


ORACLE = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS body FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id) = 1 AS kept,
  sha256(body) AS text_sha256
FROM n
"""
