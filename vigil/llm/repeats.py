"""Removal of long repeated byte strings by multi-document suffix sorting.

Every byte covered by a ``window``-byte string that also starts elsewhere, in
the same or another text, is removed. Three steps:

1. Texts are cut into segments. In every window the ``GRAM``-byte string with
   the smallest hash is its anchor, and a segment is a run of windows with one
   anchor place, so equal windows lie in segments of equal anchors. Only anchors
   that occur twice matter; segments with equal bytes are one string from here.
2. Strings of anchors shared by different strings are trimmed to the windows
   that can repeat: windows with nearly the same number of bytes before the anchor
   have most bytes in common, and where no other string of the anchor has these
   bytes, none of the windows stands elsewhere. What is left is dealt into
   buckets. A bucket's collection is suffix-sorted column by column: each round inserts one
   symbol per string (the next from its end), updating the collection's
   Burrows-Wheeler transform and the common prefixes of neighbouring suffixes in
   sequential passes. A window whose suffix shares ``window`` bytes with a
   neighbour repeats.
3. Runs of repeating windows become spans of their texts, and the bytes between
   spans are hashed.

The rounds read and write the transform front to back; as a string is shorter
than ``window + window`` bytes and a bucket is bounded, these arrays stay small,
and what a corpus-wide construction would keep in external files is what Spark
keeps as buckets in its shuffle files.

Nothing is ever expanded into pairs. Copies of a whole text are set aside by
digest first and come back as removed; equal segments are counted. An anchor
with more than ``HOT`` different strings leaves the buckets for an exact
count of its windows by a 128-bit digest, which combines before the shuffle.

Defined cases: null text counts as empty; texts shorter than the window lose
nothing; repeated rows are copies of each other; an empty table gives an empty
result; further columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, free_name, materialise, small_batches

WINDOW = 200
GRAM = 80
#: Strings of a bucket on average, and most strings of one anchor in a bucket.
BUCKET_STRINGS = 600
HOT = 2000
#: Places of the anchor in a window that are screened by one key.
STEP = 16
#: Bytes that are cut together, and bits of a place among them.
TOGETHER = 1 << 22
PLACE_BITS = 24

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Cutter:
    """Cuts texts into segments; keeps the powers of its rolling hash."""

    def __init__(self, window: int, gram: int = GRAM):
        self.window, self.gram = window, min(gram, window)
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            made = []
            for base in (_BASE, _INVERSE):
                p = np.full(n, base, np.uint64)
                p[:1] = 1
                made.append(np.multiply.accumulate(p))
            self.up, self.down = made
        return self.up[:n], self.down[:n]

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, start, windows, ahead, anchor, string) of every segment; the
        anchor stands ``ahead`` bytes behind the start."""
        parts, owner, offset = [], [], []
        for i, t in enumerate(texts):  # long texts in parts that share all windows
            for o in range(0, max(1, len(t) - self.window + 1), TOGETHER):
                parts.append(t[o:o + TOGETHER + self.window - 1])
                owner.append(i)
                offset.append(o)
        done: list[tuple[np.ndarray, ...]] = []
        at = 0
        while at < len(parts):
            to, held = at, 0
            while to < len(parts) and (to == at or held + len(parts[to]) <= TOGETHER):
                held += len(parts[to])
                to += 1
            part, start, *rest = self._cut(parts[at:to])
            part = part + at
            done.append((np.array(owner, np.int64)[part], np.array(offset, np.int64)[part] + start, *rest))
            at = to
        if not done:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        return tuple(np.concatenate(x) for x in zip(*done))

    def _cut(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        b = np.frombuffer(b"".join(texts), np.uint8)
        n, k, wide = len(b), self.gram, self.window - self.gram + 1
        none = np.zeros(0, np.int64)
        if n < self.window:
            return (none,) * 6
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size)
        up, down = self._powers(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            gram = _mix((sums[k:] - sums[:-k]) * down[:n - k + 1])
        low = np.uint64((1 << PLACE_BITS) - 1)
        value = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        # Least value of every window: prefix and suffix minima of blocks.
        blocks = -(-len(value) // wide)
        full = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
        full[:len(value)] = value
        rows = full.reshape(blocks, wide)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - self.window + 1
        place = (np.minimum(behind[:count], ahead[wide - 1:wide - 1 + count]) & low).astype(np.int64)
        inside = np.arange(count) + self.window <= np.repeat(ends, size)[:count]
        first = inside.copy()
        first[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
        start = np.flatnonzero(first)
        if not len(start):
            return (none,) * 6
        stop = np.append(start[1:], count)  # windows outside any text end a run early
        seen = np.concatenate(([0], np.cumsum(inside)))
        windows = seen[stop] - seen[start]
        long = windows + self.window - 1
        with np.errstate(over="ignore"):
            string = _mix((sums[start + long] - sums[start]) * down[start] + long.astype(np.uint64))
        text = np.searchsorted(ends, start, side="right")
        return (text, start - (ends - size)[text], windows, place[start] - start,
                gram[place[start]].view(np.int64), string.view(np.int64))


def sort_columns(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a collection and the common prefix of each
    sorted suffix with the one before it. Symbols are bytes plus one, 0 ends a
    string; the suffixes start with the empty one of every string.

    Column-wise: before a round, ``row`` holds where each string's last inserted
    suffix x stands and ``symbol`` the byte c before it. The suffix cx belongs at
    the rank of that c among all c of the transform. Its neighbours begin with
    the nearest c before and behind, so its common prefixes are one more than the
    least common prefix on the way to those.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    width = int(size.max(initial=0))
    cells = np.zeros((m, width + 1), np.uint8)  # right-aligned behind a 0
    for i, s in enumerate(strings):
        cells[i, width + 1 - len(s):] = np.frombuffer(s, np.uint8) + 1
    bwt, lcp = cells[:, width].copy(), np.zeros(m, np.uint16)
    row, symbol = np.arange(m), bwt.copy()
    alive = np.flatnonzero(symbol)
    for done in range(1, width + 1):
        order = np.argsort(bwt, kind="stable")
        here = np.zeros(len(bwt), bool)
        here[row[alive]] = True
        rank = np.flatnonzero(here[order])
        alive = alive[np.lexsort((row[alive], symbol[alive]))]  # by rank
        old = order[rank]
        sign = bwt[old]
        before = order[rank - 1]
        has_before = (rank > 0) & (bwt[before] == sign)
        after = order[np.minimum(rank + 1, len(order) - 1)]
        has_after = (rank + 1 < len(order)) & (bwt[after] == sign)
        up = np.zeros(len(rank), np.uint16)
        up[has_before] = 1 + _least(lcp, before[has_before] + 1, old[has_before] + 1)
        down = 1 + _least(lcp, old[has_after] + 1, after[has_after] + 1)
        place = rank + (m - np.count_nonzero(bwt == 0))
        fresh = np.zeros(len(bwt) + len(rank), bool)
        fresh[place] = True
        stay = ~fresh
        grown = np.empty(len(fresh), np.uint8)
        grown[stay] = bwt
        common = np.empty(len(fresh), np.uint16)
        common[stay] = lcp
        common[place] = up
        common[place[has_after] + 1] = down
        symbol[alive] = cells[alive, width - done]
        grown[place] = symbol[alive]
        row[alive] = place
        bwt, lcp = grown, common
        alive = alive[symbol[alive] > 0]
        if not len(alive):
            break
    return bwt, lcp


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Least of values[start:stop] for each pair (start < stop)."""
    if not len(start):
        return np.zeros(0, values.dtype)
    by = np.argsort(-start, kind="stable")  # backwards: no span between pairs is read
    pairs = np.empty(2 * len(by), np.int64)
    pairs[0::2], pairs[1::2] = start[by], stop[by]
    out = np.empty(len(by), values.dtype)
    out[by] = np.minimum.reduceat(np.append(values, 0), pairs)[::2]
    return out


def repeating_windows(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For every string, which of its windows stand elsewhere in the collection."""
    bwt, lcp = sort_columns(strings)
    m = len(strings)
    twice = lcp >= window
    twice[:-1] |= twice[1:]
    order = np.argsort(bwt, kind="stable")
    back = np.empty(len(bwt), np.int64)
    back[order] = np.arange(len(bwt)) + m - np.count_nonzero(bwt == 0)
    size = np.array([len(s) for s in strings], np.int64)
    out = [np.zeros(max(0, n - window + 1), bool) for n in size]
    row = np.arange(m)
    for n in range(1, int(size.max(initial=0)) + 1):  # the suffix of n bytes of each string
        on = np.flatnonzero(size >= n)
        row[on] = back[row[on]]
        if n >= window:
            for i, hit in zip(on, twice[row[on]]):
                if hit:
                    out[i][size[i] - n] = True
    return out


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _by_size(keys: DataFrame, rows: DataFrame, on: str, how: str) -> DataFrame:
    """``rows`` filtered by ``keys`` (only column ``on``), broadcast only behind a
    count of them, at 8 bytes each."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys.hint("merge"), on, how)


def _with_spans(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``texts`` (row, text) joined with ``places`` (row and a list): texts
    without places leave before the shuffle."""
    touched = _by_size(places.select("row"), texts, "row", "left_semi")
    return touched.join(places.hint("merge"), "row")


def segments(texts: DataFrame, window: int) -> DataFrame:
    """(row, start, windows, ahead, anchor, string) of texts (row, text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(window)
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            held: list[bytes] = []
            first = 0
            for i in range(batch.num_rows):
                held.append(batch.column(1)[i].as_py())
                if i + 1 == batch.num_rows or sum(map(len, held[-1:])) + len(held) * 3000 > 2 * TOGETHER:
                    text, start, windows, ahead, anchor, string = cutter.cut(held)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[first:][text]), pa.array(start.astype(np.int32)),
                         pa.array(windows.astype(np.int32)), pa.array(ahead.astype(np.int32)),
                         pa.array(anchor), pa.array(string)],
                        names=["row", "start", "windows", "ahead", "anchor", "string"])
                    first, held = i + 1, []

    return texts.mapInArrow(run, "row long, start int, windows int, ahead int, anchor long, string long")


def string_bytes(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(anchor, string, ahead, body) of strings ``wanted`` (row, start, windows,
    ahead, anchor, string), cut from the texts that hold them."""
    places = wanted.groupBy("row").agg(F.collect_list(
        F.struct("start", "windows", "ahead", "anchor", "string")).alias("at"))
    held = _with_spans(texts, materialise(places, "places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            out: list[tuple[int, int, int, bytes]] = []
            for text, at in zip(batch.column(names.index("text")), batch.column(names.index("at"))):
                raw = text.as_py()
                for p in at.as_py():
                    s = p["start"]
                    out.append((p["anchor"], p["string"], p["ahead"], raw[s:s + p["windows"] + window - 1]))
            a, s, ahead, body = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(ahead, pa.int32()),
                 pa.array(body, pa.binary())], names=["anchor", "string", "ahead", "body"])

    return held.select("text", "at").mapInArrow(run, "anchor long, string long, ahead int, body binary")


def trimmed(bodies: DataFrame, window: int) -> DataFrame:
    """(anchor, string, skip, body) of strings with windows that can repeat, cut to
    them; ``skip`` bytes went in front.

    A window with l bytes before its anchor equals one of another string only if
    that has the same l bytes before and window - gram - l behind. For STEP values
    of l, the bytes that all their windows hold are one key; a key that a single
    string has rules out all of them. Equal hashes of different bytes keep more,
    never less.
    """
    gram = min(GRAM, window)
    slack = window - gram
    keys = []
    for least in range(0, slack + 1, STEP):
        behind = max(0, slack - least - STEP + 1)
        low = F.greatest(F.lit(least), F.col("ahead") - F.octet_length("body") + window)
        high = F.least(F.lit(least + STEP - 1), F.col("ahead"))
        common = F.substring("body", F.col("ahead") - least + 1, F.lit(least + gram + behind))
        keys.append(F.when(low <= high, F.struct(F.xxhash64("anchor", F.lit(least), common).alias("key"),
                                                 low.alias("low"), high.alias("high"))))
    each = bodies.select("anchor", "string", F.explode(F.array_compact(F.array(*keys))).alias("k")).select(
        "anchor", "string", "k.*")
    again = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    part = each.join(again, "key", "left_semi").groupBy("anchor", "string").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    skip = F.col("ahead") - F.col("high")
    return bodies.join(part, ["anchor", "string"]).select(
        "anchor", "string", skip.alias("skip"),
        F.substring("body", skip + 1, F.col("high") - F.col("low") + window).alias("body"))


def sorted_runs(bodies: DataFrame, strings: int, window: int) -> DataFrame:
    """(anchor, string, first, past): runs of repeating windows, by suffix
    sorting of every bucket."""
    buckets = max(64, -(-strings // BUCKET_STRINGS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        flags = repeating_windows(pdf["body"].tolist(), window)
        for a, s, skip, f in zip(pdf["anchor"], pdf["string"], pdf["skip"], flags):
            if f.any():
                found += [(a, s, int(x) + skip, int(y) + skip) for x, y in zip(*_runs_of(f))]
        return pd.DataFrame(found, columns=["anchor", "string", "first", "past"])

    return bodies.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy(
        "bucket").applyInPandas(run, "anchor long, string long, first int, past int")


def counted_runs(bodies: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many strings: every window by a digest,
    counted with partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                skip, raw = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                n = len(raw) - window + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * n, pa.int64()),
                     pa.array([batch.column(1)[i].as_py()] * n, pa.int64()),
                     pa.array(range(skip, skip + n), pa.int32()),
                     pa.array([hashlib.blake2b(raw[j:j + window], digest_size=16).digest() for j in range(n)],
                              pa.binary())], names=["anchor", "string", "first", "w"])

    each = bodies.mapInArrow(run, "anchor long, string long, first int, w binary")
    many = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
    return each.join(many, "w").select("anchor", "string", "first", (F.col("first") + 1).alias("past"))


def spans(texts: DataFrame, window: int) -> DataFrame:
    """(row, first, past): byte spans of ``texts`` (row, text) to remove; may
    overlap. Texts are distinct."""
    segs = materialise(segments(texts, window), "segments")
    shared = segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    found = materialise(segs.join(shared, "anchor"), "shared")
    strings = materialise(found.groupBy("anchor", "string").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "windows", "ahead")).alias("at")), "strings")
    # Strings that occur twice repeat whole.
    twice = strings.where("n > 1").select("anchor", "string")
    whole = found.join(twice, ["anchor", "string"]).select(
        "row", F.col("start").alias("first"), (F.col("start") + F.col("windows") + window - 1).alias("past"))
    # Others may share windows with the other strings of their anchor.
    mixed = strings.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.max(F.col("n") == 1).alias("single")).where("kinds > 1 AND single")
    open_ = materialise(strings.join(mixed, "anchor").select("at.*", "anchor", "string"), "open")
    bodies = materialise(string_bytes(texts, open_, window), "bodies")
    bodies = materialise(trimmed(bodies, window), "trimmed")
    hot = materialise(bodies.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(
        F.col("kinds") > HOT).select("anchor"), "hot")
    cool = _by_size(hot, bodies, "anchor", "left_anti")
    runs = sorted_runs(cool, cool.count(), window)
    if not hot.isEmpty():
        runs = runs.unionByName(counted_runs(_by_size(hot, bodies, "anchor", "left_semi"), window))
    runs = materialise(runs, "runs")
    part = found.join(runs.join(twice, ["anchor", "string"], "left_anti"), ["anchor", "string"]).select(
        "row", (F.col("start") + F.col("first")).alias("first"),
        (F.col("start") + F.col("past") + window - 1).alias("past"))
    return whole.unionByName(part)


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW,
                   carry: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """``carry`` columns (all by default) with n_bytes, n_removed, n_spans,
    kept_sha256 and, if asked for, kept_bytes (what is left, as binary)."""
    small_batches(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    names = {c: f"c{i}_" for i, c in enumerate(carry)}
    rows = docs.select(*[F.col(c).alias(a) for c, a in names.items()],
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    rows = materialise(rows.withColumns({
        "row": F.monotonically_increasing_id(), "n_bytes": F.octet_length("text").cast("long"),
        "sha": F.sha2("text", 256)}), "rows")
    copies = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("least")).where("n > 1")
    copied = materialise(rows.select("row", "sha").join(copies, "sha").select(
        "row", (F.col("row") != F.col("least")).alias("extra")), "copied")
    texts = _by_size(copied.where("extra").select("row"), rows.where(F.col("n_bytes") >= window)
                     .select("row", "text"), "row", "left_anti").select("row", "text")
    cover = spans(texts, window).groupBy("row").agg(F.collect_list(F.struct("first", "past")).alias("cover"))
    cover = materialise(cover.join(copied.select("row"), "row", "left_anti"), "cover")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text, cover_ in zip(*[batch.column(i) for i in range(3)]):
                raw = text.as_py()
                merged: list[list[int]] = []
                for s in sorted((x["first"], x["past"]) for x in cover_.as_py()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                left, at = [], 0
                for a, b in merged:
                    left.append(raw[at:a])
                    at = b
                rest = b"".join(left) + raw[at:]
                out.append((row.as_py(), len(raw) - len(rest), len(merged),
                            hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 5, kinds)],
                names=["row", "gone", "parts", "kept", "rest"])

    changed = _with_spans(rows.select("row", "text"), cover).select("row", "text", "cover").mapInArrow(
        run, "row long, gone long, parts long, kept string, rest binary")
    changed = materialise(changed, "changed")
    slim = rows if keep_text else rows.drop("text")
    out = slim.join(changed, "row", "left").join(
        copied.select("row", F.lit(True).alias("copy")), "row", "left")
    all_gone = F.col("copy") & (F.col("n_bytes") >= window)
    zero = F.lit(0).cast("long")
    new = {"n_bytes": F.col("n_bytes"),
           "n_removed": F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("gone", zero)),
           "n_spans": F.when(all_gone, F.lit(1).cast("long")).otherwise(F.coalesce("parts", zero)),
           "kept_sha256": F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(
               F.coalesce("kept", "sha"))}
    if keep_text:
        new["kept_bytes"] = F.when(all_gone, F.lit(b"")).when(
            F.col("kept").isNotNull(), F.col("rest")).otherwise(F.col("text"))
    return out.select(*[F.col(a).alias(c) for c, a in names.items()],
                      *[x.alias(free_name(carry, c)) for c, x in new.items()])
