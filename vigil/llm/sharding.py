"""Sharding by a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in an order of its own:
start and stride come from hashes of its name, and a stride below a prime visits
every slot. Shards take turns; each claims the first slot it prefers that is
still free, until the table is full. Shares of the table then differ by one
slot at most, and adding or removing a shard moves few keys besides its own.

The turns are one ``aggregate`` over a row; the table has as many rows as the
prime, at least SLOTS_A_SHARD for each shard named, so it is broadcast, and placing
a key is a hash, a remainder and a lookup. Filling takes time that grows with the
square of the slots: pass fewer ``slots`` for thousands of shards. Only DataFrame
functions run.

A key that holds many rows would fill its shard; ``spread`` deals the rows of
each key to that many places, by a second key of the row.

Defined cases: a null id places the row by its ``fallback`` columns (nulls
count as empty); repeated rows share a shard; repeated shard names count once; more
shards than slots, or none, are an error; an empty table gives an empty
result; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialise

SHARDS = 16
#: At least this many slots a shard keep shares within one percent.
SLOTS_A_SHARD = 128


def prime_from(n: int) -> int:
    """Smallest prime from n on."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def shard_names(spark: SparkSession, n: int = SHARDS) -> DataFrame:
    return spark.range(n).select(F.format_string("shard-%03d", "id").alias("shard"))


def number(key: Column, salt: str, digits: int = 8) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, digits), 16, 10).cast("long")


def fill(shards: DataFrame, slots: int) -> DataFrame:
    """(slot, shard): the filled table. ``shards`` is a bounded list of names
    (column shard), ``slots`` a prime above their number."""
    prefs = F.struct("shard", (number(F.col("shard"), "|o") % slots).alias("o"),
                     (number(F.col("shard"), "|s") % (slots - 1) + 1).alias("s"))
    # One row: the shard names in order, at most one per slot.
    row = shards.select("shard").distinct().agg(F.sort_array(F.collect_list(prefs)).alias("p")).select(
        "p", F.size("p").alias("n"))
    start = F.struct(F.array_repeat(F.lit(-1), slots).alias("own"),
                     F.array_repeat(F.lit(0).cast("long"), F.col("n")).alias("next"))

    def turn(state: Column, t: Column) -> Column:
        who = (t % F.col("n")).cast("int")
        pref = F.get("p", who)
        free = F.filter(F.sequence(F.get(state["next"], who), F.lit(slots - 1).cast("long")),
                        lambda j: F.get(state["own"], ((pref["o"] + j * pref["s"]) % slots).cast("int")) < 0)

        def claim(j: Column) -> Column:
            slot = ((pref["o"] + j * pref["s"]) % slots).cast("int")
            return F.struct(
                F.concat(F.slice(state["own"], F.lit(1), slot), F.array(who),
                         F.slice(state["own"], slot + 2, F.lit(slots))).alias("own"),
                F.concat(F.slice(state["next"], F.lit(1), who), F.array(j + 1),
                         F.slice(state["next"], who + 2, F.col("n"))).alias("next"))

        return F.transform(F.slice(free, 1, 1), claim)[0]

    filled = row.where("n > 0").withColumn("t", F.aggregate(
        F.sequence(F.lit(0), F.lit(slots - 1)), start, turn))
    return filled.select("p", F.posexplode("t.own").alias("slot", "who")).select(
        "slot", F.get("p", F.col("who"))["shard"].alias("shard"))


def place(docs: DataFrame, table: DataFrame, slots: int, id_col: str = "doc_id",
          fallback: tuple[str, ...] = (), spread: int = 1, second: Column | None = None,
          carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) with slot and shard. ``table`` has
    ``slots`` rows, a fixed bound, and is broadcast."""
    carry = docs.columns if carry is None else carry
    names = {c: f"c{i}_" for i, c in enumerate(carry)}
    other = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fallback])
    key = F.coalesce(F.col(id_col).cast("string"), other if fallback else F.lit(""))
    if spread > 1 and second is not None:
        key = F.concat(key, F.lit("#"), (number(F.coalesce(second.cast("string"), F.lit("")), "") % spread).cast("string"))
    rows = docs.select(*[F.col(c).alias(a) for c, a in names.items()],
                       (number(key, "") % slots).cast("int").alias("x_slot"))
    out = rows.join(F.broadcast(table.select(F.col("slot").alias("t_slot"), F.col("shard").alias("t_shard"))),
                    F.col("x_slot") == F.col("t_slot"), "left")
    return out.select(*[F.col(a).alias(c) for c, a in names.items()],
                      F.col("x_slot").alias(free_name(carry, "slot")),
                      F.col("t_shard").alias(free_name(carry, "shard")))


def placement(docs: DataFrame, shards: DataFrame | None = None, slots: int | None = None,
              **how: object) -> DataFrame:
    """Fills a table for ``shards`` (default: SHARDS names) and places ``docs``."""
    names = shard_names(docs.sparkSession) if shards is None else shards.select("shard").distinct()
    n = SHARDS if shards is None else names.count()
    slots = slots or prime_from(SLOTS_A_SHARD * n)
    if not 0 < n <= slots:
        raise ValueError(f"{n} shards do not fit {slots} slots")
    return place(docs, materialise(fill(names, slots), "slots"), slots, **how)


def write_shards(placed: DataFrame, path: str, files: int = 4) -> None:
    """One folder per shard, its rows dealt to ``files`` writers."""
    salted = placed.withColumn("x_file", F.pmod(F.xxhash64(*placed.columns), F.lit(files)))
    salted.repartition("shard", "x_file").drop("x_file").write.partitionBy("shard").parquet(path)


def oracle(n: int = SHARDS, slots: int | None = None) -> str:
    m = slots or prime_from(SLOTS_A_SHARD * n)
    h = "('0x' || substr(md5(name || '{}'), 1, 8))::BIGINT"
    return f"""
WITH RECURSIVE s AS (SELECT i, printf('shard-%03d', i) AS name FROM range({n}) r(i)),
p AS (SELECT list({h.format('|o')} % {m} ORDER BY i) AS o, list({h.format('|s')} % ({m} - 1) + 1 ORDER BY i) AS k FROM s),
f AS (
  SELECT 0 AS t, list_transform(range({m}), lambda x: -1) AS own, list_transform(range({n}), lambda x: 0) AS nxt,
    -1::BIGINT AS slot
  UNION ALL
  SELECT t + 1, list_transform(own, lambda x, i: CASE WHEN i - 1 = (o[t % {n} + 1] + j * k[t % {n} + 1]) % {m} THEN t % {n} ELSE x END),
    list_transform(nxt, lambda x, i: CASE WHEN i - 1 = t % {n} THEN j + 1 ELSE x END),
    (o[t % {n} + 1] + j * k[t % {n} + 1]) % {m}
  FROM (SELECT f.*, p.*, list_min(list_filter(range(nxt[t % {n} + 1], {m}),
      lambda j: own[(o[t % {n} + 1] + j * k[t % {n} + 1]) % {m} + 1] < 0)) AS j FROM f, p WHERE t < {m})),
w AS (SELECT slot, (t - 1) % {n} AS i FROM f WHERE t > 0),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), coalesce(source, '') || chr(1) ||
    coalesce(lang, '') || chr(1) || coalesce(CAST(n_chars AS VARCHAR), ''))), 1, 8))::BIGINT % {m} AS INTEGER) AS slot FROM documents)
SELECT d.doc_id, d.slot, s.name AS shard FROM d JOIN w ON w.slot = d.slot JOIN s ON s.i = w.i
"""
