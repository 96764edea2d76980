"""URL filters by temporal list join.

List changes (an entry added or removed at a time) become validity intervals:
each change of an entry holds until the entry's next change. A capture is
looked up by its path prefix, its host and its domain, each with an as-of
join: equality on the key and the fetch time inside the interval. Intervals of
one entry never overlap, so a lookup adds no rows; captures of one very common
host are split by Spark's skew handling, as the interval side is small per key,
and where the whole list is small it is broadcast behind a count.

Defined cases: null or malformed urls have no host and match nothing; a null
fetch time matches nothing; of changes to one entry at one time, adding wins;
an interval holds from its start up to, not including, its end; repeated rows
get equal verdicts; an empty list or table works; further columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialise, small_or_plain

SCOPES = ["path", "host", "domain"]  # most specific first


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z]+://([^/:?#]+)", 1))


def domain_of(url: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(host_of(url), "([^.]+\\.[^.]+)$", 1)


def path_of(url: Column) -> Column:
    """Host and first path segment; empty without one."""
    first = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z]+://[^/?#]+/([^/?#]+)", 1)
    return F.when(first == "", "").otherwise(F.concat(host_of(url), F.lit("/"), first))


KEYS = {"path": path_of, "host": host_of, "domain": domain_of}


def intervals(changes: DataFrame) -> DataFrame:
    """(scope, key, since, until) of changes (scope, key, at, added)."""
    once = changes.where("key <> '' AND at IS NOT NULL").groupBy("scope", "key", "at").agg(
        F.max("added").alias("added"))
    until = F.lead("at").over(Window.partitionBy("scope", "key").orderBy("at"))
    return once.withColumn("until", until).where("added").select(
        "scope", "key", F.col("at").alias("since"), "until")


def screen(captures: DataFrame, changes: DataFrame, url_col: str = "url", at_col: str = "fetched_at",
           carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) with host, blocked, scope and since
    (of the most specific entry active at fetch time)."""
    carry = captures.columns if carry is None else carry
    names = {c: f"c{i}_" for i, c in enumerate(carry)}
    valid = materialise(intervals(changes), "intervals")
    rows = captures.select(*[F.col(c).alias(a) for c, a in names.items()],
                           F.col(at_col).alias("x_at"),
                           *[make(F.col(url_col)).alias(f"x_{s}") for s, make in KEYS.items()])
    for s in SCOPES:
        part = small_or_plain(valid.where(F.col("scope") == s).select(
            F.col("key").alias(f"k_{s}"), F.col("since").alias(f"s_{s}"), F.col("until").alias(f"u_{s}")))
        rows = rows.join(part, (F.col(f"x_{s}") == F.col(f"k_{s}")) & (F.col("x_at") >= F.col(f"s_{s}"))
                         & (F.col(f"u_{s}").isNull() | (F.col("x_at") < F.col(f"u_{s}"))), "left")
    scope = F.coalesce(*[F.when(F.col(f"k_{s}").isNotNull(), F.lit(s)) for s in SCOPES])
    new = {"host": F.col("x_host"), "blocked": scope.isNotNull(), "scope": scope,
           "since": F.coalesce(*[F.col(f"s_{s}") for s in SCOPES])}
    return rows.select(*[F.col(a).alias(c) for c, a in names.items()],
                       *[x.alias(free_name(carry, c)) for c, x in new.items()])


# The tables hold no list and no fetch times: both are derived from ``pages``
# by MD5, alike in Spark and SQL.
DAY = 86400


def _number(key: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(salt))), 1, 6), 16, 10).cast("long")


def derived_captures(pages: DataFrame) -> DataFrame:
    """``pages`` with fetched_at: a second of a year, drawn from the page."""
    key = F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))
    return pages.withColumn("fetched_at", _number(key, "|t") * 2 % F.lit(365 * DAY))


def derived_changes(pages: DataFrame) -> DataFrame:
    """Dated changes for about a quarter of the hosts, an eighth of the path
    prefixes and a sixteenth of the domains: added, removed, added again."""
    share = {"path": 8, "host": 4, "domain": 16}
    out = None
    for s in SCOPES:
        keys = pages.select(KEYS[s](F.col("url")).alias("key")).where("key <> ''").distinct()
        keys = keys.where(_number(F.col("key"), f"|{s}") % share[s] == 0)
        first = _number(F.col("key"), "|a") % (200 * DAY)
        gone = first + _number(F.col("key"), "|b") % (60 * DAY) + 1
        again = gone + _number(F.col("key"), "|c") % (60 * DAY) + 1
        one = keys.select(F.lit(s).alias("scope"), "key", F.explode(F.array(
            F.struct(first.alias("at"), F.lit(True).alias("added")),
            F.struct(gone.alias("at"), F.lit(False).alias("added")),
            F.struct(again.alias("at"), F.lit(True).alias("added")))).alias("x")).select(
            "scope", "key", "x.at", "x.added")
        out = one if out is None else out.unionByName(one)
    return out


def _sql_number(key: str, salt: str) -> str:
    return f"('0x' || substr(md5({key} || '{salt}'), 1, 6))::BIGINT"


def oracle() -> str:
    n = _sql_number
    parts = [f"""SELECT '{s}' AS scope, k AS key, unnest([1, 2, 3]) AS step,
      {n('k', '|a')} % (200 * 86400) AS a1, {n('k', '|b')} % (60 * 86400) + 1 AS a2,
      {n('k', '|c')} % (60 * 86400) + 1 AS a3
      FROM (SELECT DISTINCT {s} AS k FROM p WHERE {s} <> '') WHERE {n('k', '|' + s)} % {m} = 0"""
             for s, m in (("path", 8), ("host", 4), ("domain", 16))]
    joins = "\n".join(f"""LEFT JOIN v {s}_v ON {s}_v.scope = '{s}' AND {s}_v.key = p.{s}
      AND p.tm >= {s}_v.since AND (p.tm < {s}_v.until OR {s}_v.until IS NULL)""" for s in SCOPES)
    return f"""
WITH h AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/:?#]+)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z]+://[^/?#]+/([^/?#]+)', 1) AS seg FROM pages),
p AS (SELECT page_id, url, host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain,
    CASE WHEN seg = '' THEN '' ELSE host || '/' || seg END AS path,
    {n("coalesce(CAST(page_id AS VARCHAR), url, '')", '|t')} * 2 % (365 * 86400) AS tm FROM h),
c AS ({' UNION ALL '.join(parts)}),
t AS (SELECT scope, key, step, CASE step WHEN 1 THEN a1 WHEN 2 THEN a1 + a2 ELSE a1 + a2 + a3 END AS tm FROM c),
v AS (SELECT * FROM (SELECT scope, key, step, tm AS since, lead(tm) OVER (PARTITION BY scope, key ORDER BY tm) AS until
    FROM t) WHERE step <> 2)
SELECT p.page_id, p.url, p.tm AS fetched_at, p.host,
  coalesce(path_v.key, host_v.key, domain_v.key) IS NOT NULL AS blocked,
  coalesce(path_v.scope, host_v.scope, domain_v.scope) AS scope,
  coalesce(path_v.since, host_v.since, domain_v.since) AS since
FROM p
{joins}
"""
