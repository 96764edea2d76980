"""Quality rules: robust multivariate outliers per language and source.

Statistics of every text come from array functions inside one scan, without a
shuffle. The statistics, as transformed rates, form a vector per document; for
each (language, source) group a minimum-covariance-determinant estimate is
found by concentration steps. One step is two grouped aggregates: a histogram
of distances (which gives the radius that holds three quarters of the group)
and the moments inside it. Groups are only ever aggregated, so a source with a
third of all rows costs no more than its partial sums, and what the steps join
back is one row per group.

Languages and the whole table are fitted in the same steps, as groups of their
own. A group's moments are then drawn towards its language's, and those towards
the table's, with the weight n^2 / (n^2 + half_rows^2) on the own side: a source
of few rows is judged by its language, a large one by itself, without a size at
which the method goes on or off.

A document is rejected when its squared Mahalanobis distance from its group's
estimate exceeds the cut of a chi-squared with as many degrees, and at least
one of its rates is worse than the group's centre by more than its spread.

Defined cases: null or blank text has no words, zero statistics and
base_failed; null language or source form groups of their own; every document
that passes the base rule is judged, whatever its group's size; a group none of
whose rows lies in its mid half starts from all its rows; repeated rows get
equal verdicts; an empty table gives an empty result; further columns are carried along, and
result columns whose names clash get underscores.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir

from .common import free_name, materialise, small_or_plain, words

SYMBOLS = "[#*$%&|<>]"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Share of a group inside the estimate, and squared distance that rejects
#: (chi-squared with 4 degrees of freedom, upper tail about 1e-9).
INSIDE = 0.75
CUT = 50.0
#: Smallest standard deviation of each transformed rate that counts. Those of
#: the repeats are such that in a clean group 54 of 100 lines or 45 of 100 words
#: repeated pass the cut alone, and one line of three said again does not.
FLOOR = {"v1": 0.10, "v2": 0.25, "v3": 0.075, "v4": 0.0625}
VECTOR = list(FLOOR)
#: Sign of a worse value; 0: either direction.
WORSE = {"v1": 0, "v2": 1, "v3": 1, "v4": 1}
STEPS = 4
#: Rows at which a group's own estimate has half the weight.
HALF_ROWS = 30
#: Histogram bins a unit of ln(distance).
FINE = 32
#: E[d^2 | d^2 < q]/4 for 4 degrees of freedom at the 0.75 quantile, inverted:
#: brings the inner covariance back to that of the whole group.
CONSISTENT = 1.7185


def text_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with s_<name> for every name of BASE and s_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    out = docs.withColumn("s_w", words(F.col(text_col)))
    out = out.withColumn("s_h", F.when(F.size("s_w") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice("s_w", 1, F.size("s_w") - 2),
                    lambda x, i: F.xxhash64(x, F.get("s_w", i + 1), F.get("s_w", i + 2)))))
    # Only texts with some window twice are sorted by window.
    twice = F.size(F.array_distinct("s_h")) < F.size("s_h")
    out = out.withColumn("s_s", F.when(twice, F.array_sort(F.transform(
        "s_h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    out = out.withColumn("s_p", F.array_sort(F.transform(F.filter(
        "s_s", lambda x, i: F.coalesce(
            (x["h"] == F.get("s_s", i - 1)["h"]), F.lit(False)) | F.coalesce(
            (x["h"] == F.get("s_s", i + 1)["h"]), F.lit(False))), lambda x: x["p"])))
    covered = F.aggregate(
        F.transform("s_p", lambda p, i: F.least(F.lit(3), F.coalesce(
            F.get("s_p", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return out.withColumns({"s_lines_": lines}).withColumns({
        "s_n_words": F.size("s_w").cast("long"),
        "s_word_chars": F.aggregate("s_w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "s_n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "s_lines": F.size("s_lines_").cast("long"),
        "s_n_dup_lines": (F.size("s_lines_") - F.size(F.array_distinct("s_lines_"))).cast("long"),
        "s_n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("s_w", "s_h", "s_s", "s_p", "s_lines_")


def base_failed() -> Column:
    return (F.col("s_n_words") < 50) | (100 * F.col("s_n_repeat_words") > 50 * F.col("s_n_words"))


def vector() -> dict[str, Column]:
    """Transformed rates: logs of the mean word length and of symbols per hundred
    characters; shares of repeated lines and repeated words, whose logs would
    hardly tell a text with one line twice from one that repeats all."""

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {"v1": F.log1p(share("s_word_chars", "s_n_words")),
            "v2": F.log1p(100.0 * share("s_n_symbols", "s_word_chars")),
            "v3": share("s_n_dup_lines", "s_lines"), "v4": share("s_n_repeat_words", "s_n_words")}


def _moments(group: list[str], weight: Column) -> list[Column]:
    """Count, means and covariances of the rows with a true ``weight``."""
    x = {v: F.when(weight, F.col(v)) for v in VECTOR}
    return ([F.count(F.when(weight, 1)).alias("m_n")]
            + [F.avg(x[v]).alias(f"m_{v}") for v in VECTOR]
            + [F.covar_pop(x[a], x[b]).alias(f"c_{a}{b}")
               for a, b in combinations_with_replacement(VECTOR, 2)])


def _spread(model: DataFrame, scale: float) -> DataFrame:
    """Cholesky factor of each group's covariance (scaled, variances floored by
    adding to the diagonal) as columns l_<row><column>."""
    for j, b in enumerate(VECTOR):
        for a in VECTOR[j:]:
            done = VECTOR[:j]
            inner = F.coalesce(F.col(f"c_{b}{a}"), F.lit(0.0)) * scale
            if a == b:
                inner = inner + FLOOR[a] ** 2
            for k in done:
                inner = inner - F.col(f"l_{a}{k}") * F.col(f"l_{b}{k}")
            value = F.sqrt(F.greatest(inner, F.lit(FLOOR[a] ** 2 / 4))) if a == b else (
                inner / F.col(f"l_{b}{b}"))
            model = model.withColumn(f"l_{a}{b}", value)
    keep = [c for c in model.columns if not c.startswith("c_")]
    return model.select(*keep)


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution, from m_ and l_."""
    solved: dict[str, Column] = {}
    for a in VECTOR:
        y = F.col(a) - F.col(f"m_{a}")
        for k in solved:
            y = y - F.col(f"l_{a}{k}") * solved[k]
        solved[a] = y / F.col(f"l_{a}{a}")
    total = F.lit(0.0)
    for y in solved.values():
        total = total + y * y
    return total


def _same(a: str, b: str, names: list[str]) -> Column:
    """Null-safe equality of the columns ``a`` + name and ``b`` + name."""
    out = F.lit(True)
    for x in names:
        out = out & F.col(a + x).eqNullSafe(F.col(b + x))
    return out


def _renamed(df: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({f"g_{x}": prefix + x for x in names})


def _with_model(rows: DataFrame, model: DataFrame, names: list[str]) -> DataFrame:
    m = small_or_plain(_renamed(model, "h_", names))
    return rows.join(m, _same("g_", "h_", names), "left")


#: Levels of groups: 0 language and source, 1 language, 2 the whole table.
LEVELS = ["level", "lang", "source"]


def _levels(rows: DataFrame) -> DataFrame:
    """Every row once a level, with the keys of its group there."""
    none = F.lit(None).cast("string")
    lang, source = F.col("g_lang"), F.col("g_source")
    keys = [F.struct(F.lit(n).alias("level"), a.alias("lang"), b.alias("source"))
            for n, (a, b) in enumerate([(lang, source), (lang, none), (none, none)])]
    return rows.select(F.explode(F.array(*keys)).alias("k"), *VECTOR).select(
        *[F.col(f"k.{x}").alias(f"g_{x}") for x in LEVELS], *VECTOR)


def _drawn(model: DataFrame, half_rows: float) -> DataFrame:
    """Moments of the groups of level 0, drawn towards those of their language,
    which are drawn towards the table's."""
    moments = [c for c in model.columns if c[:2] in ("m_", "c_") and c != "m_n"]
    weight = F.pow("g_n", F.lit(2.0)) / (F.pow("g_n", F.lit(2.0)) + float(half_rows) ** 2)
    blend = {c: weight * F.col(c) + (1 - weight) * F.col(f"up_{c}") for c in moments}

    def level(n: int) -> DataFrame:
        return model.where(F.col("g_level") == n)

    def above(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*[F.col(f"g_{k}").alias(f"up_{k}") for k in keys],
                         *[F.col(c).alias(f"up_{c}") for c in moments])

    langs = level(1).crossJoin(F.broadcast(above(level(2)))).withColumns(blend)
    langs = small_or_plain(above(langs, "lang").checkpoint(eager=True))
    return level(0).join(langs, _same("g_", "up_", ["lang"])).withColumns(blend).select(
        "g_lang", "g_source", "g_n", *moments)


def fit_groups(rows: DataFrame, steps: int = STEPS, half_rows: float = HALF_ROWS) -> DataFrame:
    """Estimate of every group of ``rows`` (g_lang, g_source, v1..v4): minimum
    covariance determinant by group, language and table, where the start is the
    mid half of each rate, then ``steps`` concentration steps; the groups' drawn
    towards the wider ones' by size."""
    by = [f"g_{x}" for x in LEVELS]
    checkpoint_dir(rows.sparkSession)
    rows = _levels(rows)
    middle = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("g_n"),
        *[F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.75)), F.lit(2000)).alias(f"q_{v}")
          for v in VECTOR])
    middle = small_or_plain(_renamed(middle, "k_", LEVELS).checkpoint(eager=True))
    # Start: rows within the quartiles of at least three of the four rates.
    near = sum((F.col(v).between(F.col(f"q_{v}")[0], F.col(f"q_{v}")[1])).cast("int")
               for v in VECTOR) >= 3
    every = _moments(by, F.lit(True))
    first = rows.join(middle, _same("g_", "k_", LEVELS)).groupBy(*by).agg(
        *_moments(by, near), F.struct(*every).alias("every"))
    first = first.withColumns({c: F.when(F.col("m_n") > 0, F.col(c)).otherwise(F.col(f"every.{c}"))
                               for c in first.columns if c[:2] in ("m_", "c_")}).drop("every")
    model = _spread(first, 2.0)
    for n in range(steps):
        model = model.checkpoint(eager=True)
        placed = _with_model(rows, model, LEVELS).select(
            *by, *VECTOR, F.floor(F.log(_distance() + 1e-6) * FINE).cast("long").alias("bin"))
        counts = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
        radius = _radius(counts, by).checkpoint(eager=True)
        inside = placed.join(small_or_plain(radius), _same("g_", "r_", LEVELS)).where("bin <= r_bin")
        found = inside.groupBy(*by).agg(*every)
        model = found if n == steps - 1 else _spread(found, CONSISTENT)
    sizes = middle.select(*[f"k_{x}" for x in LEVELS], "g_n")
    model = model.join(sizes, _same("g_", "k_", LEVELS)).checkpoint(eager=True)
    return _spread(_drawn(model, half_rows), CONSISTENT).checkpoint(eager=True)


def _radius(counts: DataFrame, by: list[str]) -> DataFrame:
    """Smallest bin up to which a group holds the inner share; the bins of a
    group are bounded by the range of the logarithm, whatever its rows."""
    bins = F.array_sort(F.collect_list(F.struct("bin", "n")))
    g = counts.groupBy(*by).agg(bins.alias("b"), F.sum("n").alias("all"))
    found = F.aggregate(
        "b", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")),
        lambda a, x: F.struct(
            (a["seen"] + x["n"]).alias("seen"),
            F.when(a["seen"] < F.ceil(F.col("all") * INSIDE), x["bin"]).otherwise(a["bin"]).alias("bin")))
    return g.select(*[F.col(f"g_{x}").alias(f"r_{x}") for x in LEVELS], found["bin"].alias("r_bin"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", carry: list[str] | None = None,
          cut: float = CUT, half_rows: float = HALF_ROWS) -> DataFrame:
    """``carry`` columns (all by default) with the base statistics,
    base_failed, kept and the squared distance."""
    carry = docs.columns if carry is None else carry
    names = {c: f"c{i}_" for i, c in enumerate(carry)}
    own = docs.select(*[F.col(c).alias(a) for c, a in names.items()],
                      F.col(text_col).alias("s_text"), F.col(lang_col).cast("string").alias("g_lang"),
                      F.col(source_col).cast("string").alias("g_source"))
    stats = text_statistics(own, "s_text").drop("s_text").withColumns(vector())
    rows = materialise(stats, "statistics")
    model = fit_groups(rows.where(~base_failed()).select("g_lang", "g_source", *VECTOR), half_rows=half_rows)
    worse = F.lit(False)
    for v, sign in WORSE.items():
        off = F.col(v) - F.col(f"m_{v}")
        worse = worse | ((F.abs(off) if not sign else off * sign) > 3 * F.col(f"l_{v}{v}"))
    far = _distance()
    out = _with_model(rows, model, ["lang", "source"])
    verdict = ~base_failed() & ~F.coalesce(
        (far > cut) & worse, F.lit(False))
    taken = list(carry)
    found = {**{b: F.col(f"s_{b}") for b in BASE}, "base_failed": base_failed(),
             "kept": verdict, "distance": far}
    return out.select(*[F.col(a).alias(c) for c, a in names.items()],
                      *[x.alias(free_name(taken, c)) for c, x in found.items()])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source") -> DataFrame:
    out = judge(docs, text_col, lang_col, source_col)
    return out.where(F.col(out.columns[len(docs.columns) + 6])).select(*docs.columns)
