"""Mixing sources to target weights by iterative proportional fitting.

Documents fall in cells (source, language, topic). Raking multiplies the token
weights of the cells until the weights of every source, language and topic
reach their targets. The raked weights over the tokens at hand give relative
sampling rates; one common factor brings the expected tokens to the budget, with
rates of scarce cells capped at one and the rest raised in turn. Every document
is then kept or not by comparing its cell's probability with a number drawn
from its id, so the sample is the same in every run and for any partitioning.

Only the cell table (one row per cell, made by partial sums) is iterated, as
grouped sums and joins; nothing about single documents is gathered, and no
group of documents ever meets in a task, however large a source is.

Targets that no weights can meet together (a source in one language whose
target is not the language's) are an ordinary case: tempering by different
powers makes them. Rounds then end once a full round leaves every factor as it
was, and the last raked weights are used: topics hold, the other margins are as
near as the rounds bring them. Whatever ends the rounds (``MOST_ROUNDS`` too,
for margins that only a limit meets), the remaining gap of every margin is
measured, put in ``gaps`` and, if it is more than rounding, given as a warning.

Defined cases: null source, language or topic are categories of their own; null
or blank text has no tokens, and a cell without tokens keeps its documents
(probability 1); documents with a null id draw from their text; rows repeated
are kept or dropped together; an empty table gives an empty result; further
columns are carried along.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir

from .common import free_name, materialise, small_or_plain

DIMS = ["source", "lang", "topic"]
#: Targets by default: shares proportional to tokens to these powers.
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.7}
#: Share of all tokens that the sample should hold.
BUDGET = 0.5
TOLERANCE = 1e-10
MOST_ROUNDS = 200
#: Relative gap of a margin that counts as not met.
MET = 1e-6


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def form_topic(text: Column) -> Column:
    """Topic by form of the whole text: technical (digits and symbols for 2 % of
    its characters), dialogue (quotes and ?! for 0.4 %), else prose."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    return F.when(50 * F.regexp_count(t, F.lit("[0-9#*$%&|<>{}=@_]")) > size, "technical").when(
        250 * F.regexp_count(t, F.lit('["?!]')) > size, "dialogue").otherwise("prose")


def _targets(cells: DataFrame, dim: str, shares: dict | None) -> DataFrame:
    """(t_<dim>, goal): target share of every category at hand."""
    margin = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).where("n > 0")
    if shares is None:
        part = margin.withColumn("part", F.pow("n", F.lit(TEMPER[dim])))
    else:
        part = margin.withColumn("part", F.element_at(
            F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col(dim)).cast("double"))
        part = part.where("part > 0")
    total = part.agg(F.sum("part")).first()[0] or 1.0
    return part.select(F.col(dim).alias(f"t_{dim}"), (F.col("part") / total).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` with their raked weight (a share of one). A round scales the
    weights to each margin in turn; rounds go on until the margins hold or, with
    some of them still off, a round's factors are those of the round before."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(total))).withColumns(
        {f"f_{dim}": F.lit(0.0) for dim in targets})
    for _ in range(MOST_ROUNDS):
        now = now.withColumns({"off": F.lit(0.0), "change": F.lit(0.0)})
        for dim, goal in targets.items():
            sums = now.groupBy(F.col(dim).alias("m_" + dim)).agg(F.sum("weight").alias("sum"))
            # Written, or plan and constraints would grow with every margin.
            factor = materialise(sums.join(goal, F.col("m_" + dim).eqNullSafe(F.col("t_" + dim))).select(
                "m_" + dim, F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor")),
                "factor")
            now = now.join(factor, F.col(dim).eqNullSafe(F.col("m_" + dim)), "left").withColumns({
                "weight": F.col("weight") * F.coalesce("factor", F.lit(0.0)),
                "off": F.greatest("off", F.coalesce(F.abs(F.col("factor") - 1), F.lit(0.0))),
                "change": F.greatest("change", F.coalesce(F.abs(F.col("factor") - F.col(f"f_{dim}")), F.lit(0.0))),
                f"f_{dim}": F.col("factor")}).drop("m_" + dim, "factor")
        now = materialise(now, "raked")
        worst, change = now.agg(F.max("off"), F.max("change")).first()
        now = now.drop("off", "change")
        # Factors that stay with gaps left: no weights meet these margins together.
        if worst is None or worst < TOLERANCE or (change < TOLERANCE and worst > MET):
            break
    return now.drop(*[f"f_{dim}" for dim in targets])


def remaining_gaps(raked: DataFrame, targets: dict[str, DataFrame]) -> dict[str, float]:
    """By margin, the largest difference of a category's weight from its target,
    as a share of the target."""
    out = {}
    for dim, goal in targets.items():
        sums = raked.groupBy(dim).agg(F.sum("weight").alias("sum"))
        out[dim] = goal.join(sums, F.col(dim).eqNullSafe(F.col(f"t_{dim}"))).agg(
            F.max(F.abs(F.col("sum") / F.col("goal") - 1))).first()[0] or 0.0
    return out


def calibrate(raked: DataFrame, budget: float) -> DataFrame:
    """``raked`` with the probability of each cell. The common factor rises from
    that without caps: cells it fills are capped and the rest of the budget is
    dealt anew to the others, until no more cells are filled."""
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    live = (F.col("tokens") > 0) & (F.col("weight") > 0)
    factor, filled = 0.0, -1
    while total:
        full = live & (F.col("weight") * factor >= F.col("tokens"))
        n, tokens, rest, edge = raked.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("tokens"))),
            F.sum(F.when(live & ~full, F.col("weight"))),
            F.max(F.when(live, F.col("tokens") / F.col("weight")))).first()
        if n == filled or rest is None:
            factor = factor if rest else float(edge or 1.0)
            break
        factor, filled = max(factor, (budget * total - (tokens or 0)) / rest), n
    return raked.withColumn("probability", F.when(F.col("tokens") == 0, 1.0).otherwise(
        F.least(F.lit(1.0), F.col("weight") * factor / F.col("tokens"))))


def draw(id_: Column, text: Column) -> Column:
    """A number in [0, 1) from 52 bits of the id's MD5."""
    key = F.coalesce(id_.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           lang_col: str = "lang", topic: Column | None = None, budget: float = BUDGET,
           shares: dict[str, dict] | None = None, carry: list[str] | None = None,
           gaps: dict[str, float] | None = None) -> DataFrame:
    """``carry`` columns (all by default) with topic, n_tokens, weight (raked
    over present share), probability and kept. ``shares`` gives target shares
    by dimension and category in place of tempered ones. ``gaps`` takes the
    remaining gap of each margin; gaps above ``MET`` are also a warning."""
    checkpoint_dir(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    names = {c: f"c{i}_" for i, c in enumerate(carry)}
    rows = materialise(docs.select(
        *[F.col(c).alias(a) for c, a in names.items()],
        F.col(source_col).alias("source"), F.col(lang_col).alias("lang"),
        (form_topic(F.col(text_col)) if topic is None else topic).alias("topic"),
        n_tokens(F.col(text_col)).alias("x_tokens"),
        draw(F.col(id_col), F.col(text_col)).alias("x_draw")), "drawn")
    cells = rows.groupBy(*DIMS).agg(F.sum("x_tokens").alias("tokens")).checkpoint(eager=True)
    targets = {d: _targets(cells, d, (shares or {}).get(d)).checkpoint(eager=True) for d in DIMS}
    raked = rake(cells, targets)
    left = remaining_gaps(raked, targets)
    if gaps is not None:
        gaps.update(left)
    if max(left.values()) > MET:
        warnings.warn("margins not all met, largest gaps as shares of the targets: "
                      + ", ".join(f"{d} {x:.3g}" for d, x in left.items()), stacklevel=2)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    found = calibrate(raked, budget).select(
        *[F.col(d).alias(f"k_{d}") for d in DIMS], "probability",
        F.when(F.col("tokens") > 0, F.col("weight") * float(total) / F.col("tokens")).otherwise(1.0).alias("weight"))
    same = None
    for d in DIMS:
        one = F.col(d).eqNullSafe(F.col(f"k_{d}"))
        same = one if same is None else same & one
    out = rows.join(small_or_plain(found.checkpoint(eager=True)), same, "left")
    new = {"topic": F.col("topic"), "n_tokens": F.col("x_tokens"), "weight": F.col("weight"),
           "probability": F.col("probability"), "kept": F.col("x_draw") < F.col("probability")}
    taken = list(carry)
    return out.select(*[F.col(a).alias(c) for c, a in names.items()],
                      *[x.alias(free_name(taken, c)) for c, x in new.items()])


def keep_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", lang_col: str = "lang", budget: float = BUDGET) -> DataFrame:
    out = sample(docs, id_col, text_col, source_col, lang_col, budget=budget)
    return out.where(F.col(out.columns[-1])).select(*docs.columns)


def oracle(rounds: int = 40) -> str:
    """The same in DuckDB: unrolled raking, exact common factor."""
    steps = ["""WITH d AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''),
    '[^\\x20\\x09-\\x0D]+')) AS n, CASE
    WHEN 50 * len(regexp_extract_all(coalesce(text, ''), '[0-9#*$%&|<>{}=@_]')) > length(coalesce(text, '')) THEN 'technical'
    WHEN 250 * len(regexp_extract_all(coalesce(text, ''), '["?!]')) > length(coalesce(text, '')) THEN 'dialogue'
    ELSE 'prose' END AS topic,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents)""",
             """c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS t,
    sum(n) / sum(sum(n)) OVER () AS w FROM d GROUP BY ALL)"""]
    for dim, power in TEMPER.items():
        steps.append(f"g_{dim} AS MATERIALIZED (SELECT {dim} AS m, pow(sum(t), {power}) / sum(pow(sum(t), {power})) OVER () AS g "
                     f"FROM c0 GROUP BY {dim} HAVING sum(t) > 0)")
    last, k = "c0", 0
    for _ in range(rounds):
        for dim in DIMS:
            k += 1
            steps.append(f"c{k} AS MATERIALIZED (SELECT source, lang, topic, t, w * coalesce(g / sum(w) OVER (PARTITION BY {dim}), 0) "
                         f"AS w FROM {last} LEFT JOIN g_{dim} ON m IS NOT DISTINCT FROM {dim})")
            last = f"c{k}"
    steps.append(f"""r AS (SELECT *, t / w AS edge, sum(t) OVER () AS total FROM {last} WHERE t > 0),
f AS (SELECT a.edge, any_value(a.total) AS total, sum(CASE WHEN b.edge <= a.edge THEN b.t ELSE 0 END) AS full_t,
    sum(CASE WHEN b.edge > a.edge THEN b.w ELSE 0 END) AS rest_w FROM r a, r b GROUP BY a.edge),
x AS (SELECT max(({BUDGET} * total - full_t) / rest_w) AS cand FROM f
    WHERE rest_w > 0 AND full_t + rest_w * edge <= {BUDGET} * total),
y AS (SELECT coalesce(cand, (SELECT {BUDGET} * max(total) / sum(w) FROM r)) AS fac FROM x)
SELECT d.doc_id, d.topic, CAST(d.n AS BIGINT) AS n_tokens, round(coalesce(r.w * r.total / r.t, 1), 6) AS weight,
  round(CASE WHEN r.t IS NULL THEN 1.0 ELSE least(1.0, r.w * fac / r.t) END, 6) AS probability,
  d.u < CASE WHEN r.t IS NULL THEN 1.0 ELSE least(1.0, r.w * fac / r.t) END AS kept
FROM d LEFT JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.lang IS NOT DISTINCT FROM d.lang
  AND r.topic = d.topic CROSS JOIN y""")
    return ",\n".join(steps)
