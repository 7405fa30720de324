"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed up by cell (source, language, topic) and raked to the target shares of each
dimension in turn.  A cell can't give more tokens than it has, so each step scales the cells of a value
up to that bound (the cells that reach it stay there, the others share what is left of the goal).  The
expected tokens that come out are calibrated: divided by the cell's tokens they are the probability of
its documents.  A document is taken if a hash of its id and the seed falls below it.

Targets that can't be met within the bounds lower the token budget by a fifth until they can; where no
budget helps, the value that stays furthest from its share is named in an error.  ``marginals`` returns
what was aimed at and what is reached.  Sweeps run over the cell table, ``SWEEPS`` a job, until all
shares are met within ``TOLERANCE``; only single numbers come to the driver.

Without targets a dimension aims at its own shares to a power (small values gain), held below the
``ROOM`` part of what a value could give at the budget.  Null dimension values are a value of their
own; a document has one token at least, so empty and null texts take part; rows that repeat share
their decision, because it depends on the id only (on the text where the id is null); an empty table
gives an empty result.  Columns named n_tokens, weight, probability and sampled are replaced, names
that begin with two underscores are reserved, others are left alone.  Long texts are only counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import stage_table

DIMS = ("source", "lang", "topic")
#: Sweeps of one job and jobs at most, deviation of a share from its target, and what a value may give without targets.
SWEEPS, JOBS, TOLERANCE, ROOM = 5, 30, 1e-3, 0.95
#: Cells up to which the cell table is sent to every executor.
BROADCAST_CELLS = 50_000


def _count(text: Column, sign: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def token_count(text: Column) -> Column:
    """Blanks and line ends, and one."""
    t = F.coalesce(text, F.lit(""))
    return (_count(t, " ") + _count(t, "\n") + 1).cast("bigint")


def form_topic(text: Column) -> Column:
    """The form that a text has, as its topic: table, shouting, signs, fragment or prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.octet_length(t), F.lit(1))
    signs = n - F.octet_length(F.translate(t, "#$%&*+=<>{}[]\\^~_", ""))
    shouting = (F.upper(t) == t) & (F.lower(t) != t)
    return F.when(_count(t, "|") * 50 > n, "table").when(signs * 20 > n, "signs").when(n < 200, "fragment").when(shouting, "shouting").otherwise("prose")


def with_cells(docs: DataFrame) -> DataFrame:
    """docs with n_tokens and topic (kept where docs has one)."""
    topic = F.col("topic") if "topic" in docs.columns else form_topic(F.col("text"))
    return docs.withColumns({"n_tokens": token_count(F.col("text")), "topic": topic})


def _limited(values: DataFrame, room: float) -> DataFrame:
    """values (v, own) with share: least(own * room, factor * v), the factor such that shares add up to one.

    The factor is found on grids of 64 numbers, each grid by one sum over the values.
    """
    cap = F.col("own") * room
    lo, hi = values.agg(1 / F.sum("v"), F.max(cap / F.col("v")) * 1.001).first()
    for _ in range(4):
        grid = [lo * (hi / lo) ** (i / 63) for i in range(64)]
        sums = values.agg(*[F.sum(F.least(cap, F.lit(g) * F.col("v"))).alias(f"s{i}") for i, g in enumerate(grid)]).first()
        at = next((i for i, x in enumerate(sums) if x >= 1), 63)
        lo, hi = grid[max(at - 1, 0)], grid[at]
    return values.withColumn("share", F.least(cap, F.lit(hi) * F.col("v")))


def target_shares(cells: DataFrame, dim: str, total: int, wanted: DataFrame | None, power: float, budget_share: float) -> DataFrame:
    """dim, share for each value: wanted (dim, v on any scale; other values keep their own share), or tempered shares."""
    own = cells.groupBy(dim).agg((F.sum("tokens") / F.lit(float(total))).alias("own"))
    if wanted is None:
        return _limited(own.withColumn("v", F.col("own") ** power), ROOM / budget_share).select(dim, "share")
    given = wanted.select(F.col(dim).alias("__value"), F.col("v").cast("double").alias("__v"))
    both = own.join(given, own[dim].eqNullSafe(F.col("__value")), "left")
    free, scale = both.agg(F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("own"))), F.lit(0.0)), F.sum("__v")).first()
    return both.select(dim, F.when(F.col("__v").isNull(), F.col("own")).otherwise(F.col("__v") * ((1 - free) / (scale or 1.0))).alias("share"))


def _scaled(rows: DataFrame, dim: str, budget: float) -> DataFrame:
    """One step: expected tokens of each value of a dimension scaled to its goal, none above a cell's tokens."""
    whole = Window.partitionBy(dim)
    order = whole.orderBy("__ratio", *DIMS)
    rows = rows.withColumn("__ratio", F.col("tokens") / F.greatest(F.col("expected"), F.lit(1e-300)))
    full = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("expected").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("__factor", (F.col(f"__g_{dim}") * budget - full) / F.greatest(rest, F.lit(1e-300)))
    factor = F.max(F.when(F.col("__factor") <= F.col("__ratio"), F.col("__factor"))).over(whole)
    rows = rows.withColumn("__factor", factor)
    scaled = F.when(F.col("__factor").isNull(), F.col("tokens").cast("double")).otherwise(F.least(F.col("tokens").cast("double"), F.greatest(F.lit(0.0), F.col("__factor")) * F.col("expected")))
    return rows.withColumn("expected", scaled).drop("__ratio", "__factor")


def marginals(raked: DataFrame, shares: dict[str, DataFrame]) -> DataFrame:
    """dim, value, target and achieved share of every value of each dimension."""
    out = None
    for dim, share in shares.items():
        sums = raked.groupBy(F.col(dim).alias("__value")).agg(F.sum("expected").alias("__x"))
        total = sums.agg(F.sum("__x").alias("__all"))
        rows = sums.join(share, share[dim].eqNullSafe(F.col("__value"))).crossJoin(F.broadcast(total)).select(F.lit(dim).alias("dim"), F.col("__value").cast("string").alias("value"), F.col("share").alias("target"), (F.col("__x") / F.col("__all")).alias("achieved"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _furthest(rows: DataFrame, dims: list[str], total: float) -> Row:
    """dim, value, target and achieved share of the value that is furthest from its target, and how far."""
    found = None
    for dim in dims:
        one = rows.groupBy(F.col(dim).cast("string").alias("value")).agg(F.max(f"__g_{dim}").alias("target"), (F.sum("expected") / F.lit(float(total or 1))).alias("achieved")).withColumn("dim", F.lit(dim))
        found = one if found is None else found.unionByName(one)
    away = F.abs(F.col("achieved") - F.col("target")) / F.greatest(F.col("target"), F.lit(1e-12))
    return found.withColumn("away", F.coalesce(away, F.lit(1.0))).orderBy(F.desc("away"), "dim", "value").first()


def rake(cells: DataFrame, shares: dict[str, DataFrame], budget_share: float = 0.8) -> DataFrame:
    """cells (dimensions, tokens: a written table) with expected, tokens to take of each: their marginals follow the shares."""
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("expected", F.lit(0.0))
    start = cells
    for dim, share in shares.items():
        start = start.join(share.select(F.col(dim).alias("__value"), F.col("share").alias(f"__g_{dim}")), start[dim].eqNullSafe(F.col("__value")), "left").drop("__value")
    start = stage_table(start, "goals")
    few = start.count() <= BROADCAST_CELLS  # one task then has all cells, and no step moves them
    worst, part = None, budget_share
    while part > budget_share / 10:
        rows, last = start.withColumn("expected", F.col("tokens") * part), None
        for _ in range(JOBS):
            rows = rows.coalesce(1) if few else rows
            for _ in range(SWEEPS):
                for dim in shares:
                    rows = _scaled(rows, dim, total * part)
            rows = stage_table(rows, "raked")
            reached = rows.agg(F.sum("expected")).first()[0]
            worst = _furthest(rows.coalesce(1) if few else rows, list(shares), reached)
            gap = max(worst["away"], abs(reached / (total * part) - 1))
            if gap < TOLERANCE:
                return rows.select(*cells.columns, "expected")
            if last is not None and gap > 0.9 * last:  # it doesn't converge
                break
            last = gap
        part *= 0.8
    raise ValueError(f"no budget meets the share of {worst['dim']} {worst['value']}: target {worst['target']:.4g}, achieved {worst['achieved']:.4g}")


def draw(doc_id: Column, seed: int, text: Column | None = None) -> Column:
    """A number in [0, 1) that depends on the id and the seed only; on the text where the id is null."""
    key = F.xxhash64(doc_id, F.lit(seed))
    if text is not None:
        key = F.when(doc_id.isNull(), F.xxhash64(text, F.lit(seed))).otherwise(key)
    return F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))


def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.7, budget_share: float = 0.8) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(docs with cells, cells with expected tokens, target shares by dimension)."""
    rows = with_cells(docs)
    cells = stage_table(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0]
    shares = {d: target_shares(cells, d, total, (targets or {}).get(d), power, budget_share) for d in DIMS if targets is None or d in targets} if total else {}
    return rows, rake(cells, shares, budget_share), shares


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.7, budget_share: float = 0.8, seed: int = 7) -> DataFrame:
    """docs with n_tokens, topic, weight (expected share to own share), probability and sampled."""
    rows, raked, _ = calibrated(docs, targets, power, budget_share)
    rate = F.col("expected") / F.col("tokens")
    given = raked.agg(F.sum("expected") / F.sum("tokens")).first()[0] or 1.0
    table = raked.select(*[F.col(d).alias(f"__{d}") for d in DIMS], (rate / given).alias("weight"), rate.alias("probability"))
    if raked.count() <= BROADCAST_CELLS:
        table = F.broadcast(table)
    match = F.lit(True)
    for d in DIMS:
        match = match & rows[d].eqNullSafe(F.col(f"__{d}"))
    joined = rows.drop("weight", "probability", "sampled").join(table, match).drop(*[f"__{d}" for d in DIMS])
    return joined.withColumn("sampled", draw(F.col("doc_id"), seed, F.col("text")) < F.col("probability"))
