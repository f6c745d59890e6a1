"""Aggregation helpers shared by the report blocks.

``grouped_rollup`` is the workhorse: most report blocks are

    GROUP BY keys: count(*), count(*) FILTER (cond), count(DISTINCT visitor),
    count(DISTINCT session), count(DISTINCT visitor) FILTER (cond), min/max ts

It first aggregates to one row per (keys, session, visitor) - additive measures
summed, filtered-distinct conditions turned into per-row flags - and only then
computes the distinct counts.  The first level is a plain hash aggregate with
map-side partial aggregation, so a hot key, visitor or session is collapsed
inside each task before anything is shuffled; the distinct rewrite (Expand)
then runs on the much smaller pre-aggregated rows, and all filtered distincts on
the visitor column share one Expand projection (``FILTER`` form).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def zsum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def grouped_rollup(
    df: DataFrame,
    keys: list[str],
    counts: dict[str, Column] | None = None,
    visitor_flags: dict[str, Column] | None = None,
    session_flags: dict[str, Column] | None = None,
    events: str | None = "events",
    visitors: str | None = "unique_visitors",
    sessions: str | None = "sessions",
    mins: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    avgs: dict[str, Column] | None = None,
    visitor: str = "visitor_id",
    session: str = "session_id",
    approx: bool = False,
) -> DataFrame:
    """``approx=True`` replaces the unfiltered distinct counts by
    ``approx_count_distinct`` (HyperLogLog++, no Expand): an opt-in for very
    large key spaces; filtered distinct counts stay exact."""
    counts = counts or {}
    visitor_flags = visitor_flags or {}
    session_flags = session_flags or {}
    mins = mins or {}
    maxs = maxs or {}
    sums = sums or {}
    avgs = avgs or {}
    lvl1 = [F.count(F.lit(1)).alias("_n")]
    lvl1 += [F.count_if(c).alias(f"_c_{n}") for n, c in counts.items()]
    lvl1 += [F.max(c.cast("int")).alias(f"_v_{n}") for n, c in visitor_flags.items()]
    lvl1 += [F.max(c.cast("int")).alias(f"_s_{n}") for n, c in session_flags.items()]
    lvl1 += [F.min(c).alias(f"_mn_{n}") for n, c in mins.items()]
    lvl1 += [F.max(c).alias(f"_mx_{n}") for n, c in maxs.items()]
    lvl1 += [F.sum(c).alias(f"_sm_{n}") for n, c in sums.items()]
    for n, c in avgs.items():
        lvl1 += [F.sum(c).alias(f"_as_{n}"), F.count(c).alias(f"_ac_{n}")]
    g1 = df.groupBy(*keys, session, visitor).agg(*lvl1)

    lvl2 = []
    if events:
        lvl2.append(F.sum("_n").cast("bigint").alias(events))
    distinct = F.approx_count_distinct if approx else F.count_distinct
    if visitors:
        lvl2.append(distinct(visitor).alias(visitors))
    if sessions:
        lvl2.append(distinct(session).alias(sessions))
    lvl2 += [F.sum(f"_c_{n}").cast("bigint").alias(n) for n in counts]
    lvl2 += [F.expr(f"count(DISTINCT {visitor}) FILTER (WHERE _v_{n} = 1)").alias(n) for n in visitor_flags]
    lvl2 += [F.expr(f"count(DISTINCT {session}) FILTER (WHERE _s_{n} = 1)").alias(n) for n in session_flags]
    lvl2 += [F.min(f"_mn_{n}").alias(n) for n in mins]
    lvl2 += [F.max(f"_mx_{n}").alias(n) for n in maxs]
    lvl2 += [F.sum(f"_sm_{n}").alias(n) for n in sums]
    lvl2 += [(F.sum(f"_as_{n}") / F.sum(f"_ac_{n}")).alias(n) for n in avgs]
    if keys:
        return g1.groupBy(*keys).agg(*lvl2)
    return g1.agg(*lvl2)


def visitor_flag_counts(df: DataFrame, keys: list[str], flags: dict[str, Column],
                        visitor: str = "visitor_id", total: str | None = "visitors") -> DataFrame:
    """N filtered distinct-visitor counts via per-visitor boolean flags.

    ``groupBy(keys, visitor)`` reduces to one row per visitor (partial
    aggregation map-side), then ``count_if(flag)`` per key.  NULL visitors are
    excluded, as ``count(DISTINCT visitor)`` ignores them."""
    g1 = df.where(F.col(visitor).isNotNull()).groupBy(*keys, visitor).agg(
        *[F.bool_or(c).alias(f"_f_{n}") for n, c in flags.items()]
    )
    aggs = ([F.count(F.lit(1)).alias(total)] if total else []) + [
        F.count_if(F.col(f"_f_{n}")).alias(n) for n in flags
    ]
    return g1.groupBy(*keys).agg(*aggs) if keys else g1.agg(*aggs)


def top_k(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """ORDER BY ... LIMIT n; Spark plans TakeOrderedAndProject (per-task top-n,
    no global sort).  Without ``n`` all rows, unsorted."""
    return df if n is None else df.orderBy(*order).limit(int(n))


def combine_rows(*frames: DataFrame) -> DataFrame:
    """Put single-row global aggregates side by side.  Every input is an
    aggregate without grouping keys (exactly one row), so the equi-join on a
    constant key pairs one row with one row."""
    out = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[str, float]], ranges: int = 64, rounds: int = 2) -> DataFrame:
    """One row of exact percentiles (``percentile_cont``): name -> (column, q);
    NULL for a column without values.

    Values are counted first (a map-side combine per distinct value).  Each
    round cuts the distinct values that are left into ``ranges`` ranges of about
    equal depth, counts them exactly, and keeps those that hold the percentile;
    the cuts come from a mergeable rank sketch and only guide, so the result
    does not depend on its error.  Ranks are cut, not values: outliers and
    uneven spreads do not matter.  What is put in order in the end is about
    ``2 / ranges ** rounds`` of the distinct values.
    """
    if ranges < 2:
        raise ValueError("ranges must be 2 or more")
    cells = [F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"), F.lit(float(q)).alias("q")) for n, (c, q) in wanted.items()]
    counts = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where(F.col("value").isNotNull()) \
        .groupBy("name", "q", "value").agg(F.count(F.lit(1)).alias("c"))
    position = F.col("q") * (F.col("n") - 1)
    bracket = counts.groupBy("name", "q").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("c").alias("n")).select(
        "name", "lo", "hi", F.lit(0).cast("bigint").alias("start"), F.floor(position).alias("first"), F.ceil(position).alias("last"),
        (position - F.floor(position)).alias("share"))  # a row per name
    counts = counts.drop("q")
    for _ in range(rounds):
        bracket = narrowed(counts, bracket, ranges)
    inner = Window.partitionBy("name").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    near = within(counts, bracket).withColumn("at", F.col("start") + F.coalesce(F.sum("c").over(inner), F.lit(0)))
    found = near.groupBy("name").agg(
        F.max(F.when(holds("at", "c", "first"), F.col("value"))).alias("a"), F.max(F.when(holds("at", "c", "last"), F.col("value"))).alias("b"),
        F.max("share").alias("share"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("share")
    return found.agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in wanted])


def holds(start: str, rows: str, position: str) -> Column:
    """Whether ``rows`` ordered rows from ``start`` on hold the position."""
    return (F.col(start) <= F.col(position)) & (F.col(start) + F.col(rows) > F.col(position))


def within(counts: DataFrame, bracket: DataFrame) -> DataFrame:
    """The counted values inside their name's bracket (a row per name)."""
    return counts.join(bracket, "name").where(F.col("value").between(F.col("lo"), F.col("hi")))


def narrowed(counts: DataFrame, bracket: DataFrame, ranges: int) -> DataFrame:
    """One round of ``exact_percentiles``: the bracket of the ranges that hold
    the positions ``first`` and ``last``; ``start`` counts the rows before it."""
    inside = within(counts, bracket)
    cuts = inside.groupBy("name").agg(F.percentile_approx("value", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts"))
    part = F.size(F.filter("cuts", lambda x: x < F.col("value")))
    parts = inside.join(cuts, "name").groupBy("name", "first", "last", "share", "start", part.alias("part")).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("c").alias("rows"))
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    parts = parts.withColumn("start", F.col("start") + F.coalesce(F.sum("rows").over(before), F.lit(0)))
    return parts.where(holds("start", "rows", "first") | holds("start", "rows", "last")).groupBy("name", "first", "last", "share").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("start").alias("start"))
