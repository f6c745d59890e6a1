"""Interaction operators re-aimed from the browser tracker to tables of raw
interaction events (W7-W10, plus F12 in ``filters``).

* ``rage_clicks`` - 3 clicks inside ``window_ms`` all within ``radius`` px of
  the last one, then a cool-down.  The cluster test uses bucketed ``lag``s per
  page instance (``scan.prev_value``); the cool-down is greedy (order dependent), so candidates are
  first split into bursts (gap > cool-down => independent, by the skew-safe
  ``sessionize``) and each burst is folded with ``aggregate`` over its sorted
  candidate times.
* ``scroll_milestones`` - first time each depth milestone is reached.
* ``section_dwell`` - enter/exit pairing, intervals >= ``min_ms`` reported
  with the running total per section.
* ``page_vitals`` - LCP = latest entry, INP = max, CLS = sum without recent input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.scan import next_value, prev_value, running_sum
from clickloom.operators.sessions import sessionize

# FIXED VALUES: tracker thresholds.
RAGE_WINDOW_MS = 1400
RAGE_RADIUS_PX = 48
RAGE_COOLDOWN_MS = 5000
SCROLL_MILESTONES = (10, 25, 50, 75, 90, 100)
SECTION_MIN_MS = 750


def _ms(ts: str):
    return F.unix_millis(F.col(ts).cast("timestamp"))


def rage_clicks(clicks: DataFrame, page: str = "page_instance_id", ts: str = "ts", x: str = "x", y: str = "y",
                window_ms: int = RAGE_WINDOW_MS, radius: float = RAGE_RADIUS_PX,
                cooldown_ms: int = RAGE_COOLDOWN_MS) -> DataFrame:
    """Rows: (page, ts, x, y) of each emitted rage click (anchor = last click)."""
    c = clicks.select(page, ts, x, y, _ms(ts).alias("_t"), F.struct(x, y).alias("_tie"))
    c = prev_value(c, page, ts, F.struct(F.col("_t").alias("t"), F.col(x).alias("x"), F.col(y).alias("y")), "_p1", "_tie")
    c = prev_value(c, page, ts, "_p1", "_p2", "_tie")
    c = c.select("*", F.col("_p2.t").alias("_t2"), F.col("_p1.x").alias("_x1"), F.col("_p1.y").alias("_y1"),
                 F.col("_p2.x").alias("_x2"), F.col("_p2.y").alias("_y2")).drop("_p1", "_p2")

    def near(px, py):
        return F.sqrt((F.col(px) - F.col(x)) ** 2 + (F.col(py) - F.col(y)) ** 2) <= radius

    cand = c.where(F.col("_t2").isNotNull() & ((F.col("_t") - F.col("_t2")) <= window_ms)
                   & near("_x1", "_y1") & near("_x2", "_y2")).select(page, ts, x, y, "_t", "_tie")
    # bursts: candidates more than the cool-down apart never interact
    b = sessionize(cand, visitor=page, ts=ts, tiebreak="_tie",
                   gap_seconds=cooldown_ms / 1000.0, out="_burst")
    # the clicks themselves go through the fold, so clicks of one millisecond stay apart
    click = F.struct(F.col("_t").alias("t"), F.col(ts).alias("ts"), F.col(x).alias("x"), F.col(y).alias("y"))
    folded = b.groupBy(page, "_burst").agg(F.array_sort(F.collect_list(click)).alias("_clicks"))
    kind = folded.schema["_clicks"].dataType.simpleString()
    emitted = folded.select(page, F.explode(F.aggregate(
        "_clicks", F.array().cast(kind),
        lambda acc, c: F.when((F.size(acc) == 0) | (c["t"] - F.element_at(acc, -1)["t"] > cooldown_ms),
                              F.concat(acc, F.array(c))).otherwise(acc),
    )).alias("_c"))
    return emitted.select(page, F.col("_c.ts").alias(ts), F.col("_c.x").alias(x), F.col("_c.y").alias(y))


def scroll_milestones(scrolls: DataFrame, page: str = "page_instance_id", ts: str = "ts", depth: str = "depth",
                      marks=SCROLL_MILESTONES) -> DataFrame:
    """(page, milestone, reached_at): first time depth >= milestone."""
    m = F.array(*[F.lit(int(v)) for v in marks])
    e = scrolls.select(page, ts, F.explode(F.filter(m, lambda v: F.col(depth) >= v)).alias("milestone"))
    return e.groupBy(page, "milestone").agg(F.min(ts).alias("reached_at"))


def section_dwell(events: DataFrame, page: str = "page_instance_id", section: str = "section_key", ts: str = "ts",
                  state: str = "state", min_ms: int = SECTION_MIN_MS) -> DataFrame:
    """(page, section, entered_at, visible_ms, cumulative_visible_ms) for each
    visible interval >= ``min_ms``; the running total counts every interval.
    An interval lasts from the first of several enters in a row to the next
    exit; an exit without an enter before it counts for nothing."""
    e = events.where(F.col(state).isin("enter", "exit")).select(
        F.concat_ws("\u0001", F.col(page), F.col(section)).alias("_ps"), page, section, ts, state)
    e = prev_value(e, "_ps", ts, state, "_before", state)
    e = e.where(F.col("_before").isNull() | (F.col("_before") != F.col(state))).drop("_before")
    e = next_value(e, "_ps", ts, F.struct(F.col(ts).alias("t"), F.col(state).alias("s")), "_nx", state)
    iv = e.where((F.col(state) == "enter") & (F.col("_nx.s") == "exit")).select(
        "_ps", page, section, F.col(ts).alias("entered_at"),
        F.greatest(F.lit(0), F.unix_millis(F.col("_nx.t").cast("timestamp")) - _ms(ts)).alias("visible_ms"))
    iv = running_sum(iv, "_ps", "entered_at", F.col("visible_ms"), "cumulative_visible_ms")
    return iv.where(F.col("visible_ms") >= min_ms).drop("_ps")


def page_vitals(entries: DataFrame, page: str = "page_instance_id", ts: str = "ts") -> DataFrame:
    """(page, lcp_ms, inp_ms, cls) from entries (metric, value, recent_input)."""
    metric, value = F.col("metric"), F.col("value")
    return entries.groupBy(page).agg(
        F.max(F.when((metric == "lcp") & value.isNotNull(), F.struct(F.col(ts).alias("t"), value.alias("v"))))["v"]
        .alias("lcp_ms"),
        F.max(F.when(metric == "inp", value)).alias("inp_ms"),
        F.coalesce(F.sum(F.when((metric == "cls") & ~F.coalesce(F.col("recent_input"), F.lit(False)), value)),
                   F.lit(0.0)).alias("cls"),
    )
