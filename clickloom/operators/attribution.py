"""Conversion attribution (J4, flagship): resolve each checkout / purchase to the
session that earned it.

Priority per conversion: explicit ids in the properties, ids in the page URL,
latest earlier event sharing the checkout id, latest earlier event sharing the
order id, the visitor's latest earlier campaign page view, else its own session.
Candidates must be non-test, non-internal, have arrived before the conversion
and within ``lookback_days`` of its arrival, and carry a client time not later
than the conversion's; the best one is the latest by (client time, arrival, id).

Plan (no pair explosion on hot keys):

1. ``asof_latest`` merges conversions and candidates into one stream per key
   (the three look-ups share the stream: keys carry a look-up prefix) and
   takes, for every conversion, the latest preceding candidate with a running
   ``last(ignorenulls)`` - windowed per (key, client-day bucket) and stitched
   across buckets with a one-row-per-bucket table, so a hot key (a bot visitor,
   a shared checkout id) is spread over its days instead of one task.
2. That latest candidate is the answer whenever it satisfies the arrival-time
   constraints (it is the maximum of a superset of the valid candidates).
3. The conversions whose latest candidate fails them walk back through the
   key's client-time buckets.  Bucket totals (least and last arrival) say which
   buckets can hold an answer; a bucket answers all its conversions in one sweep
   over a tree of sorted arrivals (``latest_arrived``), so no conversion is
   paired with candidates, however many arrived late.

Candidates are cut to the keys that conversions ask for and written once, so
history is read once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.config import ATTRIBUTION_LOOKBACK_DAYS, CONVERSION_EVENTS, UUID_PATTERN
from clickloom.functions.json import is_true, nz, prop, with_props
from clickloom.functions.nested import nested_find_many
from clickloom.functions.urls import with_url_hints
from clickloom.operators.classify import json_merge
from clickloom.session import ensure_checkpoint_dir

DAY_US = 86_400 * 1_000_000

# FIXED VALUES: property keys searched for ids, in priority order.
CHECKOUT_KEYS = ["checkout_id", "checkoutId", "ct_checkout_id", "checkout_token"]
ORDER_KEYS = ["order_id", "orderId", "ct_order_id"]
VISITOR_ID_KEYS = ["ct_visitor_id", "source_visitor_id", "attributed_visitor_id"]
SESSION_ID_KEYS = ["ct_session_id", "source_session_id", "attributed_session_id"]
CHECKOUT_CANDIDATE_EVENTS = ("checkout_started", "add_to_cart", "buy_button_click")
ORDER_CANDIDATE_EVENTS = ("checkout_started", "add_to_cart")
CONFIDENCE = {
    "explicit_ids": "high",
    "url_ids": "high",
    "checkout_id": "high",
    "order_id": "high",
    "visitor_latest_attributed_session": "medium",
    "same_session": "native",
}


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


CAND_TYPE = "struct<ts:timestamp_ntz,recv:timestamp_ntz,hid:string,session_id:string,visitor_id:string>"


def _cand_struct() -> Column:
    return F.struct(F.col("ts"), F.col("recv"), F.col("hid"), F.col("session_id"), F.col("visitor_id"))


def asof_latest(conv: DataFrame, cand: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Latest candidate preceding each conversion on the same key.

    ``conv``: (cid, key, ts, recv) and ``cand``: (key, ts, recv, hid,
    session_id, visitor_id).  Rows are ordered by (ts, recv, id, kind), a
    conversion sorting before a candidate with the identical triple (itself).
    Returns the conversion rows (cid, key, ts, recv, best) with ``best`` =
    struct(ts, recv, hid, session_id, visitor_id) or NULL.
    """
    bucket_us = int(bucket_seconds) * 1_000_000
    c = conv.select("key", "ts", "recv", F.col("cid").alias("oid"), F.lit(0).alias("kind"),
                    F.col("cid"), F.lit(None).cast(CAND_TYPE).alias("cand"))
    h = cand.select("key", "ts", "recv", F.col("hid").alias("oid"), F.lit(1).alias("kind"),
                    F.lit(None).cast("string").alias("cid"), _cand_struct().alias("cand"))
    u = c.unionByName(h).withColumn("_b", F.floor(_us(F.col("ts")) / F.lit(bucket_us)))
    w_in = (Window.partitionBy("key", "_b").orderBy("ts", "recv", "oid", "kind")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn("_in", F.last("cand", ignorenulls=True).over(w_in))
    # One row per (key, bucket): the bucket's latest candidate, carried forward
    # to later buckets of the key (a table of key-days, not of events).
    bt = u.groupBy("key", "_b").agg(F.max("cand").alias("_bm"))
    wb = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.withColumn("_carry", F.last("_bm", ignorenulls=True).over(wb)).select("key", "_b", "_carry")
    conv_rows = u.where(F.col("kind") == 0).select("key", "_b", "cid", "ts", "recv", "_in")
    j = conv_rows.join(bt, ["key", "_b"], "left")
    return j.select("cid", "key", "ts", "recv", F.coalesce("_in", "_carry").alias("best"))


def latest_arrived(arrival: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query the last place before ``ends`` whose arrival is in
    [low, high), or -1.

    ``arrival`` is in client-time order.  Level l of the tree holds, for every
    block of 2**l places, its arrivals in order, as one sorted array of (block,
    rank); a query goes left over whole blocks until one holds an arrival of
    its range, then down to the last such place: (n + q) log n in all."""
    n, levels = len(arrival), max(1, int(len(arrival)).bit_length())
    order = np.argsort(arrival, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    low_rank, high_rank = (np.searchsorted(arrival[order], x, "left") for x in (low, high))
    tree = [np.sort((np.arange(n) >> level) * (n + 1) + rank) for level in range(levels + 1)]

    def holds(level: int, block: np.ndarray, q: np.ndarray) -> np.ndarray:
        base = block * (n + 1)
        return np.searchsorted(tree[level], base + high_rank[q]) > np.searchsorted(tree[level], base + low_rank[q])

    at, found, block = ends.astype(np.int64), np.full(len(ends), -1), np.zeros(len(ends), np.int64)
    for level in range(levels + 1):
        q = np.flatnonzero((found < 0) & ((at >> level) & 1 == 1))
        left = (at[q] >> level) - 1
        hit = holds(level, left, q)
        found[q[hit]], block[q[hit]] = level, left[hit]
        at[q] -= 1 << level
    for level in range(levels - 1, -1, -1):
        q = np.flatnonzero(found > level)
        right = 2 * block[q] + 1
        block[q] = np.where(holds(level, right, q), right, right - 1)
    return np.where(found >= 0, block, -1)


def _bucket_answers(key, asked: pa.Table, cands: pa.Table) -> pa.Table:
    """The last valid candidate of one (key, bucket) for all conversions that ask it."""
    cands = cands.sort_by([(c, "ascending") for c in ("ts", "recv", "hid")])
    micros = lambda t, c: t.column(c).cast(pa.int64()).to_numpy()
    if cands.num_rows:
        ends = np.searchsorted(micros(cands, "ts"), micros(asked, "ts"), "right")
        at = latest_arrived(micros(cands, "recv"), ends, micros(asked, "since"), micros(asked, "recv"))
    else:
        at = np.full(asked.num_rows, -1)
    pick = pa.array(at, mask=at < 0)
    out = {"cid": asked.column("cid"), "key": asked.column("key")}
    return pa.table(out | {f"b_{c}": cands.column(c).take(pick) for c in ("ts", "recv", "hid", "session_id", "visitor_id")})


def walk_back(redo: DataFrame, cand: DataFrame, lookback_days: int, bucket_seconds: int) -> DataFrame:
    """Exact latest valid candidate of the conversion keys ``redo`` (cid, key,
    ts, recv): (cid, key, best), without those that have none.  Round by round
    each asks the latest bucket of its key that it has not asked yet and whose
    arrivals reach into its look-back."""
    bucket = lambda c: F.floor(_us(F.col(c)) / F.lit(int(bucket_seconds) * 1_000_000))
    since = (F.col("recv") - F.make_dt_interval(F.lit(lookback_days))).alias("since")
    cand = cand.withColumn("_b", bucket("ts"))
    totals = cand.groupBy("key", "_b").agg(F.min("recv").alias("first"), F.max("recv").alias("last"))
    lists = totals.join(redo.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("_b", "first", "last")), asc=False).alias("l"))  # a key's days
    left = redo.select("cid", "key", "ts", "recv", since, bucket("ts").alias("_c")).join(lists, "key")
    reach = F.filter("l", lambda x: (x["_b"] <= F.col("_c")) & (x["first"] < F.col("recv")) & (x["last"] >= F.col("since")))
    left = left.select("cid", "key", "ts", "recv", "since", F.transform(reach, lambda x: x["_b"]).alias("todo")).where(F.size("todo") > 0).checkpoint(eager=True)
    schema = "cid string, key string, b_ts timestamp_ntz, b_recv timestamp_ntz, b_hid string, b_session_id string, b_visitor_id string"
    answers = []
    while not left.isEmpty():
        asked = left.withColumn("_b", F.element_at("todo", 1))
        held = cand.join(asked.select("key", "_b").distinct(), ["key", "_b"], "left_semi")
        got = asked.select("cid", "key", "_b", "ts", "recv", "since").groupBy("key", "_b").cogroup(held.groupBy("key", "_b")).applyInArrow(_bucket_answers, schema)
        got = got.where("cid is not null").checkpoint(eager=True)
        answers.append(got.where("b_hid is not null").select("cid", "key", F.struct(*[F.col(f"b_{c}").alias(c) for c in ("ts", "recv", "hid", "session_id", "visitor_id")]).alias("best")))
        rest = left.join(got.where("b_hid is null").select("cid", "key"), ["cid", "key"], "left_semi")
        left = rest.withColumn("todo", F.slice("todo", 2, F.size("todo"))).where(F.size("todo") > 0).checkpoint(eager=True)
    return reduce(DataFrame.unionByName, answers) if answers else redo.select("cid", "key", F.lit(None).cast(CAND_TYPE).alias("best")).limit(0)


def resolve_latest(conv: DataFrame, cand: DataFrame, lookback_days: int = ATTRIBUTION_LOOKBACK_DAYS,
                   bucket_seconds: int = 86_400, materialize: bool = True,
                   store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(cid, key, ts, recv) x (key, ts, recv, hid, session_id, visitor_id) ->
    (cid, key, best) for every conversion key that has a valid candidate.
    Rows without a client or arrival time take no part.  ``store`` writes the
    candidates and reads them back where the caller frees them; without it they
    are a checkpoint."""
    timed = F.col("ts").isNotNull() & F.col("recv").isNotNull()
    conv = conv.where(timed)
    # Only candidates on keys that some conversion asks for; read three times below.
    cand = cand.where(timed).join(conv.select("key").distinct(), "key", "left_semi")
    ensure_checkpoint_dir(cand.sparkSession)
    if materialize:
        cand = store(cand) if store else cand.checkpoint(eager=True)
    fast = asof_latest(conv, cand, bucket_seconds).where(F.col("best").isNotNull())
    if materialize:  # consumed by the direct and the exact path: compute once
        fast = fast.checkpoint(eager=True)
    ok = (F.col("best.recv") < F.col("recv")) & (
        F.col("best.recv") >= F.col("recv") - F.make_dt_interval(F.lit(lookback_days)))
    good = fast.where(ok).select("cid", "key", "best")
    redo = fast.where(~ok).select("cid", "key", "ts", "recv")
    if redo.isEmpty():
        return good
    return good.unionByName(walk_back(redo, cand, lookback_days, bucket_seconds))


def _valid_id(c: Column, pattern: str) -> Column:
    return F.when(c.rlike(pattern), c)


# Key prefixes of the three look-ups inside one merged stream; the prefix is
# also the priority (checkout id, then order id, then visitor).
_P_CHECKOUT, _P_ORDER, _P_VISITOR = "3", "4", "5"


def _tagged(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), c)


def attribute_conversions(
    ev: DataFrame,
    lookback_days: int = ATTRIBUTION_LOOKBACK_DAYS,
    id_pattern: str = UUID_PATTERN,
    bucket_seconds: int = 86_400,
    history: DataFrame | None = None,
    materialize: bool = True,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Resolve every checkout / purchase row of ``ev`` against ``history``
    (default: ``ev`` itself).  Returns one row per conversion with the
    attribution fields (the ``conversion_attribution`` record, flattened).

    The three look-ups (checkout id, order id, visitor) share one merged
    stream: each history row is exploded into the keys it can match
    (prefixed by look-up), each conversion into its (up to three) keys, and a
    single as-of pass resolves all of them.  ``store``: see ``resolve_latest``."""
    ev = with_props(ev)
    hist = with_props(history) if history is not None else ev
    convs = with_url_hints(ev.where(F.col("event_name").isin(*CONVERSION_EVENTS)), "page_url", "_h")
    found = nested_find_many(F.col("properties"), {
        "checkout": CHECKOUT_KEYS, "order": ORDER_KEYS, "visitor": VISITOR_ID_KEYS, "session": SESSION_ID_KEYS})
    c = convs.select(
        F.col("event_id").cast("string").alias("cid"),
        "event_id", "event_name", "visitor_id", "session_id", "client_timestamp", "received_at", "_h",
        found.alias("_f"),
    ).select(
        "cid", "event_id", "event_name", "visitor_id", "session_id", "client_timestamp", "received_at",
        F.col("_h.source").alias("_hint_source"),
        F.coalesce(F.col("_f.checkout"), F.col("_h.ct_checkout_id"), F.col("_h.checkout_id")).alias("checkout_id"),
        F.coalesce(F.col("_f.order"), F.col("_h.order_id")).alias("order_id"),
        _valid_id(F.col("_f.visitor"), id_pattern).alias("_p_visitor"),
        _valid_id(F.col("_f.session"), id_pattern).alias("_p_session"),
        _valid_id(F.col("_h.ct_visitor_id"), id_pattern).alias("_u_visitor"),
        _valid_id(F.col("_h.ct_session_id"), id_pattern).alias("_u_session"),
    ).select(
        "*",
        F.coalesce("_p_visitor", "_u_visitor").alias("explicit_visitor"),
        F.coalesce("_p_session", "_u_session").alias("explicit_session"),
    )
    # Cut the lineage here: the conversion projection (the only Python step,
    # over conversions only) feeds both the stream and the final assembly.
    # A reliable checkpoint in the cluster's shared checkpoint folder.
    if materialize:
        ensure_checkpoint_dir(c.sparkSession)
        c = c.checkpoint(eager=True)

    # Conversion side: one row per look-up key (none when explicit ids decide).
    ckeys = F.when(F.col("explicit_session").isNull(), F.filter(F.array(
        _tagged(_P_CHECKOUT, F.col("checkout_id")),
        _tagged(_P_ORDER, F.col("order_id")),
        _tagged(_P_VISITOR, F.coalesce(F.col("explicit_visitor"), F.col("visitor_id").cast("string"))),
    ), lambda x: x.isNotNull()))
    conv_side = c.select("cid", F.explode(ckeys).alias("key"), F.col("client_timestamp").alias("ts"),
                         F.col("received_at").alias("recv"))

    # History side: each eligible row explodes into the keys it can match.
    eligible = hist.where(~is_true(prop("test")) & ~is_true(prop("internal_traffic")))
    name = F.col("event_name")
    tagged_pv = (nz(F.col("utm_campaign")).isNotNull() | nz(F.col("fbclid")).isNotNull()
                 | nz(prop("first_touch.utm_campaign")).isNotNull() | nz(prop("first_touch.fbclid")).isNotNull())

    def keys_of(prefix: str, cond: Column, cols: list[Column]) -> Column:
        return F.when(cond, F.array(*[_tagged(prefix, nz(x)) for x in cols])).otherwise(F.array().cast("array<string>"))

    hkeys = F.array_distinct(F.filter(F.concat(
        keys_of(_P_CHECKOUT, name.isin(*CHECKOUT_CANDIDATE_EVENTS),
                [prop("checkout_id"), prop("ct_checkout_id"), prop("checkout_token"), prop("conversion_attribution.checkout_id")]),
        keys_of(_P_ORDER, name.isin(*ORDER_CANDIDATE_EVENTS),
                [prop("order_id"), prop("ct_order_id"), prop("conversion_attribution.order_id")]),
        keys_of(_P_VISITOR, (name == "page_view") & tagged_pv, [F.col("visitor_id").cast("string")]),
    ), lambda x: x.isNotNull()))
    cand_side = eligible.where(F.size(hkeys) > 0).select(
        F.explode(hkeys).alias("key"), F.col("client_timestamp").alias("ts"), F.col("received_at").alias("recv"),
        F.col("event_id").cast("string").alias("hid"), F.col("session_id").cast("string").alias("session_id"),
        F.col("visitor_id").cast("string").alias("visitor_id"))

    matches = resolve_latest(conv_side, cand_side, lookback_days, bucket_seconds, materialize, store)
    best = matches.groupBy("cid").agg(
        F.min_by(F.struct(F.substring("key", 1, 1).cast("int").alias("prio"), F.col("best.session_id").alias("m_session"),
                          F.col("best.visitor_id").alias("m_visitor"), F.col("best.hid").alias("m_event")),
                 F.col("key")).alias("m"))
    r = c.join(best, "cid", "left")

    own_session = F.col("session_id").cast("string")
    own_visitor = F.col("visitor_id").cast("string")
    method = (F.when(F.col("_p_session").isNotNull(), "explicit_ids")
              .when(F.col("_u_session").isNotNull(), "url_ids")
              .when(F.col("m.prio") == 3, "checkout_id")
              .when(F.col("m.prio") == 4, "order_id")
              .when(F.col("m.prio") == 5, "visitor_latest_attributed_session")
              .otherwise("same_session"))
    att_session = F.coalesce(F.col("explicit_session"), F.col("m.m_session"), own_session)
    att_visitor = F.coalesce(F.col("explicit_visitor"), F.col("m.m_visitor"), own_visitor)
    conf = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    r = r.select(
        "event_id", "event_name", "visitor_id", "session_id", "client_timestamp", "received_at",
        att_visitor.alias("attributed_visitor_id"),
        att_session.alias("attributed_session_id"),
        method.alias("method"),
        F.col("m.m_event").alias("matched_event_id"),
        "checkout_id", "order_id", "_hint_source",
    )
    return r.select(
        "*",
        conf[F.col("method")].alias("confidence"),
        (F.col("attributed_session_id") != F.col("session_id").cast("string")).alias("cross_session"),
        F.when(F.col("method") == "explicit_ids", "properties")
        .when(F.col("method") == "url_ids", F.concat(F.lit("page_url_"), F.coalesce("_hint_source", F.lit("unknown"))))
        .otherwise(F.col("method")).alias("identifier_source"),
        F.lit(lookback_days).alias("lookback_days"),
    ).drop("_hint_source")


def stamp_attribution(ev: DataFrame, resolved: DataFrame) -> DataFrame:
    """Write the resolved record into the conversions' property bag (as the
    ingest path does); other rows pass through unchanged."""
    rec = F.parse_json(F.to_json(F.struct(
        F.lit(2).alias("version"), F.col("attributed_visitor_id").alias("visitor_id"),
        F.col("attributed_session_id").alias("session_id"), "method", "confidence", "cross_session",
        "checkout_id", "order_id", F.col("visitor_id").cast("string").alias("actual_visitor_id"),
        F.col("session_id").cast("string").alias("actual_session_id"), "identifier_source", "lookback_days",
        F.col("received_at").cast("string").alias("resolved_at"),
    )))
    r = resolved.select("event_id", rec.alias("_rec"))
    j = ev.join(r, "event_id", "left")
    # the record replaces one that the client may have sent under the same key
    merged = F.when(F.col("_rec").isNotNull(), json_merge(F.col("properties"), {"conversion_attribution": F.col("_rec")}))
    merged = F.coalesce(merged, F.col("properties"))
    return j.withColumn("properties", merged).drop("_rec")
