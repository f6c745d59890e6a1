"""URL functions as native column expressions: stable hash (X7), URL hints
(X10), URL sanitiser (X8), referrer host (X24).

All of them are built from ``try_parse_url``, ``split`` and higher-order array
functions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.config import URL_CLICK_ID_PARAMS, URL_PRESERVED_PARAMS


def js_trim(c: Column) -> Column:
    """Trim all leading/trailing whitespace (Spark's ``trim`` only strips spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def optional_text(c: Column, max_len: int | None = None) -> Column:
    """String trimmed, '' -> NULL, cut to ``max_len`` if that is given."""
    t = js_trim(c)
    return F.when(t != "", t if max_len is None else F.substring(t, 1, max_len))


def sha24(c: Column) -> Column:
    """First 24 hex chars of SHA-256."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 24)


def _escaped(url: Column) -> Column:
    # java.net.URI rejects raw spaces, '|' and a few other characters that
    # browsers accept; percent-escape them before parsing.
    for char, code in ((" ", "%20"), ("|", "%7C"), ("^", "%5E"), ("`", "%60"), ('"', "%22")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named
    (also inside lambdas, which would repeat it for every element)."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(_escaped(url), F.lit(part))


def is_http_url(url: Column) -> Column:
    return F.lower(parse_url_part(url, "PROTOCOL")).isin("http", "https") & parse_url_part(url, "HOST").isNotNull()


def query_pairs(url: Column) -> Column:
    """Array of struct(k, v) of the URL's query string, names and values
    form-decoded, in order."""
    return pairs_of_query(parse_url_part(url, "QUERY"))


def pairs_of_query(q: Column) -> Column:
    parts = F.filter(F.split(q, "&"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            F.try_url_decode(F.substring_index(x, "=", 1)).alias("k"),
            F.try_url_decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def url_param(pairs: Column, name: str) -> Column:
    """First value of query parameter ``name`` (``URLSearchParams.get``)."""
    return F.get(F.filter(pairs, lambda p: p["k"] == F.lit(name)), 0)["v"]


def first_param(pairs: Column, names, max_len: int | None = None) -> Column:
    return F.coalesce(*[optional_text(url_param(pairs, n), max_len) for n in names])


def params_map(pairs: Column) -> Column:
    """Query pairs as a map name -> first value (later duplicates dropped)."""
    first = lambda pairs, keys: F.filter(pairs, lambda p, i: (F.array_position(keys, p["k"]) == i + 1) & p["k"].isNotNull())
    return let(pairs, lambda pairs: let(F.transform(pairs, lambda p: p["k"]), lambda keys: F.map_from_entries(first(pairs, keys))))


# FIXED VALUES: query parameter names read as attribution hints, in priority order.
HINT_PARAMS = {
    "ct_visitor_id": ("ct_visitor_id", "attributes[ct_visitor_id]", "attributes[_ct_visitor_id]"),
    "ct_session_id": ("ct_session_id", "attributes[ct_session_id]", "attributes[_ct_session_id]"),
    "ct_checkout_id": ("ct_checkout_id", "checkout_token", "attributes[ct_checkout_id]"),
    "checkout_id": ("checkout_id", "checkout_token"),
    "order_id": ("order_id",),
    "utm_source": ("utm_source", "attributes[ct_utm_source]"),
    "utm_medium": ("utm_medium", "attributes[ct_utm_medium]"),
    "utm_campaign": ("utm_campaign", "attributes[ct_utm_campaign]"),
    "utm_content": ("utm_content", "attributes[ct_utm_content]"),
    "utm_term": ("utm_term", "attributes[ct_utm_term]"),
    "fbclid": ("fbclid", "attributes[ct_fbclid]"),
    "origin": ("ref", "attributes[ct_origin]"),
}
# Keys of the base64url JSON carried in the ``properties`` query parameter.
ENCODED_HINT_KEYS = {
    "ct_visitor_id": ("_ct_visitor_id", "ct_visitor_id"),
    "ct_session_id": ("_ct_session_id", "ct_session_id"),
    "ct_checkout_id": ("_ct_checkout_id", "ct_checkout_id"),
    "utm_source": ("_ct_utm_source",),
    "utm_medium": ("_ct_utm_medium",),
    "utm_campaign": ("_ct_utm_campaign",),
    "utm_content": ("_ct_utm_content",),
    "utm_term": ("_ct_utm_term",),
    "fbclid": ("_ct_fbclid",),
}


def with_url_hints(df, url_col: str = "page_url", out: str = "url_hints", encoded_fallback: bool = True):
    """Add the ``url_hints`` struct in small steps: the query string is parsed
    once into a name -> value map column and the encoded document once into a
    struct column; each hint is then a map lookup.  (One monolithic expression
    would repeat the parsing per parameter name and outgrow code generation.)"""
    d = df.withColumn("_qm", F.when(F.col(url_col).contains("?"), params_map(query_pairs(F.col(url_col)))))  # else there is no query string
    raw = F.col("_qm")["properties"]
    keys = sorted({k for ks in ENCODED_HINT_KEYS.values() for k in ks})
    schema = "struct<" + ",".join(f"`{k}`:string" for k in keys) + ">"
    d = d.withColumn("_qe", F.from_json(F.try_to_binary(F.translate(raw, "-_", "+/"), F.lit("base64")).cast("string"), schema))
    query = {name: F.coalesce(*[optional_text(F.col("_qm")[n]) for n in params])
             for name, params in HINT_PARAMS.items()}
    d = d.select("*", *[v.alias(f"_q_{k}") for k, v in query.items()],
                 *[F.coalesce(*[optional_text(F.col("_qe")[k]) for k in ks]).alias(f"_e_{name}")
                   for name, ks in ENCODED_HINT_KEYS.items()])
    has_q = F.greatest(*[F.col(f"_q_{k}").isNotNull() for k in HINT_PARAMS])
    has_e = F.greatest(*[F.col(f"_e_{k}").isNotNull() for k in ENCODED_HINT_KEYS])
    fields = [(F.coalesce(F.col(f"_q_{k}"), F.col(f"_e_{k}")) if (encoded_fallback and k in ENCODED_HINT_KEYS)
               else F.col(f"_q_{k}")).alias(k) for k in HINT_PARAMS]
    source = F.when(has_q & has_e, "mixed").when(has_q, "query").when(has_e, "encoded_properties")
    d = d.withColumn(out, F.struct(*fields, source.alias("source")))
    return d.drop("_qm", "_qe", *[f"_q_{k}" for k in HINT_PARAMS], *[f"_e_{k}" for k in ENCODED_HINT_KEYS])


def referrer_host(ref: Column) -> Column:
    """X24."""
    return parse_url_part(ref, "HOST")


def sanitize_url(url: Column) -> Column:
    """Keep scheme, host and path; hash checkout / cart paths; keep the
    preserved parameters (last duplicate wins, first position kept) and replace
    click ids by ``<name>_hash``; unparsable input stays as it is."""
    lower = lambda u, part: F.lower(F.try_parse_url(u, F.lit(part)))
    parts = lambda u: F.struct(
        lower(u, "PROTOCOL").alias("proto"), lower(u, "HOST").alias("host"), F.try_parse_url(u, F.lit("AUTHORITY")).alias("auth"),
        F.try_parse_url(u, F.lit("PATH")).alias("path"), F.try_parse_url(u, F.lit("QUERY")).alias("query"))
    return let(let(_escaped(url), parts), lambda p: F.when(p["proto"].isNotNull() & p["host"].isNotNull(), _reduced(p)).otherwise(url))


def _reduced(url: Column) -> Column:
    """The sanitised text of a URL's parts (proto, host, auth, path, query)."""
    proto, host, port = url["proto"], url["host"], F.regexp_extract(url["auth"], r":(\d+)$", 1)
    default_port = lambda port: ((proto == "http") & (port == "80")) | ((proto == "https") & (port == "443"))
    hostport = let(port, lambda port: F.when((port != "") & ~default_port(port), F.concat(host, F.lit(":"), port)).otherwise(host))
    path = F.coalesce(F.when(url["path"] != "", url["path"]), F.lit("/"))
    path = (F.when(path.startswith("/checkouts/"), F.concat(F.lit("/checkouts/hash-"), sha24(path)))
            .when(path.startswith("/cart/"), F.concat(F.lit("/cart/hash-"), sha24(path)))
            .otherwise(path))
    pres = F.array(*[F.lit(p) for p in URL_PRESERVED_PARAMS])
    clicks = F.array(*[F.lit(p) for p in URL_CLICK_ID_PARAMS])
    kept = F.transform(
        F.filter(pairs_of_query(url["query"]), lambda p: F.array_contains(pres, p["k"]) | F.array_contains(clicks, p["k"])),
        lambda p: F.when(F.array_contains(clicks, p["k"]),
                         F.struct(F.concat(p["k"], F.lit("_hash")).alias("k"), sha24(p["v"]).alias("v")))
        .otherwise(F.struct(p["k"].alias("k"), p["v"].alias("v"))),
    )
    pairs = let(kept, lambda kept: F.transform(
        F.array_distinct(F.transform(kept, lambda p: p["k"])),
        lambda k: F.concat(F.url_encode(k), F.lit("="),
                           F.url_encode(F.element_at(F.filter(kept, lambda p: p["k"] == k), -1)["v"])),
    ))
    query = let(pairs, lambda pairs: F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(F.lit("")))
    return F.concat(proto, F.lit("://"), hostport, path, F.when(url["query"].isNotNull(), query).otherwise(F.lit("")))
