import hashlib
import json
import math

from pyspark.sql import functions as F

from clickloom.functions.nested import find_nested
from clickloom.functions.sanitize import reduced_url, sanitize_json_text
from clickloom.functions.stats import safe_divide, wilson
from clickloom.functions.urls import sanitize_url, with_url_hints
from clickloom.operators.classify import classify_traffic, json_merge
from clickloom.operators.diagnosis import js_round, parse_decimal


def test_find_nested_order_and_depth():
    keys = frozenset({"order_id", "orderId"})
    assert find_nested({"a": {"orderId": "X"}, "order_id": "Y"}, keys) == "Y"  # this level first
    assert find_nested({"a": [{"b": {"orderId": "Z"}}]}, keys) == "Z"
    deep = {"a": {"b": {"c": {"d": {"e": {"order_id": "deep"}}}}}}
    assert find_nested(deep, keys) == "deep"  # no depth is too deep
    assert find_nested({"x": {"order_id": "", "y": {"order_id": "no"}}, "z": [1, {"orderId": "Q"}]}, keys) == "Q"
    assert find_nested({"items": [{"n": i} for i in range(200)] + [{"orderId": "last"}]}, keys) == "last"
    assert find_nested({"order_id": None, "x": {"order_id": "N"}}, keys) == "N"


def test_url_hints(spark):
    enc = "eyJfY3RfdmlzaXRvcl9pZCI6IlYxIiwiX2N0X3V0bV9jYW1wYWlnbiI6ImVuYyJ9"  # {"_ct_visitor_id":"V1","_ct_utm_campaign":"enc"}
    df = spark.createDataFrame([
        (f"https://a.example.com/p?utm_source=fb&utm_source=two&attributes%5Bct_session_id%5D=S1&properties={enc}",),
        ("https://a.example.com/p?utm_source=%20",),
        ("not a url",),
    ], ["u"])
    h = [r.h for r in with_url_hints(df, "u", "h").collect()]
    assert (h[0].utm_source, h[0].ct_session_id, h[0].ct_visitor_id, h[0].utm_campaign, h[0].source) == (
        "fb", "S1", "V1", "enc", "mixed")
    assert h[1].utm_source is None and h[1].source is None
    assert h[2].source is None


def test_sanitize_url_native_matches_python(spark):
    urls = [
        "https://Shop.Example.com:443/checkouts/abc?utm_source=x&fbclid=123&foo=bar&utm_source=y",
        "http://shop.example.com:8080/cart/1:2?ref=a%20b&gclid=g",
        "https://shop.example.com",
        "nonsense value",
    ]
    df = spark.createDataFrame([(u,) for u in urls], ["u"])
    got = [r.s for r in df.select(sanitize_url(F.col("u")).alias("s")).collect()]
    assert got == [reduced_url(u) for u in urls]
    assert got[0].startswith("https://shop.example.com/checkouts/hash-") and "fbclid_hash=" in got[0]
    assert "utm_source=y" in got[0] and "foo" not in got[0]


def test_sanitize_value_rules():
    doc = {"checkout_id": "abc", "page_url": "https://x.example.com/cart/9?utm_source=s", "count": "12",
           "order_date": "2024", "nested": {"email": "a@b"}, "empty": ""}
    out = json.loads(sanitize_json_text(json.dumps(doc)))
    assert out["checkout_id"].startswith("sha256:") and len(out["checkout_id"]) == 31
    assert out["page_url"].startswith("https://x.example.com/cart/hash-")
    assert out["count"] == 12 and out["order_date"] == "2024"
    assert out["nested"]["email"].startswith("sha256:")
    deep = {"a": {}}
    cur = deep["a"]
    for _ in range(12):
        cur["a"] = {}
        cur = cur["a"]
    assert "[depth-limited]" in sanitize_json_text(json.dumps(deep), max_depth=10)
    assert "[depth-limited]" not in sanitize_json_text(json.dumps(deep))
    many = json.dumps({"email": ["a@b"] * 3, "rows": [{"phone": "1"}] * 3})
    assert "a@b" not in sanitize_json_text(many) and sanitize_json_text(many).count("sha256:") == 6


def test_wilson_cases(spark):
    df = spark.createDataFrame([(0, 0), (5, 3), (0, 10), (10, 10), (3, 20)], "s long, n long")
    w = [r.w for r in df.select(wilson("s", "n").alias("w")).collect()]
    assert not w[0].valid and w[0].warning == "no valid denominator"
    assert not w[1].valid and "exceed" in w[1].warning
    assert w[2].valid and w[2].lower_95 == 0.0 and 0 < w[2].upper_95 < 0.4
    assert w[3].upper_95 == 1.0 and w[3].rate == 1.0
    z = 1.959963984540054
    p, n = 3 / 20, 20
    den = 1 + z * z / n
    center = (p + z * z / (2 * n)) / den
    margin = (z / den) * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    assert abs(w[4].lower_95 - round(center - margin, 6)) < 1e-9


def test_safe_divide_and_rounding(spark):
    r = spark.range(1).select(safe_divide(F.lit(1), F.lit(3)).alias("a"), safe_divide(F.lit(1), F.lit(0)).alias("b"),
                              js_round(F.lit(1.005), 2).alias("c"), js_round(F.lit(-2.5), 0).alias("d"),
                              parse_decimal(F.lit("1.234,56")).alias("e"), parse_decimal(F.lit(" ")).alias("f")).first()
    assert r.a == 0.333333 and r.b is None and r.c == 1.01 and r.d == -2.0 and r.e == 1234.56 and r.f is None


def test_classify_precedence(spark):
    rows = [
        ("https://x.example.com/?ct_internal=1", "/", "sale", '{"test": "true"}', "internal", "url_ct_internal"),
        ("http://localhost:3000/", "/", None, "{}", "internal", "localhost"),
        ("https://x.example.com/", "/", None, '{"server_context": {"user_agent": "Googlebot/2.1"}}', "bot", "known_bot_user_agent"),
        ("https://x.example.com/?preview_theme_id=1", "/", "qa", "{}", "preview", "shopify_theme_preview"),
        ("https://x.example.com/", "/", "black-friday-test", "{}", "qa", "test_campaign"),
        ("https://x.example.com/", "/", "contest", "{}", "production", "production_default"),
        ("https://x.example.com/", "/", None, '{"internal_traffic": "TRUE"}', "internal", "property_internal_traffic"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "page_url string, page_path string, utm_campaign string, properties string")
    got = [(r.traffic_classification, r.traffic_classification_reason) for r in classify_traffic(df).collect()]
    assert got == [r[4:] for r in rows]


def test_json_merge_right_wins(spark):
    df = spark.createDataFrame([('{"a": 1, "test": "false", "o": {"x": [1, 2]}}',)], ["p"])
    out = df.select(json_merge(F.col("p"), {"test": F.parse_json(F.lit("true")), "b": F.lit("s").cast("variant"),
                                            "n": F.lit(None).cast("variant")}).alias("m")).first().m
    assert json.loads(out) == {"a": 1, "o": {"x": [1, 2]}, "test": True, "b": "s"}


def test_checkout_helpers(spark):
    from clickloom.operators.checkout import compact_map, ct_attributes, device_bucket

    df = spark.createDataFrame([([{"key": "ct_a", "value": "1"}, {"key": "x", "value": "2"}, {"key": "ct_a", "value": "3"},
                                  {"key": "ct_b", "value": ""}], 800)],
                               "attrs array<struct<key:string,value:string>>, w int")
    r = df.select(ct_attributes(F.col("attrs")).alias("m"), device_bucket(F.col("w")).alias("d"),
                  device_bucket(F.lit(0)).alias("d0"), compact_map(ct_attributes(F.col("attrs"))).alias("c")).first()
    assert r.m == {"ct_a": "3", "ct_b": ""} and r.d == "tablet" and r.d0 == "desktop" and r.c == {"ct_a": "3"}


def test_a_url_is_taken_apart_once(spark):
    """The plan names each part of a URL once, and lambdas do not repeat it."""
    from clickloom.functions.urls import sanitize_url

    rows = [("https://A.shop:443/cart/9?utm_source=a b&fbclid=1&utm_source=c&x=1",), ("https://a.shop:8080?ref=p&ref=q",), ("mailto:a?ref=1",), ("https://a.shop/x y?",), (None,)]
    out = spark.createDataFrame(rows, "url string").select(sanitize_url(F.col("url")).alias("u"))
    assert out._jdf.queryExecution().analyzed().toString().count("parse_url") <= 5
    cart, click = (hashlib.sha256(x).hexdigest()[:24] for x in (b"/cart/9", b"1"))
    assert [r.u for r in out.collect()] == [f"https://a.shop/cart/hash-{cart}?utm_source=c&fbclid_hash={click}", "https://a.shop:8080/?ref=q", "mailto:a?ref=1", "https://a.shop/x%20y", None]


def test_json_rules_are_remembered_by_key_and_text(monkeypatch):
    from clickloom.functions import sanitize

    asked, keep = [], sanitize.text_rule
    monkeypatch.setattr(sanitize, "text_rule", lambda key: asked.append(key) or keep(key))
    sanitize.json_tools.cache_clear()
    docs = [json.dumps({"n": "1", "email": "1", "at": "1", "deep": {"n": "1", "l": ["1"]}, "long": "x" * 99})] * 3
    assert len({sanitize.sanitize_json_text(d) for d in docs}) == 1
    assert (asked.count("n"), asked.count("email"), asked.count("at"), asked.count("long")) == (1, 1, 1, 3)
    assert json.loads(sanitize.sanitize_json_text(docs[0]))["n"] == 1 and json.loads(sanitize.sanitize_json_text(docs[0]))["at"] == "1"
    sanitize.json_tools.cache_clear()
