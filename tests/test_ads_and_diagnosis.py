import json

from pyspark.sql import functions as F

from clickloom.operators.diagnosis import diagnose_funnel, funnel_warnings, sample_readiness, unit_economics
from clickloom.sources.ads import ingest_ads_json, upsert_latest


def test_normalize_ads(spark, tmpdir_path):
    rows = [
        {"date_start": "2024-01-02", "campaign_id": "c1", "ad_id": "a1", "spend": "12.5", "impressions": "100.6",
         "landing_page_views": 0, "actions": [{"action_type": "landing_page_view", "value": "7"}]},
        {"date_start": "2024-01-02", "campaign_id": "c1"},                      # missing ad id
        {"date_start": "2024-02-30", "campaign_id": "c1", "ad_id": "a2"},       # impossible date
        {"date_start": "2024-01-03", "campaign_id": " ", "ad_id": "a3"},        # blank campaign
        {"date_start": "2024-01-03", "campaign_id": 7, "ad_id": 8, "spend": -4, "purchases": "x",
         "actions": [{"action_type": "omni_purchase", "value": "2"}]},
    ]
    path = f"{tmpdir_path}/ads.json"
    with open(path, "w") as f:
        f.write(json.dumps({"rows": rows}) + "\n")
    ok, bad = ingest_ads_json(spark, path)
    ok = {r.ad_id: r for r in ok.collect()}
    assert bad.count() == 3
    assert ok["a1"].landing_page_views == 7 and ok["a1"].impressions == 101 and ok["a1"].account_id == "unknown-account"
    assert ok["8"].spend == 0.0 and ok["8"].purchases == 2.0 and ok["8"].adset_id == "unknown-adset"


def test_upsert_latest_order_independent(spark):
    old = spark.createDataFrame([("k", 1, 10.0), ("m", 1, 1.0)], "ad_id string, seq int, spend double")
    new = spark.createDataFrame([("k", 3, 30.0), ("k", 2, 20.0)], "ad_id string, seq int, spend double")
    a = {r.ad_id: r.spend for r in upsert_latest(old, new, keys=("ad_id",), order=("seq",)).collect()}
    b = {r.ad_id: r.spend for r in upsert_latest(new, old, keys=("ad_id",), order=("seq",)).collect()}
    assert a == b == {"k": 30.0, "m": 1.0}


def test_unit_economics(spark):
    df = spark.createDataFrame([("o1", "169", "69", "20"), ("o2", "100", "30", "40"), ("o3", "0", "30", "10"),
                                ("o4", None, "30", "10")],
                               "offer_id string, average_order_value string, contribution_margin_percent string, "
                               "desired_profit_percent string")
    e = {r.offer_id: r for r in unit_economics(df).collect()}
    assert e["o1"].target_cac == 82.81 and e["o1"].break_even_cac == 116.61 and e["o1"].target_roas == 2.0408
    assert e["o2"].economics_warning == "profit_exceeds_margin"
    assert e["o3"].economics_warning == "invalid_ranges" and e["o4"].economics_warning == "missing_inputs"


def _funnel(spark, rows):
    cols = ("campaign_id offer_id spend impressions reach three_second_views link_clicks landing_page_views "
            "add_to_carts checkouts purchases revenue").split()
    schema = ", ".join(f"{c} string" if c in ("campaign_id", "offer_id") else f"{c} double" for c in cols)
    return spark.createDataFrame(rows, schema)


def test_diagnosis_statuses_and_bottleneck(spark):
    f = _funnel(spark, [
        ("c1", "o", 500.0, 10000.0, 8000.0, 1000.0, 200.0, 180.0, 5.0, 3.0, 1.0, 169.0),    # hook 10% < 20 -> creative
        ("c2", "o", 500.0, 10000.0, 8000.0, 4000.0, 200.0, 180.0, 20.0, 12.0, 8.0, 1352.0),  # healthy-ish
        ("c3", "o", 10.0, 100.0, 120.0, None, 2.0, 3.0, None, 1.0, 2.0, 5.0),               # small, inconsistent
    ])
    offers = spark.createDataFrame([("o", "169", "69", "20")], "offer_id string, average_order_value string, "
                                   "contribution_margin_percent string, desired_profit_percent string")
    d = {r.campaign_id: r for r in diagnose_funnel(f, offers).collect()}
    assert d["c1"].first_probable_bottleneck == "creative_hook"
    assert d["c3"].diagnosis_summary == "waiting_for_sample"
    s = {r.campaign_id: r for r in sample_readiness(f).collect()}
    assert s["c2"].cac_sample_status == "directional" and s["c3"].creative_sample_status == "insufficient"
    w = {r.campaign_id: r.warnings for r in funnel_warnings(f).collect()}
    assert "reach_exceeds_impressions" in w["c3"] and "landing_page_views_exceed_clicks" in w["c3"]
    assert "add_to_carts_missing" in w["c3"] and "purchases_exceed_checkouts" in w["c3"]
