import datetime as dt

from clickloom.operators.interaction import page_vitals, scroll_milestones, section_dwell

T0 = dt.datetime(2024, 5, 1, 10, 0, 0)


def ms(n):
    return T0 + dt.timedelta(milliseconds=n)


def test_section_dwell_threshold_and_running_total(spark):
    rows = [("p", "s1", ms(0), "enter"), ("p", "s1", ms(749), "exit"),       # 749 ms: not reported
            ("p", "s1", ms(1000), "enter"), ("p", "s1", ms(1750), "exit"),   # 750 ms: reported, total 1499
            ("p", "s2", ms(0), "enter"), ("p", "s2", ms(5000), "exit"),
            ("p", "s2", ms(6000), "exit")]                                   # stray exit ignored
    df = spark.createDataFrame(rows, "page_instance_id string, section_key string, ts timestamp_ntz, state string")
    got = sorted((r.section_key, r.visible_ms, r.cumulative_visible_ms) for r in section_dwell(df).collect())
    assert got == [("s1", 750, 1499), ("s2", 5000, 5000)]


def test_scroll_milestones_passed_at_once(spark):
    rows = [("p", ms(0), 5), ("p", ms(100), 60), ("p", ms(200), 100), ("q", ms(0), 30)]
    df = spark.createDataFrame(rows, "page_instance_id string, ts timestamp_ntz, depth int")
    got = {(r.page_instance_id, r.milestone): r.reached_at for r in scroll_milestones(df).collect()}
    assert got[("p", 10)] == got[("p", 50)] == ms(100)  # 10, 25 and 50 reached by one event
    assert got[("p", 100)] == ms(200) and ("q", 50) not in got and got[("q", 25)] == ms(0)


def test_page_vitals_late_lcp_and_recent_input(spark):
    rows = [("p", ms(0), "lcp", 1200.0, False), ("p", ms(900), "lcp", 2500.0, False),   # late LCP wins
            ("p", ms(100), "inp", 80.0, False), ("p", ms(200), "inp", 240.0, False),
            ("p", ms(300), "cls", 0.1, False), ("p", ms(400), "cls", 0.3, True)]       # shift after input ignored
    df = spark.createDataFrame(rows, "page_instance_id string, ts timestamp_ntz, metric string, value double, "
                                     "recent_input boolean")
    r = page_vitals(df).first()
    assert (r.lcp_ms, r.inp_ms, round(r.cls, 6)) == (2500.0, 240.0, 0.1)


def test_visitor_overlap_three_valued(spark):
    import json

    from conftest import make_events

    from clickloom.operators.journeys import visitor_overlap

    rows = [
        # funnel only (page_type present, so the sales-page flag is FALSE, not NULL)
        dict(visitor_id="f", event_name="funnel_view", client_timestamp=T0, properties=json.dumps({"page_type": "funnel"})),
        # funnel event without any page_type: sales-page flag NULL -> not "funnel only"
        dict(visitor_id="g", event_name="funnel_view", client_timestamp=T0),
        # sales page only (page_type given)
        dict(visitor_id="s", event_name="page_view", client_timestamp=T0, properties=json.dumps({"page_type": "sales_page"})),
        # both
        dict(visitor_id="b", event_name="funnel_view", client_timestamp=T0),
        dict(visitor_id="b", event_name="purchase", client_timestamp=T0, properties=json.dumps({"page_type": "x"})),
        dict(visitor_id="b", event_name="sales_page_view", client_timestamp=T0),
        # no page_type anywhere: both flags NULL -> in no group at all
        dict(visitor_id="n", event_name="page_view", client_timestamp=T0, page_path="/p"),
        # page_type present but neither: both flags FALSE -> unclassified
        dict(visitor_id="u", event_name="page_view", client_timestamp=T0, page_path="/p",
             properties=json.dumps({"page_type": "other"})),
    ]
    r = visitor_overlap(make_events(spark, rows)).first()
    assert (r.funnel_only_visitors, r.sales_page_only_visitors, r.funnel_and_sales_page_visitors,
            r.unclassified_visitors, r.funnel_touched_purchase_visitors) == (1, 1, 1, 1, 1)
