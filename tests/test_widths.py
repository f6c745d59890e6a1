"""What shuffles and stored steps move: narrow rows, whatever the width of the table."""

from pyspark.sql import functions as F

from clickloom.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def test_bag_is_made_after_the_last_shuffle(spark):
    plan = FX._fx_events_build(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda *words: [i for i, line in enumerate(plan) if any(w in line.split("(")[0] for w in words)]
    bag = [i for i, line in enumerate(plan) if "concat_ws" in line]
    moves = at("Join", "Window", "Aggregate")
    assert bag and moves and max(bag) < min(moves)  # the plan is printed from the top


def test_silver_rows_are_put_in_order_before_they_are_widened(spark):
    rows = FX._fx_rows(spark, SF)
    assert "properties" not in rows.columns and rows.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    wide = FX._fx_wide(rows.repartitionByRange("ts").sortWithinPartitions("event_date"))
    order = wide._jdf.queryExecution().optimizedPlan().outputOrdering()
    assert "event_date" in order.toString()  # the partitioned write sorts nothing again


def test_ads_go_through_the_upsert_narrow(spark):
    plan = FX.fx_ads(spark, SF, materialize=False)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [i for i, line in enumerate(plan) if "Campaign " in line]
    merged = [i for i, line in enumerate(plan) if "max_by" in line]
    assert made and merged and max(made) < min(merged)  # the plan is printed from the top


def test_upserted_ads_are_those_of_the_raw_rows(spark):
    from clickloom.sources.ads import upsert_latest

    plain = upsert_latest(None, FX.fx_ads_raw(spark, SF), order=("ingested_at", "ingested_seq"))
    got = FX.fx_ads(spark, SF, materialize=False)
    assert got.schema.simpleString() == plain.schema.simpleString()
    assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0


def test_posted_ads_are_read_once_and_stored_compressed(spark):
    from clickloom.plans.catalog import QUERIES, _ad_post_rows, _stage_dir
    from clickloom.sources.ads import normalized_ads

    got = QUERIES["ads_ingest_json"](spark, SF)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("json") == 1
    assert all(f.endswith(".json.gz") for f in spark.read.text(f"{_stage_dir(spark, 'ad_posts', SF)}/posts").inputFiles())
    want = normalized_ads(_ad_post_rows(spark, SF)).select("ingested_seq", "campaign_id", "accepted")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_stream_source_is_compressed(spark):
    from clickloom.plans.catalog import STREAM_CUTS, STREAM_FILES, _stream_source

    files = spark.read.text(f"{_stream_source(spark, SF)}/source").inputFiles()
    assert len(files) == STREAM_FILES * (len(STREAM_CUTS) - 1) and all(f.endswith(".gz") for f in files)


def test_a_batch_checkpoints_no_bags_and_leaves_no_steps(spark, tmpdir_path, monkeypatch):
    import os

    from test_seen import T0, body

    from clickloom.config import UUID_PATTERN
    from clickloom.sources.events import parse_bodies
    from clickloom.streaming import ingest

    batch = parse_bodies(spark.createDataFrame([(body(n, f"s{n % 2}"), T0) for n in (1, 1, 2, 3)], "body string, arrival timestamp_ntz"))
    seen, keep = [], type(batch).checkpoint
    monkeypatch.setattr(type(batch), "checkpoint", lambda self, *a, **k: (seen.append(self.columns), keep(self, *a, **k))[1])
    ingest.process_batch(spark, batch, 0, f"{tmpdir_path}/t", f"{tmpdir_path}/d", "arrival", UUID_PATTERN, None, 30, buckets=2)
    assert seen and not any("properties" in c for c in seen)
    assert sorted(r.event_id[-1] for r in spark.read.parquet(f"{tmpdir_path}/t").collect()) == ["1", "2"]
    assert os.listdir(f"{tmpdir_path}/t_steps") == []


def test_weeks_are_dealt_to_files_without_a_shuffle(spark):
    from clickloom.plans.catalog import dealt

    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    wide = dealt(spark.range(0, 100, 1, 12), 8)
    assert wide.rdd.getNumPartitions() == 8 and wide.count() == 100 and "Exchange" not in plan(wide)
    few = dealt(spark.range(0, 100, 1, 3), 8)
    assert few.rdd.getNumPartitions() == 8 and few.count() == 100


def test_latest_rows_of_numbers_are_found_without_a_sort(spark):
    from clickloom.sources.ads import upsert_latest

    rows = [(1, 10, 5, 1.0, None), (1, 11, None, 2.0, 7), (1, 11, 4, None, 8), (1, None, 9, 4.0, 9),
            (2, None, None, 5.0, 1), (None, 3, 1, 6.0, 2), (None, 3, 2, 7.0, None), (3, None, 1, 8.0, 3), (3, None, 2, 9.0, 4)]
    t = spark.createDataFrame(rows, "k int, at bigint, seq bigint, v double, w int")
    got = upsert_latest(t.limit(4), t, keys=("k",), order=("at", "seq"))
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, 11, 4, None, 8), (2, None, None, 5.0, 1), (None, 3, 2, 7.0, None), (3, None, 2, 9.0, 4)], key=str)
    text = t.withColumn("w", t.w.cast("string"))  # the struct form gives the same rows
    plain = upsert_latest(None, text, keys=("k",), order=("at", "seq"))
    assert plain.withColumn("w", plain.w.cast("int")).exceptAll(got).count() == 0
    assert "SortAggregate" not in upsert_latest(None, FX.fx_ads_narrow(spark, SF), ("account", "day", "ad"), ("ingested_at", "ingested_seq"))._jdf.queryExecution().executedPlan().toString()


def test_ingest_reads_the_bag_once(spark):
    from clickloom.plans.catalog import QUERIES

    plan = lambda q: QUERIES[q](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan("ingest_events_batch")
    again = plan("reclassify_history")
    assert "get_json_object" not in again and again.count("from_json(MapType") <= 1


def test_event_table_is_stored_with_the_table_codec(spark):
    files = FX.fx_silver(spark, SF).inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_a_batch_holds_no_step_that_is_not_read_again(spark, tmpdir_path, monkeypatch):
    import os

    from test_seen import T0, body

    from clickloom.config import UUID_PATTERN
    from clickloom.sources.events import parse_bodies
    from clickloom.streaming import ingest

    batch = parse_bodies(spark.createDataFrame([(body(n, f"s{n % 2}"), T0) for n in (1, 1, 2, 3)], "body string, arrival timestamp_ntz"))
    points, held, keep, stamp = [], [], type(batch).checkpoint, ingest.stamp_attribution
    monkeypatch.setattr(type(batch), "checkpoint", lambda self, *a, **k: (points.append(self.columns), keep(self, *a, **k))[1])
    monkeypatch.setattr(ingest, "stamp_attribution", lambda *a: (held.extend(os.listdir(f"{tmpdir_path}/t_steps/batch-0")), stamp(*a))[1])
    ingest.process_batch(spark, batch, 0, f"{tmpdir_path}/t", f"{tmpdir_path}/d", "arrival", UUID_PATTERN, None, 30, buckets=2)
    assert sorted(held) == ["candidates", "fresh"]  # the accepted rows are gone before the target is written
    assert not any("hid" in c or "_hash" in c for c in points)  # a checkpoint would outlive the batch
    target = spark.read.parquet(f"{tmpdir_path}/t")
    assert all(f.endswith(".zstd.parquet") for f in target.inputFiles()) and target.count() == 2


def test_stream_files_are_of_one_size_and_made_of_narrow_rows(spark, tmpdir_path, monkeypatch):
    import datetime as dt

    from clickloom.plans import catalog

    day = lambda n: dt.datetime(2024, 1, 1 + n)
    rows = [(i, i % 7, day(1 if i % 10 else i // 10 % 29) + dt.timedelta(seconds=i), "view", 1.0, f'{{"k": {i % 90}}}') for i in range(1200)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string").repartition(3).write.parquet(f"{tmpdir_path}/events.parquet")
    spark.createDataFrame([(i, f"https://a.example/{i}?utm_source=x") for i in range(5)], "page_id bigint, url string").write.parquet(f"{tmpdir_path}/pages.parquet")
    monkeypatch.setattr(catalog, "events", lambda *_: (_ for _ in ()).throw(AssertionError("the event table is not needed")))
    lines = spark.read.text(f"{catalog._stream_source(spark, tmpdir_path)}/source").select("value", F.input_file_name().alias("file"))
    first = lines.where("value like '%2024-01-02T%'").groupBy("file").count().collect()  # one day has most rows
    sizes = sorted(r["count"] for r in first)[-catalog.STREAM_FILES:]
    assert len(sizes) == catalog.STREAM_FILES and max(sizes) <= 1.5 * min(sizes)
    table = FX.fx_widened(FX.fx_rows(spark, tmpdir_path))
    plain = FX.fx_events(spark, tmpdir_path)
    assert table.columns == plain.columns and table.count() == plain.count() == 1200 and table.exceptAll(plain).count() == 0


def test_a_url_without_a_query_is_not_searched_for_hints(spark):
    from clickloom.functions.urls import with_url_hints

    rows = [("https://a.example/p",), ("https://a.example/p?utm_source=x&utm_source=y&ct_session_id=s",), ("no scheme?utm_source=z q",), (None,)]
    df = with_url_hints(spark.createDataFrame(rows, "u string"), "u", "h")
    assert df._jdf.queryExecution().analyzed().toString().count("parse_url") == 1  # named once, also for the names' places
    got = [(r.h.source, r.h.utm_source, r.h.ct_session_id) for r in df.collect()]
    assert got[0] == got[3] == (None, None, None) and got[1] == ("query", "x", "s") and got[2] == ("query", "z q", None)
