import datetime as dt

from clickloom.streaming.aggregates import stream_daily, stream_dedupe

T0 = dt.datetime(2024, 7, 1, 9, 0, 0)


def test_dedupe_and_daily_counts_match_batch(spark, tmpdir_path):
    rows = []
    for i in range(60):
        ts = T0 + dt.timedelta(hours=i * 2)
        name = "page_view" if i % 3 else "purchase"
        rows.append((f"e{i}", name, f"v{i % 4}", ts, ts))
    replays = [(e, n, v, c, r + dt.timedelta(minutes=5)) for e, n, v, c, r in rows[::7]]
    schema = "event_id string, event_name string, visitor_id string, client_timestamp timestamp_ntz, received_at timestamp_ntz"
    src = f"{tmpdir_path}/src"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    spark.createDataFrame(replays, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out = f"{tmpdir_path}/out"
    q = (stream_daily(stream_dedupe(stream)).writeStream.outputMode("complete")
         .option("checkpointLocation", f"{tmpdir_path}/ck").trigger(availableNow=True)
         .foreachBatch(lambda df, _e: df.write.mode("overwrite").parquet(out)).start())
    q.awaitTermination()
    got = {r.day: (r.events, r.purchases) for r in spark.read.parquet(out).collect()}
    want = {}
    for _, n, _, c, _ in rows:
        d = dt.datetime(c.year, c.month, c.day)
        e, p = want.get(d, (0, 0))
        want[d] = (e + 1, p + (n == "purchase"))
    assert got == want
