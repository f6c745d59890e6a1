import json
import os

from pyspark.sql import functions as F

from clickloom.plans import catalog as C
from clickloom.plans import export as EXP

SF = "/root/testdata/sf0.001"


def test_full_bundle_isolated_and_written(spark, tmpdir_path):
    bundle = EXP.build_bundle(C.events(spark, SF), C.ads(spark, SF), C._fx_cfg())
    bundle["broken"] = lambda: C.events(spark, SF).select(F.col("no_such_column"))  # fails at analysis
    health = {r.name: r for r in EXP.write_bundle(spark, bundle, f"{tmpdir_path}/export").collect()}
    assert not health["broken"].ok and "no_such_column" in health["broken"].error
    assert all(h.ok for n, h in health.items() if n != "broken")
    assert health["raw_events"].rows > 0 and health["meta_daily"].rows > 0
    raw = [json.loads(line) for f in os.listdir(f"{tmpdir_path}/export/raw_events") if f.endswith(".json")
           for line in open(f"{tmpdir_path}/export/raw_events/{f}")]
    props = [json.loads(r["properties"]) for r in raw if "properties" in r]
    assert all(p["checkout_id"].startswith("sha256:") for p in props if "checkout_id" in p)
    scope = EXP.export_scope(spark.createDataFrame(list(health.values())), C.R.overview_basic(C.base(spark, SF)), 10000)
    s = scope.first()
    assert s.mode == "partial_with_isolated_failures" and s.failed_query_blocks == 1
