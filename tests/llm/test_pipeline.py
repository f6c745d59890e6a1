"""Every stage on its own input against a brute-force version."""

from collections import Counter

import corpus_pipeline
import pytest

from .helpers import corpus, frame
from .test_neardup import brute as groups
from .test_substrings import brute as repeats

SF = "/root/testdata/sf0.001"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_registered():
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_duplicates", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


@pytest.fixture(scope="module")
def rows():
    return corpus(seed=12, n=80)


def test_near_duplicates(spark, rows):
    out = stage("near_duplicates")(spark, frame(spark, [*rows, (None, "x"), rows[0]]), SF)
    assert out.dtypes == frame(spark, []).dtypes
    assert corpus_pipeline.NEAR_PERCENT == 80
    kept = {i for i, _, _, k in groups(rows, 80) if k}
    assert Counter(r.doc_id for r in out.collect()) == Counter([*kept, None])


def test_substring_duplicates(spark, rows):
    out = stage("substring_duplicates")(spark, frame(spark, rows), SF)
    assert out.dtypes == frame(spark, []).dtypes
    want, text = repeats(rows, 20), dict(rows)
    for r in out.collect():
        assert r.text == (want[r.doc_id][2].decode() if want[r.doc_id][1] else text[r.doc_id])
        assert r.n_chars == (len(r.text) if r.text is not None else None)


def test_toxicity_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1.5D AS score", "'x' AS predicted")
    out = stage("toxicity")(spark, docs, SF)
    assert out.columns == docs.columns and out.filter("score <> 1.5 or predicted <> 'x'").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0")
    clean = docs.join(labels, "doc_id").count()
    assert out.join(labels, "doc_id").count() >= 0.98 * clean


def test_packing(spark, rows):
    out = stage("packing")(spark, frame(spark, rows), SF).collect()
    assert {r.doc_id for r in out} == {i for i, _ in rows}
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0


def test_empty_table(spark):
    empty = frame(spark, [])
    for name in ("near_duplicates", "substring_duplicates", "packing"):
        assert stage(name)(spark, empty, SF).count() == 0
