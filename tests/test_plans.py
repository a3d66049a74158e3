"""What the plans must look like, whatever the size of the tables."""

import os

import pytest
from conftest import SF
from pyspark.sql import functions as F

from factledger.operators import asof
from factledger.plans.queries import QUERIES
from factledger.plans.view import Rules, served_view

KEYS = ["provider", "model", "fact_key"]


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("eras") / "eras")
    one = spark.createDataFrame([(1, "p", "m", "rate.input", "1", 5, None, "unused")], "id long, provider string, model string, fact_key string, value_json string, boundary long, prior_ms long, detail string")
    one.write.parquet(path)
    return spark.read.parquet(path)


def test_reads_reach_the_scan(stored):
    rows = asof.select_prefixes(stored, ["rate."]).where("provider = 'p'").select(*KEYS, "value_json", "boundary", "id")
    text = plan(asof.as_of(rows, 7, KEYS).select(*KEYS, "value_json"))
    assert "LessThanOrEqual(boundary,7)" in text and "StringStartsWith(fact_key,rate.)" in text and "EqualTo(provider,p)" in text
    assert all("detail" not in x for x in text.splitlines() if x.startswith("ReadSchema"))
    assert text.count("hashpartitioning") == 1


def test_view_filters_before_it_aggregates(stored):
    text = plan(served_view(stored, Rules(), at=7, prefixes=["rate."], provider="p").facts)
    scans = [x for x in text.splitlines() if x.startswith("PushedFilters")]
    assert all("detail" not in x for x in text.splitlines() if x.startswith("ReadSchema"))
    assert scans and all("EqualTo(provider,p)" in x for x in scans)


def test_as_of_join_shuffles_once(spark, stored):
    left = stored.select(*KEYS, F.col("boundary").alias("at"))
    text = plan(asof.as_of_join(left, stored, KEYS, "at", ["value_json"]))
    assert "Join" not in text and text.count("hashpartitioning") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_the_view_folds_entities_once(stored):
    """Layers are expressions: however many there are, the eras are aggregated per fact and per entity once (known ids apart)."""
    t = lambda rows, schema: stored.sparkSession.createDataFrame(rows, schema)
    r = Rules(overrides=t([("p", "m", "limit.context", "1", None)], "provider string, model string, fact_key string, value string, replaces string"), ranges=t([("p", 0, 2)], "provider string, low int, high int"), limits=t([("p", "limit.image_bytes", "image", "fixed", 3, None, None, None)], "provider string, fact_key string, modality string, kind string, value long, at long, other long, conditions array<struct<above long, value long>>"), policy="x")
    text = plan(served_view(stored, r).facts)
    assert len([x for x in text.splitlines() if x.startswith("Location") and "eras" in x]) == 1


def test_committed_batches_are_named_to_the_scan(spark, tmp_path):
    from factledger.sources import tables

    path = str(tmp_path / "t")
    tables.seed_if_empty(spark, spark.createDataFrame([("p", "m", "f", "1")], "provider string, model string, fact_key string, value_json string"), path, "s", 1)
    text = plan(tables.read_eras(spark, path, "s", "p", "q"))
    assert any(x.startswith("PartitionFilters") and "batch" in x for x in text.splitlines()) and "GreaterThanOrEqual(provider,p)" in text and "Join" not in text
