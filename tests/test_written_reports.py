"""Counting lines that nearly all differ: formats don't meet in one task."""

from cuemill.jobs import catalog
from cuemill.operators import reports


def test_formats_are_counted_apart(spark, sf_dir):
    got = catalog.QUERIES["written_reports"](spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(value#") == len(reports.FORMATS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got.select("*").rdd.getNumPartitions() == parts * len(reports.FORMATS)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
