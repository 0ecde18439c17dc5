"""Plan shapes: what must not appear, and what must be pushed to the scan."""

import pytest

import __spark_entry__ as entry
from cartlens.operators.baskets import basket_items, order_items_delivered
from cartlens.sources.sample import sample_shop

FOLDER = "/root/testdata/sf0.001"
CHECKED = sorted(set(entry.oracle_sql()))


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_join_and_no_row_at_a_time_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for word in ("CartesianProduct", "BatchEvalPython", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_status_filter_reaches_the_scan(spark):
    shop = sample_shop(spark, FOLDER)
    plan = plan_of(order_items_delivered(shop.order_items, shop.orders))
    assert "EqualTo(o_orderstatus,F)" in plan
    assert plan.split("== Physical Plan ==")[1].count("FileScan") == 2
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_time_filter_reaches_the_scan(spark):
    plan = plan_of(entry.queries()["behavior_logs_since"](spark, FOLDER))
    assert "GreaterThanOrEqual(ts," in plan


def test_hot_order_is_split(spark):
    """One order with a third of all lines: adaptive execution splits its join partition."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        lines = spark.range(60_000).selectExpr(
            "if(id % 3 = 0, 1, id) as order_id", "id * 7919 as product_id"
        ).repartition(16)
        orders = spark.range(60_000).selectExpr("id as order_id", "'delivered' as order_status")
        joined = basket_items(order_items_delivered(lines, orders))
        assert len(joined.collect()) == 60_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in changed:
            spark.conf.unset(key)
