"""The quality reports compute each fact once and plan few exchanges."""

import pytest

from arrears.plans import quality
from arrears.plans.model import Model
from arrears.sources.catalog import DriverSources
from arrears.sources.driver_dates import events_params, orders_params
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def model(spark):
    return Model(DriverSources(spark, SF_SMALL), events_params(), orders_params())


@pytest.mark.parametrize("name, most", [("primary_keys", 40), ("foreign_keys", 40), ("fanout", 40), ("value_domains", 40),
                                        ("client_ids", 40)])
def test_planned_exchanges(spark, model, name, most):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = getattr(quality, name)(model)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange ") < most
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_stored_datasets_are_written_once(spark, model):
    a = model.stored({"fact_payments": ("payment_id", "client_id")})
    assert a.fact_payments.columns == ["payment_id", "client_id"] and len(model.fact_payments.columns) > 2
    assert a.fact_payments.count() == model.fact_payments.count()
    again = a.stored({"fact_payments": ("payment_id",)})
    assert again.fact_payments is a.fact_payments and again.fact_dialer is not None
