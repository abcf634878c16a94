"""Counts measured independently on the driver's sf0.001 tables (recorded
in FIXTURES.md) and determinism under reordered input."""

from pyspark.sql import functions as F

from arrears.plans.model import Model
from arrears.sources.driver_dates import events_params, orders_params
from arrears.sources.catalog import DriverSources
from conftest import SF_SMALL


def test_fixture_counts(spark):
    m = Model(DriverSources(spark, SF_SMALL), events_params(), orders_params())
    d = m.fact_dialer.agg(F.sum("answered_flag"), F.sum("operator_not_connected_flag"),
                          F.sum("cpc_flag"), F.count(F.lit(1))).collect()[0]
    assert tuple(d) == (368, 220, 66, 376)
    e = m.fact_ptp_enriched
    money = {r[0]: r[1] for r in e.where("payment_id is not null").groupBy("money_type").count().collect()}
    assert money == {"NEW MONEY": 11, "OLD MONEY": 8}
    unpaid = {r[0]: r[1] for r in e.where("payment_id is null").groupBy("ptp_status").count().collect()}
    assert unpaid == {"DUE": 5, "OVERDUE": 4}
    ch = {r[0]: r[1] for r in m.fact_contacts.groupBy("contact_channel").count().collect()}
    assert ch == {"BOT": 40, "Dialer": 5, "Email": 109, "Manual": 300, "RCS": 105, "SMS": 122,
                  "WhatsApp": 115}
    ps = {r[0]: r[1] for r in m.fact_operator_presence.groupBy("attendance_status").count().collect()}
    assert ps == {"absent": 18, "inactive": 13, "not_employed": 23, "present": 33, "training": 5}
    assert m.fact_contacts.where("derived_from_dialer_flag = 1").count() == 14   # matches
    assert m.fact_contacts.where("has_promise = 1").count() == 402     # of 796
    assert m.dim_cases.count() == 130


class Reordered(DriverSources):
    """Every relation hash-repartitioned on all its columns: a different
    row order and partitioning than the files give."""

    def _load(self, name):
        df = super()._load(name)
        return df.repartition(5, *df.columns)


def test_results_do_not_depend_on_input_order(spark):
    a, b = Model(DriverSources(spark, SF_SMALL), events_params(), orders_params()), Model(Reordered(spark, SF_SMALL), events_params(), orders_params())
    for name in ("fact_contacts", "fact_ptp", "fact_ptp_enriched", "fact_dialer"):
        x = sorted(map(tuple, getattr(a, name).collect()), key=repr)
        y = sorted(map(tuple, getattr(b, name).collect()), key=repr)
        assert x == y, name
