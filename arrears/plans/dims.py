"""Dimension datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.config import Params
from arrears.functions.dates import rolling_start
from arrears.plans.facts import client_company, dim_operators, provider_rows  # noqa: F401
from arrears.sources.catalog import Sources

col = F.col


def dim_cases(src: Sources, p: Params) -> DataFrame:
    """Cases that are open (status 0/1) or changed in the rolling window,
    with their provider. The filter touches only ``cases`` columns, so
    Catalyst applies it below the join (and pushes it into the scan)."""
    c = src.cases.where(col("case_status_id").isin(0, 1)
                        | (col("update_date") >= F.lit(rolling_start(p.as_of, p.rolling_days))))
    prov = provider_rows(src, p)
    return c.join(prov, c["case_id"] == prov["_acid"], "left").select(
        "case_id", "client_id", "debtor_id", "ref_number", "client_ref_number",
        "case_status_id", "original_capital", "actual_capital", "department_id",
        "currency_id", F.to_date("insert_date").alias("insert_date"),
        F.to_date("update_date").alias("update_date"), "provider")


def dim_client(src: Sources, p: Params | None = None) -> DataFrame:
    cl, co = src.client, src.company
    return (cl.join(co, cl["company_id"] == co["company_id"], "left")
              .select(cl["client_id"], co["company_id"], co["company_name"]))


def dim_company(src: Sources, p: Params | None = None) -> DataFrame:
    """Companies with their clients; reserved client ids 1 and 999 (and
    companies without clients) drop out: the outer join becomes inner."""
    co, cl = src.company, src.client
    return (co.join(cl, cl["company_id"] == co["company_id"], "left")
              .where((cl["client_id"] > 1) & (cl["client_id"] != 999))
              .select(co["company_id"], co["company_name"], cl["client_id"]))


def dim_commission_rules(src: Sources, p: Params | None = None) -> DataFrame:
    return src.dim_commission_rules.select("client_id", "commission_rate")
