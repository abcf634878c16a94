"""Explicit schema (Spark DDL) of every domain relation.

Readers apply these instead of inferring; ``validate`` checks a relation
against its declared schema (names and types, nullability ignored).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SCHEMAS: dict[str, str] = {
    "company": "company_id INT,company_name STRING",
    "client": "client_id INT,company_id INT",
    "dim_commission_rules": "client_id INT,commission_rate DOUBLE",
    "cases": "case_id BIGINT,client_id INT,debtor_id BIGINT,ref_number STRING,client_ref_number STRING,case_status_id BIGINT,original_capital DOUBLE,actual_capital DOUBLE,department_id BIGINT,currency_id INT,insert_date DATE,update_date DATE,dpd_original BIGINT",
    "cases_information": "case_id BIGINT,dpd_original BIGINT,original_capital DOUBLE,actual_capital DOUBLE,case_statute_id BIGINT",
    "case_attributes": "case_id BIGINT,attribute_type INT,attribute_value STRING",
    "users": "user_id BIGINT,user_name STRING,full_name STRING,user_status INT,sip_account STRING,insert_date DATE,update_date DATE",
    "contact_events": "contact_id BIGINT,case_id BIGINT,telecom_id BIGINT,contact_date TIMESTAMP_NTZ,description STRING,status_type_id INT,target_type_id BIGINT,contact_text STRING,insert_user STRING",
    "dialer_calls": "uniqueid BIGINT,queue_item_id BIGINT,disposition_code BIGINT,campaign_id BIGINT,campaign_name STRING,case_id BIGINT,debtor_id BIGINT,telecom_id BIGINT,client_id BIGINT,phone_number STRING,call_date TIMESTAMP_NTZ,duration INT,billsec INT,disposition STRING,hangup_cause STRING",
    "dialer_contact": "unique_id BIGINT,sip_account STRING,contact_id BIGINT,call_date TIMESTAMP_NTZ",
    "ptp_overview": "ptp_id BIGINT,case_id BIGINT,client_id INT,ref_number STRING,client_ref_number STRING,operator STRING,contact_id BIGINT,type STRING,payment_number BIGINT,number_of_installments BIGINT,contact_date TIMESTAMP_NTZ,promise_date DATE,last_payment_date DATE,promise_capital DOUBLE,promise_capital_total DOUBLE,paid DOUBLE,dpd BIGINT,phone_number STRING,contact_attribute STRING,state STRING",
    "payments": "payment_id STRING,ref_number STRING,case_id BIGINT,client_id INT,payment_date DATE,payed_capital DOUBLE,payed_plus_money DOUBLE,payed_administrative_assessment DOUBLE,payed_delay_charge DOUBLE",
    "promises_information": "case_id BIGINT,contact_date TIMESTAMP_NTZ,operator STRING,contact_time STRING",
    "installment": "installment_id BIGINT,case_id BIGINT,ref_number STRING,insert_date TIMESTAMP_NTZ,amount DOUBLE",
}


def struct(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def validate(df: DataFrame, name: str) -> list[str]:
    """Return a list of differences between ``df`` and the declared schema."""
    want = {f.name: f.dataType for f in struct(name).fields}
    got = {f.name: f.dataType for f in df.schema.fields}
    errs = [f"missing column {c}" for c in want if c not in got]
    errs += [f"{c}: {got[c].simpleString()} != {t.simpleString()}"
             for c, t in want.items() if c in got and got[c] != t]
    return errs
