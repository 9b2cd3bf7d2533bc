"""Registered queries: cleaned tables and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import (
    P, payments, raw, settled_payments, settled_sponsors, settled_works, sponsors, tidy, works,
)
from catalog.oracles import STEPS, money_sum, oracle, tidy as sql_tidy
from catalog.registry import query
from worklens.functions.scalars import exact_sum
from worklens.operators import cohorts
from worklens.plans import financial, temporal, vendor


@query(oracle("""
    SELECT s.vendor, transaction_count, total_vendor_expenditure, average_vendor_transaction, pending_count, success_count,
           (transaction_count - 1)::double / transaction_count AS vendor_repeat_rate,
           pending_count::double / transaction_count AS pending_payment_ratio,
           success_count::double / transaction_count AS payment_status_distribution,
           c.share AS max_constituency_share, m.share AS max_sponsor_share
    FROM vend_stats s LEFT JOIN vend_const c USING (vendor) LEFT JOIN vend_sponsor m USING (vendor)"""))
def vendor_concentration(spark, sf):
    return vendor.vendor_concentration(payments(spark, sf))


@query(oracle("SELECT * FROM payments"))
def clean_payments(spark, sf):
    return payments(spark, sf)


@query(oracle("SELECT * FROM works"))
def unified_works(spark, sf):
    return works(spark, sf)


@query(oracle(sql_tidy("sponsors", "utilization_pct completion_rate_pct")))
def clean_sponsors(spark, sf):
    return tidy(sponsors(spark, sf), "utilization_pct completion_rate_pct")


FIN = "expenditure_ratio unspent_balance recommendation_sanction_ratio expenditure_deviation cost_deviation cost_percentile state_cost_percentile constituency_cost_percentile release_ratio"


@query(oracle(sql_tidy("fin", FIN)))
def financial_features(spark, sf):
    return tidy(financial.financial_features(settled_works(spark, sf), settled_sponsors(spark, sf), P), FIN)


TMP = "completion_delay_months project_duration_months duration_deviation_from_historical_baseline year_over_year_change"


@query(oracle(sql_tidy("tmp", TMP)))
def temporal_features(spark, sf):
    return tidy(temporal.temporal_features(settled_works(spark, sf), settled_payments(spark, sf), P), TMP)


VEND = "median_vendor_transaction year_over_year_vendor_change"


@query(oracle(sql_tidy("vend", VEND)))
def vendor_features(spark, sf):
    return tidy(vendor.vendor_features(settled_payments(spark, sf), P), VEND)


@query(oracle(sql_tidy("vend_cohort", "constituency_avg_vendor_transaction constituency_avg_vendor_repeat_rate constituency_pending_payment_ratio")))
def constituency_vendor_cohorts(spark, sf):
    out = vendor.vendor_cohorts(vendor.vendor_features(settled_payments(spark, sf), P))
    return tidy(out, "constituency_avg_vendor_transaction constituency_avg_vendor_repeat_rate constituency_pending_payment_ratio")
