"""Input views over the shared Parquet tables, as SQL text that Spark and DuckDB both accept.

Every view reads whole tables. Amounts and dates are kept as raw text, so that cleaning has work to do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _rupees(amount: str) -> str:
    return f"'₹' || cast(cast({amount} AS decimal(18,2)) AS string)"


def _rupees_with_commas(amount: str) -> str:
    whole = f"cast({amount} AS decimal(18,2))"
    thousands = f"cast(floor({whole} / 1000) AS bigint)"
    rest = f"cast(cast({whole} - {thousands} * 1000 AS decimal(9,2)) AS string)"
    return f"CASE WHEN {whole} >= 1000 THEN '₹ ' || cast({thousands} AS string) || ',' || lpad({rest}, 6, '0') ELSE '₹' || cast({whole} AS string) || ' ' END"


VIEWS = {
    "geo": """
        SELECT c_custkey, c_name AS mp_name, n_name AS state, c_acctbal,
               CASE WHEN c_acctbal >= 9000 THEN 'AT LARGE'
                    ELSE n_name || '-' || c_mktsegment || '-' || cast(c_custkey % 4 AS string) END AS constituency
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "recommended_raw": f"""
        SELECT o_orderkey AS work_id, 'Work ' || o_orderpriority || ' for ' || constituency AS work_description,
               mp_name, constituency, state, {_rupees("o_totalprice")} AS recommended_amount,
               cast(o_orderdate AS string) AS recommendation_date, o_orderstatus <> 'P' AS has_images,
               o_orderpriority AS ida
        FROM orders JOIN geo ON o_custkey = c_custkey LEFT JOIN finished ON l_orderkey = o_orderkey
        WHERE o_orderstatus <> 'F' OR l_orderkey IS NULL""",
    "finished": """
        SELECT l_orderkey, sum(cast(l_extendedprice AS decimal(18,2))) AS amount, max(l_shipdate) AS shipped,
               min(l_partkey) AS partkey
        FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey""",
    "completed_raw": f"""
        SELECT o_orderkey AS work_id, 'Done ' || p_name AS work_description,
               CASE WHEN p_size = 50 THEN NULL WHEN p_size = 49 AND p_brand = 'Brand#7' THEN 'RARE' ELSE p_type END AS category,
               mp_name, constituency, state, {_rupees("amount")} AS final_amount,
               cast(shipped AS string) AS completed_date, cast(NULL AS boolean) AS has_images,
               CASE WHEN p_size = 1 AND p_type = 'PROMO' THEN cast(p_size AS double) END AS average_rating, p_brand AS ida
        FROM finished JOIN orders ON l_orderkey = o_orderkey JOIN geo ON o_custkey = c_custkey
             JOIN part ON partkey = p_partkey""",
    "payment_lines": f"""
        SELECT mp_name, constituency, state, p_name AS work_description, s_name AS vendor, p_brand AS ida,
               {_rupees_with_commas("l_extendedprice")} AS expenditure_amount,
               cast(l_shipdate AS string) AS expenditure_date,
               CASE WHEN l_linestatus = 'F' THEN 'Payment Success' ELSE 'Payment In-Progress' END AS payment_status,
               l_discount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN geo ON o_custkey = c_custkey
             JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "payments_raw": """
        SELECT mp_name, constituency, state, work_description, vendor, ida, expenditure_amount, expenditure_date,
               payment_status FROM payment_lines
        UNION ALL
        SELECT mp_name, constituency, state, work_description, vendor, ida, expenditure_amount, expenditure_date,
               payment_status FROM payment_lines WHERE l_discount = 0.1""",
    "sponsor_raw": f"""
        SELECT mp_name, constituency, state, {_rupees("greatest(c_acctbal, 0) * 1000")} AS allocated_amount,
               '₹' || cast(spent AS string) AS total_expenditure,
               CASE WHEN c_acctbal > 0 THEN cast(spent AS double) / (c_acctbal * 1000) * 100 END AS utilization_pct,
               done AS completed_works_count, every AS recommended_works_count,
               CASE WHEN every > 0 THEN 100.0E0 * cast(done AS double) / cast(every AS double) END AS completion_rate_pct,
               {_rupees("greatest(c_acctbal, 0)")} AS unspent_amount, every AS transaction_count,
               done AS successful_payments, every - done AS pending_payments
        FROM geo JOIN (
            SELECT o_custkey, count(*) AS every, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done,
                   sum(CASE WHEN o_orderstatus = 'F' THEN cast(o_totalprice AS decimal(18,2)) ELSE 0 END) AS spent
            FROM orders GROUP BY o_custkey) t ON o_custkey = c_custkey""",
    "texts": """
        SELECT doc_id AS work_id, lang AS state, source AS constituency, 'sponsor of ' || source AS mp_name,
               text AS work_description, lang AS project_status
        FROM documents""",
    "reviews": """
        SELECT 'AUDIT_' || cast(event_id AS string) AS log_id, user_id AS work_id,
               CASE event_type WHEN 'view' THEN 'Not Reviewed' WHEN 'click' THEN 'Verified Normal'
                    WHEN 'purchase' THEN 'Needs Further Review' WHEN 'error' THEN 'Evidence Insufficient'
                    ELSE 'Manual Investigation Required' END AS review_status,
               CASE WHEN value >= 10 THEN ' ' || props || ' ' END AS reviewer_notes,
               CASE WHEN value >= 40 THEN '' ELSE 'OFFICER_' || event_type END AS reviewer_id,
               ts AS review_timestamp, value AS ai_risk_score_at_review,
               CASE WHEN value >= 50 THEN 'HIGH' WHEN value >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS ai_risk_category_at_review
        FROM events""",
    "proposals": """
        SELECT p_partkey AS proposal_id, 'Done ' || p_name AS work_description,
               CASE WHEN p_size = 3 THEN 'UNSEEN' ELSE p_type END AS category,
               p_retailprice * 100 AS recommended_amount,
               CASE WHEN p_size = 2 THEN NULL ELSE p_retailprice * (60 + p_size) END AS sanctioned_amount,
               n_name AS state, CASE WHEN p_size = 4 THEN 'NOWHERE' ELSE 'AT LARGE' END AS constituency,
               CASE WHEN p_size = 5 THEN '2020-06-01' ELSE '2000-01-20' END AS recommendation_date,
               CASE WHEN p_size = 6 THEN NULL WHEN p_size = 7 THEN '1999-12-31' ELSE '2000-02-01' END AS sanction_date,
               CASE WHEN p_size = 8 THEN '2000-01-25' WHEN p_size = 9 THEN '2000-12-31' END AS completion_date
        FROM part JOIN nation ON n_nationkey = p_partkey % 25""",
}


def used(text: str, known: dict[str, str]) -> list[str]:
    """Names of ``known`` that a SQL text needs, dependencies first."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", sql):
            if name in known and name not in order:
                visit(known[name])
                order.append(name)

    visit(text)
    return order


def with_ctes(select: str, known: dict[str, str]) -> str:
    names = used(select, known)
    if not names:
        return select
    return "WITH " + ", ".join(f"{n} AS ({known[n]})" for n in names) + " " + select


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def placed_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the place of their customer, by order key."""
    orders, geo = table(spark, sf, "orders"), view(spark, sf, "geo")
    return orders.join(geo, orders.o_custkey == geo.c_custkey).select("o_orderkey", "mp_name", "constituency", "state")


def payment_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The view of this name with its joins in another order: places are joined to the few orders, not to their many lines, and the
    lines meet them last, because places are the widest of what is joined."""
    lines, part, supplier = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    placed = placed_orders(spark, sf)
    rows = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    rows = rows.join(placed, rows.l_orderkey == placed.o_orderkey)
    return rows.selectExpr(
        "mp_name", "constituency", "state", "p_name AS work_description", "s_name AS vendor", "p_brand AS ida",
        f"{_rupees_with_commas('l_extendedprice')} AS expenditure_amount", "cast(l_shipdate AS string) AS expenditure_date",
        "CASE WHEN l_linestatus = 'F' THEN 'Payment Success' ELSE 'Payment In-Progress' END AS payment_status", "l_discount",
    )


def payments_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The view of this name without a second reading of the lines: one that comes twice is doubled where it stands."""
    rows = payment_lines(spark, sf).withColumn("_copy", F.explode(F.when(F.col("l_discount") == 0.1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.drop("l_discount", "_copy")


#: Views that Spark reads by other steps than their text, to the same rows.
READERS = {"payment_lines": payment_lines, "payments_raw": payments_raw}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view as DataFrame. Base tables become temp views only while the text is analysed."""
    if name in READERS:
        return READERS[name](spark, sf)
    sql = with_ctes(f"SELECT * FROM {name}", {k: v for k, v in VIEWS.items() if k not in READERS})
    for part in used(sql, dict.fromkeys(READERS, "")):
        READERS[part](spark, sf).createOrReplaceTempView(part)
    for base in used(sql, {t: "" for t in TABLES}):
        table(spark, sf, base).createOrReplaceTempView(base)
    return spark.sql(sql)
