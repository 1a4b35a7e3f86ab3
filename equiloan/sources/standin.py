"""Stand-in application table built from the driver's TPC-H-style tables.

The driver's tables hold no loan data. This view only gives rows in the
application schema (FIXTURES.md section B); it does none of the workflow's
work. Every step after it (filters, labels, attributes, metrics, mitigation,
models) runs through the library's own operators.

The same SQL text feeds Spark (tables passed as DataFrame parameters, so no
global view is registered) and the DuckDB oracle (tables by name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# {orders}, {customer}, {lineitem} are table placeholders; {hint} is a Spark
# join hint (empty for the oracle, where it would only be a comment).
APPLICATIONS_SQL = """
SELECT {hint}
  o.o_orderkey                                        AS application_id,
  CAST(year(o.o_orderdate) AS INT)                    AS activity_year,
  o.o_totalprice                                      AS loan_amount,
  o.o_totalprice / li.gross                           AS loan_to_value_ratio,
  li.gross                                            AS property_value,
  CASE WHEN c.c_acctbal <= 0 THEN NULL
       WHEN (c.c_custkey * 37) % 101 >= 50 THEN c.c_acctbal * 0.8e0
       ELSE c.c_acctbal END                           AS income,
  100 * li.disc / li.n                                AS debt_to_income_ratio,
  CAST(li.qty AS DOUBLE)                              AS loan_term,
  CAST(1 + o.o_orderkey % 4 AS INT)                   AS total_units,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL
       ELSE CAST(300 + (o.o_orderkey * 31) % 551 AS DOUBLE) END AS credit_score,
  CAST((c.c_custkey * 37) % 101 AS DOUBLE)            AS tract_minority_population_percent,
  CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 4
       WHEN (c.c_custkey * 37) % 101 >= 50 AND o.o_orderkey % 7 = 0 THEN 3
       WHEN o.o_orderstatus = 'F' THEN 1
       WHEN o.o_orderstatus = 'O' THEN 2
       ELSE 3 END                                     AS action_taken,
  c.c_mktsegment                                      AS derived_race,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Joint' END AS derived_sex,
  CASE WHEN o.o_orderkey % 5  = 0 THEN '1' ELSE '2' END    AS loan_type,
  CASE WHEN o.o_orderkey % 7  = 1 THEN '1' ELSE '31' END   AS loan_purpose,
  CASE WHEN o.o_orderkey % 11 = 2 THEN '1' ELSE '2' END    AS lien_status,
  CASE WHEN o.o_orderkey % 13 = 3 THEN '2' ELSE '1111' END AS reverse_mortgage,
  CASE WHEN o.o_orderkey % 17 = 4 THEN '2' ELSE '1' END    AS open_end_line_of_credit,
  CASE WHEN o.o_orderkey % 19 = 5 THEN '2' ELSE '1' END    AS business_or_commercial_purpose,
  CASE WHEN o.o_orderkey % 23 = 6 THEN '1' ELSE '3' END    AS occupancy_type,
  CASE WHEN o.o_orderkey % 29 = 7 THEN '1' ELSE '2' END    AS submission_of_application,
  CAST(1 + o.o_orderkey % 10 AS VARCHAR(4))                AS denial_reason_1,
  CASE WHEN o.o_orderkey % 2 = 0 THEN CAST(1 + o.o_orderkey % 9 AS VARCHAR(4)) END AS denial_reason_2,
  CASE WHEN o.o_orderkey % 6 = 0 THEN CAST(1 + o.o_orderkey % 7 AS VARCHAR(4)) END AS denial_reason_3,
  CASE WHEN o.o_orderkey % 12 = 0 THEN CAST(1 + o.o_orderkey % 5 AS VARCHAR(4)) END AS denial_reason_4
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
LEFT JOIN (
  SELECT l_orderkey,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross,
         CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE)      AS disc,
         SUM(CAST(l_quantity AS BIGINT))                             AS qty,
         COUNT(*)                                                    AS n
  FROM {lineitem} GROUP BY l_orderkey
) li ON li.l_orderkey = o.o_orderkey
"""

# Stand-in for a model: a fixed scorecard decision, so that every metric and
# report on decisions can be value-checked by SQL without training anything.
RULE_INCOME_MIN = 2500
RULE_LTV_MAX = 3


def stand_in_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application rows derived from orders, customer and lineitem at ``sf_dir``."""
    tables = {
        name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
        for name in ("orders", "customer", "lineitem")
    }
    # orders and the per-order lineitem aggregate are joined on the order key
    # with a shuffle hash join: the aggregate is already hash-partitioned by
    # that key, so only orders moves, and the rows come out spread over the
    # shuffle partitions (a broadcast would keep them in the scan's tasks).
    return spark.sql(APPLICATIONS_SQL.replace("{hint}", "/*+ SHUFFLE_HASH(li) */"), **tables)


def applications_sql_for_oracle() -> str:
    return APPLICATIONS_SQL.format(orders="orders", customer="customer", lineitem="lineitem", hint="")


def rule_decision(df: DataFrame, income: str = "income", ltv: str = "loan_to_value_ratio",
                  out: str = "rule_decision") -> DataFrame:
    """The stand-in scorecard: approve when income > 2500 and LTV < 3.

    Taking the feature columns as parameters lets the same rule score
    repaired features (M3) as well as the originals."""
    from pyspark.sql import functions as F

    cond = (F.col(income) > F.lit(RULE_INCOME_MIN)) & (F.col(ltv) < F.lit(RULE_LTV_MAX))
    return df.withColumn(out, F.coalesce(cond.cast("int"), F.lit(0)))
