"""SQL oracle: for each registered query, an independent DuckDB formulation.

The Spark side is built from DataFrame operators; the SQL here is written
directly against the driver's tables (pre-registered as views), with the
stand-in ``applications`` and ``labelled`` inputs as CTEs. Doubles are
rounded to 6 places and every ratio divides by ``NULLIF(d, 0)`` on both sides.
"""

from __future__ import annotations

from equiloan.constants import ATTRIBUTES
from equiloan.functions.columns import portable_hash_sql
from equiloan.sources.standin import applications_sql_for_oracle

LABELLED_SQL = """
SELECT *,
  CASE WHEN action_taken IN (1, 2) THEN 1 ELSE 0 END AS approved,
  CASE WHEN tract_minority_population_percent >= 40 THEN 0 ELSE 1 END AS a40,
  CASE WHEN tract_minority_population_percent >= 50 THEN 0 ELSE 1 END AS a50,
  CASE WHEN tract_minority_population_percent >= 60 THEN 0 ELSE 1 END AS a60,
  CASE WHEN tract_minority_population_percent >= 70 THEN 0 ELSE 1 END AS a70,
  CASE WHEN tract_minority_population_percent >= 80 THEN 0 ELSE 1 END AS a80,
  CASE WHEN tract_minority_population_percent >= 90 THEN 0 ELSE 1 END AS a90,
  CASE WHEN income > 2500 AND loan_to_value_ratio < 3 THEN 1 ELSE 0 END AS rule_decision
FROM applications
WHERE action_taken IN (1, 2, 3)
  AND loan_amount IS NOT NULL AND loan_to_value_ratio IS NOT NULL
  AND property_value IS NOT NULL AND income IS NOT NULL
  AND debt_to_income_ratio IS NOT NULL AND loan_term IS NOT NULL
"""


def with_inputs(body: str, *ctes: tuple[str, str]) -> str:
    """``WITH applications, labelled [, extra CTEs] <body>``."""
    parts = [f"applications AS ({applications_sql_for_oracle()})", f"labelled AS ({LABELLED_SQL})"]
    parts += [f"{name} AS ({sql})" for name, sql in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def attribute_long(source: str, y: str = "approved", yhat: str = "rule_decision",
                   extra: str = "") -> str:
    """UNION ALL of the six attribute columns as (attribute, g, y, yhat)."""
    sel = []
    for a in ATTRIBUTES:
        sel.append(f"SELECT {extra}'{a}' AS attribute, {a} AS g, {y} AS y, {yhat} AS yhat FROM {source}")
    return "\nUNION ALL\n".join(sel)


def metric_select(c: str = "c", theil: str = "th", counts_as_bigint: bool = True) -> str:
    """Metric expressions over per-attribute conditional sums in CTE ``c``."""
    n_cols = ("CAST(n_u AS BIGINT) AS n_unprivileged, CAST(n_p AS BIGINT) AS n_privileged"
              if counts_as_bigint else "ROUND(n_u, 6) AS n_unprivileged, ROUND(n_p, 6) AS n_privileged")
    return f"""
  {n_cols},
  ROUND(pos_u / NULLIF(n_u, 0), 6) AS base_rate_unprivileged,
  ROUND(pos_p / NULLIF(n_p, 0), 6) AS base_rate_privileged,
  ROUND(pos_u / NULLIF(n_u, 0) - pos_p / NULLIF(n_p, 0), 6) AS statistical_parity_difference,
  ROUND((pos_u / NULLIF(n_u, 0)) / NULLIF(pos_p / NULLIF(n_p, 0), 0), 6) AS disparate_impact,
  ROUND(pos_u / NULLIF(n_u, 0) - pos_p / NULLIF(n_p, 0), 6) AS mean_difference,
  ROUND(sel_u / NULLIF(n_u, 0), 6) AS decision_rate_unprivileged,
  ROUND(sel_p / NULLIF(n_p, 0), 6) AS decision_rate_privileged,
  ROUND(sel_u / NULLIF(n_u, 0) - sel_p / NULLIF(n_p, 0), 6) AS decision_parity_difference,
  ROUND((sel_u / NULLIF(n_u, 0)) / NULLIF(sel_p / NULLIF(n_p, 0), 0), 6) AS decision_disparate_impact,
  ROUND(0.5 * ((fp_u / NULLIF(neg_u, 0) - fp_p / NULLIF(neg_p, 0))
             + (tp_u / NULLIF(pos_u, 0) - tp_p / NULLIF(pos_p, 0))), 6) AS average_odds_difference,
  ROUND(tp_u / NULLIF(pos_u, 0) - tp_p / NULLIF(pos_p, 0), 6) AS equal_opportunity_difference,
  ROUND({theil}.theil, 6) AS theil_index"""


def conditional_sums(weight: str = "1.0") -> str:
    w = f"CAST({weight} AS DOUBLE)"
    return f"""
  SUM(CASE WHEN g = 0 THEN {w} ELSE 0.0 END) AS n_u,
  SUM(CASE WHEN g = 0 AND y = 1 THEN {w} ELSE 0.0 END) AS pos_u,
  SUM(CASE WHEN g = 0 AND yhat = 1 THEN {w} ELSE 0.0 END) AS sel_u,
  SUM(CASE WHEN g = 0 AND y = 1 AND yhat = 1 THEN {w} ELSE 0.0 END) AS tp_u,
  SUM(CASE WHEN g = 0 AND y = 0 AND yhat = 1 THEN {w} ELSE 0.0 END) AS fp_u,
  SUM(CASE WHEN g = 0 AND y = 0 THEN {w} ELSE 0.0 END) AS neg_u,
  SUM(CASE WHEN g = 1 THEN {w} ELSE 0.0 END) AS n_p,
  SUM(CASE WHEN g = 1 AND y = 1 THEN {w} ELSE 0.0 END) AS pos_p,
  SUM(CASE WHEN g = 1 AND yhat = 1 THEN {w} ELSE 0.0 END) AS sel_p,
  SUM(CASE WHEN g = 1 AND y = 1 AND yhat = 1 THEN {w} ELSE 0.0 END) AS tp_p,
  SUM(CASE WHEN g = 1 AND y = 0 AND yhat = 1 THEN {w} ELSE 0.0 END) AS fp_p,
  SUM(CASE WHEN g = 1 AND y = 0 THEN {w} ELSE 0.0 END) AS neg_p"""


def theil_per_row(source: str, y: str = "approved", yhat: str = "rule_decision", by: str = "") -> str:
    """Theil index as a per-row computation (the row-level twin of the counts form)."""
    by_sel = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    join = f" USING ({by})" if by else " ON TRUE"
    return f"""
SELECT {by_sel}AVG(CASE WHEN b > 0 THEN (b / mu) * ln(b / mu) ELSE 0.0 END) AS theil
FROM (SELECT {by_sel}CAST({yhat} - {y} + 1 AS DOUBLE) AS b FROM {source}) r
JOIN (SELECT {by_sel}AVG(CAST({yhat} - {y} + 1 AS DOUBLE)) AS mu FROM {source}{group}) m{join}
{group}"""


def R(expr: str) -> str:
    """Round to 6 places; ``+ 0.0`` turns a negative zero into zero."""
    return f"(ROUND({expr}, 6) + 0.0)"


def split_ctes(source: str = "labelled", seed: int = 42, fraction: float = 0.25) -> list[tuple[str, str]]:
    """P16 bins + T1 stratified split as CTEs ``binned`` and ``splitted``."""
    return [
        ("mm", f"SELECT MIN(tract_minority_population_percent) AS mn, "
               f"MAX(tract_minority_population_percent) AS mx FROM {source}"),
        ("binned", f"SELECT s.*, CAST(LEAST(GREATEST(CEIL((tract_minority_population_percent - mn) "
                   f"/ ((mx - mn) / 10.0)) - 1, 0), 9) AS INT) AS bins FROM {source} s, mm"),
        ("hashed", f"SELECT *, {portable_hash_sql('application_id', seed)} AS h FROM binned"),
        ("splitted", f"SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY bins ORDER BY h, application_id) "
                     f"<= ROUND({fraction} * COUNT(*) OVER (PARTITION BY bins)) THEN 'test' ELSE 'train' END "
                     f"AS split FROM hashed"),
    ]


def repair_ctes(p: str, source: str, attributes: list[str] | str, features: list[str], level: float = 1.0) -> list[tuple[str, str]]:
    """M3 as SQL windows: ``{p}_rep`` = (attribute, feature, g, value, repaired)."""
    attributes = [attributes] if isinstance(attributes, str) else list(attributes)
    long = "\nUNION ALL\n".join(
        f"SELECT '{a}' AS attribute, '{f}' AS feature, CAST({a} AS INT) AS g, CAST({f} AS DOUBLE) AS value "
        f"FROM {source} WHERE {a} IS NOT NULL AND {f} IS NOT NULL" for a in attributes for f in features)
    lam = f"CAST({float(level)!r} AS DOUBLE)"
    k = "attribute, feature, g"
    return [
        (f"{p}_long", long),
        (f"{p}_dist", f"SELECT {k}, value, COUNT(*) AS n FROM {p}_long GROUP BY {k}, value"),
        (f"{p}_tot", f"SELECT {k}, SUM(n) AS ng FROM {p}_dist GROUP BY {k}"),
        (f"{p}_pf", f"SELECT attribute, feature, CAST(MIN(ng) AS BIGINT) AS bb, "
                    f"COUNT(*) AS ngroups FROM {p}_tot GROUP BY attribute, feature"),
        (f"{p}_ub", f"""SELECT d.attribute, d.feature, d.g, d.value, d.n, pf.bb, pf.ngroups,
  CAST(LEAST(FLOOR(((CAST(SUM(d.n) OVER (PARTITION BY d.attribute, d.feature, d.g ORDER BY d.value) AS DOUBLE)
        - CAST(d.n AS DOUBLE) / 2.0) / CAST(t.ng AS DOUBLE)) * CAST(pf.bb AS DOUBLE)), pf.bb - 1) AS BIGINT) AS b
FROM {p}_dist d JOIN {p}_tot t USING ({k}) JOIN {p}_pf pf USING (attribute, feature)"""),
        (f"{p}_means", f"SELECT {k}, b, SUM(value * CAST(n AS DOUBLE)) / CAST(SUM(n) AS DOUBLE) AS m "
                       f"FROM {p}_ub GROUP BY {k}, b"),
        (f"{p}_grid", f"SELECT t.attribute, t.feature, t.g, UNNEST(range(0, pf.bb)) AS b "
                      f"FROM {p}_tot t JOIN {p}_pf pf USING (attribute, feature)"),
        (f"{p}_filled", f"""SELECT gr.attribute, gr.feature, gr.g, gr.b,
  COALESCE(LAST_VALUE(m IGNORE NULLS) OVER (PARTITION BY gr.attribute, gr.feature, gr.g ORDER BY gr.b
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           FIRST_VALUE(m IGNORE NULLS) OVER (PARTITION BY gr.attribute, gr.feature, gr.g ORDER BY gr.b
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS mf
FROM {p}_grid gr LEFT JOIN {p}_means mm USING ({k}, b)"""),
        (f"{p}_mid", f"SELECT attribute, feature, b, AVG(mf) AS mid FROM {p}_filled GROUP BY attribute, feature, b"),
        (f"{p}_rep", f"""SELECT ub.attribute, ub.feature, ub.g, ub.value,
  CASE WHEN ub.ngroups < 2 THEN ub.value ELSE (1.0 - {lam}) * ub.value + {lam} * md.mid END AS repaired
FROM {p}_ub ub LEFT JOIN {p}_mid md USING (attribute, feature, b)"""),
    ]


def repaired_columns(p: str, alias: str, attribute: str, features: list[str],
                     attr_expr: str | None = None, g_expr: str | None = None) -> tuple[str, str]:
    """(select expressions, joins) replacing ``features`` of ``alias`` by
    repaired values for ``attribute`` (a literal name, or ``attr_expr``)."""
    sel, joins = [], []
    a_match = attr_expr if attr_expr else f"'{attribute}'"
    g = g_expr if g_expr else f"CAST({alias}.{attribute} AS INT)"
    for i, f in enumerate(features):
        r = f"{p}r{i}"
        sel.append(f"CASE WHEN {alias}.{f} IS NULL THEN NULL ELSE COALESCE({r}.repaired, {alias}.{f}) END AS {f}")
        joins.append(f"LEFT JOIN {p}_rep {r} ON {r}.attribute = {a_match} AND {r}.feature = '{f}' "
                     f"AND {r}.g = {g} AND {r}.value = CAST({alias}.{f} AS DOUBLE)")
    return ", ".join(sel), "\n".join(joins)
