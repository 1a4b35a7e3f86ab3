"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL
oracle for each name that SQL can express.

Every query reads the driver's tables through the stand-in input and runs the
library's operators over all of their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from equiloan.constants import ATTRIBUTES
from equiloan.operators import parity
from equiloan.plans import oracle as O
from equiloan.plans import views

from equiloan.plans.registry import ORACLE, QUERIES, register  # noqa: E402,F401


# --- flagship: parity of outcomes and decisions per tract threshold -------

PARITY_BY_THRESHOLD_SQL = O.with_inputs(
    f"""SELECT c.attribute, {O.metric_select()}
FROM c JOIN th ON TRUE
""",
    ("long", O.attribute_long("labelled")),
    ("c", f"SELECT attribute, {O.conditional_sums()} FROM long GROUP BY attribute"),
    ("th", O.theil_per_row("labelled")),
)


@register("parity_by_threshold", PARITY_BY_THRESHOLD_SQL)
def parity_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tract threshold, how unequal are outcomes
    (labels) and decisions (the scorecard)? One contingency pass."""
    df = views.labelled(spark, sf_dir)
    ct = parity.contingency(df, ATTRIBUTES, label="approved", decision="rule_decision")
    return parity.parity_metrics(ct)


# The other query modules register themselves on import.
from equiloan.plans import q_prep  # noqa: E402,F401
from equiloan.plans import q_metrics  # noqa: E402,F401
from equiloan.plans import q_models  # noqa: E402,F401
from equiloan.plans import q_stream  # noqa: E402,F401
