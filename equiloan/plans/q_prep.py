"""Registered queries: sources, sinks and preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiloan.constants import (
    ATTRIBUTES,
    COLUMNS_TO_DROP,
    COLUMNS_TO_ENCODE,
    COLUMNS_TO_SCALE,
    CONDITIONS,
    DENIAL_SLOTS,
    PREDICTORS,
    SLICE_YEAR,
    THRESHOLDS,
)
from equiloan.functions.columns import round6
from equiloan.operators import describe, prep, splits
from equiloan.plans import oracle as O
from equiloan.plans import views
from equiloan.plans.registry import register
from equiloan.session import shared_path
from equiloan.sources import applications as src
from equiloan.sources import sinks

R = O.R
W = O.with_inputs

# --- S1-S5 -------------------------------------------------------------------

RAW_NAMES = {"open_end_line_of_credit": "open-end_line_of_credit",
             "denial_reason_1": "denial_reason-1", "denial_reason_2": "denial_reason-2",
             "denial_reason_3": "denial_reason-3", "denial_reason_4": "denial_reason-4"}

APPS_COLS = ["application_id", "activity_year", "action_taken", "total_units", "debt_to_income_ratio",
             "loan_amount", "loan_to_value_ratio", "loan_term", "property_value", "income", "credit_score",
             "tract_minority_population_percent", "derived_race", "derived_sex", "loan_type", "loan_purpose",
             "lien_status", "reverse_mortgage", "open_end_line_of_credit", "business_or_commercial_purpose",
             "occupancy_type", "submission_of_application", "denial_reason_1", "denial_reason_2",
             "denial_reason_3", "denial_reason_4"]


@register("read_applications", W(f"SELECT {', '.join(APPS_COLS)} FROM applications"))
def q_read_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 (+S4 as CSV): the application table written as a raw CSV with the
    source's spelling of names, then scanned back with declared types,
    sanitised names and tolerant number parsing."""
    apps = views.applications(spark, sf_dir)
    raw = apps.select(*[F.col(c).alias(RAW_NAMES.get(c, c)) for c in apps.columns])
    path = shared_path(spark, "applications-csv")
    sinks.write_prepared(raw, path, fmt="csv", partition_by=None)
    return src.read_applications(spark, path, fmt="csv", missing="null").select(*APPS_COLS)


UNCLEAN = ["NaN", "1e12", "Exempt", " 7 ", "3.0", ""]


@register("read_unclean_numbers", W(
    "SELECT application_id, CASE application_id % 6 WHEN 3 THEN 7 WHEN 4 THEN 3 END AS total_units, "
    "CASE application_id % 6 WHEN 1 THEN 1e12 WHEN 3 THEN 7.0 WHEN 4 THEN 3.0 END AS income FROM applications"))
def q_read_unclean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 on unclean numbers: every application's units and income spelt as
    ``NaN``, ``1e12``, ``Exempt``, blanks around a number, ``3.0`` or nothing,
    written as CSV and scanned back; what is no number of the declared type is
    null and the job goes on (NaN incomes count as missing)."""
    spelt = F.element_at(F.array(*[F.lit(x) for x in UNCLEAN]), (F.col("application_id") % 6 + 1).cast("int"))
    raw = views.applications(spark, sf_dir).select("application_id", spelt.alias("total_units"), spelt.alias("income"))
    path = shared_path(spark, "unclean-csv")
    sinks.write_prepared(raw, path, fmt="csv", partition_by=None)
    got = src.read_applications(spark, path, fmt="csv", missing="null")
    return got.select("application_id", "total_units", F.when(~F.isnan("income"), F.col("income")).alias("income"))


KNOWN_CODES = {"loan_type": ["1", "2", "3", "4"], "lien_status": ["1", "2"]}
_PROBLEM_SQL = ("CASE application_id % 50 WHEN 7 THEN 'malformed' WHEN 13 THEN 'malformed' "
                "WHEN 21 THEN 'unparsed:total_units,unparsed:income' WHEN 33 THEN 'unknown:loan_type' ELSE '' END")


def _checked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every application as a line of all declared columns, some of them broken
    (by the last digits of the id): a short row, a row with a field too many,
    two numbers that are none, a code that does not exist; read back."""
    apps, rule = views.applications(spark, sf_dir), F.col("application_id") % 50
    names = [f.name for f in src.APPLICATION_SCHEMA.fields]
    text = {n: F.coalesce(F.col(n).cast("string"), F.lit("NA")) if n in apps.columns else F.lit("NA") for n in names}
    text["total_units"] = F.when(rule == 21, F.lit("Exempt")).otherwise(text["total_units"])
    text["income"] = F.when(rule == 21, F.lit("n/a")).otherwise(text["income"])
    text["loan_type"] = F.when(rule == 33, F.lit("9")).otherwise(text["loan_type"])
    line = F.concat_ws(",", *[text[n] for n in names])
    short = F.concat_ws(",", *[text[n] for n in names[:3]])
    path = shared_path(spark, "broken-csv")
    apps.select(F.when(rule == 7, short).when(rule == 13, F.concat(line, F.lit(",surplus"))).otherwise(line)
                .alias("value")).write.text(path)
    return src.read_applications_checked(spark, path, KNOWN_CODES, names=names)


@register("scan_problems", W(
    f"SELECT problem, COUNT(*) AS n FROM (SELECT UNNEST(string_split(CASE WHEN p = '' THEN 'accepted' ELSE p END, ',')) "
    f"AS problem FROM (SELECT {_PROBLEM_SQL} AS p FROM applications)) GROUP BY problem"))
def q_scan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed rows, unparsed numbers and unknown codes counted in the
    scan that types all declared columns."""
    return src.scan_problems(_checked_scan(spark, sf_dir))


@register("scan_quarantine", W(
    f"SELECT application_id, problems, problems = 'malformed' AS has_record, "
    f"CASE WHEN application_id % 50 IN (21, 33) THEN loan_amount END AS loan_amount "
    f"FROM (SELECT application_id, loan_amount, {_PROBLEM_SQL} AS problems FROM applications) WHERE problems <> ''"))
def q_scan_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows set aside, each with its problems and, where its fields
    cannot be trusted, its text; the values of the others are kept."""
    rows = _checked_scan(spark, sf_dir).filter(F.size("problems") > 0)
    return rows.select("application_id", F.concat_ws(",", "problems").alias("problems"),
                       F.col("raw_record").isNotNull().alias("has_record"),
                       F.when(F.col("raw_record").isNull(), F.col("loan_amount")).alias("loan_amount"))


@register("scan_accepted", W(f"SELECT {', '.join(APPS_COLS)} FROM applications WHERE {_PROBLEM_SQL} = ''"))
def q_scan_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the same file without a problem, typed."""
    return src.accepted(_checked_scan(spark, sf_dir)).select(*APPS_COLS)


@register("year_slice", W(f"SELECT application_id, activity_year, approved FROM labelled "
                          f"WHERE activity_year = {SLICE_YEAR}"))
def q_year_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One activity year of the prepared table, read from the table S4
    writes partitioned by year: the filter prunes whole year folders
    (``PartitionFilters``), so other years are never opened."""
    path = shared_path(spark, "prepared-by-year")
    sinks.write_prepared(views.labelled(spark, sf_dir).select("application_id", "activity_year", "approved"), path)
    return src.year_slice(spark.read.parquet(path), SLICE_YEAR).select("application_id", "activity_year", "approved")


LABELLED_COLS = APPS_COLS + ["approved"] + ATTRIBUTES + ["rule_decision"]


@register("write_prepared", W(f"SELECT {', '.join(LABELLED_COLS)} FROM labelled"))
def q_write_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared table written as Parquet partitioned by year, read back."""
    path = shared_path(spark, "prepared")
    sinks.write_prepared(views.labelled(spark, sf_dir), path)
    return spark.read.parquet(path).select(*LABELLED_COLS)


def _denial_counts_sql() -> str:
    sel = []
    from equiloan.constants import DENIAL_CODES
    from equiloan.functions.columns import sanitize_name
    for s in DENIAL_SLOTS:
        for code in DENIAL_CODES[s]:
            sel.append(f"SELECT '{sanitize_name(s + '_' + code)}' AS denial_reason, "
                       f"CAST(COUNT_IF({s} = '{code}') AS BIGINT) AS count FROM labelled")
    return W("\nUNION ALL\n".join(sel))


@register("read_columns", _denial_counts_sql())
def q_read_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 (+G5): only the four denial slots scanned from the written prepared
    table (Parquet column pruning), then the indicator counts."""
    path = shared_path(spark, "prepared-slots")
    sinks.write_prepared(views.labelled(spark, sf_dir), path)
    return describe.denial_reason_counts(src.read_columns(spark, path, DENIAL_SLOTS))


# --- P1-P10 -------------------------------------------------------------------

ENC_PRESENT = [c for c in COLUMNS_TO_ENCODE if c in APPS_COLS]


def _code_table_sql() -> str:
    long = "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM applications "
                                f"WHERE {c} IS NOT NULL" for c in ENC_PRESENT)
    return W("SELECT \"column\", value, CAST(DENSE_RANK() OVER (PARTITION BY \"column\" ORDER BY value) - 1 AS INT) "
             "AS code FROM (SELECT DISTINCT \"column\", value FROM long) d", ("long", long))


@register("categorize", _code_table_sql())
def q_categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary codes of the categorical columns."""
    return prep.code_table(views.applications(spark, sf_dir), ENC_PRESENT)


CODED = [*ENC_PRESENT, "activity_year"]


@register("categorize_rows", W(
    "SELECT a.application_id, " + ", ".join(f"k{i}.code AS {c}_code" for i, c in enumerate(CODED)) + " FROM applications a "
    + " ".join(f"LEFT JOIN codes k{i} ON k{i}.col = '{c}' AND k{i}.value = CAST(a.{c} AS VARCHAR)" for i, c in enumerate(CODED)),
    ("seen", "\nUNION\n".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM applications WHERE {c} IS NOT NULL"
                               for c in CODED)),
    ("codes", "SELECT col, value, CAST(ROW_NUMBER() OVER (PARTITION BY col ORDER BY value) - 1 AS INT) AS code FROM seen")))
def q_categorize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every application's dictionary codes, the year's among them."""
    apps = views.applications(spark, sf_dir).select("application_id", *CODED)
    return prep.categorize(apps, CODED).select("application_id", *[f"{c}_code" for c in CODED])


YEARS_PRESENT = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


@register("year_indicators", W(
    "SELECT application_id, " + ", ".join(
        f"CASE WHEN activity_year = {y} THEN 1 ELSE 0 END AS activity_year_{y}" for y in YEARS_PRESENT)
    + " FROM applications"))
def q_year_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 0/1 column per year found in the data."""
    apps = views.applications(spark, sf_dir).select("application_id", "activity_year")
    return prep.year_indicators(apps).drop("activity_year")


@register("drop_missing", W(f"SELECT application_id, {', '.join(PREDICTORS)} FROM applications WHERE "
                            + " AND ".join(f"{p} IS NOT NULL" for p in PREDICTORS)))
def q_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with all six predictors present."""
    apps = views.applications(spark, sf_dir).select("application_id", *PREDICTORS)
    return prep.drop_missing(apps, PREDICTORS)


@register("valid_actions", W("SELECT application_id, action_taken FROM applications WHERE action_taken IN (1, 2, 3)"))
def q_valid_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with action 1, 2 or 3."""
    return prep.valid_actions(views.applications(spark, sf_dir).select("application_id", "action_taken"))


@register("recode_label", W("SELECT application_id, action_taken, CASE WHEN action_taken IN (1, 2) THEN 1 "
                            "ELSE 0 END AS approved FROM applications WHERE action_taken IN (1, 2, 3)"))
def q_recode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 + P5: approved = 1 for actions 1, 2; 0 for 3."""
    apps = views.applications(spark, sf_dir).select("application_id", "action_taken")
    return prep.recode_label(prep.valid_actions(apps))


@register("threshold_flags", W("SELECT application_id, " + ", ".join(
    f"CASE WHEN tract_minority_population_percent >= {t} THEN 1 ELSE 0 END AS tract_minority_percentage{t}"
    for t in THRESHOLDS) + " FROM applications"))
def q_threshold_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share >= t flags on the unscaled percent."""
    apps = views.applications(spark, sf_dir).select("application_id", "tract_minority_population_percent")
    return prep.threshold_flags(apps).drop("tract_minority_population_percent")


@register("protected_attributes", W("SELECT application_id, " + ", ".join(
    f"CASE WHEN tract_minority_population_percent >= {t} THEN 0 ELSE 1 END AS a{t}" for t in THRESHOLDS)
    + " FROM applications"))
def q_protected_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """privileged = 1 when the share is below the threshold."""
    apps = views.applications(spark, sf_dir).select("application_id", "tract_minority_population_percent")
    return prep.protected_attributes(apps).drop("tract_minority_population_percent")


@register("min_max", W(
    "SELECT application_id, " + ", ".join(
        f"{R(f'CASE WHEN {c} IS NULL THEN NULL ELSE COALESCE((CAST({c} AS DOUBLE) - mn_{i}) / NULLIF(mx_{i} - mn_{i}, 0), 0.0) END')} AS {c}"
        for i, c in enumerate(COLUMNS_TO_SCALE))
    + " FROM labelled, st",
    ("st", "SELECT " + ", ".join(f"CAST(MIN({c}) AS DOUBLE) AS mn_{i}, CAST(MAX({c}) AS DOUBLE) AS mx_{i}"
                                 for i, c in enumerate(COLUMNS_TO_SCALE)) + " FROM labelled")))
def q_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine columns scaled to 0..1 over all prepared rows (one aggregation)."""
    df = views.labelled(spark, sf_dir).select("application_id", *COLUMNS_TO_SCALE)
    out = prep.min_max(df, COLUMNS_TO_SCALE)
    return out.select("application_id", *[round6(c).alias(c) for c in COLUMNS_TO_SCALE])


# Vocabulary of the stand-in's categorical columns (only the oracle needs it;
# the Spark side discovers it from the data).
STANDIN_VOCAB = {
    "derived_race": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "derived_sex": ["Female", "Joint", "Male"],
    "loan_type": ["1", "2"], "loan_purpose": ["1", "31"], "lien_status": ["1", "2"],
    "reverse_mortgage": ["1111", "2"], "open_end_line_of_credit": ["1", "2"],
    "business_or_commercial_purpose": ["1", "2"], "occupancy_type": ["1", "3"],
    "submission_of_application": ["1", "2"],
    "denial_reason_1": [str(i) for i in range(1, 11)],
    "denial_reason_2": [str(i) for i in range(1, 10)],
    "denial_reason_3": [str(i) for i in range(1, 8)],
    "denial_reason_4": [str(i) for i in range(1, 6)],
}


def _indicator_sql(cols: list[str], drop: set[str] = frozenset()) -> str:
    sel = []
    for c in cols:
        for v in STANDIN_VOCAB[c]:
            name = f"{c}_{v}"
            if name not in drop:
                sel.append(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {name}")
    return ", ".join(sel)


@register("one_hot", W(f"SELECT application_id, {_indicator_sql(ENC_PRESENT)} FROM applications"))
def q_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<column>_<value> indicators for every categorical column present."""
    apps = views.applications(spark, sf_dir).select("application_id", *ENC_PRESENT)
    return prep.one_hot(apps, ENC_PRESENT)


FILL_COLS = ["credit_score", "income", "loan_to_value_ratio", "property_value", "debt_to_income_ratio", "loan_term"]


@register("fill_missing", W("SELECT application_id, " + ", ".join(
    f"COALESCE({c}, 0.0) AS {c}" for c in FILL_COLS) + " FROM applications"))
def q_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: remaining nulls become 0."""
    return prep.fill_missing(views.applications(spark, sf_dir).select("application_id", *FILL_COLS), 0)


CAST_COLS = ["derived_race", "derived_sex", "loan_type", "loan_purpose", "reverse_mortgage",
             "denial_reason_1", "denial_reason_2", "credit_score", "income"]


@register("cast_numeric", W("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(COUNT_IF({c} IS NULL) AS BIGINT) AS n_null, "
    f"CAST(COUNT_IF({c} IS NOT NULL AND TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) IS NULL) AS BIGINT) AS n_failed, "
    f"CAST(COUNT(*) AS BIGINT) AS n FROM applications" for c in CAST_COLS)))
def q_cast_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per column, nulls and values that do not parse as numbers (the
    report that decides which columns the tolerant cast converts)."""
    return prep.cast_report(views.applications(spark, sf_dir), CAST_COLS)


#: Columns of CAST_COLS in which every value parses (the query checks it).
_CAST_FAIL = "(SELECT COUNT_IF({c} IS NOT NULL AND TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) IS NULL) FROM applications)"


@register("cast_numeric_rows", W("SELECT application_id, " + ", ".join(
    f"CASE WHEN {_CAST_FAIL.format(c=c)} = 0 THEN TRY_CAST(trim(CAST({c} AS VARCHAR)) AS DOUBLE) END AS {c}, "
    f"CASE WHEN {_CAST_FAIL.format(c=c)} > 0 THEN CAST({c} AS VARCHAR) END AS {c}_left" for c in CAST_COLS)
    + " FROM applications"))
def q_cast_numeric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tolerant cast itself: columns whose values all parse as
    doubles, the others (``<col>_left``) as they were."""
    got = prep.cast_numeric(views.applications(spark, sf_dir).select("application_id", *CAST_COLS))
    cast = {c for c, t in got.dtypes if t == "double"}
    return got.select("application_id", *[x for c in CAST_COLS for x in (
        (F.col(c) if c in cast else F.lit(None).cast("double")).alias(c),
        (F.lit(None).cast("string") if c in cast else F.col(c)).alias(f"{c}_left"))])


NUMERIC_LABELLED = ["activity_year", "action_taken", "total_units", "debt_to_income_ratio", "loan_amount",
                    "loan_to_value_ratio", "loan_term", "property_value", "income", "credit_score",
                    "tract_minority_population_percent", "approved", *ATTRIBUTES, "rule_decision"]


@register("coerce_and_drop", W("SELECT application_id, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC_LABELLED) + " FROM labelled WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in NUMERIC_LABELLED)))
def q_coerce_and_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns only, as doubles, rows with any null dropped."""
    return prep.coerce_and_drop(views.labelled(spark, sf_dir))


@register("exclude_where", W("SELECT application_id, approved FROM labelled WHERE " + " AND ".join(
    f"NOT ({c} IS NOT DISTINCT FROM '{v}')" for c, v in CONDITIONS)))
def q_exclude_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop rows meeting any of the eight conditions (null-safe)."""
    return prep.exclude_where(views.labelled(spark, sf_dir)).select("application_id", "approved")


COND_COLS = [c for c, _ in CONDITIONS]


@register("drop_if_present", W(
    f"SELECT application_id, {_indicator_sql(COND_COLS, set(COLUMNS_TO_DROP))} FROM labelled"))
def q_drop_if_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of the loan codes, then the listed columns dropped
    where present (credit_score and total_units go too)."""
    df = views.labelled(spark, sf_dir).select("application_id", "credit_score", "total_units", *COND_COLS)
    return prep.drop_if_present(prep.one_hot(df, COND_COLS), COLUMNS_TO_DROP)


@register("retain", W(f"SELECT application_id, {', '.join(PREDICTORS)}, approved FROM labelled"))
def q_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, six predictors, label."""
    return prep.retain(views.labelled(spark, sf_dir), PREDICTORS)


@register("equal_width_bins", W("SELECT application_id, tract_minority_population_percent, bins FROM binned",
                                *O.split_ctes()[:2]))
def q_equal_width_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten equal-width bins of the tract share, right-closed."""
    df = views.labelled(spark, sf_dir).select("application_id", "tract_minority_population_percent")
    return prep.equal_width_bins(df)


CASCADE_SQL = """CASE WHEN {d} = 1 THEN 1
  WHEN denial_reason_1 = '1' OR denial_reason_2 = '1' OR denial_reason_3 = '1' OR denial_reason_4 = '1' THEN 2
  WHEN denial_reason_1 = '4' OR denial_reason_2 = '4' OR denial_reason_3 = '4' OR denial_reason_4 = '4' THEN 3
  WHEN denial_reason_1 = '5' OR denial_reason_2 = '5' OR denial_reason_3 = '5' OR denial_reason_4 = '5' THEN 4
  ELSE 5 END"""


@register("denial_reason_final", W(
    f"SELECT application_id, {CASCADE_SQL.format(d='approved')} AS denial_reason_final FROM labelled"))
def q_denial_reason_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first-match denial reason cascade."""
    return prep.denial_reason_final(views.labelled(spark, sf_dir)).select("application_id", "denial_reason_final")


@register("denial_reason_for", W(
    f"SELECT application_id, {CASCADE_SQL.format(d='rule_decision')} AS denial_reason_final_rule_decision "
    f"FROM labelled"))
def q_denial_reason_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade driven by a model's decision (the scorecard)."""
    return prep.denial_reason_for(views.labelled(spark, sf_dir), "rule_decision").select(
        "application_id", "denial_reason_final_rule_decision")


@register("attribute_approval_columns", W(
    "SELECT application_id, approved AS original_approved, "
    + ", ".join(f"{a} AS {a}_approved" for a in ATTRIBUTES) + " FROM labelled"))
def q_attribute_approval_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """original_approved and <attr>_approved columns."""
    df = prep.attribute_approval_columns(views.labelled(spark, sf_dir), ATTRIBUTES)
    return df.select("application_id", "original_approved", *[f"{a}_approved" for a in ATTRIBUTES])


@register("standardize", W(
    "SELECT application_id, split, " + ", ".join(
        f"{R(f'(CAST({p} AS DOUBLE) - m_{i}) / COALESCE(NULLIF(s_{i}, 0), 1.0)')} AS {p}"
        for i, p in enumerate(PREDICTORS)) + " FROM splitted, st",
    *O.split_ctes(),
    ("st", "SELECT " + ", ".join(f"AVG({p}) AS m_{i}, STDDEV_POP({p}) AS s_{i}" for i, p in enumerate(PREDICTORS))
     + " FROM splitted WHERE split = 'train'")))
def q_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: predictors standardised with mean and population sd of the
    training split (T1), applied to every row."""
    df = splits.stratified_split(prep.equal_width_bins(views.labelled(spark, sf_dir)))
    train = df.filter(F.col("split") == "train")
    out = prep.standardize(df, PREDICTORS, fit_on=train)
    return out.select("application_id", "split", *[round6(p).alias(p) for p in PREDICTORS])


PRIMARY_SQL = ("CASE WHEN denial_reason_1 IN (" + ", ".join(f"'{i}'" for i in range(1, 11))
               + ") THEN CAST(denial_reason_1 AS INT) ELSE 1 END")


@register("argmax_label", W(f"SELECT application_id, {PRIMARY_SQL} AS primary_denial_reason FROM labelled"))
def q_primary_denial_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary denial reason (argmax of the ten slot-1 indicators)."""
    return prep.primary_denial_reason(views.labelled(spark, sf_dir)).select("application_id", "primary_denial_reason")


@register("clamp_label", W(f"SELECT application_id, CAST(LEAST(GREATEST({PRIMARY_SQL}, 0), 9) AS INT) AS class_code "
                           f"FROM labelled"))
def q_clamp_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary reason clamped to 0..9 (a ten-output class code)."""
    df = prep.primary_denial_reason(views.labelled(spark, sf_dir))
    return prep.clamp_label(df, "primary_denial_reason", 0, 9, out="class_code").select("application_id", "class_code")


@register("decide", W(
    "SELECT application_id, CASE WHEN (income - mn) / NULLIF(mx - mn, 0) >= 0.5 THEN 1 ELSE 0 END AS decision "
    "FROM labelled, st", ("st", "SELECT MIN(income) AS mn, MAX(income) AS mx FROM labelled")))
def q_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score in 0..1 (min-max scaled income) thresholded at 0.5."""
    df = prep.min_max(views.labelled(spark, sf_dir).select("application_id", "income"), ["income"])
    return prep.decide(df, "income", 0.5).select("application_id", "decision")


@register("validate_labels", W("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(COUNT_IF({c} IS NULL) AS BIGINT) AS n_null, "
    f"CAST(COUNT_IF({c} IS NOT NULL AND CAST({c} AS DOUBLE) NOT IN (0.0, 1.0)) AS BIGINT) AS n_invalid, "
    f"CAST(COUNT(*) AS BIGINT) AS n FROM labelled" for c in ["approved", *ATTRIBUTES])))
def q_validate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence check, then nulls and non-0/1 values per label/attribute."""
    return prep.validate_labels(views.labelled(spark, sf_dir), "approved", ATTRIBUTES)


@register("denied_only", W("SELECT application_id, approved FROM labelled WHERE approved = 0"))
def q_denied_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: rows with an unfavourable label."""
    return prep.denied_only(views.labelled(spark, sf_dir)).select("application_id", "approved")
