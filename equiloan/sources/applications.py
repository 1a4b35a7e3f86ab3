"""Typed scans of application tables.

The raw table is a wide CSV or Parquet file. Only the declared columns are
read (the scan prunes the rest), names are sanitised, numbers are parsed with
``try_cast`` so an unclean value becomes null instead of failing the job, and
codes read from float-typed sources lose their ``.0``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiloan.constants import COLUMNS_TO_ENCODE, DENIAL_SLOTS
from equiloan.functions.columns import normalize_code, sanitize_names

# Declared types of the application table (sanitised names).
INT_COLUMNS = ["activity_year", "action_taken", "total_units"]
DOUBLE_COLUMNS = [
    "debt_to_income_ratio", "loan_amount", "loan_to_value_ratio", "loan_term",
    "property_value", "income", "credit_score", "tract_minority_population_percent",
]
STRING_COLUMNS = list(COLUMNS_TO_ENCODE)

APPLICATION_SCHEMA = T.StructType(
    [T.StructField("application_id", T.LongType(), True)]
    + [T.StructField(c, T.IntegerType(), True) for c in INT_COLUMNS]
    + [T.StructField(c, T.DoubleType(), True) for c in DOUBLE_COLUMNS]
    + [T.StructField(c, T.StringType(), True) for c in STRING_COLUMNS]
)


def _typed(df: DataFrame, missing: str) -> DataFrame:
    """Select declared columns by sanitised name and parse them to their types."""
    raw_names = df.columns
    mapping = sanitize_names(raw_names)
    by_clean = {clean: raw for raw, clean in mapping.items()}
    out = []
    for field in APPLICATION_SCHEMA.fields:
        raw = by_clean.get(field.name)
        if raw is None:
            if missing == "error":
                raise ValueError(f"column {field.name!r} missing from the source")
            if missing == "null":
                out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        out.append(_parsed(field, raw).alias(field.name))
    return df.select(*out)


def _parsed(field: T.StructField, raw: str) -> Column:
    """The source column ``raw`` parsed to its declared type."""
    src = F.col(f"`{raw}`")
    if isinstance(field.dataType, T.StringType):
        expr = normalize_code(src) if field.name in DENIAL_SLOTS or field.name in STRING_COLUMNS else src
        return F.when(src.isNull(), F.lit(None).cast("string")).otherwise(expr)
    # Parse through string so that '1.0', ' 12 ' and 'Exempt' all behave.
    expr = F.expr(f"try_cast(trim(cast(`{raw}` as string)) as {field.dataType.simpleString()})")
    if isinstance(field.dataType, T.IntegerType):
        expr = F.coalesce(expr, F.expr(f"try_cast(try_cast(trim(cast(`{raw}` as string)) as double) as int)"))
    return expr


def read_applications(spark: SparkSession, path: str, fmt: str = "csv",
                      missing: str = "error", null_value: str = "NA") -> DataFrame:
    """Typed scan of the declared application columns out of a wider file.

    CSV is read as strings (no schema inference pass) and parsed per column;
    only the selected columns are parsed by the CSV reader. ``missing`` says
    what to do with a declared column the file lacks: raise an ``error``
    (default), add a ``null`` column, or ``skip`` it.
    """
    if fmt == "csv":
        df = (spark.read.option("header", True).option("nullValue", null_value)
              .option("mode", "PERMISSIVE").csv(path))
    else:
        df = spark.read.format(fmt).load(path)
    return _typed(df, missing)


def read_applications_checked(spark: SparkSession, path: str, known_codes: dict[str, list[str]] | None = None,
                              names: list[str] | None = None, null_value: str = "NA") -> DataFrame:
    """S1 with a quarantine: every row of the CSV, all declared columns typed
    as by ``read_applications``, and two columns about the row, in one scan.

    ``raw_record`` is the text of a row with too few or too many fields (its
    values are those that could be told apart), else null. ``problems`` lists
    what is wrong, in the order of the columns: ``malformed`` for such a row,
    ``unparsed:<column>`` for a number that is there but cannot be parsed, and
    ``unknown:<column>`` for a code outside ``known_codes`` of that column; a
    malformed row gets no other problem. Declared columns that the file lacks
    are null. ``names`` are the column names of a file without a header."""
    if names is None:
        names = spark.read.option("header", True).csv(path).columns
        header = True
    else:
        header = False
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("raw_record", T.StringType())])
    # Without column pruning the reader counts every field of a line.
    raw = (spark.read.schema(schema).option("header", header).option("nullValue", null_value).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "raw_record").option("columnPruning", False).csv(path))
    by_clean = {clean: name for name, clean in sanitize_names(names).items()}
    typed, problems = [], []
    for field in APPLICATION_SCHEMA.fields:
        name = by_clean.get(field.name)
        if name is None:
            typed.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value, codes = _parsed(field, name), (known_codes or {}).get(field.name)
        typed.append(value.alias(field.name))
        if not isinstance(field.dataType, T.StringType):
            there = F.coalesce(F.trim(F.col(f"`{name}`")) != "", F.lit(False))
            problems.append(F.when(there & value.isNull(), F.lit(f"unparsed:{field.name}")))
        elif codes is not None:
            problems.append(F.when(value.isNotNull() & ~value.isin(list(codes)), F.lit(f"unknown:{field.name}")))
    found = F.array_compact(F.array(*problems)) if problems else F.array().cast("array<string>")
    broken = F.when(F.col("raw_record").isNotNull(), F.array(F.lit("malformed"))).otherwise(found)
    return raw.select(*typed, "raw_record", broken.alias("problems"))


def accepted(checked: DataFrame) -> DataFrame:
    """The rows of a checked scan without a problem, in the declared columns."""
    return checked.filter(F.size("problems") == 0).drop("raw_record", "problems")


def scan_problems(checked: DataFrame) -> DataFrame:
    """(problem, n): rows per problem of a checked scan, and ``accepted`` ones;
    one aggregation of few groups."""
    each = F.when(F.size("problems") == 0, F.array(F.lit("accepted"))).otherwise(F.col("problems"))
    return checked.select(F.explode(each).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def in_year(year: int):
    """The predicate of S2."""
    return F.col("activity_year") == F.lit(year)


def year_slice(df: DataFrame, year: int) -> DataFrame:
    """Rows of one activity year. On a table written partitioned by year
    this prunes whole directories; on Parquet it is a pushed-down filter."""
    return df.filter(in_year(year))


def read_columns(spark: SparkSession, path: str, columns: list[str], fmt: str = "parquet") -> DataFrame:
    """S3: scan of a column subset (Parquet reads only those column chunks)."""
    return spark.read.format(fmt).load(path).select(*columns)
