"""Preparation operators (P1-P25): projections, filters and derived columns.

Every operator takes and returns a DataFrame and adds column expressions to
the plan; none loops over rows. Operators that need a statistic of the data
(vocabularies, min/max, mean/sd) fit it with one aggregation whose result is
bounded by (columns x values) and apply it as literals - the fit/transform
pattern of ``pyspark.ml``, without vectors.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equiloan.constants import (
    APPROVED_ACTIONS,
    CONDITIONS,
    DENIAL_APPROVED,
    DENIAL_CASCADE,
    DENIAL_OTHER,
    DENIAL_SLOTS,
    PRIMARY_REASON_CODES,
    THRESHOLDS,
    VALID_ACTIONS,
)
from equiloan.functions.columns import clamp, code_is, flag, safe_div, sanitize_name
from equiloan.operators.cumulative import buckets_for, materialize, materialize_counted, range_buckets, running_total

TRACT_PCT = "tract_minority_population_percent"
#: No cap on vocabularies by default; give one to refuse columns that are not
#: categorical.
DEFAULT_VOCAB_CAP: int | None = None


# --- P1, P9: vocabularies, codes and one-hot indicators ----------------------

def vocabulary(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """(column, value, n) for every distinct non-null value of ``cols``.

    One pass: the columns are unpivoted (Expand) and counted; the partial
    aggregate holds at most (columns x distinct values) rows per task.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        raise ValueError("no column to build a vocabulary from")
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        ids=[], values=cols, variableColumnName="column", valueColumnName="value")
    return (long.filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def code_table(df: DataFrame, cols: Iterable[str], cap: int | None = DEFAULT_VOCAB_CAP,
               buckets: int | None = None) -> DataFrame:
    """(column, value, code) with 0-based codes in value order per column.

    The codes are running totals over the distinct-value table, cut into
    ranges by its measured size, so a column of very many values is not ranked
    in one task. With ``cap``, a column with more values raises (one small
    aggregation: one row per column)."""
    vocab, rows = materialize_counted(vocabulary(df, cols).select("column", "value", F.lit(1).alias("one")), "vocabulary")
    sizes = [] if cap is None else vocab.groupBy("column").agg(F.count(F.lit(1)).alias("k")).filter(
        F.col("k") > cap).collect()
    if sizes:
        raise ValueError(f"columns above the vocabulary cap of {cap}: {sorted(r['column'] for r in sizes)}")
    buckets = buckets or buckets_for(rows)
    ranked = running_total(range_buckets(vocab, ["column"], "value", buckets), ["column"], "value", "one", buckets=buckets)
    return ranked.select("column", "value", (F.col("cum_one") - 1).cast("int").alias("code"))


def collect_vocabulary(df: DataFrame, cols: Iterable[str], cap: int | None = DEFAULT_VOCAB_CAP) -> dict[str, list[str]]:
    """Distinct values per column, sorted, fetched to the driver: they become
    the columns of a table, so they fit a row by intent. With ``cap``, a column
    with more values raises before more than cap x columns rows are fetched."""
    cols = [c for c in cols if c in df.columns]
    found = vocabulary(df, cols).select("column", "value")
    budget = None if cap is None else cap * len(cols)
    rows = (found if budget is None else found.limit(budget + 1)).collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["column"]].append(r["value"])
    too_big = [c for c, v in out.items() if cap is not None and len(v) > cap]
    if too_big or (budget is not None and len(rows) > budget):
        raise ValueError(f"columns {too_big or 'several'} have more than {cap} values each")
    return {c: sorted(v) for c, v in out.items()}


#: A column of so few values is coded by a literal map; a larger one by a join.
LITERAL_VALUES = 50


def categorize(df: DataFrame, cols: Iterable[str], cap: int | None = DEFAULT_VOCAB_CAP,
               suffix: str = "_code") -> DataFrame:
    """Integer category codes next to the columns (``<col>_code``; null
    stays null). The code table stays distributed: columns of at most
    ``LITERAL_VALUES`` values are coded in the projection (only their codes are
    fetched), each larger one by a join with its codes, broadcast behind a
    check of their number."""
    from equiloan.operators.compose import broadcast_if_small

    cols = [c for c in cols if c in df.columns]
    codes = materialize(code_table(df, cols, cap), "codes")
    sizes = {r["column"]: r["k"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    few = [c for c in cols if sizes.get(c, 0) <= LITERAL_VALUES]
    held: dict[str, list] = {c: [] for c in few}
    for r in codes.filter(F.col("column").isin(few)).collect() if few else []:
        held[r["column"]].append((r["value"], r["code"]))
    out, exprs = df, []
    for i, c in enumerate(cols):
        if c not in held:
            own = codes.filter(F.col("column") == F.lit(c)).select(F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}"))
            out = out.join(broadcast_if_small(own), F.col(c).cast("string") == F.col(f"_value{i}"), "left")
            exprs.append(F.col(f"_code{i}").alias(c + suffix))
        elif held[c]:
            mapping = F.create_map(*[F.lit(x) for pair in held[c] for x in pair])
            exprs.append(F.element_at(mapping, F.col(c).cast("string")).cast("int").alias(c + suffix))
        else:
            exprs.append(F.lit(None).cast("int").alias(c + suffix))
    return out.select(*[F.col(c) for c in df.columns], *exprs)


def one_hot(df: DataFrame, cols: Iterable[str], vocab: dict[str, list[str]] | None = None,
            cap: int | None = DEFAULT_VOCAB_CAP, drop_source: bool = True) -> DataFrame:
    """``<col>_<value>`` 0/1 indicators; a null gives all zeros.

    The vocabulary comes from one aggregation (or is passed in, e.g. fitted on
    another table); indicators are then one ``select``. Keep the narrow table
    for metrics and models: past ~100 columns whole-stage codegen switches off.
    """
    cols = [c for c in cols if c in df.columns]
    vocab = vocab if vocab is not None else collect_vocabulary(df, cols, cap)
    names: dict[str, str] = {}
    exprs: list[Column] = []
    for c in cols:
        for v in vocab.get(c, []):
            name = sanitize_name(f"{c}_{v}")
            if name in names or name in df.columns:
                raise ValueError(f"indicator name collision: {name!r}")
            names[name] = c
            exprs.append(flag(F.col(c).cast("string") == F.lit(v)).alias(name))
    keep = [F.col(c) for c in df.columns if not (drop_source and c in cols)]
    return df.select(*keep, *exprs)


# --- P2-P7: year flags, filters, label, thresholds, attributes --------------

def distinct_years(df: DataFrame, col: str = "activity_year", cap: int | None = None) -> list[int]:
    years = [r[0] for r in df.select(col).distinct().collect() if r[0] is not None]
    if cap is not None and len(years) > cap:
        raise ValueError("too many distinct years for indicator columns")
    return sorted(years)


def year_indicators(df: DataFrame, years: list[int] | None = None, col: str = "activity_year") -> DataFrame:
    """``activity_year_<y>`` 0/1 per year (found in the data unless given)."""
    years = years if years is not None else distinct_years(df, col)
    return df.withColumns({f"{col}_{y}": flag(F.col(col) == F.lit(y)) for y in years})


def no_missing(cols: Iterable[str]) -> Column:
    """The predicate of P3: none of ``cols`` is null (or NaN)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return cond


def drop_missing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.filter(no_missing(cols))


def has_valid_action(col: str = "action_taken", values=VALID_ACTIONS) -> Column:
    """The predicate of P4: the action code is one of ``values``."""
    return F.coalesce(F.col(col).isin(list(values)), F.lit(False))


def valid_actions(df: DataFrame, col: str = "action_taken", values=VALID_ACTIONS) -> DataFrame:
    """Keep rows whose action code is one of ``values``."""
    return df.filter(has_valid_action(col, values))


def recode_label(df: DataFrame, col: str = "action_taken", out: str = "approved") -> DataFrame:
    """P5: ``approved`` = 1 for approved actions, else 0."""
    return df.withColumn(out, F.when(F.col(col).isin(list(APPROVED_ACTIONS)), F.lit(1)).otherwise(F.lit(0)))


def threshold_flags(df: DataFrame, thresholds=THRESHOLDS, col: str = TRACT_PCT,
                    prefix: str = "tract_minority_percentage") -> DataFrame:
    """``<prefix><t>`` = 1 when the (unscaled) share is >= t; null -> 0."""
    return df.withColumns({f"{prefix}{t}": flag(F.col(col) >= F.lit(t)) for t in thresholds})


def protected_attributes(df: DataFrame, thresholds=THRESHOLDS, col: str = TRACT_PCT,
                         prefix: str = "a") -> DataFrame:
    """``a<t>`` = 1 - flag: 1 (privileged) when the share is below t."""
    return df.withColumns({f"{prefix}{t}": F.lit(1) - flag(F.col(col) >= F.lit(t)) for t in thresholds})


# --- P8, P10-P12, P20: scaling, filling, casting -----------------------------

def fit_min_max(df: DataFrame, cols: Iterable[str]) -> dict[str, tuple]:
    cols = [c for c in cols if c in df.columns]
    row = df.agg(*[F.min(c).alias(f"mn_{i}") for i, c in enumerate(cols)],
                 *[F.max(c).alias(f"mx_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"mn_{i}"], row[f"mx_{i}"]) for i, c in enumerate(cols)}


def min_max(df: DataFrame, cols: Iterable[str], stats: dict[str, tuple] | None = None) -> DataFrame:
    """Scale to 0..1 with the columns' min and max over all rows (one
    aggregation for all columns). A constant column scales to 0, a null stays
    null (P10 fills it)."""
    cols = [c for c in cols if c in df.columns]
    stats = stats if stats is not None else fit_min_max(df, cols)
    out = {}
    for c in cols:
        mn, mx = stats[c]
        if mn is None:
            out[c] = F.col(c).cast("double")
            continue
        x = F.col(c).cast("double")
        scaled = F.coalesce(safe_div(x - F.lit(float(mn)), F.lit(float(mx)) - F.lit(float(mn))), F.lit(0.0))
        out[c] = F.when(x.isNull(), F.lit(None).cast("double")).otherwise(scaled)
    return df.withColumns(out)


def fill_missing(df: DataFrame, value=0) -> DataFrame:
    """P10: every remaining null in a numeric column becomes ``value``."""
    return df.na.fill(value)


def _numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def cast_report(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """P11 report: per column, rows, nulls before and values that fail to
    parse as a number. One aggregation over all columns, then unpivoted."""
    cols = list(cols) if cols is not None else df.columns
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        src = F.col(c)
        parsed = F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)")
        aggs.append(F.count_if(src.isNull()).alias(f"null_{i}"))
        aggs.append(F.count_if(src.isNotNull() & parsed.isNull()).alias(f"fail_{i}"))
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', null_{i}, fail_{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column, n_null, n_failed)", "n")


def cast_numeric(df: DataFrame, cols: Iterable[str] | None = None, label: str | None = "approved",
                 tolerant: bool = True, keep: Iterable[str] = ("application_id",)) -> DataFrame:
    """Cast columns to double; the label goes back to int.

    Strict: an unparsable value raises. Tolerant: columns with unparsable
    values are left as they are (found with one aggregation, ``cast_report``).
    """
    keep = set(keep)
    cols = [c for c in (cols if cols is not None else df.columns) if c not in keep]
    failing = set()
    if tolerant:
        rep = cast_report(df, cols).filter(F.col("n_failed") > 0).select("column").collect()
        failing = {r[0] for r in rep}
    out = {}
    for c in cols:
        if c in failing:
            continue
        if tolerant:
            out[c] = F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)")
        else:
            out[c] = F.col(c).cast("double")
    df = df.withColumns(out)
    if label and label in df.columns:
        df = df.withColumn(label, F.col(label).cast("int"))
    return df


def coerce_and_drop(df: DataFrame, keep: Iterable[str] = ("application_id",)) -> DataFrame:
    """Drop non-numeric columns, coerce the rest to double, drop rows with
    any null."""
    keep = [c for c in keep if c in df.columns]
    numeric = [f.name for f in df.schema.fields if _numeric(f.dataType) and f.name not in keep]
    out = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in numeric])
    return out.dropna()


def fit_standardize(df: DataFrame, cols: Iterable[str], with_count: bool = False):
    """{column: (mean, population sd)}, with the row count if asked for: one
    aggregation."""
    cols = list(cols)
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)], F.count(F.lit(1)).alias("n")).first()
    stats = {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}
    return (stats, row["n"]) if with_count else stats


def standardize(df: DataFrame, cols: Iterable[str], fit_on: DataFrame | None = None,
                stats: dict[str, tuple] | None = None) -> DataFrame:
    """P20: zero mean, unit population sd, fitted on ``fit_on`` (e.g. the
    training split) and applied to ``df``. A zero sd divides by 1."""
    cols = list(cols)
    stats = stats if stats is not None else fit_standardize(fit_on if fit_on is not None else df, cols)
    out = {}
    for c in cols:
        m, s = stats[c]
        s = s if s not in (None, 0.0) else 1.0
        out[c] = (F.col(c).cast("double") - F.lit(float(m if m is not None else 0.0))) / F.lit(float(s))
    return df.withColumns(out)


# --- P13-P16: exclusion, drops, retention, bins -----------------------------

def not_excluded(columns: Iterable[str], conditions=CONDITIONS) -> Column:
    """The predicate of P13 in ``drop`` mode: no condition on a column that is
    present is met; a null code meets none."""
    columns, cond = set(columns), F.lit(True)
    for c, v in conditions:
        if c in columns:
            cond = cond & ~F.col(c).cast("string").eqNullSafe(F.lit(v))
    return cond


def exclude_where(df: DataFrame, conditions=CONDITIONS, mode: str = "drop") -> DataFrame:
    """For each (column, code) present, drop rows whose indicator
    ``<column>_<code>`` is 1 (mode ``drop``, as written), or keep only rows
    where every indicator is 1 (mode ``keep``). A null code has indicator 0,
    so it is kept by ``drop``: the test is null-safe (``<=>``)."""
    present = [(c, v) for c, v in conditions if c in df.columns]
    if not present:
        return df
    hits = [F.col(c).cast("string").eqNullSafe(F.lit(v)) for c, v in present]
    if mode == "drop":
        cond = not_excluded(df.columns, conditions)
    elif mode == "keep":
        cond = hits[0]
        for h in hits[1:]:
            cond = cond & h
    else:
        raise ValueError("mode must be 'drop' or 'keep'")
    return df.filter(cond)


def drop_if_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist (absent names are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def retain(df: DataFrame, features: Iterable[str], label: str | None = "approved",
           key: str = "application_id", extra: Iterable[str] = ()) -> DataFrame:
    """Keep the key, the features, the label and any extra columns."""
    cols = ([key] if key in df.columns else []) + list(features) + list(extra)
    if label:
        cols.append(label)
    return df.select(*cols)


def fit_equal_width(df: DataFrame, col: str) -> tuple:
    row = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx")).first()
    return row["mn"], row["mx"]


def equal_width_bins(df: DataFrame, col: str = TRACT_PCT, n: int = 10, out: str = "bins",
                     stats: tuple | None = None) -> DataFrame:
    """``n`` equal-width bins over [min, max], right-closed, the lowest
    value in bin 0: bin = clamp(ceil((x - min) / w) - 1, 0, n - 1)."""
    mn, mx = stats if stats is not None else fit_equal_width(df, col)
    if mn is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    w = (float(mx) - float(mn)) / n
    x = F.col(col).cast("double")
    if w == 0:
        b = F.when(x.isNotNull(), F.lit(0))
    else:
        b = clamp(F.ceil((x - F.lit(float(mn))) / F.lit(w)) - F.lit(1), 0, n - 1)
    return df.withColumn(out, b.cast("int"))


# --- P17-P19, P21-P25: denial reasons, approvals, labels, decisions ---------

def _any_slot_is(code: str, slots=DENIAL_SLOTS) -> Column:
    cond = code_is(slots[0], code)
    for s in slots[1:]:
        cond = cond | code_is(s, code)
    return cond


def denial_reason_final(df: DataFrame, decision: str = "approved", out: str = "denial_reason_final",
                        slots=DENIAL_SLOTS) -> DataFrame:
    """First match of approved -> 1; any slot debt-to-income -> 2;
    collateral -> 3; insufficient cash -> 4; else 5. ``decision`` may be the
    label or any model's decision column (P18)."""
    slots = [s for s in slots if s in df.columns]
    expr = F.when(F.col(decision) == F.lit(1), F.lit(DENIAL_APPROVED))
    for code, reason in DENIAL_CASCADE:
        expr = expr.when(_any_slot_is(code, slots), F.lit(reason))
    return df.withColumn(out, expr.otherwise(F.lit(DENIAL_OTHER)))


def denial_reason_for(df: DataFrame, decision: str, out: str | None = None) -> DataFrame:
    """The P17 cascade with a model's decision in place of ``approved``."""
    return denial_reason_final(df, decision=decision, out=out or f"denial_reason_final_{decision}")


def attribute_approval_columns(df: DataFrame, attributes: Iterable[str], label: str = "approved",
                               original: str = "original_approved") -> DataFrame:
    """``<attr>_approved`` copies of each attribute and ``original_approved``."""
    cols = {original: F.col(label)}
    cols.update({f"{a}_approved": F.col(a) for a in attributes})
    return df.withColumns(cols)


def primary_denial_reason(df: DataFrame, slot: str = "denial_reason_1", out: str = "primary_denial_reason") -> DataFrame:
    """First of the ten slot-1 indicators with the largest value; a row
    with all ten at 0 (other code or null) falls to reason 1."""
    c = F.col(slot).cast("string")
    expr = F.when(c.isin(PRIMARY_REASON_CODES), c.cast("int")).otherwise(F.lit(1))
    return df.withColumn(out, expr)


def clamp_label(df: DataFrame, col: str, lo: int = 0, hi: int = 9, out: str | None = None) -> DataFrame:
    """Class codes clamped to lo..hi."""
    return df.withColumn(out or col, clamp(col, lo, hi).cast("int"))


def decide(df: DataFrame, score: str | Column, threshold: float = 0.5, out: str = "decision") -> DataFrame:
    """Score >= threshold -> 1, else 0 (a null score is 0)."""
    s = F.col(score) if isinstance(score, str) else score
    return df.withColumn(out, flag(s >= F.lit(threshold)))


def validate_labels(df: DataFrame, label: str = "approved", attributes: Iterable[str] = ()) -> DataFrame:
    """Raise if the label or an attribute column is missing; else report
    per column the rows, nulls and values outside {0, 1} (one aggregation)."""
    cols = [label] + list(attributes)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{i}"))
        aggs.append(F.count_if(F.col(c).isNotNull() & ~F.col(c).cast("double").isin(0.0, 1.0)).alias(f"bad_{i}"))
    stack = ", ".join(f"'{c}', null_{i}, bad_{i}" for i, c in enumerate(cols))
    return df.agg(*aggs).selectExpr(f"stack({len(cols)}, {stack}) as (column, n_null, n_invalid)", "n")


def denied_only(df: DataFrame, label: str = "approved") -> DataFrame:
    """P25: rows with an unfavourable label."""
    return df.filter(F.col(label) == F.lit(0))
