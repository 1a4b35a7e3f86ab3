"""Descriptive statistics and counts.

Quartiles are exact and distributed, not the ``percentile`` aggregate, which
gathers a group's values in one task. One aggregation gives the plain
statistics and, from quantile sketches, a narrow bracket around every wanted
position; a second scan counts the rows between the brackets and the values
inside them, which are then ranked. Where a bracket holds more rows than one
task should rank, passes that sketch only what lies inside narrow it first,
each to about a hundredth. Nothing of the table's size is written or shuffled.
``approx=True`` takes the sketches' values instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloan.constants import CONDITIONS, DENIAL_CODES, DENIAL_SLOTS
from equiloan.functions.columns import code_is, round6, sanitize_name
from equiloan.operators.cumulative import exact_quantiles

STATS = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
PROBS = [0.25, 0.5, 0.75]


#: 1 / relative rank error of the sketches; brackets are four errors wide.
SKETCH_ACCURACY = 5000
#: Rows inside a bracket up to which its values are ranked by one task.
BRACKET_ROWS = 200_000
#: Parts into which a narrowing pass cuts a bracket.
CUTS = 256


def describe_scopes(df: DataFrame, cols: Iterable[str], scope: Column | None = None, overall: str | None = None,
                    approx: bool = False) -> DataFrame:
    """G1-G3 core: (predictor, scope) -> count, mean, sd (sample), min,
    quartiles, max, for every value of ``scope`` (null: in none) and, named
    ``overall``, for all rows. Scopes are few (years, splits): their sketches,
    one row per scope, are fetched."""
    cols = list(cols)
    spark = df.sparkSession
    base = df.select((scope if scope is not None else F.lit(None)).cast("string").alias("_s"),
                     *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    slack = 2.0 / SKETCH_ACCURACY
    probs = [q for p in PROBS for q in (max(p - slack, 0.0), p, min(p + slack, 1.0))]
    aggs = []
    for i in range(len(cols)):
        c = F.col(f"_c{i}")
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"a{i}"), F.stddev_samp(c).alias(f"d{i}"),
                 F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"),
                 F.percentile_approx(c, F.array(*[F.lit(q) for q in probs]), F.lit(SKETCH_ACCURACY)).alias(f"q{i}")]
    found = base.rollup("_s").agg(F.grouping("_s").alias("_all"), F.count(F.lit(1)).alias("_rows"), *aggs).collect()
    rows, brackets = [], []
    for r in found:
        name = overall if r["_all"] else r["_s"]
        if name is None or not r["_rows"]:
            continue
        for i, c in enumerate(cols):
            q = r[f"q{i}"]
            rows.append((c, name, r[f"n{i}"], r[f"a{i}"], r[f"d{i}"], r[f"l{i}"],
                         *([None] * 3 if q is None or not approx else [q[1], q[4], q[7]]), r[f"h{i}"]))
            if q is not None and not approx:
                n = r[f"n{i}"]
                few = n < 4 * SKETCH_ACCURACY  # one rank is more than a bracket's margin
                for j, p in enumerate(PROBS):
                    low, high = (r[f"l{i}"], r[f"h{i}"]) if few else (q[3 * j], q[3 * j + 2])
                    pos = p * (n - 1)
                    brackets.append((i, None if r["_all"] else name, j, float(low), float(high), int(pos),
                                     min(int(pos) + 1, n - 1), pos - int(pos), c, name, n * (1 if few else 3 * slack)))
    table = spark.createDataFrame(rows, "predictor string, scope string, count long, mean double, std double, min double, "
                                        "q25 double, q50 double, q75 double, max double")
    if brackets:
        found = _ranked(base, brackets)
        if found is None:  # a sketch outside its promise: rank everything
            found = _all_ranked(base, cols, overall)
        table = table.drop("q25", "q50", "q75").join(found, ["predictor", "scope"], "left")
    return table.select("predictor", "scope", "count",
                        *[round6(c).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


def _bounds(targets: list[dict]) -> dict[tuple, tuple[list, list]]:
    """Per (column, scope): the distinct ends of its targets' brackets in
    order, and for every cell between and on them (2k: below end k, 2k+1: on
    it) whether it lies inside a bracket and is no end itself."""
    out = {}
    for t in targets:
        out.setdefault((t["c"], t["s"]), set()).update((t["low"], t["high"]))
    for key, ends in out.items():
        ends = sorted(ends, key=lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v))
        at = {repr(v): i for i, v in enumerate(ends)}
        inside = [False] * (2 * len(ends) + 1)
        for t in targets:
            if (t["c"], t["s"]) == key:
                for i in range(at[repr(t["low"])] + 1, at[repr(t["high"])] + 1):
                    inside[2 * i] = True
        out[key] = (ends, inside)
    return out


def _cells(base: DataFrame, targets: list[dict]) -> DataFrame:
    """Every value of every (column ``c``, scope ``s``, null for all rows) with
    its ``cell``; ``value`` only inside a bracket. One scan of the table."""
    bounds = _bounds(targets)
    width = max(len(ends) for ends, _ in bounds.values())
    table = base.sparkSession.createDataFrame(
        [(c, s, ends, inside) for (c, s), (ends, inside) in bounds.items()],
        "c int, s string, ends array<double>, inside array<boolean>")
    table = table.select("c", "s", "inside", *[F.get("ends", F.lit(j)).alias(f"e{j}") for j in range(width)])
    value = lambda c, s: F.struct(F.lit(c).alias("c"), s.alias("s"), F.col(f"_c{c}").alias("x"))
    arms = [arm for c in sorted({c for c, _ in bounds}) for arm in (
        value(c, F.lit(None).cast("string")), F.when(F.col("_s").isNotNull(), value(c, F.col("_s"))))]
    rows = base.select(F.explode(F.array_compact(F.array(*arms))).alias("r")).select("r.*").filter(F.col("x").isNotNull()).alias("r")
    rows = rows.join(F.broadcast(table).alias("t"), (F.col("r.c") == F.col("t.c")) & F.col("r.s").eqNullSafe(F.col("t.s")))
    over = lambda j: (F.coalesce(F.col("x") > F.col(f"e{j}"), F.lit(False)).cast("int")
                      + F.coalesce(F.col("x") >= F.col(f"e{j}"), F.lit(False)).cast("int"))
    cell = over(0)
    for j in range(1, width):
        cell = cell + over(j)
    return rows.select("r.c", "r.s", cell.alias("cell"), "inside", "x").select(
        "c", "s", "cell", F.when(F.get("inside", F.col("cell")), F.col("x")).alias("value"))


def _narrow(base: DataFrame, targets: list[dict]) -> bool:
    """One pass that cuts every bracket to a few of ``CUTS`` parts of what lies
    inside it; False if a rank turns out to lie outside its bracket."""
    fractions = F.array(*[F.lit(j / CUTS) for j in range(CUTS + 1)])
    found = (_cells(base, targets).groupBy("c", "s", "cell")
             .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", fractions, F.lit(SKETCH_ACCURACY)).alias("q"))
             .collect())  # a few cells per column and scope
    bounds, cells = _bounds(targets), {}
    for r in found:
        cells.setdefault((r["c"], r["s"]), {})[r["cell"]] = (r["n"], r["q"])
    for t in targets:
        ends, inside = bounds[t["c"], t["s"]]
        mine, before = cells.get((t["c"], t["s"]), {}), 0
        for cell in range(len(inside)):
            n, q = mine.get(cell, (0, None))
            if before <= t["rank"] < before + n:
                break
            before += n
        else:
            return False
        if cell % 2:
            t.update(low=ends[cell // 2], high=ends[cell // 2], rows=0.0)
        elif not inside[cell]:
            return False
        else:
            at, slack = (t["rank"] - before) / n, 2.0 / SKETCH_ACCURACY + 1.0 / n
            i, j = math.floor((at - slack) * CUTS), math.ceil((at + slack) * CUTS)
            t.update(low=q[i] if i > 0 else ends[cell // 2 - 1], high=q[j] if j < CUTS else ends[cell // 2],
                     rows=n * min(1.0, (j - i) / CUTS + 2.0 / SKETCH_ACCURACY))
    return True


def _ranked(base: DataFrame, brackets: list[tuple]) -> DataFrame | None:
    """Exact quartiles from the brackets (column, scope or None for all rows,
    quartile, low, high, ranks of the two order statistics, fraction, names,
    rows expected inside); None if a rank is not inside its bracket.

    Brackets that hold more than ``BRACKET_ROWS`` rows are narrowed by further
    passes first. The last pass counts the values inside them, and a window
    per column and scope, over at most a few times ``BRACKET_ROWS`` values,
    ranks those."""
    spark = base.sparkSession
    targets = [{"c": b[0], "s": b[1], "rank": r, "low": b[3], "high": b[4], "rows": b[10], "of": (b[9], b[1], b[8]),
                "quartile": b[2], "part": b[7], "end": e} for b in brackets for e, r in enumerate((b[5], b[6]))]
    while (most := max(t["rows"] for t in targets)) > BRACKET_ROWS:
        if not _narrow(base, targets) or max(t["rows"] for t in targets) >= most:
            return None
    bounds = _bounds(targets)
    counts = _cells(base, targets).groupBy("c", "s", "cell", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("c", "s").orderBy("cell", "value").rowsBetween(Window.unboundedPreceding, 0))
    wanted = spark.createDataFrame(sorted({(t["c"], t["s"], t["rank"]) for t in targets}, key=str), "c int, s string, rank long")
    hit = counts.withColumn("upto", upto).alias("a").join(
        F.broadcast(wanted).alias("b"), (F.col("a.c") == F.col("b.c")) & F.col("a.s").eqNullSafe(F.col("b.s"))
        & (F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    at = {(r["c"], r["s"], r["rank"]): bounds[r["c"], r["s"]][0][r["cell"] // 2] if r["cell"] % 2 else r["value"]
          for r in hit.select("a.c", "a.s", "rank", "cell", "value").collect()}  # one row per rank
    out: dict[tuple, list] = {}
    for low, high in zip(targets[::2], targets[1::2]):
        v0, v1 = (at.get((t["c"], t["s"], t["rank"])) for t in (low, high))
        if v0 is None or v1 is None:
            return None
        name, _, predictor = low["of"]
        out.setdefault((predictor, name), [None] * 3)[low["quartile"]] = v0 + (v1 - v0) * low["part"]
    return spark.createDataFrame([(*k, *v) for k, v in out.items()],
                                 "predictor string, scope string, q25 double, q50 double, q75 double")


def _all_ranked(base: DataFrame, cols: list[str], overall: str | None) -> DataFrame:
    scopes = F.array_compact(F.array(F.col("_s"), F.lit(overall).cast("string")))
    long = (base.select(F.explode(scopes).alias("scope"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])
            .unpivot(ids=["scope"], values=cols, variableColumnName="predictor", valueColumnName="value"))
    return exact_quantiles(long, ["predictor", "scope"], "value", PROBS, names=["q25", "q50", "q75"])


def describe_by_year(df: DataFrame, cols: Iterable[str], years: list[int], approx: bool = False,
                     col: str = "activity_year") -> DataFrame:
    """G1 + G2: per predictor, statistics for each listed year and over all years."""
    y = F.col(col)
    scope = F.when(y.isin(list(years)), F.concat(F.lit(f"{col}_"), y.cast("string")))
    return describe_scopes(df, cols, scope, "All_years", approx)


def describe_overall(df: DataFrame, cols: Iterable[str], approx: bool = False) -> DataFrame:
    """The same statistics over all rows."""
    return describe_scopes(df, cols, None, "All_years", approx)


def describe_splits(df: DataFrame, col: str, split: str = "split", approx: bool = False) -> DataFrame:
    """One column described over all rows and per split."""
    return describe_scopes(df, [col], F.col(split), "all", approx)


def side_by_side(desc: DataFrame, scopes: list[str]) -> DataFrame:
    """One row per predictor, columns <scope>_<stat> (pivot on known scopes)."""
    aggs = []
    for s in scopes:
        for st in STATS:
            aggs.append(F.max(F.when(F.col("scope") == F.lit(s), F.col(st))).alias(f"{s}_{st}"))
    return desc.groupBy("predictor").agg(*aggs)


def condition_counts(df: DataFrame, conditions=CONDITIONS) -> DataFrame:
    """Rows whose indicator <column>_<code> is 1, per condition, and rows
    meeting all of them. One aggregation, then unpivoted. Run it before the
    exclusion (P13), which removes exactly these rows."""
    present = [(c, v) for c, v in conditions if c in df.columns]
    hits = [code_is(c, v) for c, v in present]
    all_hit = hits[0]
    for h in hits[1:]:
        all_hit = all_hit & h
    aggs = [F.count_if(h).alias(f"c{i}") for i, h in enumerate(hits)] + [F.count_if(all_hit).alias("call")]
    labels = [f"{sanitize_name(c + '_' + v)} == 1" for c, v in present] + ["All conditions met"]
    refs = [f"c{i}" for i in range(len(hits))] + ["call"]
    stack = ", ".join(f"'{lab}', {r}" for lab, r in zip(labels, refs))
    return df.agg(*aggs).selectExpr(f"stack({len(refs)}, {stack}) as (condition, count)")


def denial_reason_counts(df: DataFrame, slots=DENIAL_SLOTS, codes=DENIAL_CODES) -> DataFrame:
    """Rows with each denial indicator <slot>_<code> = 1 (38 indicators,
    zeros included). One aggregation of conditional counts, then unpivoted."""
    names, aggs = [], []
    for s in slots:
        for code in codes[s]:
            i = len(names)
            names.append(sanitize_name(f"{s}_{code}"))
            aggs.append(F.count_if(code_is(s, code)).alias(f"d{i}") if s in df.columns
                        else F.lit(0).cast("bigint").alias(f"d{i}"))
    stack = ", ".join(f"'{n}', d{i}" for i, n in enumerate(names))
    return df.agg(*aggs).selectExpr(f"stack({len(names)}, {stack}) as (denial_reason, count)")


def stage_audit(df: DataFrame, stages: list[tuple[str, Column, int]]) -> DataFrame:
    """Rows and columns after each stage, in one pass over the input.

    ``stages`` lists (name, predicate a row must meet to survive up to that
    stage, number of columns after it). Each stage's row count is a
    ``count_if`` of the conjunction of the predicates so far."""
    aggs, cond = [], F.lit(True)
    for i, (_, pred, _) in enumerate(stages):
        cond = cond & F.coalesce(pred, F.lit(False))
        aggs.append(F.count_if(cond).alias(f"s{i}"))
    stack = ", ".join(f"{i + 1}, '{name}', s{i}, {ncols}" for i, (name, _, ncols) in enumerate(stages))
    return df.agg(*aggs).selectExpr(f"stack({len(stages)}, {stack}) as (stage_order, stage, rows, columns)")
