"""Bias mitigation (M1-M4): reweighing and distribution repair.

Reweighing (Kamiran & Calders 2012) gives each (group, label) cell the weight
N_g * N_y / (N * N_gy); the weights come from the contingency table, so
fitting them is one aggregation whatever the data size, and applying them is
a join with a table of at most four rows per attribute.

Repair (after Feldman et al. 2015) moves each feature value to the same
within-group quantile of the "median" distribution of the groups, mixed with
the original by ``level``. Our definition, for groups g and distinct values:
  u = (cum - n/2) / N_g (mid-rank quantile; ties share one u),
  bucket b = min(floor(u * B), B - 1), B = the smallest group's size (or
  ``max_buckets``, where a caller asks for a coarser repair),
  per (g, b) the count-weighted mean value, empty buckets filled from the
  previous one (leading ones from the next), mid(b) = mean over groups,
  repaired = (1 - level) * x + level * mid(b(x)).
Null stays null; a feature whose group is empty is left unchanged. The rank
is the exact bucketed running total of ``cumulative``. Up to ``ARRAY_EDGES``
buckets, the fit hands on the buckets' edges as arrays and applying them is a
binary search in them, batch by batch; up to ``GROUP_VALUES`` distinct values of a
feature, one task an (attribute, feature) fits them from the counts; above, joins
and windows do. Above ``ARRAY_EDGES``, the fit goes by packed blocks of the sorted
distinct values, and hands on one row per (feature, value) with the targets of all
attributes, which the rows join once per feature. None of these choices changes a
result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiloan.functions.columns import round6, safe_div
from equiloan.operators.cumulative import (
    buckets_for,
    materialize,
    materialize_counted,
    range_buckets,
    running_total,
)
from equiloan.operators.parity import contingency
from equiloan.session import discard, ship_package

# --- M1, M2: reweighing -------------------------------------------------------

def weights_from_contingency(ct: DataFrame, by: list[str]) -> DataFrame:
    """(by..., attribute, g, y) -> n, weight from a contingency table: one
    conditional-sum aggregation per (by, attribute) gives the four cell counts,
    the weights are arithmetic on them, and ``stack`` turns the row back into
    at most four cells (empty cells have no row)."""
    n = F.col("n")
    cells = ct.groupBy(*by, "attribute").agg(*[
        F.sum(F.when((F.col("g") == g) & (F.col("y") == y), n).otherwise(F.lit(0))).alias(f"n{g}{y}")
        for g in (0, 1) for y in (0, 1)])
    d = lambda c: F.col(c).cast("double")
    total = d("n00") + d("n01") + d("n10") + d("n11")
    n_g = {0: d("n00") + d("n01"), 1: d("n10") + d("n11")}
    n_y = {0: d("n00") + d("n10"), 1: d("n01") + d("n11")}
    wcols = {f"w{g}{y}": safe_div(n_g[g] * n_y[y], total * d(f"n{g}{y}")) for g in (0, 1) for y in (0, 1)}
    wide = cells.withColumns(wcols)
    stack = ", ".join(f"{g}, {y}, n{g}{y}, w{g}{y}" for g in (0, 1) for y in (0, 1))
    long = wide.selectExpr(*[f"`{b}`" for b in by], "attribute", f"stack(4, {stack}) as (g, y, n, weight)")
    return long.filter(F.col("n") > 0)


def reweigh_weights(df: DataFrame, attributes: Iterable[str], label: str = "approved",
                    by: Iterable[str] = ()) -> DataFrame:
    """M1 fit: (by..., attribute, g, y) -> n, weight = N_g N_y / (N N_gy).
    At most 4 rows per (by, attribute); a cell with no rows has no weight
    (and no row needs one). One pass over the rows (the contingency)."""
    by = list(by)
    return weights_from_contingency(contingency(df, attributes, label=label, decision=None, by=by), by)


def apply_weights(df: DataFrame, weights: DataFrame, attribute: str, label: str = "approved",
                  by: Iterable[str] = (), out: str = "weight") -> DataFrame:
    """M1 transform: each row gets the weight of its (group, label) cell for
    ``attribute``. The fitted table has at most 4 rows per ``by`` value; it is
    joined on its typed keys (null ``by`` values match each other), broadcast
    behind a check of its size."""
    from equiloan.operators.compose import broadcast_if_small

    by = list(by)
    w = (weights.filter(F.col("attribute") == F.lit(attribute))
         .select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("g").alias("_g"), F.col("y").alias("_y"),
                 F.col("weight").alias("_weight")))
    cond = (F.col(attribute).cast("int") == F.col("_g")) & (F.col(label).cast("int") == F.col("_y"))
    for i, b in enumerate(by):
        cond = cond & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    joined = df.drop(out).join(broadcast_if_small(w), cond, "left")
    return joined.select(*[F.col(c) for c in df.columns if c != out], F.col("_weight").alias(out))


def weighted_contingency(ct: DataFrame, weights: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """G10 support: contingency cells with w = n * weight of the (g, y) cell;
    equal to summing per-row weights, at the cost of a join of two tiny tables."""
    by = list(by)
    j = ct.drop("w").join(weights.select(*by, "attribute", "g", "y", "weight"),
                          [*by, "attribute", "g", "y"], "left")
    return j.withColumn("w", F.col("n").cast("double") * F.col("weight")).drop("weight")


def reweigh_report(df: DataFrame, attributes: Iterable[str], label: str = "approved",
                   by: Iterable[str] = ()) -> DataFrame:
    """M2: parity difference, disparate impact and mean difference of the
    labels before and after reweighing, per (by..., attribute). One
    contingency job; the weights are fitted on the same rows (so the
    reweighed values are 0, 1, 0)."""
    from equiloan.operators.parity import parity_metrics

    by = list(by)
    ct = contingency(df, attributes, label=label, decision=None, by=by)
    weights = weights_from_contingency(ct, by)
    part = [*by, "attribute"]
    before = parity_metrics(ct, by=by)
    after = parity_metrics(weighted_contingency(ct, weights, by), by=by, weighted=True)
    keep = ["statistical_parity_difference", "disparate_impact", "mean_difference"]
    b = before.select(*part, "n_unprivileged", "n_privileged", *keep)
    a = after.select(*part, *[F.col(k).alias(f"{k}_reweighed") for k in keep])
    return b.join(a, part, "inner")


# --- M3, M4: distribution repair ---------------------------------------------

def _feature_long(df: DataFrame, features: list[str], attribute: str) -> DataFrame:
    return (df.select(F.col(attribute).cast("int").alias("g"), *[F.col(f).cast("double").alias(f) for f in features])
            .unpivot(ids=["g"], values=features, variableColumnName="feature", valueColumnName="value")
            .filter(F.col("g").isNotNull() & F.col("value").isNotNull()))


def repair_edges(df: DataFrame, features: Iterable[str], attributes: Iterable[str] | str,
                 max_buckets: int | None = None, coarse_buckets: int | None = None) -> DataFrame:
    """M3 fit: one row per (attribute, g) with, for every feature, the upper
    edges of the group's quantile buckets (``hi_<f>``) and the bucket's
    median-distribution value (``mid_<f>``). A value's bucket is monotone in the value within its group,
    so the edges say everything the repair needs. With more than
    ``ARRAY_EDGES`` buckets in some feature: one row per (feature, value) with
    ``mid``, for every attribute its targets ``m0`` and ``m1`` in either group
    (null where the feature stays as it is) and the groups that have it, ``seen``.
    The resolution of the quantiles is the smaller group's size; a
    ``max_buckets`` below that gives a coarser repair."""
    features = list(features)
    attributes = [attributes] if isinstance(attributes, str) else list(attributes)
    keys = ["attribute", "feature", "g"]
    # The only pass over the rows: one row per (feature, distinct value) with
    # a count per (attribute, group) - the attributes are 0/1 flags, so this
    # is len(attributes) times fewer rows to shuffle and sort than one row
    # per (attribute, group, value).
    cells = [(a, g) for a in attributes for g in (0, 1)]
    base = df.select(*[F.col(a).cast("int").alias(a) for a in attributes],
                     *[F.col(f).cast("double").alias(f) for f in features])
    by_value = (base.unpivot(ids=attributes, values=features, variableColumnName="feature", valueColumnName="value")
                .filter(F.col("value").isNotNull()))
    features_rows, wide_rows = materialize_counted(by_value.groupBy("feature", "value").agg(
        *[F.count_if(F.col(a) == F.lit(g)).alias(f"c{i}") for i, (a, g) in enumerate(cells)]), "repair-dist")
    # One row a feature.
    found = {r["feature"]: r for r in features_rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(f"c{i}").alias(f"c{i}") for i in range(len(cells))]).collect()}
    most = max((min(r["n"], _resolution([r[f"c{2 * i}"], r[f"c{2 * i + 1}"]], max_buckets))
                for r in found.values() for i in range(len(attributes))), default=0)
    if most > ARRAY_EDGES:
        sizes = {f: [r[f"c{i}"] for i in range(len(cells))] for f, r in found.items()}
        return _values_by_block(features_rows, wide_rows, attributes, sizes, max_buckets)
    if coarse_buckets is None and max((r["n"] for r in found.values()), default=0) <= GROUP_VALUES:
        return _edges_by_group(features_rows, features, attributes, max_buckets)
    buckets = coarse_buckets if coarse_buckets is not None else buckets_for(wide_rows)
    wide = range_buckets(features_rows, ["feature"], "value", buckets)
    wcum = running_total(wide, ["feature"], "value", [f"c{i}" for i in range(len(cells))], buckets=buckets)
    stack = ", ".join(f"'{a}', {g}, c{i}, cum_c{i}" for i, (a, g) in enumerate(cells))
    cum = (wcum.selectExpr("feature", "value", f"stack({len(cells)}, {stack}) as (attribute, g, n, cum_n)")
           .filter(F.col("n") > 0))
    tot = wide.selectExpr("feature", f"stack({len(cells)}, " + ", ".join(
        f"'{a}', {g}, c{i}" for i, (a, g) in enumerate(cells)) + ") as (attribute, g, n)") \
        .groupBy(*keys).agg(F.sum("n").alias("ng")).filter(F.col("ng") > 0)
    bound = F.min("ng") if max_buckets is None else F.least(F.lit(max_buckets).cast("long"), F.min("ng"))
    per_feature = tot.groupBy("attribute", "feature").agg(bound.alias("bb"), F.count(F.lit(1)).alias("ngroups"))
    # At most 2 x attributes x features rows.
    sizes = materialize(tot.join(per_feature, ["attribute", "feature"], "inner"), "repair-sizes")
    u = safe_div(F.col("cum_n").cast("double") - F.col("n").cast("double") / F.lit(2.0), F.col("ng").cast("double"))
    b = F.least(F.floor(u * F.col("bb").cast("double")), F.col("bb") - F.lit(1)).cast("long")
    ub = materialize(cum.join(F.broadcast(sizes), keys, "inner").withColumn("b", b)
                     .select(*keys, "value", "n", "b", "ngroups"), "repair-ranks")
    means = ub.groupBy(*keys, "b").agg(
        safe_div(F.sum(F.col("value") * F.col("n").cast("double")), F.sum(F.col("n")).cast("double")).alias("m"))
    mid = _filled(sizes, means, keys).groupBy("attribute", "feature", "b").agg(F.avg("mf").alias("mid"))
    edges = (ub.filter(F.col("ngroups") >= 2).groupBy(*keys, "b").agg(F.max("value").alias("hi"))
             .join(mid, ["attribute", "feature", "b"], "inner")
             .groupBy("attribute", "g", "feature")
             .agg(F.sort_array(F.collect_list(F.struct("b", "hi", "mid"))).alias("e")))
    return _wide_edges(edges.select("attribute", "g", "feature", F.col("e.hi").alias("hi"), F.col("e.mid").alias("mid")),
                       features)


def _wide_edges(edges: DataFrame, features: list[str]) -> DataFrame:
    pick = lambda f, c: F.first(F.when(F.col("feature") == F.lit(f), F.col(c)), ignorenulls=True)
    wide = edges.groupBy("attribute", "g").agg(
        *[pick(f, c).alias(f"{c}_{i}") for i, f in enumerate(features) for c in ("hi", "mid")])
    return materialize(wide, "repair-edges")


#: Up to so many edges per feature and group are handed on as arrays (17 bytes
#: each, for two groups, are broadcast: at most 51 MB for six features and an
#: attribute); more are joined by value.
ARRAY_EDGES = 250_000
#: Buckets are filled in runs of so many, one task each.
FILL_RUN = 100_000
#: Up to so many distinct values, a feature's buckets for one attribute are
#: fitted in one task (about 200 bytes a value there).
GROUP_VALUES = 1_000_000


def _resolution(sizes: Iterable[int], max_buckets: int | None) -> int:
    """Buckets of a feature: the smaller group's size, at most ``max_buckets``."""
    least = min((int(n) for n in sizes if n), default=0)
    return least if max_buckets is None else min(least, max_buckets)


def _bucket_of(n: np.ndarray, before: int, total: int, buckets: int) -> np.ndarray:
    """The buckets of ascending values of a group, from their counts, the rows
    before them and the rows in all."""
    u = (before + np.cumsum(n) - n / 2.0) / float(total)
    return np.minimum(np.floor(u * float(buckets)), buckets - 1).astype(np.int64)


def _group_buckets(value: np.ndarray, counts: np.ndarray, max_buckets: int | None):
    """For each of the groups 0 and 1 that has values: (g, values ascending,
    the target of each, whether it is the last of its bucket), from the
    distinct values and their counts (group, value). Targets are None where
    the feature stays as it is. Buckets that neither group fills are not held."""
    order = np.argsort(value, kind="stable")  # unknown numbers last
    value, counts = value[order], counts[:, order]
    groups = [g for g in (0, 1) if counts[g].any()]
    buckets = _resolution(counts.sum(axis=1).tolist(), max_buckets)
    found = []
    for g in groups:
        held = np.flatnonzero(counts[g])
        x, n = value[held], counts[g][held]
        b = _bucket_of(n, 0, n.sum(), buckets)
        first = np.concatenate(([True], b[1:] != b[:-1]))
        place = np.cumsum(first) - 1
        with np.errstate(invalid="ignore"):
            mean = np.bincount(place, x * n) / np.bincount(place, n)
        found.append((g, x, b[first], place, mean))
    for k, (g, x, b, place, mean) in enumerate(found):
        mid = None
        if len(found) > 1:
            _, _, other, _, other_mean = found[1 - k]
            # An empty bucket takes the mean before it, a leading one that after it.
            with np.errstate(invalid="ignore"):
                mid = ((mean + other_mean[np.maximum(np.searchsorted(other, b, "right") - 1, 0)]) / 2.0)[place]
        yield g, x, mid, np.concatenate((place[1:] != place[:-1], [True]))


def _edges_by_group(counts: DataFrame, features: list[str], attributes: list[str], max_buckets: int | None) -> DataFrame:
    """``repair_edges`` from the counts of every (feature, value), one task an
    (attribute, feature)."""
    ship_package(counts.sparkSession)
    stack = ", ".join(f"'{a}', c{2 * i}, c{2 * i + 1}" for i, a in enumerate(attributes))
    long = counts.selectExpr("feature", "value", f"stack({len(attributes)}, {stack}) as (attribute, n0, n1)").filter(
        F.col("n0") + F.col("n1") > 0)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        parts = []
        for g, x, mid, last in _group_buckets(column("value"), np.stack([column("n0"), column("n1")]), max_buckets):
            if mid is not None:
                parts.append(pa.table({"attribute": pa.repeat(key[0], 1), "feature": pa.repeat(key[1], 1),
                                       "g": pa.repeat(pa.scalar(g, pa.int32()), 1),
                                       "hi": pa.array([x[last]], pa.list_(pa.float64())),
                                       "mid": pa.array([mid[last]], pa.list_(pa.float64()))}))
        return pa.concat_tables(parts) if parts else _NO_EDGES

    return _wide_edges(long.groupBy("attribute", "feature").applyInArrow(
        fit, "attribute string, feature string, g int, hi array<double>, mid array<double>"), features)


_NO_EDGES = pa.schema([("attribute", pa.string()), ("feature", pa.string()), ("g", pa.int32()),
                       ("hi", pa.list_(pa.float64())), ("mid", pa.list_(pa.float64()))]).empty_table()


#: Distinct values of a block.
BLOCK_VALUES = 100_000
_BLOCK = "feature string, part int, value binary, n binary, totals array<long>"
_BLOCK_ARROW = pa.schema([("feature", pa.string()), ("part", pa.int32()), ("value", pa.binary()), ("n", pa.binary()),
                          ("totals", pa.list_(pa.int64()))])
#: What a block knows of the buckets of a run, for one attribute and group.
_SUMS = "attribute int, feature string, run long, part int, g int, b binary, total binary, n binary"
_SUMS_ARROW = pa.schema([("attribute", pa.int32()), ("feature", pa.string()), ("run", pa.int64()), ("part", pa.int32()),
                         ("g", pa.int32()), ("b", pa.binary()), ("total", pa.binary()), ("n", pa.binary())])
#: The buckets of a run: both groups' means, the first and the last of them, and
#: the blocks they come from (part, g, first bucket, end).
_MEANS = ("attribute int, feature string, run long, b0 binary, m0 binary, b1 binary, m1 binary, first0 double, last0 double, "
          "first1 double, last1 double, blocks binary")
_MIDS = "feature string, part int, attribute int, g int, run long, mid binary"
_MIDS_ARROW = pa.schema([("feature", pa.string()), ("part", pa.int32()), ("attribute", pa.int32()), ("g", pa.int32()),
                         ("run", pa.int64()), ("mid", pa.binary())])


def _pack_counts(batches: Iterable[pa.RecordBatch], cells: int) -> Iterable[pa.RecordBatch]:
    """A row per feature from a range of (feature, value): values ascending and
    their counts, as few bytes each as hold them."""
    batches = [b for b in batches if b.num_rows]
    table = pa.Table.from_batches(batches) if batches else None
    for feature in pc.unique(table.column("feature")).to_pylist() if batches else ():
        own = table.filter(pc.equal(table.column("feature"), feature))
        value = own.column("value").to_numpy()
        order = np.argsort(value, kind="stable")  # unknown numbers last
        n = np.stack([own.column(f"c{i}").to_numpy()[order] for i in range(cells)])
        kind = np.min_scalar_type(int(n.max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
            (feature, TaskContext.get().partitionId(), value[order].tobytes(), n.astype(kind).tobytes(), n.sum(axis=1).tolist()),
            _BLOCK_ARROW.types, strict=True)], schema=_BLOCK_ARROW)


def _block_buckets(value: bytes, n: bytes, before: list[int], sizes: list[int], buckets: list[int]):
    """(attribute, group, places of the group's values in the block, their
    counts, bucket of each, where a new bucket begins); attributes that leave
    the feature as it is have no buckets."""
    counts = np.frombuffer(n, f"u{len(n) // (len(sizes) * (len(value) // 8))}").reshape(len(sizes), -1)
    for cell, row in enumerate(counts):
        held = np.flatnonzero(row)
        if len(held) and buckets[cell // 2]:
            k = row[held].astype(np.int64)
            b = _bucket_of(k, before[cell], sizes[cell], buckets[cell // 2])
            yield cell // 2, cell % 2, held, k, b, np.concatenate(([True], b[1:] != b[:-1]))


def _values_by_block(counts: DataFrame, rows: int, attributes: list[str], sizes: dict[str, list[int]],
                     max_buckets: int | None) -> DataFrame:
    """``repair_edges`` by value: a block of sorted values knows, with the rows
    before it, the bucket of each value; the sums of the buckets meet in runs of
    ``FILL_RUN`` buckets, which give their targets back to the blocks. All of it
    travels packed, and the driver holds a few numbers a block and a run."""
    spark, run_size = counts.sparkSession, FILL_RUN
    sc = spark.sparkContext
    ship_package(spark)
    cells = 2 * len(attributes)
    blocks = materialize(counts.repartitionByRange(buckets_for(rows, BLOCK_VALUES), "feature", "value").mapInArrow(
        lambda batches: _pack_counts(batches, cells), _BLOCK), "repair-blocks")
    before: dict[tuple[str, int], list[int]] = {}
    done = {f: [0] * cells for f in sizes}
    for r in sorted(blocks.select("feature", "part", "totals").collect(), key=lambda r: (r["feature"], r["part"])):
        before[r["feature"], r["part"]] = done[r["feature"]]
        done[r["feature"]] = [a + b for a, b in zip(done[r["feature"]], r["totals"], strict=True)]
    buckets = {f: [_resolution(n[2 * i:2 * i + 2], max_buckets) if all(n[2 * i:2 * i + 2]) else 0 for i in range(len(attributes))]
               for f, n in sizes.items()}
    sent = sc.broadcast((before, sizes, buckets))

    def sums(batches):
        before, sizes, buckets = sent.value
        for row in (r for batch in batches for r in batch.to_pylist()):
            f, part, out = row["feature"], row["part"], []
            x = np.frombuffer(row["value"], np.float64)
            for a, g, held, k, b, first in _block_buckets(row["value"], row["n"], before[f, part], sizes[f], buckets[f]):
                # The first bucket may go on from the block before: its values are
                # added one by one, in the order of one block.
                apart = first | (b == b[0])
                place, own = np.cumsum(apart) - 1, b[apart]
                with np.errstate(invalid="ignore"):
                    total = np.bincount(place, x[held] * k)
                n, run = np.bincount(place, k), own // run_size
                cuts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True])))
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    out.append((a, f, int(run[lo]), part, g, *(v[lo:hi].tobytes() for v in (
                        (own - run * run_size).astype(np.uint32), total, n))))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                zip(*out, strict=True) if out else [[]] * len(_SUMS_ARROW), _SUMS_ARROW.types, strict=True)], schema=_SUMS_ARROW)

    def means(key: tuple, table: pa.Table) -> pa.Table:
        out, places = {"attribute": key[0].as_py(), "feature": key[1].as_py(), "run": key[2].as_py()}, []
        parts = table.sort_by("part").to_pylist()
        for g in (0, 1):
            own = [r for r in parts if r["g"] == g]
            read = lambda c, kind: np.frombuffer(b"".join(r[c] for r in own), kind)  # noqa: E731, B023
            b, place = np.unique(read("b", np.uint32), return_inverse=True)
            # Values of a bucket may lie in two blocks or more.
            with np.errstate(invalid="ignore"):
                mean = np.bincount(place, read("total", np.float64)) / np.bincount(place, read("n", np.float64))
            out |= {f"b{g}": b.tobytes(), f"m{g}": mean.tobytes(), f"first{g}": mean[0] if len(b) else None,
                    f"last{g}": mean[-1] if len(b) else None}
            at = 0
            for r in own:
                n = len(r["b"]) // 4
                places.append((r["part"], g, place[at], place[at + n - 1] + 1))
                at += n
        return pa.Table.from_pylist([out | {"blocks": np.array(places, np.int64).tobytes()}], schema=pa.schema(
            [(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
                             "double": pa.float64()}[c.split()[1]]) for c in _MEANS.split(", ")]))

    runs = materialize(blocks.mapInArrow(sums, _SUMS).groupBy("attribute", "feature", "run").applyInArrow(means, _MEANS),
                       "repair-means")
    # The mean that an empty bucket takes from the runs before; leading ones take the first of all.
    carried: dict[tuple, tuple] = {}
    last: dict[tuple, list] = {}
    edges = sorted(runs.drop("b0", "m0", "b1", "m1", "blocks").collect(), key=lambda r: (r["attribute"], r["feature"], r["run"]))
    for r in reversed(edges):
        first = last.setdefault((r["attribute"], r["feature"]), [None, None])
        last[r["attribute"], r["feature"]] = [first[g] if r[f"first{g}"] is None else r[f"first{g}"] for g in (0, 1)]
    for r in edges:
        held = last[r["attribute"], r["feature"]]
        carried[r["attribute"], r["feature"], r["run"]] = tuple(held)
        last[r["attribute"], r["feature"]] = [held[g] if r[f"last{g}"] is None else r[f"last{g}"] for g in (0, 1)]
    carry = sc.broadcast(carried)

    def mids(batches):
        for row in (r for batch in batches for r in batch.to_pylist()):
            b = [np.frombuffer(row[f"b{g}"], np.uint32) for g in (0, 1)]
            m = [np.frombuffer(row[f"m{g}"], np.float64) for g in (0, 1)]
            out, mid = [], []
            for g in (0, 1):
                other = np.concatenate(([carry.value[row["attribute"], row["feature"], row["run"]][1 - g]], m[1 - g]))
                mid.append((m[g] + other[np.searchsorted(b[1 - g], b[g], "right")]) / 2.0)
            for part, g, lo, hi in np.frombuffer(row["blocks"], np.int64).reshape(-1, 4).tolist():
                out.append((row["feature"], part, row["attribute"], g, row["run"], mid[g][lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), _MIDS_ARROW.types,
                                                                               strict=True)], schema=_MIDS_ARROW)

    kinds = pa.struct([("seen", pa.int8()), ("m0", pa.float64()), ("m1", pa.float64())])
    out_schema = pa.schema([("feature", pa.string()), ("value", pa.float64()), ("mid", pa.struct([(a, kinds) for a in attributes]))])

    def values(key: tuple, block: pa.Table, targets: pa.Table) -> pa.Table:
        before, sizes, buckets = sent.value
        f, row = key[0].as_py(), block.to_pylist()[0]
        x = np.frombuffer(row["value"], np.float64)
        counts = np.frombuffer(row["n"], f"u{len(row['n']) // (cells * len(x))}").reshape(cells, -1)
        given: dict[tuple[int, int], list[bytes]] = {}
        for r in targets.sort_by("run").to_pylist():
            given.setdefault((r["attribute"], r["g"]), []).append(r["mid"])
        found = {}
        for a, g, held, _, _, first in _block_buckets(row["value"], row["n"], before[f, row["part"]], sizes[f], buckets[f]):
            full, empty = np.zeros(len(x)), np.ones(len(x), bool)
            full[held] = np.frombuffer(b"".join(given[a, g]), np.float64)[np.cumsum(first) - 1]
            empty[held] = False
            found[a, g] = pa.array(full, mask=empty)
        none = pa.nulls(len(x), pa.float64())
        structs = [pa.StructArray.from_arrays(
            [pa.array(((counts[2 * i] > 0) + 2 * (counts[2 * i + 1] > 0)).astype(np.int8)), found.get((i, 0), none),
             found.get((i, 1), none)], ["seen", "m0", "m1"]) for i in range(len(attributes))]
        return pa.table([pa.repeat(pa.scalar(f), len(x)), pa.array(x), pa.StructArray.from_arrays(structs, attributes)],
                        schema=out_schema)

    mid = ", ".join(f"`{a}`: struct<seen: tinyint, m0: double, m1: double>" for a in attributes)
    table = materialize(blocks.groupBy("feature", "part").cogroup(runs.mapInArrow(mids, _MIDS).groupBy("feature", "part"))
                        .applyInArrow(values, f"feature string, value double, mid struct<{mid}>"), "repair-values")
    for used in (blocks, runs):
        discard(used)
    return table


def _filled(sizes: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, b, mf) for every bucket: its mean, an empty bucket's from the
    previous one, a leading one's from the next. Each run of ``FILL_RUN``
    buckets is filled on its own and takes over the last mean before it."""
    run = F.floor(F.col("b") / F.lit(FILL_RUN)).cast("long")
    last = F.col("bb") - F.lit(1)
    runs = sizes.select(*keys, "bb", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / F.lit(FILL_RUN))))
                        .alias("run"))
    of_run = means.withColumn("run", run).groupBy(*keys, "run").agg(F.max_by("m", "b").alias("m_last"))
    first = means.groupBy(*keys).agg(F.min_by("m", "b").alias("m_first"))
    before = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = (runs.join(of_run, [*keys, "run"], "left").join(first, keys, "left")
               .select(*keys, "bb", "run",
                       F.coalesce(F.last("m_last", ignorenulls=True).over(before), "m_first").alias("carry")))
    start = F.col("run") * F.lit(FILL_RUN)
    grid = carried.select(*keys, "run", "carry", F.explode(
        F.sequence(start, F.least(last, start + F.lit(FILL_RUN - 1)))).alias("b"))
    w = Window.partitionBy(*keys, "run").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(means, [*keys, "b"], "left").select(
        *keys, "b", F.coalesce(F.last("m", ignorenulls=True).over(w), F.col("carry")).alias("mf"))


def _lookup(edges: DataFrame, n: int, attribute: str, level: float):
    """A function of struct(g, x0, x1, ...) that gives struct(x0, x1, ...) with
    the repaired values of the n features, batch by batch: the edges below a
    value are counted by a binary search. The edges go to the workers once
    and never beside a row."""
    held: dict[int, list] = {}
    for r in edges.filter(F.col("attribute") == F.lit(attribute)).toArrow().combine_chunks().to_batches():
        for k, g in enumerate(r.column("g").to_pylist()):
            each = [(r.column(f"hi_{i}")[k].values, r.column(f"mid_{i}")[k].values) for i in range(n)]
            held[g] = [None if hi is None else (hi.to_numpy(zero_copy_only=False), mid.to_numpy(zero_copy_only=False),
                                                mid.is_null().to_numpy(zero_copy_only=False)) for hi, mid in each]
    sent, lam = edges.sparkSession.sparkContext.broadcast(held), float(level)
    names = [f"x{i}" for i in range(n)]

    def look_up(rows: pa.Array) -> pa.Array:
        g, out = rows.field("g").to_numpy(zero_copy_only=False), []
        for i, name in enumerate(names):
            x, unknown = (v.to_numpy(zero_copy_only=False).copy() for v in (rows.field(name), rows.field(name).is_null()))
            known = ~unknown
            for group, arrays in sent.value.items():
                if arrays[i] is not None:
                    hi, mid, empty = arrays[i]
                    live = np.flatnonzero(known & (g == group))
                    at = np.minimum(np.searchsorted(hi, x[live]), len(hi) - 1)
                    with np.errstate(invalid="ignore"):
                        x[live] = (1.0 - lam) * x[live] + lam * mid[at]
                    unknown[live] = empty[at]
            out.append(pa.array(x, pa.float64(), mask=unknown))
        return pa.StructArray.from_arrays(out, names)

    return F.arrow_udf(look_up, ", ".join(f"{x} double" for x in names))


def repaired_columns(df: DataFrame, edges: DataFrame, features: Iterable[str], attribute: str, level: float = 1.0,
                     names: dict[str, str] | None = None) -> DataFrame:
    """M3 transform: features (or new columns, given ``names``) with their
    repaired values for ``attribute``: a lookup in the group's edges, which
    every worker holds, so the rows are not shuffled; or, with more edges than arrays hold, one join per feature on the value."""
    features = list(features)
    names = names or {f: f for f in features}
    if "mid" in edges.columns:
        return _repaired_by_value(df, edges, features, level, {attribute: names})
    rows = F.struct(F.col(attribute).cast("int").alias("g"),
                    *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    found = df.withColumn("_repaired", _lookup(edges, len(features), attribute, level)(rows))
    return found.withColumns({names[f]: F.col("_repaired")[f"x{i}"] for i, f in enumerate(features)}).drop("_repaired")


def repaired_attributes(df: DataFrame, edges: DataFrame, features: Iterable[str], names: dict[str, dict[str, str]],
                        level: float = 1.0) -> DataFrame:
    """``repaired_columns`` for several attributes, as new columns:
    ``names[attribute][feature]``. With an edge table by value the rows are
    joined once per feature for all of them."""
    features = list(features)
    if "mid" in edges.columns:
        return _repaired_by_value(df, edges, features, level, names)
    for a in names:
        df = repaired_columns(df, edges, features, a, level, names[a])
    return df


def _repaired_by_value(df: DataFrame, values: DataFrame, features: list[str], level: float,
                       names: dict[str, dict[str, str]]) -> DataFrame:
    """``repaired_attributes`` by a join on the value, one per feature. A value
    that the fit did not see in the row's group raises."""
    joined, lam = df, F.lit(float(level))
    for i, f in enumerate(features):
        x, new = F.col(f).cast("double"), {}
        t = values.filter(F.col("feature") == F.lit(f)).select(
            F.col("value").alias(f"_v{i}"), F.struct(*[F.col("mid").getField(a).alias(a) for a in names]).alias(f"_m{i}"))
        joined = joined.join(t, x == F.col(f"_v{i}"), "left")
        for a in names:
            g, m = F.col(a).cast("int"), F.col(f"_m{i}").getField(a)
            seen = m.getField("seen").cast("int").bitwiseAND(F.when(g == 0, F.lit(1)).otherwise(F.lit(2))) > 0
            unseen = x.isNotNull() & g.isin(0, 1) & ~F.coalesce(seen, F.lit(False))
            at = F.when(unseen, F.raise_error(F.lit(f"{f}: a value that the repair was not fitted on")).cast("double")) \
                .when(g == 0, m.getField("m0")).when(g == 1, m.getField("m1"))
            new[names[a][f]] = F.when(at.isNull(), x).otherwise((F.lit(1.0) - lam) * x + lam * at)
        joined = joined.withColumns(new).drop(f"_v{i}", f"_m{i}")
    new = [names[a][f] for a in names for f in features]
    return joined.select(*[F.col(f"`{c}`") for c in [*df.columns, *[c for c in new if c not in df.columns]]])


def repair_disparate_impact(df: DataFrame, features: Iterable[str], attribute: str, level: float = 1.0,
                            max_buckets: int | None = None, coarse_buckets: int | None = None) -> DataFrame:
    """M3: replace each feature by its repaired value; labels untouched. A
    missing value, a row without group, and features of which one group has no
    value stay as they are."""
    features = list(features)
    return repaired_columns(df, repair_edges(df, features, attribute, max_buckets, coarse_buckets), features, attribute,
                            level)


def group_gap(df: DataFrame, features: Iterable[str], attribute: str, coarse_buckets: int | None = None) -> DataFrame:
    """M4 support: per feature, the mean of each group and the two-sample
    Kolmogorov-Smirnov distance max_v |F_0(v) - F_1(v)| (exact, distributed)."""
    features = list(features)
    long = _feature_long(df, features, attribute)
    means = long.groupBy("feature").agg(
        F.avg(F.when(F.col("g") == 0, F.col("value"))).alias("mean_unprivileged"),
        F.avg(F.when(F.col("g") == 1, F.col("value"))).alias("mean_privileged"))
    dist, rows = materialize_counted(long.groupBy("feature", "value").agg(
        F.count_if(F.col("g") == 0).alias("n0"), F.count_if(F.col("g") == 1).alias("n1")), "gap-dist")
    buckets = coarse_buckets if coarse_buckets is not None else buckets_for(rows)
    dist = range_buckets(dist, ["feature"], "value", buckets)
    cum = running_total(dist, ["feature"], "value", ["n0", "n1"], buckets=buckets)
    tot = dist.groupBy("feature").agg(F.sum("n0").alias("tot0"), F.sum("n1").alias("tot1"))
    gap = F.abs(safe_div(F.col("cum_n0").cast("double"), F.col("tot0").cast("double"))
                - safe_div(F.col("cum_n1").cast("double"), F.col("tot1").cast("double")))
    ks = cum.join(tot, "feature", "inner").groupBy("feature").agg(F.max(gap).alias("ks_distance"))
    return means.join(ks, "feature", "inner")


def repair_report(df: DataFrame, repaired: DataFrame, features: Iterable[str], attribute: str,
                  label: str = "approved") -> DataFrame:
    """M4: label parity before and after repair (repair leaves labels alone,
    so they are equal) and the feature gap (group means, KS) before and after."""
    from equiloan.operators.parity import label_metrics

    features = list(features)
    before = group_gap(df, features, attribute)
    after = group_gap(repaired, features, attribute)
    lb = label_metrics(df, [attribute], label).select(F.col("statistical_parity_difference").alias("spd_before"))
    la = label_metrics(repaired, [attribute], label).select(F.col("statistical_parity_difference").alias("spd_after"))
    b = before.select("feature", *[round6(c).alias(f"{c}_before") for c in
                                   ["mean_unprivileged", "mean_privileged", "ks_distance"]])
    a = after.select("feature", *[round6(c).alias(f"{c}_after") for c in
                                  ["mean_unprivileged", "mean_privileged", "ks_distance"]])
    rep = b.join(a, "feature", "inner")
    # The label parity is one value per attribute: attach it as literals
    # from a one-row aggregate (a 1-row result, fetched once).
    s_b = lb.first()[0]
    s_a = la.first()[0]
    return rep.withColumn("attribute", F.lit(attribute)) \
        .withColumn("spd_before", F.lit(s_b).cast("double")) \
        .withColumn("spd_after", F.lit(s_a).cast("double"))
