"""Side-by-side composition (J1-J5) as key joins, never by row position.

Rows carry ``application_id``; derived columns are added to the same frame
when they come from it (``withColumns``: no join at all) and joined on the key
when they come from another table (model predictions, a split).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Derived columns next to the source columns, without duplicating
    the predictors (one projection over the same rows)."""
    dup = [c for c in columns if c in df.columns]
    if dup:
        raise ValueError(f"columns already present: {dup}")
    return df.withColumns(columns)


def align_predictions(df: DataFrame, predictions: DataFrame, key: str = "application_id",
                      prediction: str = "prediction", out: str | None = None) -> DataFrame:
    """Attach one split's predictions to the whole table by key; rows
    outside the split get null (not a neighbour's prediction)."""
    p = predictions.select(key, F.col(prediction).alias(out or prediction))
    return df.join(p, key, "left")


def pivot_decisions(long: DataFrame, model_ids: list[str], key: str = "application_id",
                    model: str = "model_id", decision: str = "decision", prefix: str = "decision_") -> DataFrame:
    """J4 core: long predictions (key, model, decision) -> one column per
    model. The model list is given, so no extra pass collects it."""
    aggs = [F.max(F.when(F.col(model) == F.lit(m), F.col(decision))).alias(f"{prefix}{m}") for m in model_ids]
    return long.groupBy(key).agg(*aggs)


def attach_model_decisions(df: DataFrame, long: DataFrame, model_ids: list[str], key: str = "application_id",
                           model: str = "model_id", decision: str = "decision",
                           prefix: str = "decision_") -> DataFrame:
    """Pivot the long predictions on the known model ids and left-join
    them to the table on the key. The pivot leaves the predictions hash-
    partitioned by key, which the join reuses."""
    wide = pivot_decisions(long, model_ids, key, model, decision, prefix)
    return df.join(wide, key, "left")


def attach_packed_decisions(df: DataFrame, packed: DataFrame, model_ids: list[str], key: str = "application_id",
                            decisions: str = "decisions", prefix: str = "decision_") -> DataFrame:
    """J4 for many models: one key join with the packed decisions, whose
    array places become one column per model; no pivot, no long table."""
    wide = packed.select(key, *[F.get(decisions, F.lit(i)).alias(f"{prefix}{m}") for i, m in enumerate(model_ids)])
    return df.join(wide, key, "left")


def merge_result_tables(a: DataFrame, b: DataFrame, on: Iterable[str],
                        suffixes: tuple[str, str] = ("_rf", "_nn")) -> DataFrame:
    """Inner join of two result tables on shared key columns, every other
    column suffixed by its side. One join over all rows: no match can be lost
    across chunks."""
    on = list(on)
    sa = a.select(*on, *[F.col(c).alias(c + suffixes[0]) for c in a.columns if c not in on])
    sb = b.select(*on, *[F.col(c).alias(c + suffixes[1]) for c in b.columns if c not in on])
    return sa.join(sb, on, "inner")


BROADCAST_MAX_ROWS = 1_000_000


def broadcast_if_small(stats: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only behind a measured bound: the rows of ``stats`` are
    counted (up to ``max_rows + 1``) first; a larger table is left to the
    planner (shuffle join, AQE)."""
    n = stats.limit(max_rows + 1).count()
    return F.broadcast(stats) if n <= max_rows else stats


def attach_statistics(df: DataFrame, stats: DataFrame, on: Iterable[str],
                      max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Apply a small statistics table (weights, edges, per-group
    values) back to all rows by key, broadcast when its measured size allows,
    so the rows are not shuffled. Table-wide statistics (one row) are applied
    as literals by the fitting operators instead."""
    return df.join(broadcast_if_small(stats, max_rows), list(on), "left")
