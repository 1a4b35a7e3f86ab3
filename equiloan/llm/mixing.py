"""Mixing sources to target weights by pivotal dependent rounding (operator 9).

Every document gets an expected number of copies r = target / size of its
source. The whole part is taken as it is; the fractional parts are rounded
together, so that a source's total of taken words stays put while documents
are drawn at random:

- two documents with fractional parts a, b and sizes s, t trade words: one
  gains what the other loses, until one part is 0 or 1. Which way the words
  move is a coin whose bias keeps both expectations (the pivotal method, with
  mass in words);
- each task does this along its documents and hands on at most one
  undecided document per source; those meet in the next level of a reduction
  tree of fan-in ``fan``, until one is left per source, which a last coin
  decides. So a source's total is off its target by at most one document.

A source of any size is cut into blocks by a hash of id, text and number among
equal rows, so that neither null nor repeated ids gather in one block; blocks,
and tree levels, follow the measured number of rows. Coins are hashes of the
same three and the seed: reruns agree.

Sizes count words ``[^\\x20\\x09-\\x0D]+`` of whole texts, however long; null and
empty texts have size 0 and take nothing. A null source is a source of its own
and comes last. Rows that share a doc_id are rows of their own and can differ
in their copies; rows equal in id, text and source are numbered and
interchangeable. Ties cannot matter: nothing is ranked. An empty table gives an
empty result. Other columns are not read; ``mixed`` passes them through.
Targets: the
sources by code point weigh 1, 2, 3, repeating; each gets its share of all
words but never over ``limit`` times its own; what is cut off is shared out
again by weight (the level at which everything is placed is found in closed
form from the sources' running totals; the table has one row per source).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship, stash
from equiloan.llm.textops import chunks, texts, words

BLOCK_ROWS = 10_000
FAN = 64
_SIZES = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("mark", pa.int64()), ("size", pa.int64())])


def _sizes(batches):
    for batch in batches:
        docs = texts(batch)
        size = np.zeros(len(docs), np.int64)
        for a, b in chunks(docs):
            _, starts, _, owner = words(docs[a:b])
            size[a:b] = np.bincount(owner, minlength=b - a)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "source", "mark")), pa.array(size)],
            schema=_SIZES)


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark (a hash of the text), size (its words)."""
    ship(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.xxhash64("text").alias("mark"), "text")
            .mapInArrow(_sizes, "doc_id long, source string, mark long, size long"))


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """source, source_size, target. Water filling: with sources in order of
    limit * size / weight, those before the level are at their limit and the
    rest share what is left by weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows without a partition: the table has one row per source.
    rank = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    t = (per.withColumn("_w", w).withColumn("_cap", F.lit(float(limit)) * F.col("source_size"))
         .withColumn("_edge", F.col("_cap") / F.col("_w")))
    order = Window.orderBy("_edge", F.col("source").cast("binary").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = (t.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
         .withColumn("_rest", F.sum("_w").over(after))
         .withColumn("_total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_rest")))
    # The level of the first source whose own edge is not below it.
    level = F.min(F.when(F.col("_edge") >= F.col("_level"), F.struct("_edge", "_level"))).over(everything)
    t = t.withColumn("_at", level["_level"])
    return t.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_at"), F.lit(float("inf")))
                                                     * F.col("_w")).alias("target"))


def coin(a: int, b: int, seed: int) -> float:
    """Uniform in [0, 1) from two keys and the seed."""
    m = (1 << 64) - 1
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + (seed + 1) * 0x165667B19E3779F9) & m
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & m
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivot(keys: Sequence[int], parts: Sequence[float], sizes: Sequence[int], seed: int):
    """Sequential pivotal rounding with words as mass. Returns (decided:
    index -> 0 or 1, index of the undecided row or None, its part)."""
    decided: dict[int, int] = {}
    i, p = None, 0.0
    for j in range(len(keys)):
        q = parts[j]
        if q <= 1e-12 or q >= 1 - 1e-12:
            decided[j] = int(q > 0.5)
            continue
        if i is None:
            i, p = j, q
            continue
        s, t = sizes[i], sizes[j]
        up = min((1 - p) * s, q * t)      # words from j to i
        down = min(p * s, (1 - q) * t)    # words from i to j
        move = up if coin(keys[i], keys[j], seed) * (up + down) < down else -down
        p, q = p + move / s, q - move / t
        left_done = p <= 1e-12 or p >= 1 - 1e-12
        right_done = q <= 1e-12 or q >= 1 - 1e-12
        if left_done:
            decided[i] = int(p > 0.5)
        if right_done:
            decided[j] = int(q > 0.5)
        i, p = (j, q) if left_done and not right_done else (None, 0.0) if left_done else (i, p)
    return decided, i, p


def _level(seed: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("mark", "ascending"), ("copy", "ascending")])
        ids, mark, copy, part, size = (table.column(c).to_pylist() for c in ("doc_id", "mark", "copy", "part", "size"))
        keys = [((-1 if d is None else d) * 1_000_003 + c) ^ m for d, m, c in zip(ids, mark, copy, strict=True)]
        decided, open_row, p = pivot(keys, part, size, seed)
        extra = np.full(len(keys), -1, np.int64)
        for j, v in decided.items():
            extra[j] = v
        part = np.array(part, float)
        if open_row is not None:
            part[open_row] = p
            if last:
                extra[open_row] = int(coin(keys[open_row], 0, seed) < p)
        return pa.table({"doc_id": table.column("doc_id"), "mark": table.column("mark"), "copy": table.column("copy"), "part": part,
                         "size": table.column("size"), "extra": extra, "source": table.column("source"),
                         "block": table.column("block")})
    return run


_ROUND = "doc_id long, mark long, copy long, part double, size long, extra long, source string, block long"


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), limit: float = 3.0, seed: int = 7,
                fan: int = FAN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: doc_id, mark (a hash of its text), copy (its
    number among rows equal in id, text and source), source, size, source_size, target, taken (words), copies."""
    sized = stash(word_sizes(docs).withColumn("copy", _number()), "mix-sizes")
    goal = targets(sized, weights, limit).withColumnRenamed("source", "_source")
    if goal.count() <= 10_000:  # one row per source
        goal = F.broadcast(goal)
    ratio = F.when(F.col("size") > 0, F.try_divide("target", "source_size")).otherwise(F.lit(0.0))
    rows = (sized.join(goal, F.col("source").eqNullSafe(F.col("_source")), "inner").drop("_source")
            .withColumn("_ratio", ratio).withColumn("whole", F.floor("_ratio").cast("long"))
            .withColumn("part", F.col("_ratio") - F.col("whole")))
    blocks = max(1, -(-sized.count() // block_rows))
    level = rows.filter("part > 0").select(
        "doc_id", "mark", "copy", "part", "size", F.lit(-1).cast("long").alias("extra"), "source",
        F.pmod(F.xxhash64("doc_id", "mark", "copy"), F.lit(blocks)).cast("long").alias("block"))
    done = None
    while True:
        out = stash(level.groupBy("source", "block").applyInArrow(_level(seed, blocks == 1), _ROUND), "mix-level")
        decided = out.filter("extra >= 0").select(
            F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("copy").alias("_copy"),
            F.col("source").alias("_from"), "extra")
        done = decided if done is None else done.unionByName(decided)
        if blocks == 1:
            break
        blocks = -(-blocks // fan)
        level = out.filter("extra < 0").withColumn("block", F.col("block") % F.lit(blocks))
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    same = (F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
            & (F.col("copy") == F.col("_copy")) & F.col("source").eqNullSafe(F.col("_from")))
    return (rows.join(done, same, "left")
            .select("doc_id", "mark", "copy", "source", "size", "source_size", "target",
                    (copies * F.col("size")).alias("taken"), copies.alias("copies")))


def _number():
    return F.row_number().over(Window.partitionBy("doc_id", "mark", "source").orderBy("mark")).cast("long")


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), limit: float = 3.0, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them."""
    taken = (mix_sources(docs, weights, limit, seed).filter("copies > 0")
             .select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("copy").alias("_number"),
                     F.col("source").alias("_from"), F.col("copies").alias("_copies")))
    # Whole rows travel as one struct, so no column of theirs can clash.
    rows = (docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("mark"))
            .withColumn("copy", _number()))
    same = (F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
            & (F.col("copy") == F.col("_number")) & F.col("source").eqNullSafe(F.col("_from")))
    return (rows.join(taken, same)
            .select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("doc.*"))
