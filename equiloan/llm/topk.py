"""Exact top-k inner-product search by columnar branch and bound (operator 2).

Vectors become whole numbers floor(scale * x). Queries and candidates are cut
into bounded blocks, every pair of a query block and a candidate block meets
in one group (a block grid: nothing unbounded is broadcast or gathered), and a
group works on the candidates in vertical layout, one row per dimension:

- scores grow dimension block by dimension block, dimensions of large
  spread first;
- after each block a candidate survives only if its partial score plus the
  most the remaining dimensions can add (the product of the remaining masses
  of query and candidate, Cauchy-Schwarz) reaches the k-th best score known
  for the query; survivors are compacted before the next block;
- the k-th best score starts from exact scores of the candidates with the
  best partial scores, which belong to the block and so may be counted on.

Each group hands on its best k per query; a last ranking per query merges
groups, by score and then by the smaller id. All arithmetic is exact: whole
numbers below 2^53 in doubles (bounds are rounded away from pruning), and
Python integers for a group with larger ones (a score beyond a long is given as
the nearest long).

Null vectors and vectors holding a null or non-finite component take no part.
Vectors of different lengths meet on the components they share, missing ones
count 0. A query never meets a row with its own id. Rows that share an id are
candidates of their own (the better one ranks first, further order between
equal rows is immaterial); a query id that occurs on several rows is asked
with each of them and the results are merged. A query with fewer than k
candidates gets all of them. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship, stash

QUERY_BLOCK = 1024
ROW_BLOCK = 16384
DIMENSION_BLOCK = 16

_VECTOR = "vec_id long, v binary"


def _whole(scale: int):
    """floor(scale * x) of valid vectors, as little-endian doubles."""
    def run(batches):
        for batch in batches:
            ids, out = [], []
            col = batch.column(batch.schema.get_field_index("embedding"))
            values = col.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(values * scale)
            fine = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            edges = col.offsets.to_numpy()
            for i, a, b, there in zip(batch.column(batch.schema.get_field_index("vec_id")).to_pylist(), edges[:-1],
                                      edges[1:], col.is_valid().to_pylist(), strict=True):
                if there and i is not None and fine[b] == fine[a]:
                    ids.append(i)
                    out.append(values[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())],
                                             names=["vec_id", "v"])
    return run


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    rows = [np.frombuffer(b, np.float64) for b in table.column("v").to_pylist()]
    if all(len(r) == dims for r in rows):
        return np.stack(rows) if rows else np.zeros((0, dims))
    out = np.zeros((len(rows), dims))
    for o, r in zip(out, rows, strict=True):
        o[: len(r)] = r
    return out


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int,
           width: int = DIMENSION_BLOCK):
    """(query index, row index, score) of each query's k best rows, by branch
    and bound. ``queries`` and ``rows`` hold whole numbers."""
    if not len(queries) or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
    dims = rows.shape[1]
    with np.errstate(over="ignore"):
        exact = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(dims, 1) < 2**52
    if not exact:  # rare: numbers beyond what doubles hold exactly
        score = np.array([[int(v) for v in r] for r in queries.tolist()], object) @ np.array(
            [[int(v) for v in r] for r in rows.tolist()], object).T
        return _best(score, query_ids, row_ids, k)
    order = np.argsort(-rows.var(axis=0), kind="stable")
    q, columns = queries[:, order], np.ascontiguousarray(rows[:, order].T)  # vertical layout
    edges = [*range(0, dims, width), dims]
    q_rest = [np.sqrt((q[:, e:] ** 2).sum(axis=1)) for e in edges]
    row_rest = [np.sqrt((columns[e:] ** 2).sum(axis=0)) for e in edges]
    first = edges[1] if dims else 0
    partial = q[:, :first] @ columns[:first]
    out_q, out_r, out_s = [], [], []
    for i in range(len(q)):
        alive = np.flatnonzero(row_ids != query_ids[i])
        score = partial[i, alive]
        if len(alive) > k:
            # Exact scores of the most promising rows give the first bound.
            bound = score + q_rest[1][i] * row_rest[1][alive] if first < dims else score
            seed = alive[np.argpartition(-bound, k - 1)[:k]]
            floor = np.sort(q[i] @ columns[:, seed])[0]
            for at in range(1, len(edges) - 1):
                most = score + q_rest[at][i] * row_rest[at][alive] * (1 + 1e-9) + 1e-3
                live = most >= floor
                alive, score = alive[live], score[live]
                a, b = edges[at], edges[at + 1]
                score = score + q[i, a:b] @ columns[a:b][:, alive]
                if len(alive) > 4 * k and b < dims:  # a better bound from what is known by now
                    lead = alive[np.argpartition(-score, k - 1)[:k]]
                    floor = max(floor, np.sort(q[i] @ columns[:, lead])[0])
            live = score >= floor
            alive, score = alive[live], score[live]
        best = np.lexsort((row_ids[alive], -score))[:k]
        out_q.append(np.full(len(best), i))
        out_r.append(alive[best])
        out_s.append(np.rint(score[best]).astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s).astype(object)


def _best(score, query_ids, row_ids, k):
    out = ([], [], [])
    for i in range(len(query_ids)):
        rows = [j for j in range(len(row_ids)) if row_ids[j] != query_ids[i]]
        for j in sorted(rows, key=lambda j: (-score[i, j], row_ids[j]))[:k]:
            for o, v in zip(out, (i, j, score[i, j]), strict=True):
                o.append(v)
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], object)


_LIMIT = (1 << 63) - 1


def _cell(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        dims = max([len(b) // 8 for t in (queries, rows) for b in t.column("v").to_pylist()], default=0)
        q_ids, r_ids = (t.column("vec_id").to_numpy() for t in (queries, rows))
        a, b, score = search(_matrix(queries, dims), q_ids, _matrix(rows, dims), r_ids, k)
        score = [max(-_LIMIT, min(_LIMIT, int(s))) for s in score]
        return pa.table({"query_id": pa.array(q_ids[a] if len(a) else [], pa.int64()),
                         "vec_id": pa.array(r_ids[b] if len(b) else [], pa.int64()),
                         "score": pa.array(score, pa.int64())})
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, query_block: int = QUERY_BLOCK,
          row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of every query."""
    spark = vectors.sparkSession
    ship(spark)
    whole = stash(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
        _whole(scale), _VECTOR), "topk-vectors")
    asked = whole.filter(is_query)
    n_rows, n_asked = whole.count(), asked.count()
    across, down = max(1, -(-n_rows // row_block)), max(1, -(-n_asked // query_block))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select("vec_id", "v", block(down).alias("qb"), every(across).alias("rb"))
    r = whole.select("vec_id", "v", block(across).alias("rb"), every(down).alias("qb"))
    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(
        _cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
