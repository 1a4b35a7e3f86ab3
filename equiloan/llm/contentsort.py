"""Exact dedup by content sort (operator 7).

1. ``representatives``: inside each input partition, rows with equal
   normalised text collapse to one representative that carries the text, the
   number of rows and the smallest and largest id; the other rows keep only
   the representative's key. A group of copies therefore sends at most one
   text per input partition through the shuffle, however large it is.
2. Representatives are range-partitioned by sampled splitters on (a bounded
   prefix of the normalised bytes, a content hash): equal texts always share
   a partition, unequal texts with a common opening do not have to, and the
   sample that reaches the driver holds bounded keys, never whole texts.
3. Spark's external sort orders each partition by the whole content; a
   streaming pass compares each row with its neighbour in full and closes a
   run of equals with the id that stays.
4. The members join their representative's verdict on its key.

Rows are compared after lower-casing A-Z only. Null text counts as empty,
and all empty texts are equal. Rows that share a doc_id are rows of their
own; they tie, and each of them carries the same verdict. A null doc_id is
smaller than any other. Extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship, shuffle_partitions, stash
from equiloan.llm.textops import texts

PREFIX = 24
_STAGE = "doc_id long, sha string, rep string, content binary, n long, low long, high long"
_STAGE_ARROW = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("rep", pa.string()),
                          ("content", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _collapse(batches):
    """Members with their representative's key; the first row of each distinct
    text in a batch is the representative. Batches are bounded, so is this."""
    import uuid

    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        bodies = [t.lower() for t in texts(batch)]  # bytes.lower() touches A-Z only
        seen: dict[bytes, list] = {}
        token = uuid.uuid4().hex
        reps, shas = [], []
        for i, (doc, body) in enumerate(zip(ids, bodies, strict=True)):
            group = seen.get(body)
            if group is None:
                group = seen[body] = [i, hashlib.sha256(body).hexdigest(), 0, None, None]
            group[2] += 1
            if doc is not None:
                group[3] = doc if group[3] is None else min(group[3], doc)
                group[4] = doc if group[4] is None else max(group[4], doc)
            reps.append(f"{token}-{group[0]}")
            shas.append(group[1])
        n = len(ids)
        content, count, low, high = [None] * n, [None] * n, [None] * n, [None] * n
        for body, (i, _, c, a, b) in seen.items():
            content[i], count[i], low[i], high[i] = body, c, a, b
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in
             zip((ids, shas, reps, content, count, low, high), _STAGE_ARROW, strict=True)], schema=_STAGE_ARROW)


_RUN = "rep string, low long, high long, size long"
_RUN_ARROW = pa.schema([("rep", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("size", pa.int64())])


def _neighbours(batches):
    """Close runs of equal neighbours; holds one text and the keys of the
    current run (at most one per batch of the input)."""
    held, keys, low, high, size = None, [], None, None, 0

    def closed():
        k = len(keys)
        return [keys, [low] * k, [high] * k, [size] * k]

    for batch in batches:
        out: list[list] = [[], [], [], []]
        for body, rep, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("content", "rep", "n", "low", "high")),
                                      strict=True):
            if held is None or body != held:
                if keys:
                    for o, c in zip(out, closed(), strict=True):
                        o.extend(c)
                held, keys, low, high, size = body, [], None, None, 0
            keys.append(rep)
            size += n
            low = a if low is None else low if a is None else min(low, a)
            high = b if high is None else high if b is None else max(high, b)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _RUN_ARROW, strict=True)],
                                             schema=_RUN_ARROW)
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(closed(), _RUN_ARROW, strict=True)],
                                         schema=_RUN_ARROW)


def content_sort(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    ``keep`` says which id of equal texts stays, "smallest" or "largest"."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = docs.sparkSession
    ship(spark)
    stage = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                  .mapInArrow(_collapse, _STAGE), "content-sort")
    reps = stage.filter("content is not null").select("content", "rep", "n", "low", "high")
    ordered = (reps.repartitionByRange(shuffle_partitions(spark), F.substring("content", 1, PREFIX),
                                       F.xxhash64("content"))
               .sortWithinPartitions("content"))
    runs = ordered.mapInArrow(_neighbours, _RUN)
    verdict = runs.select("rep", F.col("high" if keep == "largest" else "low").alias("keep_id"),
                          F.col("size").alias("group_size"))
    members = stage.select("doc_id", "rep", F.col("sha").alias("text_sha256"))
    return members.join(verdict, "rep").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
