"""Reversible line dedup: sharded cuckoo filters over exact reference counts
(operator 3).

The exact side is a postings table (key, doc_id): which document holds which
line key. Reference counts (documents per key, largest doc_id) are one
aggregation of it with partial sums, so a line that a third of all documents
share is one row per task before the shuffle. Inserting documents appends
postings, deleting documents removes theirs; counts, and so every earlier
decision, go back to what they were (``LineIndex``).

The fast side is one cuckoo filter per shard of the key space, holding the
keys whose count has reached the threshold, kept as a written table (shard,
keys, filter) at any size. A filter answers "not repeated" without error, so
only lines that may be repeated go on to the exact table, which decides. Where
the stored filters together stay under ``filter_bytes`` the scan of the
documents probes them as a broadcast; above, lines meet the filter of their
shard in a cogroup, in groups of about ``PROBE_ROWS`` lines, so that a shard
with a very common line is probed by several tasks. Both ways give the same
rows. In ``LineIndex`` a change of documents recounts only the keys it touches
and changes the filters by the keys that cross the threshold: they are inserted
on the way up and deleted on the way down. When the keys outgrow the shards
(twice ``SHARD_KEYS`` each), the filters are built anew with more shards.

A line's key is the line without white space at both ends and with A-Z
lower-cased; it is compared by a 128-bit hash. Lines under ``min_chars`` code
points are never dropped. Null or empty text is one empty line; very long
texts and lines are read whole. A line that occurs twice in one document counts
once for it, and rows that share a doc_id are one document where documents are
counted (rows without an id too): the ids that occur on several rows are found
first, and only their postings are made distinct. Inserting a document again
changes nothing. Ties cannot occur: the largest doc_id is unique, and rows that
share it all keep the line. A null doc_id never holds the largest id. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship, stash
from equiloan.llm.textops import lists, texts

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 50_000
FILTER_BYTES = 64 << 20
#: Lines that one task probes against the filter of their shard.
PROBE_ROWS = 200_000
#: Repeated ids, or sizes of shards, that may be broadcast (8 bytes each).
BROADCAST_IDS = 500_000


# --- cuckoo filter -----------------------------------------------------------

class CuckooFilter:
    """Four 16-bit fingerprints per bucket; a fingerprint lives in one of two
    buckets, each computed from the other, so it can be moved and deleted."""

    SLOTS = 4
    KICKS = 500

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1
        while buckets * self.SLOTS * 0.85 < max(capacity, 1):
            buckets *= 2
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        f = (keys >> np.uint64(48)).astype(np.uint16)
        return np.where(f == 0, np.uint16(1), f)

    def _other(self, bucket, fingerprint):
        return (bucket ^ (np.asarray(fingerprint, np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)).astype(np.int64)) \
            & self.mask

    def _places(self, keys: np.ndarray):
        f = self._print(keys)
        first = (keys & np.uint64(self.mask)).astype(np.int64)
        return f, first, self._other(first, f)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, a, b = self._places(np.asarray(keys, np.uint64))
        return ((self.table[a] == f[:, None]) | (self.table[b] == f[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        """Add keys; when a chain of moves finds no room the table doubles its
        slots per bucket, so no key is ever lost."""
        for f, a, b in zip(*(x.tolist() for x in self._places(np.asarray(keys, np.uint64))), strict=True):
            for bucket in (a, b):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = f
                    break
            else:
                bucket = a
                for kick in range(self.KICKS):
                    slot = kick % self.table.shape[1]
                    f, self.table[bucket, slot] = int(self.table[bucket, slot]), f
                    bucket = int(self._other(bucket, f))
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = f
                        break
                else:
                    self.table = np.hstack([self.table, np.zeros_like(self.table)])
                    self.table[bucket, np.flatnonzero(self.table[bucket] == 0)[0]] = f

    def delete(self, keys: np.ndarray) -> None:
        """Remove one copy of each key (keys that were inserted)."""
        for f, a, b in zip(*(x.tolist() for x in self._places(np.asarray(keys, np.uint64))), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == f)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return len(self.table).to_bytes(8, "little") + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets = int.from_bytes(data[:8], "little")
        return cls(0, np.frombuffer(data, np.uint16, offset=8).reshape(buckets, -1).copy())


# --- lines to postings ---------------------------------------------------------

def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    """(lines, key of each line); a line too short to drop has an empty key."""
    lines = text.split(b"\n")
    keys = []
    for line in lines:
        key = line.strip().lower()  # bytes: ASCII white space, A-Z
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            keys.append(xxhash.xxh3_128_digest(key))
        else:
            keys.append(b"")
    return lines, keys


_POSTING = "doc_id long, hi long, lo long"
_POSTING_ARROW = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])


def _postings(min_chars: int, probe=None):
    """Distinct keys of each document; ``probe`` is a broadcast list of filters."""
    def run(batches):
        filters = [CuckooFilter.from_bytes(b) for b in probe.value] if probe is not None else None
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            owners, found = [], []
            for doc, body in zip(ids, texts(batch), strict=True):
                keys = {k for k in line_keys(body, min_chars)[1] if k}
                found.extend(keys)
                owners.extend([doc] * len(keys))
            pair = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            owner = np.array([-1 if d is None else d for d in owners], np.int64)
            null = np.array([d is None for d in owners], bool)
            if filters is not None and len(pair):
                shard = _shards(pair[:, 0], len(filters))
                maybe = np.zeros(len(pair), bool)
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    maybe[at] = filters[s].contains(pair[at, 1].view(np.uint64))
                pair, owner, null = pair[maybe], owner[maybe], null[maybe]
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner, mask=null), pa.array(np.ascontiguousarray(pair[:, 0])),
                 pa.array(np.ascontiguousarray(pair[:, 1]))], schema=_POSTING_ARROW)
    return run


def _shards(hi: np.ndarray, shards: int) -> np.ndarray:
    return (hi.view(np.uint64) % np.uint64(shards)).astype(np.int64)


def postings(docs: DataFrame, min_chars: int = MIN_CHARS, probe=None) -> DataFrame:
    """(doc_id, hi, lo): one row per document and distinct line key."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _postings(min_chars, probe), _POSTING)


def document_postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``postings`` with one row per (doc_id, key), also where rows share an
    id: the ids on several rows (a shuffle of ids alone) are found first, and
    only their postings are shuffled to become distinct."""
    ids = docs.select(F.col("doc_id").cast("long").alias("_doc"))
    again = stash(ids.groupBy("_doc").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("_doc"), "line-ids")
    post = postings(docs, min_chars)
    n = again.count()
    if not n:
        return post
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    same = F.col("doc_id").eqNullSafe(F.col("_doc"))
    return post.join(again, same, "left_anti").unionByName(post.join(again, same, "left_semi").distinct())


def reference_counts(post: DataFrame) -> DataFrame:
    """(hi, lo) -> n_docs, max_doc: the exact table."""
    return post.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def _build(table: pa.Table) -> pa.Table:
    keys = table.column("lo").to_numpy().view(np.uint64)
    f = CuckooFilter(len(keys))
    f.insert(keys)
    return pa.table({"shard": table.column("shard").slice(0, 1), "keys": [len(keys)], "filter": [f.to_bytes()]})


def _shard_column(shards: int) -> Column:
    """The shard of a key as ``_shards`` computes it: the unsigned high half
    modulo the number of shards."""
    high = F.shiftrightunsigned("hi", 32) % shards
    low = F.col("hi").bitwiseAND(F.lit(0xFFFFFFFF)) % shards
    return ((high * F.lit((1 << 32) % shards) + low) % shards).cast("long")


_FILTER = "shard long, keys long, filter binary"


def _change(held: pa.Table, changes: pa.Table) -> pa.Table:
    """One shard's filter after the keys that left and the keys that came."""
    f = CuckooFilter.from_bytes(held.column("filter")[0].as_py()) if len(held) else CuckooFilter(0)
    keys = held.column("keys")[0].as_py() if len(held) else 0
    if len(changes):
        lo = changes.column("lo").to_numpy().view(np.uint64)
        came = changes.column("came").to_numpy()
        f.delete(lo[~came])
        f.insert(lo[came])
        keys += int(came.sum()) - int((~came).sum())
    shard = (held if len(held) else changes).column("shard").slice(0, 1)
    return pa.table({"shard": shard, "keys": [keys], "filter": [f.to_bytes()]})


def _probe(lines: pa.Table, held: pa.Table) -> pa.Table:
    """The lines of one shard that its filter may hold."""
    lines = lines.select(["doc_id", "hi", "lo"])
    if not len(lines) or not len(held):
        return lines.slice(0, 0)
    f = CuckooFilter.from_bytes(held.column("filter")[0].as_py())
    return lines.filter(pa.array(f.contains(lines.column("lo").to_numpy().view(np.uint64))))


@dataclass
class ShardFilters:
    """One cuckoo filter per shard of the repeated keys, as a written table."""

    table: DataFrame
    shards: int

    @classmethod
    def build(cls, repeated: DataFrame) -> ShardFilters:
        shards = max(1, -(-repeated.count() // SHARD_KEYS))
        keys = repeated.select(_shard_column(shards).alias("shard"), "lo")
        return cls(stash(keys.groupBy("shard").applyInArrow(_build, _FILTER), "line-filters"), shards)

    def update(self, came: DataFrame, went: DataFrame) -> ShardFilters:
        """Filters with the keys of ``came`` inserted and of ``went`` deleted
        (each (hi, lo) once; ``went`` only keys that are held)."""
        def side(keys, flag):
            return keys.select(_shard_column(self.shards).alias("shard"), "lo", F.lit(flag).alias("came"))

        changes = side(came, True).unionByName(side(went, False))
        table = self.table.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_change, _FILTER)
        return ShardFilters(stash(table, "line-filters"), self.shards)

    def broadcast(self, filter_bytes: int):
        """The filters as a broadcast list, or None above the size bound."""
        size = self.table.agg(F.sum(F.length("filter")).alias("size")).first()["size"] or 0
        empty = CuckooFilter(0).to_bytes()
        if size + len(empty) * self.shards > filter_bytes:
            return None
        held = [empty] * self.shards
        for r in self.table.select("shard", "filter").toLocalIterator():
            held[r["shard"]] = bytes(r["filter"])
        return self.table.sparkSession.sparkContext.broadcast(held)

    def probe(self, post: DataFrame) -> DataFrame:
        """Postings (one row per doc_id and key) whose key may be repeated,
        by a cogroup with the stored filters."""
        held = stash(post.withColumn("shard", _shard_column(self.shards)), "line-probes")
        parts = stash(held.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(PROBE_ROWS)).cast("long").alias("parts")),
                      "line-shards")
        small = F.broadcast(parts) if self.shards <= BROADCAST_IDS else parts
        lines = held.join(small, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "hi", "lo"), F.col("parts")))
        copies = self.table.join(small, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "filter")
        return (lines.select("doc_id", "hi", "lo", "shard", "part").groupBy("shard", "part")
                .cogroup(copies.groupBy("shard", "part")).applyInArrow(_probe, _POSTING))


# --- rewriting -----------------------------------------------------------------

_RESULT = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"


def _rewrite(min_chars: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            drops = batch.column(batch.schema.get_field_index("drops")).to_pylist()
            text, n_lines, n_dropped, sha = [], [], [], []
            for body, drop in zip(texts(batch), drops, strict=True):
                if drop is None:
                    kept, n, gone = body, body.count(b"\n") + 1, 0
                else:
                    lines, keys = line_keys(body, min_chars)
                    gone_keys = {drop[i:i + 16] for i in range(0, len(drop), 16)}
                    stay = [line for line, key in zip(lines, keys, strict=True) if key not in gone_keys]
                    kept, n, gone = b"\n".join(stay), len(lines), len(lines) - len(stay)
                text.append(kept)
                n_lines.append(n)
                n_dropped.append(gone)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(text, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
                 pa.array(n_dropped, pa.int64()), pa.array(sha)],
                names=["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"])
    return run


def _drop_lists(table: pa.Table) -> pa.Table:
    pair = np.stack([table.column("hi").to_numpy(), table.column("lo").to_numpy()], axis=1)
    return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "drops": [np.ascontiguousarray(pair).tobytes()]})


def decide(docs: DataFrame, repeated: DataFrame, filters: ShardFilters, min_chars: int, filter_bytes: int) -> DataFrame:
    """Rewritten documents given the repeated keys (hi, lo, max_doc) and the
    filters that hold them."""
    probe = filters.broadcast(filter_bytes)
    held = postings(docs, min_chars, probe) if probe is not None else filters.probe(
        document_postings(docs.filter(F.col("doc_id").isNotNull()), min_chars))
    r = repeated.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "max_doc")
    gone = (held.join(r, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")))
            .filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")) & F.col("doc_id").isNotNull())
            .select("doc_id", "hi", "lo"))
    drops = gone.groupBy("doc_id").applyInArrow(_drop_lists, "doc_id long, drops binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.join(drops, "doc_id", "left").mapInArrow(_rewrite(min_chars), _RESULT)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, text (lines that stay), n_lines, n_dropped, kept_sha256."""
    repeated = stash(reference_counts(document_postings(docs, min_chars)).filter(F.col("n_docs") >= min_docs), "line-keys")
    return decide(docs, repeated, ShardFilters.build(repeated), min_chars, filter_bytes)


class LineIndex:
    """Incremental index: ``insert`` and ``delete`` documents, ``dedup`` any
    documents against what is held. Each change writes a new version of the
    postings, of the reference counts and of the filters, so a version can be
    gone back to; counts and filters change only by the keys it touches."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 filter_bytes: int = FILTER_BYTES):
        self.min_chars, self.min_docs, self.filter_bytes = min_chars, min_docs, filter_bytes
        self.postings = spark.createDataFrame([], _POSTING)
        self._counts = reference_counts(self.postings)
        self.filters = ShardFilters(spark.createDataFrame([], _FILTER), 1)

    def insert(self, docs: DataFrame) -> LineIndex:
        held = self.postings.select(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "hi", "lo")))
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))
        new = stash(document_postings(docs, self.min_chars).join(held, same, "left_anti"), "line-postings")
        return self._advance(stash(self.postings.unionByName(new), "line-postings"), new)

    def delete(self, doc_ids: DataFrame | Iterable[int]) -> LineIndex:
        spark = self.postings.sparkSession
        if not isinstance(doc_ids, DataFrame):
            doc_ids = spark.createDataFrame([(int(i),) for i in doc_ids], "doc_id long")
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        rest = self.postings.join(ids, "doc_id", "left_anti").select("doc_id", "hi", "lo")
        return self._advance(stash(rest, "line-postings"), self.postings.join(ids, "doc_id", "left_semi"))

    def _advance(self, post: DataFrame, changed: DataFrame) -> LineIndex:
        """The next version, after the postings ``changed`` came or went."""
        key = ["hi", "lo"]
        touched = stash(changed.select(*key).distinct(), "line-touched")
        counts = stash(self._counts.join(touched, key, "left_anti").unionByName(
            reference_counts(post.join(touched, key, "left_semi"))), "line-counts")
        before, after = (self._repeated(c).select(*key) for c in (self._counts, counts))
        if after.count() > 2 * SHARD_KEYS * self.filters.shards:
            self.filters = ShardFilters.build(after)
        else:
            self.filters = self.filters.update(after.join(touched, key, "left_semi").join(before, key, "left_anti"),
                                               before.join(touched, key, "left_semi").join(after, key, "left_anti"))
        self.postings, self._counts = post, counts
        return self

    def _repeated(self, counts: DataFrame) -> DataFrame:
        return counts.filter(F.col("n_docs") >= self.min_docs)

    def counts(self) -> DataFrame:
        """(hi, lo) -> n_docs, max_doc: the exact table of the documents held."""
        return self._counts

    def dedup(self, docs: DataFrame) -> DataFrame:
        return decide(docs, self._repeated(self._counts), self.filters, self.min_chars, self.filter_bytes)
