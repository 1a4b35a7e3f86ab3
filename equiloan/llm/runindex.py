"""Repeated passages by a run-length index (operator 4).

A window is a string of ``length`` bytes; every byte covered by a window that
also starts anywhere else is to be removed. Exactly, over all documents:

1. Anchors. Every window owns one anchor, the smallest of its ``seed``-byte
   strings by hash (the leftmost of equals). Equal windows own equal anchors
   at equal places. The windows of one anchor occurrence are a stretch of
   consecutive starts; the bytes they span are its segment (under
   ``2 * length`` bytes), and each window lies in exactly one segment.
2. Segments meet by anchor hash. An anchor that occurs once settles its
   segment: nothing repeats. Segments with equal contents settle too: all of
   their windows repeat. Equal contents are combined inside each batch before
   the shuffle and by a partial aggregation after it, so a passage that a third
   of all documents share costs one row per task.
3. What is left, different segments around one anchor, is partitioned into
   shards by anchor and every shard builds a run-length index: the suffix order
   of its segments, the Burrows-Wheeler transform, its runs, and at each run
   start a sample (text position, its predecessor in suffix order, the length
   they share). Between samples the shared length falls by one per position
   and the predecessor moves along (the phi function of the r-index), so one
   stream over the text yields for every position the longest match that
   precedes it in order; a window repeats if that match, at it or at its
   successor, has ``length`` bytes or more.
4. An anchor with more segments than a shard may hold is cut finer instead:
   its segments are halved by the place of the anchor in the window, and the
   halves meet by longer strings around the anchor, which all their windows
   contain; this repeats until groups fit, at the latest when the string is
   the whole window.
5. The marked spans of each document are merged and cut out.

Texts are judged as given, as UTF-8 bytes; matches never cross documents. Null
text is empty. Rows that share a doc_id, and null ids, are documents of their
own. Other columns are not read. ``text`` of the result is what is left,
decoded with replacement where a cut falls inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship, shuffle_partitions, stash
from equiloan.llm.textops import chunks, mix, texts

LENGTH, SEED = 200, 64
#: Bytes of different segments a shard of the index is meant to hold, and the
#: most one anchor may bring.
SHARD_BYTES, GROUP_BYTES = 1 << 20, 1 << 19
SEPARATOR = 0xFF  # occurs in no UTF-8 text

_LETTERS = np.random.default_rng(4).integers(0, 2**64, 256, dtype=np.uint64)


# --- anchors ---------------------------------------------------------------------

def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of every ``seed``-byte string, by doubling."""
    parts, h, size, at, left = [], _LETTERS[data], 1, 0, seed
    out = None
    while left:
        if left & 1:
            piece = h[at: at + len(data) - seed + 1]
            out = piece.copy() if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + piece)
            at += size
        left >>= 1
        if left:
            h = mix(h[:-size] * np.uint64(0xC2B2AE3D27D4EB4F) + h[size:])
            size *= 2
    return out


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of every ``width`` hashes in a row, the
    leftmost of equals. 40 bits of the hash are compared; in the other 24 the
    position rides along, so a sliding minimum carries both (long inputs go
    piece by piece)."""
    piece, out = 1 << 22, []
    for at in range(0, len(h) - width + 1, piece):
        part = h[at: at + piece + width - 1]
        low = (part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        size, n = 1, len(part) - width + 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[width - size: width - size + n])
        out.append((low & np.uint64((1 << 24) - 1)).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def segments(docs: list[bytes], length: int, seed: int):
    """(document, anchor hash, anchor place, first window, last window) of each
    anchor occurrence; places count from the document's first byte."""
    size = np.array([len(t) for t in docs], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    data = np.frombuffer(b"".join(docs), np.uint8)
    if len(data) < length:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    h = seed_hashes(data, seed)
    owner = leftmost_least(h, length - seed + 1)
    doc = np.repeat(np.arange(len(docs)), size)[: len(owner)]
    inside = np.arange(len(owner)) + length <= begin[doc + 1]
    edge = np.ones(len(owner), bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(edge & inside)
    # A stretch ends where the next begins or the document has no more windows.
    stop = np.concatenate((np.flatnonzero(edge)[1:], [len(owner)]))[np.searchsorted(np.flatnonzero(edge), first)]
    last = np.minimum(stop - 1, begin[doc[first] + 1] - length)
    d = doc[first]
    return d, h[owner[first]], owner[first] - begin[d], first - begin[d], last - begin[d]


NORMAL, MANY, SETTLED = 0, 1, 2
_KEYS = ("key", "content", "kind", "doc_id", "mark", "first", "last", "place", "low", "high")
_ROW = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()),
                  ("mark", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("place", pa.int32()),
                  ("low", pa.int32()), ("high", pa.int32())])
_ROW_SQL = ("key long, content long, kind int, doc_id long, mark long, first int, last int, place int, low int, "
            "high int")


def combine(key, content, rest: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of one batch with equal (key, content) become one row of kind MANY;
    the others of the group are SETTLED already and get a key of their own, so
    that they travel anywhere."""
    order = np.lexsort((content, key))
    key, content = key[order], content[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    again = np.zeros(len(key), bool)
    again[:-1] = ~new[1:]
    kind = np.where(new, np.where(again, MANY, NORMAL), SETTLED).astype(np.int32)
    spread = mix(key.view(np.uint64) + np.arange(len(key), dtype=np.uint64)).view(np.int64)
    key = np.where(kind == SETTLED, spread, key)
    return [key, content, kind, *(x[order] for x in rest)]


def _anchors(length: int, seed: int):
    def run(batches):
        for batch in batches:
            docs = texts(batch)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            mark = batch.column(batch.schema.get_field_index("mark")).to_numpy()
            for a, b in chunks(docs, limit=4 << 20):
                part = docs[a:b]
                d, anchor, place, first, last = segments(part, length, seed)
                digest, bodies = xxhash.xxh3_64_intdigest, [memoryview(t) for t in part]
                content = np.array([digest(bodies[i][f: e + length]) for i, f, e in
                                    zip(d.tolist(), first.tolist(), last.tolist(), strict=True)], np.uint64)
                small = [x.astype(np.int32) for x in (first, last, place)]
                n = len(d)
                rows = combine(anchor.view(np.int64), content.view(np.int64),
                               [d, mark[a:b][d], *small, np.zeros(n, np.int32), np.full(n, length - seed, np.int32)])
                rows[3] = ids.slice(a, b - a).take(pa.array(rows[3]))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x) for x in rows], schema=_ROW)
    return run


# --- settling ----------------------------------------------------------------------

SPAN, PENDING, INDEX = 0, 1, 2
HELD_ROWS = 200_000


def _settle(batches):
    """Rows sorted by (key, content): equal contents are SPAN (and one of them
    INDEX), different contents around one key PENDING, the rest is dropped.
    Holds the rows of the current key, and of a hot one only its last
    content."""
    held, crossed = None, None  # crossed: a key of which other contents were handed on

    def decide(t: pa.Table):
        key, content, kind = (t.column(c).to_numpy() for c in ("key", "content", "kind"))
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= content[1:] != content[:-1]
        group = np.cumsum(new) - 1
        of_key = np.cumsum(new_key) - 1
        contents = np.bincount(of_key[new])[of_key]
        if crossed is not None:
            contents = np.where(key == crossed, 2, contents)
        settled = (np.bincount(group)[group] > 1) | (np.bincount(group, weights=kind == MANY)[group] > 0)
        for mask, value in ((settled, SPAN), (settled & new & (contents > 1), INDEX), (~settled & (contents > 1), PENDING)):
            at = np.flatnonzero(mask)
            if len(at):
                out = t.take(pa.array(at))
                out = out.set_column(out.schema.get_field_index("kind"), "kind",
                                     pa.array(np.full(len(at), value, np.int32)))
                yield from out.combine_chunks().to_batches()

    for batch in batches:
        t = pa.Table.from_batches([batch])
        gone = t.column("kind").to_numpy() == SETTLED
        if gone.any():
            out = t.filter(pa.array(gone))
            out = out.set_column(out.schema.get_field_index("kind"), "kind",
                                 pa.array(np.full(len(out), SPAN, np.int32)))
            yield from out.combine_chunks().to_batches()
            t = t.filter(pa.array(~gone))
        if held is not None:
            t = pa.concat_tables([held, t])
        if not len(t):
            continue
        key = t.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if len(t) - cut > HELD_ROWS:
            content = t.column("content").to_numpy()[cut:]
            edge = int(np.searchsorted(content, content[-1]))
            if edge:
                crossed, cut = int(key[-1]), cut + edge
        if cut:
            yield from decide(t.slice(0, cut))
        held = t.slice(cut).combine_chunks()
        if crossed is not None and crossed != int(key[-1]):
            crossed = None
    if held is not None and len(held):
        yield from decide(held)


def settle(rows: DataFrame) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "content").mapInArrow(_settle, _ROW_SQL)


# --- the index -----------------------------------------------------------------------

class RunIndex:
    """Run-length Burrows-Wheeler index of different texts without the
    separator byte."""

    def __init__(self, bodies: list[bytes]):
        text = bytes([SEPARATOR]).join(bodies) + bytes([SEPARATOR])
        self.text = np.frombuffer(text, np.uint8)
        n = len(self.text)
        size = np.array([len(b) for b in bodies], np.int64)
        self.ends = np.cumsum(size + 1) - 1
        self.begins = self.ends - size
        suffix = self._sort(n)
        # The transform; the first text's start has no byte before it and is
        # a run of its own.
        before = np.where(suffix > 0, self.text[suffix - 1], 256).astype(np.int16)
        start = np.ones(n, bool)
        start[1:] = before[1:] != before[:-1]
        self.heads = before[start]
        self.lengths = np.diff(np.concatenate((np.flatnonzero(start), [n])))
        # Samples at run starts: text position, predecessor, shared length.
        row = np.flatnonzero(start)
        at, ahead = suffix[row], suffix[np.maximum(row - 1, 0)]
        shared = self._shared(at, ahead)
        shared[row == 0] = 0
        order = np.argsort(at)
        self.sample_at, self.sample_ahead, self.sample_shared = at[order], ahead[order], shared[order]
        del self._levels

    def _sort(self, n: int) -> np.ndarray:
        """Suffix array by prefix doubling from 8 bytes; the ranks of every
        level are kept until the samples are made."""
        wide = np.concatenate((self.text, np.zeros(8, np.uint8))).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | wide[j: j + n]
        order = np.argsort(key, kind="stable")
        rank = self._ranks(key[order], order, n)
        self._levels = [(8, rank)]
        step = 8
        while True:
            count = np.bincount(rank, minlength=n)
            open_ = np.flatnonzero(count[rank] > 1)
            if not len(open_) or step >= n:
                break
            after = np.zeros(len(open_), np.int64)
            inside = open_ + step < n
            after[inside] = rank[open_[inside] + step] + 1
            pair = (rank[open_].astype(np.int64) << 32) | after
            o = np.argsort(pair, kind="stable")
            pair, open_ = pair[o], open_[o]
            base = pair >> 32
            i = np.arange(len(pair))
            group = np.maximum.accumulate(np.where(np.concatenate(([True], base[1:] != base[:-1])), i, 0))
            equal = np.maximum.accumulate(np.where(np.concatenate(([True], pair[1:] != pair[:-1])), i, 0))
            rank = rank.copy()
            rank[open_] = base + equal - group
            step *= 2
            self._levels.append((step, rank))
        suffix = np.empty(n, np.int64)
        suffix[rank] = np.arange(n)
        return suffix

    @staticmethod
    def _ranks(ordered: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
        i = np.arange(n)
        first = np.maximum.accumulate(np.where(np.concatenate(([True], ordered[1:] != ordered[:-1])), i, 0))
        rank = np.empty(n, np.int32)
        rank[order] = first
        return rank

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes ``a`` and ``b``, from the
        ranks of the levels, longest first."""
        n = len(self.text)
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for step, rank in reversed(self._levels):
            ok = (a < n) & (b < n)
            same = np.zeros(len(a), bool)
            same[ok] = rank[a[ok]] == rank[b[ok]]
            # Equal ranks at a level mean equal bytes only up to the text's end.
            same &= (a + step <= n) & (b + step <= n) & (a != b)
            a[same] += step
            b[same] += step
            out[same] += step
        live = np.flatnonzero((a < n) & (b < n) & (a != b))
        for _ in range(7):
            live = live[(a[live] < n) & (b[live] < n)]
            live = live[self.text[a[live]] == self.text[b[live]]]
            if not len(live):
                break
            a[live] += 1
            b[live] += 1
            out[live] += 1
        return out

    def repeated(self, length: int) -> np.ndarray:
        """For every text position, whether the ``length`` bytes there occur
        somewhere else in the index: one stream over the samples."""
        n = len(self.text)
        place = np.arange(n)
        s = np.searchsorted(self.sample_at, place, side="right") - 1
        moved = place - self.sample_at[s]
        match = self.sample_shared[s] - moved      # with the predecessor in order
        ahead = self.sample_ahead[s] + moved       # phi
        room = np.repeat(self.ends, self.ends - self.begins + 1) - place
        hit = np.flatnonzero((match >= length) & (room >= length))
        out = np.zeros(n, bool)
        out[hit] = True
        out[ahead[hit]] = True  # the predecessor of a match matches too
        return out


# --- texts of what is pending ----------------------------------------------------------

_BODY_SQL = _ROW_SQL + ", body binary"


def _bodies(length: int):
    """Cut the pending segments of each document out of its text."""
    def run(batches):
        for batch in batches:
            docs = texts(batch)
            col = batch.column(batch.schema.get_field_index("rows"))
            edges = col.offsets.to_numpy()
            flat = col.values
            first, last = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            owner = np.repeat(np.arange(len(docs)), np.diff(edges))
            at = np.arange(edges[0], edges[-1])
            body = [docs[i][f: e + length] for i, f, e in
                    zip(owner.tolist(), first[at].tolist(), last[at].tolist(), strict=True)]
            take = pa.array(owner)
            inner = lambda c: flat.field(c).slice(edges[0], edges[-1] - edges[0])
            columns = [batch.column(batch.schema.get_field_index(c)).take(take) if c in ("doc_id", "mark") else inner(c)
                       for c in _KEYS]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(body, pa.binary())], names=[*_KEYS, "body"])
    return run


def _halves(length: int):
    """Segments cut in two by the anchor's place in the window, keyed by the
    bytes around the anchor that all windows of a half contain."""
    def run(batches):
        for batch in batches:
            out = {c: [] for c in (*_KEYS, "body")}
            for r in batch.to_pylist():
                if r["low"] == r["high"]:
                    continue  # one window each, all different: nothing repeats
                middle = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    first, last = max(r["first"], r["place"] - high), min(r["last"], r["place"] - low)
                    if first > last:
                        continue
                    body = r["body"][first - r["first"]: last - r["first"] + length]
                    a, b = r["place"] - low - first, r["place"] - high + length - first
                    key = xxhash.xxh3_64_intdigest(body[a:b], seed=low * 1024 + high)
                    for c, v in (("key", key), ("content", xxhash.xxh3_64_intdigest(body)), ("first", first),
                                 ("last", last), ("low", low), ("high", high), ("body", body),
                                 ("kind", MANY if r["kind"] == INDEX else NORMAL),
                                 ("doc_id", r["doc_id"]), ("mark", r["mark"]), ("place", r["place"])):
                        out[c].append(v)
            for c in ("key", "content"):
                out[c] = np.array(out[c], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _ROW]
                                             + [pa.array(out["body"], pa.binary())], names=[*_KEYS, "body"])
    return run


_SPAN = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("span", pa.int64())])


def _search(length: int):
    """One shard: index its segments and mark the repeated windows."""
    def run(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        index = RunIndex(bodies)
        hit = index.repeated(length)
        pending = table.column("kind").to_numpy() == PENDING
        seg = np.repeat(np.arange(len(bodies)), index.ends - index.begins + 1)
        hit &= pending[seg]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        a, b = edge[0::2], edge[1::2]  # windows a .. b - 1; a separator never starts one
        s = seg[a] if len(a) else np.zeros(0, np.int64)
        first = table.column("first").to_numpy()[s].astype(np.int64)
        start = first + a - index.begins[s]
        stop = first + (b - 1) - index.begins[s] + length
        take = pa.array(s)
        return pa.table({"doc_id": table.column("doc_id").take(take), "mark": table.column("mark").take(take),
                         "span": pa.array((start << 32) | stop, pa.int64())})
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, shard_bytes: int = SHARD_BYTES,
                   group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, mark, span): stretches of bytes that repeated windows cover,
    span = start * 2^32 + end; they may overlap. ``docs`` has doc_id, text and
    mark (a hash of the text that tells rows of one doc_id apart)."""
    if not 8 <= seed <= length:
        raise ValueError("the seed must have 8 to length bytes")
    whole = lambda rows: rows.filter(f"kind = {SPAN}").select(
        "doc_id", "mark", (F.shiftleft(F.col("first").cast("long"), 32) + F.col("last") + length).alias("span"))
    met = stash(settle(docs.mapInArrow(_anchors(length, seed), _ROW_SQL)), "run-settled")
    spans = whole(met)
    pending = (met.filter(f"kind <> {SPAN}").groupBy("doc_id", "mark")
               .agg(F.collect_list(F.struct(*[c for c in _KEYS if c not in ("doc_id", "mark")])).alias("rows"))
               .withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"}))
    ready = None
    todo = stash(docs.join(pending, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")))
                 .select("doc_id", "mark", "text", "rows").mapInArrow(_bodies(length), _BODY_SQL), "run-pending")
    while True:
        # Keys with more bytes than an index should get; at most one per
        # ``group_bytes`` of text.
        big = todo.groupBy("key").agg(F.sum(F.length("body")).alias("n")).filter(F.col("n") > group_bytes).select("key")
        big = stash(big, "run-big")
        small = todo.join(big, "key", "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        if big.isEmpty():
            break
        cut = stash(todo.join(big, "key", "left_semi").mapInArrow(_halves(length), _BODY_SQL), "run-halves")
        met = stash(settle(cut.drop("body")), "run-settled")
        spans = spans.unionByName(whole(met))
        left = met.filter(f"kind <> {SPAN}").select("key", "content", "kind", "doc_id", "mark", "first", "low")
        todo = stash(
            cut.drop("kind").join(
                left.select(*[F.col(c).alias(f"_{c}") for c in left.columns]),
                (F.col("key") == F.col("_key")) & (F.col("content") == F.col("_content"))
                & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("mark") == F.col("_mark"))
                & (F.col("first") == F.col("_first")) & (F.col("low") == F.col("_low")))
            .select(*[F.col("_kind").alias("kind") if c == "kind" else F.col(c) for c in (*_KEYS, "body")])
            .dropDuplicates(["key", "content"]), "run-pending")
    ready = stash(ready, "run-ready")
    total = ready.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    found = (ready.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard")
             .applyInArrow(_search(length), "doc_id long, mark long, span long"))
    return spans.unionByName(found)


_CUT = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches):
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("spans"))
        text, rows = [], ([], [], [], [])
        for body, spans in zip(texts(batch), col, strict=True):
            kept, removed, count = body, 0, 0
            if spans.is_valid:
                s = np.sort(spans.values.to_numpy())
                start, stop = s >> 32, np.maximum.accumulate(s & 0xFFFFFFFF)
                new = np.concatenate(([True], start[1:] > stop[:-1]))
                a, b = start[new], stop[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))]
                edges = [0, *np.stack((a, b), axis=1).ravel().tolist(), len(body)]
                kept = b"".join([body[i:j] for i, j in zip(edges[0::2], edges[1::2], strict=True)])
                removed, count = len(body) - len(kept), len(a)
            text.append(kept.decode("utf-8", "replace"))
            for o, v in zip(rows, (len(body), removed, count, hashlib.sha256(kept).hexdigest()), strict=True):
                o.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(text, pa.string()),
             *(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.string())],
            names=["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, shard_bytes: int = SHARD_BYTES,
                 group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, text (what is left), n_bytes, n_removed, n_spans, kept_sha256."""
    ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    spans = (repeated_spans(base, length, seed, shard_bytes, group_bytes).groupBy("doc_id", "mark")
             .agg(F.collect_list("span").alias("spans")).withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"}))
    return (base.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
            .select("doc_id", "text", "spans").mapInArrow(_cut, _CUT))
