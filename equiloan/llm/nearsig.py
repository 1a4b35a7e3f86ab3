"""Near-duplicate documents by a multi-index Hamming join on b-bit MinHash
signatures, confirmed on the full shingle sets (operator 8).

1. ``sketch``: every document's set of word shingles, its size, a 128-bit
   hash of the whole set and a signature of ``parts`` MinHash values of 16
   bits. Documents with equal sets collapse to one node.
2. Multi-index: the signature is cut into ``chunks`` chunks. Two signatures
   that differ in at most ``chunks * (errors + 1) - 1`` places differ in at most
   ``errors`` places of some chunk, so the keys made of each chunk with every
   choice of ``errors`` places left out contain a common key for every such
   pair: no pair within the distance is missed. With the defaults (6 chunks of
   6, 2 errors: distance 17 of 36) two documents of similarity exactly 0.8 lie
   within the distance with probability 0.99995, more similar ones more surely.
3. Keys held by several nodes are buckets. First every member of a bucket is
   compared with one pivot, as a star: the member that meets the most others
   over all its buckets, which in a group of copies is the original they were
   made from. Then components are formed, and only buckets that still hold
   several components compare the rest of their pairs across components. So a
   bucket of n near copies costs n comparisons, not n squared, and no link
   between different components is lost. Such a pair is taken up in one of
   the buckets it shares, is held to the signature distance and to a longer
   signature (512 values of 4 bits, which a pair of similarity 0.8 fails with
   a probability of 10^-6), and then confirmed on the two full sets; of each two
   components the most alike pair goes first, and only where it does not
   link the others follow. Only confirmed pairs link.
4. Connected components of the links; the smallest doc_id of each stays.

Null and empty texts have an empty set (size 0) and link with nothing. A text
with fewer words than a shingle is one shingle. A-Z is lower-cased. Rows that
share a doc_id are one document: whatever links one links all. A null doc_id
is a document of its own per distinct set and never names a component that
has another id. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloan.llm.components import connected_components
from equiloan.llm.runtime import ship, shuffle_partitions, stash
from equiloan.llm.textops import chunks as text_chunks
from equiloan.llm.textops import distinct, mix, span_hashes, texts, words

PARTS, CHUNKS, ERRORS = 36, 6, 2
#: Nodes whose ids may be broadcast to fetch their texts (40 bytes each);
#: more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: Rows of a mixed bucket that one group holds; larger ones are cut.
BLOCK_ROWS = 4096
#: Values of the long signature, and the standard deviations by which it may
#: miss its expected agreement.
LONG_PARTS, LONG_SLACK = 512, 4.75

_RNG = np.random.default_rng(8)
_STEP = _RNG.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALE = _RNG.integers(0, 2**63, 256 + LONG_PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**64, 256 + LONG_PARTS, dtype=np.uint64)


def shingle_sets(docs: list[bytes], width: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    data, starts, ends, owner = words([t.lower() for t in docs])
    word = span_hashes(data, starts, ends)
    count = np.bincount(owner, minlength=len(docs))
    first = np.concatenate(([0], np.cumsum(count)))
    long = len(word) - width + 1
    run = np.zeros(max(long, 0), np.uint64)
    for j in range(width):
        run += word[j: j + max(long, 0)] * _STEP[j]
    run = mix(run + np.uint64(width))
    out = []
    for i, n in enumerate(count.tolist()):
        a = first[i]
        if n >= width:
            out.append(distinct(run[a: a + n - width + 1]))
        elif n:
            whole = (word[a: a + n] * _STEP[:n]).sum(dtype=np.uint64)
            out.append(mix(np.array([whole + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least(shingles: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    low = np.full(len(scale), np.uint64(2**64 - 1))
    step = max(1, 150_000 // len(scale))
    for at in range(0, len(shingles), step):
        v = shingles[at: at + step, None] * scale[None, :] + shift[None, :]
        np.minimum(low, v.min(axis=0), out=low)
    return mix(low)


def signature(shingles: np.ndarray, parts: int) -> np.ndarray:
    """``parts`` MinHash values, 16 bits of each."""
    return (_least(shingles, _SCALE[:parts], _SHIFT[:parts]) >> np.uint64(48)).astype(np.uint16)


def long_signature(shingles: np.ndarray) -> bytes:
    """LONG_PARTS further MinHash values, 4 bits of each, two to a byte."""
    v = (_least(shingles, _SCALE[256:], _SHIFT[256:]) >> np.uint64(60)).astype(np.uint8)
    return (v[0::2] << 4 | v[1::2]).tobytes()


_AGREE = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.int64)


def long_floor(percent: int) -> float:
    """The least agreement of long signatures that ``percent`` allows."""
    q = percent / 100 + (1 - percent / 100) / 16
    return LONG_PARTS * q - LONG_SLACK * (LONG_PARTS * q * (1 - q)) ** 0.5


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()),
                     ("sig", pa.binary())])


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sketch(width: int, parts: int):
    def run(batches):
        for batch in batches:
            docs = texts(batch)
            n, hi, lo, sig = [], [], [], []
            for a, b in text_chunks(docs):
                for s in shingle_sets(docs[a:b], width):
                    n.append(len(s))
                    h = _set_hash(s)
                    hi.append(h[0])
                    lo.append(h[1])
                    sig.append(signature(s, parts).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")),
                 *(pa.array(x, f.type) for x, f in zip((n, hi, lo, sig), list(_SKETCH)[1:], strict=True))],
                schema=_SKETCH)
    return run


def index_keys(sig: np.ndarray, chunks: int, errors: int) -> np.ndarray:
    """(rows, keys) 64-bit keys of signatures (rows, parts): each chunk with
    every choice of ``errors`` places left out. The low 10 bits number the
    choice."""
    edges = np.linspace(0, sig.shape[1], chunks + 1).astype(int)
    wide = sig.astype(np.uint64)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for places in combinations(range(a, b), max(b - a - errors, 1)):
            h = np.full(len(sig), len(out) + 1, np.uint64)
            for p in places:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, p])
            out.append(h >> np.uint64(10) << np.uint64(10) | np.uint64(len(out)))
    return np.stack(out, axis=1).view(np.int64)


def first_shared(differ: np.ndarray, chunks: int, errors: int) -> np.ndarray:
    """Number of the first key that signatures share, given where they differ
    (rows, parts): the first choice of places that leaves out all differences
    of its chunk."""
    edges = np.linspace(0, differ.shape[1], chunks + 1).astype(int)
    out, number = np.full(len(differ), 1 << 20), 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for places in combinations(range(a, b), max(b - a - errors, 1)):
            out = np.minimum(out, np.where(differ[:, places].any(axis=1), 1 << 20, number))
            number += 1
    return out


def _keys(parts: int, chunks: int, errors: int):
    def run(batches):
        for batch in batches:
            node = batch.column(batch.schema.get_field_index("node")).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sig")).to_pylist()),
                                np.uint16).reshape(-1, parts)
            for at in range(0, len(node), 1024):
                keys = index_keys(sig[at: at + 1024], chunks, errors)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(node[at: at + 1024], keys.shape[1]))],
                    names=["key", "node"])
    return run


def _buckets(batches):
    """Rows of runs of equal keys longer than one; rows come sorted by key.
    Only one row is carried from batch to batch."""
    last_key = last_node = None
    waiting = False  # the last row began a run and is not out yet
    for batch in batches:
        key, node = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "node"))
        if not len(key):
            continue
        start = np.concatenate(([last_key is None or key[0] != last_key], key[1:] != key[:-1]))
        rows = ~start | np.concatenate((~start[1:], [False]))
        k, n = key[rows], node[rows]
        if waiting and not start[0]:
            k, n = np.concatenate(([last_key], k)), np.concatenate(([last_node], n))
        waiting = bool(start[-1])
        last_key, last_node = key[-1], node[-1]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "node"])


def _near(parts: int, distance: int):
    """Pairs whose signatures differ in at most ``distance`` places."""
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()),
                                  np.uint16).reshape(-1, parts) for c in ("sig_a", "sig_b"))
            near = pa.array((a != b).sum(axis=1) <= distance)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)).filter(near) for c in ("a", "b")], names=["a", "b"])
    return run


def _long(width: int):
    def run(batches):
        for batch in batches:
            docs = texts(batch)
            out = []
            for a, b in text_chunks(docs):
                out += [long_signature(s) for s in shingle_sets(docs[a:b], width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("node")), pa.array(out, pa.binary())], names=["node", "long"])
    return run


def spread(inside: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, i, j, node, component, second (of block j): the groups (key, i, j) that compare the
    mixed buckets ``inside`` (key, node, component, n rows of the key). A
    bucket of up to ``block_rows`` is one group. A larger one is cut by a hash
    of the node into blocks of about so many rows, first those outside its
    largest component, then those of that component; a group holds two blocks
    (i < j) or one (i = j), so that any two rows of different components meet
    in exactly one group."""
    whole = inside.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "component",
                           F.lit(False).alias("second"))
    large = inside.filter(F.col("n") > F.lit(block_rows))
    sizes = (large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
             .agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("m")))
    per = lambda c: F.ceil(c / F.lit(block_rows)).cast("int")
    sizes = stash(sizes.select("key", F.col("m.component").alias("main"), per(F.col("n") - F.col("m.c")).alias("others"),
                               per(F.col("m.c")).alias("mains")), "near-blocks")
    if sizes.isEmpty():
        return whole
    own = F.col("component") == F.col("main")
    place = lambda blocks: F.pmod(F.xxhash64("node", F.lit("block")), F.col(blocks)).cast("int")
    block = F.when(own, F.col("others") + place("mains")).otherwise(place("others"))
    with_ = F.sequence(F.lit(0), F.when(own, F.col("others")).otherwise(F.col("others") + F.col("mains")) - F.lit(1))
    cut = (large.join(sizes, "key").select("key", "node", "component", block.alias("own"), F.explode(with_).alias("other"))
           .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component",
                   (F.col("own") > F.col("other")).alias("second")))
    return whole.join(sizes.select("key"), "key", "left_anti").unionByName(cut)


def _across(parts: int, chunks: int, errors: int, floor: float):
    """Pairs of different components within both signature bounds, of runs of
    equal (key, i, j) (sorted), each pair in the first key it shares. A run's
    signatures are held, some 350 bytes a row; in a run of one block rows of
    its largest component are only compared with the others, in a run of two
    blocks the rows of one with those of the other."""
    distance = chunks * (errors + 1) - 1

    def pairs(rows):
        number = rows[0][0][0] & 1023
        node, comp = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(-1, parts)
        long = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        if rows[0][0][1] == rows[0][0][2]:
            values, counts = np.unique(comp, return_counts=True)
            last = comp == values[np.argmax(counts)]
            across = 0
        else:
            last = np.array([r[5] for r in rows])
            across = int((~last).sum())
        order = np.concatenate((np.flatnonzero(~last), np.flatnonzero(last)))
        node, comp, sig, long = node[order], comp[order], sig[order], long[order]
        for i in range(int((~last).sum())):
            start = max(i + 1, across)
            rest = np.flatnonzero(comp[start:] != comp[i]) + start
            differ = sig[rest] != sig[i]
            ok = differ.sum(axis=1) <= distance
            rest, differ = rest[ok], differ[ok]
            agree = _AGREE[long[rest] ^ long[i]].sum(axis=1)
            ok = agree >= floor
            rest, differ, agree = rest[ok], differ[ok], agree[ok]
            ok = first_shared(differ, chunks, errors) == number if len(rest) else ok[:0]
            hit = rest[ok]
            if len(hit):
                swap = node[hit] < node[i]
                a, b = np.where(swap, node[hit], node[i]), np.where(swap, node[i], node[hit])
                x, y = np.minimum(comp[i], comp[hit]), np.maximum(comp[i], comp[hit])
                yield a, b, x, y, agree[ok]

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out = []
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            groups = zip(column("key"), column("i"), column("j"), strict=True)
            for row in zip(groups, *map(column, ("node", "component", "sig", "long", "second")), strict=True):
                if held and row[0] != held[0][0]:
                    out.extend(pairs(held))
                    held = []
                held.append(row)
            if out:
                yield table(out)
        out = list(pairs(held)) if held else []
        if out:
            yield table(out)

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)],
                                          names=["a", "b", "x", "y", "agree"])

    return run


def _confirm(width: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b"))
            left, right = texts(batch, "text_a"), texts(batch, "text_b")
            keep = []
            seen: tuple[int | None, np.ndarray | None] = (None, None)
            for lo, hi in text_chunks(right):
                for i, s in zip(range(lo, hi), shingle_sets(right[lo:hi], width), strict=True):
                    if seen[0] != a[i]:  # rows of one pivot come together
                        seen = (a[i], shingle_sets([left[i]], width)[0])
                    both = np.sort(np.concatenate((seen[1], s)))
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(keep), pa.array(b, pa.int64()).filter(keep)],
                                             names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, parts: int = PARTS, chunks: int = CHUNKS,
                    errors: int = ERRORS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row. Documents with at
    least ``percent`` % common of all their shingles are linked."""
    spark = docs.sparkSession
    ship(spark)
    distance = chunks * (errors + 1) - 1
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stash(base.mapInArrow(_sketch(width, parts), "doc_id long, n_shingles long, hi long, lo long, sig binary")
                     .withColumn("row", F.monotonically_increasing_id()), "near-sketch")
    # One node per distinct set: its first row.
    nodes = stash(sketches.filter("sig is not null").groupBy("hi", "lo")
                  .agg(F.min(F.struct("row", "doc_id", "sig")).alias("x"))
                  .select(F.col("x.row").alias("node"), F.col("x.doc_id").alias("doc_id"), F.col("x.sig").alias("sig"),
                          "hi", "lo"), "near-nodes")
    keyed = nodes.select("node", "sig").mapInArrow(_keys(parts, chunks, errors), "key long, node long")
    buckets = stash(keyed.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
                    .mapInArrow(_buckets, "key long, node long"), "near-buckets")
    sig = nodes.select("node", "sig")
    side = lambda c: sig.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    per_key = buckets.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others"))
    met = buckets.join(per_key, "key").groupBy("node").agg(F.sum("others").alias("met"))
    pivots = (buckets.join(met, "node").groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("x"))).alias("p"))
              .select("key", (-F.col("p.x")).alias("pivot")))
    star = stash(buckets.join(pivots, "key").filter("node <> pivot")
                 .select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "near-star")
    close = star.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near(parts, distance), "a long, b long")
    wanted = stash(buckets.select("node").distinct().join(nodes.drop("sig"), "node"), "near-wanted")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    bodies = stash(
        base.join(wanted.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")))
        .select("node", "hi", "lo", "text").mapInArrow(_own_text(width), "node long, text string")
        .dropDuplicates(["node"]), "near-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        body = lambda c: bodies.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
        return (pairs.join(body("b"), "b").join(body("a"), "a").select("a", "b", "text_a", "text_b")
                .mapInArrow(_confirm(width, percent), "a long, b long"))

    links = stash(confirmed(close), "near-links")
    # Rows that share an id are one document.
    placed = sketches.filter("sig is not null").join(nodes.select("hi", "lo", "node"), ["hi", "lo"])
    same = (placed.filter("doc_id is not null").groupBy("doc_id")
            .agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("a <> b"))
    shared = placed.join(same.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")
    links = stash(links.unionByName(shared), "near-links")
    found = connected_components(links)

    # What is left to compare: pairs of different components in one bucket.
    labelled = (buckets.select("key", "node").join(found, "node", "left")
                .select("key", "node", F.coalesce("component", "node").alias("component")))
    mixed = (labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"),
                                         F.count(F.lit(1)).alias("n"))
             .filter("x <> y").select("key", "n"))
    longer = bodies.mapInArrow(_long(width), "node long, long binary")
    inside = stash(labelled.join(mixed, "key"), "near-mixed")
    both = stash(inside.select("node").distinct().join(sig, "node").join(longer, "node"), "near-long")
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = stash(spread(inside, block_rows).join(both, "node")
                 .select("key", "i", "j", "node", "component", "sig", "long", "second")
                 .repartition(shuffle_partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
                 .mapInArrow(_across(parts, chunks, errors, long_floor(percent)),
                             "a long, b long, x long, y long, agree long")
                 .join(tested, ["a", "b"], "left_anti"), "near-left")
    # Of each two components the most alike pair first: where it links, the
    # others need no comparing.
    best = stash(left.groupBy("x", "y").agg(F.max(F.struct("agree", "a", "b")).alias("p"))
                 .select("p.a", "p.b", "x", "y"), "near-best")
    joined = stash(confirmed(best.select("a", "b")), "near-links")
    if not joined.isEmpty():
        # Components of components; only the labels change.
        merged = connected_components(best.join(joined, ["a", "b"], "left_semi")
                                      .select(F.col("x").alias("a"), F.col("y").alias("b")))
        merged = merged.select(F.col("node").alias("_c"), F.col("component").alias("_m"))
        whole = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        found = stash(whole.join(merged, F.col("component") == F.col("_c"), "left")
                      .select("node", F.coalesce("_m", "component").alias("component")), "near-found")
        label = lambda c: merged.select(F.col("_c").alias(c), F.col("_m").alias(f"m{c}"))
        left = (left.join(label("x"), "x", "left").join(label("y"), "y", "left")
                .filter(F.coalesce("mx", "x") != F.coalesce("my", "y")).select("a", "b"))
    # (Most alike pairs that did not link are few; they may be tried again.)
    more = stash(confirmed(left.select("a", "b")), "near-links")
    if not more.isEmpty():
        found = connected_components(links.unionByName(joined).unionByName(more))

    rows = (sketches.join(nodes.select("hi", "lo", "node"), ["hi", "lo"], "left")
            .join(found, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component")))
    smallest = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(smallest, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _own_text(width: int):
    """Rows whose text really has the node's set (a doc_id may have several
    rows)."""
    def run(batches):
        for batch in batches:
            docs = texts(batch)
            hi, lo = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hi", "lo"))
            keep = []
            for a, b in text_chunks(docs):
                for i, s in zip(range(a, b), shingle_sets(docs[a:b], width), strict=True):
                    keep.append(_set_hash(s) == (hi[i], lo[i]))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)).filter(keep) for c in ("node", "text")],
                names=["node", "text"])
    return run
