"""Packing by cutting-stock column generation (operator 10).

1. ``tokens``: every document becomes token ids followed by the end id and is
   cut at multiples of the sequence length. Full pieces are sequences by
   themselves; the shorter tails are the items to pack.
2. ``solve``: on the histogram of tail lengths (classes of ``grain`` tokens,
   rounded up) a linear program over cutting patterns is solved by column
   generation: a revised simplex holds the basis, knapsack dynamic programming
   over the duals prices the next pattern. The patterns are used their
   rounded-down number of times; what remains in the histogram is packed by
   first fit decreasing into patterns used once. ``plan`` does this twice:
   with all tails, and with those above ``exact`` tokens only, whose free room
   and further sequences then take the short ones by their exact lengths; the
   fewer sequences win. The histogram has at most ``length`` rows, whatever the
   size of the corpus.
3. ``assign``: tails are ranked inside their class (counts per block of ids
   give each block its offset, so no class is ever in one task) and the k-th
   tail of a class goes to the k-th slot the patterns hold for it. Offsets
   inside a sequence are a running sum over its few pieces.

Null text is an empty document: its one id is the end id. Rows that share a
doc_id are packed each on its own. A null doc_id is kept. Sequences that end
at a power of two need no padding, so the pattern of a lone tail whose length
is a power of two costs nothing.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship, stash
from equiloan.llm.textops import texts

LENGTH = 4096
GRAIN = 16
#: Tails up to so many tokens may be packed by their exact lengths: many of
#: them share a sequence, where rounding each would add up.
EXACT = 256
END = 2
BLOCK_ROWS = 100_000
CACHE = 250_000


# --- tokens ------------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for the characters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return {b: chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)}


class WordEncoder(dict):
    """Ids (little-endian bytes) of each white-space-free word, kept in a
    bounded cache.

    The tokenizer drops white space and never joins across it, so a text's
    ids are its words' ids in order. Inside a plain Latin word its own steps
    are applied: lower case, split into runs of letters, single digits and
    runs of other signs, merges of each run by the tokenizer's model. Any
    other word goes through the whole tokenizer. ``words`` and ``runs`` hold
    at most ``CACHE`` entries each and start afresh when full."""

    _CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
    _RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
    _SIMPLE = re.compile("[\\x21-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0132-\\u0148\\u014a-\\u017e]+")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.runs: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        shown = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
        ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self.runs) >= CACHE:
            self.runs.clear()
        self.runs[run] = ids
        return ids

    def _other(self, word: str) -> bytes:
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > 400 or "<|" in word or not self._SIMPLE.fullmatch(word):
            ids = self._other(word)
        else:
            low = word.lower()
            if low.isalpha():
                ids = self.runs.get(low) or self._run(low)
            elif low[:-1].isalpha() and low[-1] in ".,;:!?":
                a, b = low[:-1], low[-1]
                ids = (self.runs.get(a) or self._run(a)) + (self.runs.get(b) or self._run(b))
            else:
                ids = b"".join([self.runs.get(r) or self._run(r) for r in self._RUN.findall(low)])
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


_ENCODERS: dict[str, WordEncoder] = {}
#: str.split() also cuts at these, which the tokenizer takes as signs.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def _tokens(path: str, length: int, end: int):
    last = array("I", [end]).tobytes()

    def run(batches):
        encoder = _ENCODERS.get(path)
        if encoder is None:
            encoder = _ENCODERS[path] = WordEncoder(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            rows = batch.column(batch.schema.get_field_index("row")).to_pylist()
            out: list[list] = [[] for _ in _PIECES]
            for row, doc, body in zip(rows, ids, texts(batch), strict=True):
                text = body.decode("utf-8", "replace")
                if _NOT_SPACE.search(text):
                    parts = [encoder._other(w) for w in re.split("[ \t\n\r\x0b\x0c]+", text) if w]
                else:
                    parts = [encoder[w] for w in text.split()]
                parts.append(last)
                data = b"".join(parts)
                n = len(data) // 4
                for start in range(0, n, length):
                    piece = data[4 * start:4 * (start + length)]
                    for o, v in zip(out, (row, doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, _PIECES, strict=True)],
                                             schema=_PIECES)
    return run


def tokens(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """row, doc_id, start, length, ids_crc32, doc_tokens: the documents' ids
    cut at multiples of ``length``. ``row`` numbers the input rows."""
    ship(docs.sparkSession)
    return (docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        "text")
            .mapInArrow(_tokens(path, length, end),
                        "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))


# --- patterns ----------------------------------------------------------------

def _price(dual: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of classes
    1..capacity (class k is k units long) with the largest sum of duals."""
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        gain = dual[:room] + value[room - 1::-1][:room]  # item k+1 leaves room - k - 1
        k = int(np.argmax(gain))
        if gain[k] > value[room - 1] + 1e-12:
            value[room], choice[room] = gain[k], k + 1
        else:
            value[room] = value[room - 1]
    pattern, room = np.zeros(capacity, np.int64), capacity
    while room > 0:
        if choice[room]:
            pattern[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(value[capacity]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots. These matrices are small: a threaded
    library's threads would wait for each other longer than they work."""
    n = len(a)
    w = np.hstack([a, np.eye(n)])
    for k in range(n):
        p = k + int(np.argmax(np.abs(w[k:, k])))
        if p != k:
            w[[k, p]] = w[[p, k]]
        w[k] /= w[k, k]
        rest = w[:, k].copy()
        rest[k] = 0
        w -= rest[:, None] * w[k]
    return w[:, n:]


def solve(counts: np.ndarray, steps: int = 4000) -> list[tuple[int, np.ndarray]]:
    """(uses, pattern) covering exactly ``counts[k]`` items of k + 1 units in
    sequences of ``len(counts)`` units. ``steps`` bounds the simplex steps; a
    basis that is not optimal yet still gives whole patterns."""
    capacity = len(counts)
    demand = counts.astype(float)
    need = np.flatnonzero(counts)
    if not len(need):
        return []
    m = len(need)
    basis = np.zeros((m, m))
    basis[np.arange(m), np.arange(m)] = capacity // (need + 1)
    inverse = np.diag(1.0 / np.diag(basis))
    x = (inverse * demand[need]).sum(axis=1)
    for step in range(steps):
        if step % 200 == 199:
            inverse = _inverse(basis)
            x = np.maximum((inverse * demand[need]).sum(axis=1), 0)
        dual = np.full(capacity, -1.0)
        dual[need] = inverse.sum(axis=0)
        best, pattern = _price(np.where(dual > 1e-12, dual, -1.0), capacity)
        if best <= 1 + 1e-7:
            break
        column = pattern[need].astype(float)
        along = (inverse * column).sum(axis=1)
        ok = along > 1e-10
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, along, 1), np.inf)
        out = int(np.argmin(ratio))
        t = ratio[out]
        x = np.maximum(x - t * along, 0)
        x[out] = t
        basis[:, out] = column
        row = inverse[out] / along[out]
        inverse = inverse - np.outer(along, row)
        inverse[out] = row
    left = counts.astype(np.int64).copy()
    patterns: list[tuple[int, np.ndarray]] = []
    for j in range(m):
        pattern = np.zeros(capacity, np.int64)
        pattern[need] = np.rint(basis[:, j]).astype(np.int64)
        used = np.flatnonzero(pattern)
        uses = int(min(np.floor(x[j] + 1e-6), *(left[used] // pattern[used]))) if len(used) else 0
        if uses > 0:
            patterns.append((uses, pattern))
            left -= uses * pattern
    bins: list[list] = []  # first fit decreasing over what the rounding left
    for k in np.repeat(np.arange(capacity)[::-1], left[::-1]):
        size = int(k) + 1
        for b in bins:
            if b[0] >= size:
                break
        else:
            b = [capacity, np.zeros(capacity, np.int64)]
            bins.append(b)
        b[0] -= size
        b[1][k] += 1
    return patterns + [(1, b[1]) for b in bins]


def _greedy(left: np.ndarray, room: int) -> np.ndarray:
    """A pattern of lengths 1..len(left), the longest that fits first."""
    pattern = np.zeros(len(left), np.int64)
    for k in np.flatnonzero(left)[::-1]:
        n = min(room // (int(k) + 1), int(left[k]))
        pattern[k] = n
        room -= n * (int(k) + 1)
    return pattern


def fill(patterns: list[tuple[int, np.ndarray]], short: np.ndarray, length: int, grain: int) -> list[tuple[int, np.ndarray]]:
    """``short[k]`` items of k + 1 tokens put into the free room of
    ``patterns`` (of ``grain`` tokens a unit), then into sequences of their own.
    The patterns returned have the classes of ``short`` before those of
    ``patterns``. Each round uses up a class or a pattern."""
    left, out = short.astype(np.int64).copy(), []
    units = -(-length // grain)
    own = (int(left.sum()), np.zeros(units, np.int64))  # more than enough sequences of short items alone
    for uses, pattern in [*patterns, own]:
        room = length - grain * int((pattern * np.arange(1, units + 1)).sum())
        while uses:
            add = _greedy(left, max(room, 0))
            used = np.flatnonzero(add)
            n = int(min(uses, *(left[used] // add[used]))) if len(used) else uses
            if len(used) or pattern.any():
                out.append((n, np.concatenate((add, pattern))))
            left -= n * add
            uses -= n
    return out


def plan(lengths: np.ndarray, grain: int, exact: int) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """(tokens below which classes are exact, uses and pattern) for
    ``lengths[k]`` tails of k + 1 tokens. Class k of the patterns is length
    k + 1 up to that bound, then unit by unit of ``grain`` tokens."""
    length = len(lengths)
    unit = -(-np.arange(1, length + 1) // grain) - 1
    coarse = np.bincount(unit, weights=lengths, minlength=-(-length // grain)).astype(np.int64)
    rounded = solve(coarse)
    exact = min(exact, length) // grain * grain
    if not lengths[:exact].any():
        return 0, rounded
    long = coarse.copy()
    long[:exact // grain] = 0
    filled = fill(solve(long), lengths[:exact], length, grain)
    fewer = sum(u for u, _ in filled) < sum(u for u, _ in rounded)
    return (exact, filled) if fewer else (0, rounded)


# --- assignment ---------------------------------------------------------------

def _slots(capacity: int, patterns: list[tuple[int, np.ndarray]]):
    """Per class: first rank of each pattern, its slots per use, and the first
    sequence of each pattern."""
    base = np.concatenate(([0], np.cumsum([u for u, _ in patterns]))).astype(np.int64)
    table = {}
    for k in range(capacity):
        hold = [(i, u, int(p[k])) for i, (u, p) in enumerate(patterns) if p[k]]
        if hold:
            first = np.concatenate(([0], np.cumsum([u * c for _, u, c in hold]))).astype(np.int64)
            table[k] = (first, np.array([c for *_, c in hold], np.int64),
                        np.array([base[i] for i, *_ in hold], np.int64))
    return table, int(base[-1])


def _place(table):
    def run(batches):
        for batch in batches:
            unit = batch.column(batch.schema.get_field_index("unit")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            seq = np.empty(len(unit), np.int64)
            slot = np.empty(len(unit), np.int64)
            for k in np.unique(unit):
                at = np.flatnonzero(unit == k)
                first, per, base = table[int(k) - 1]
                i = np.searchsorted(first, rank[at], side="right") - 1
                inside = rank[at] - first[i]
                seq[at] = base[i] + inside // per[i]
                slot[at] = int(k) * 4096 + inside % per[i]
            keep = [c for c in batch.schema.names if c not in ("unit", "rank")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(seq), pa.array(slot)],
                names=[*keep, "sequence_id", "slot"])
    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, grain: int = GRAIN, end: int = END,
         block_rows: int = BLOCK_ROWS, exact: int = EXACT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stash(tokens(docs, path, length, end), "pack-pieces")
    counts = np.zeros(length, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``length`` rows
        counts[r["length"] - 1] = r["n"]
    # Tails as long as a sequence once rounded up have a sequence of their own.
    exact, patterns = plan(counts, grain, exact)
    table, _ = _slots(exact + -(-length // grain), patterns)
    unit = F.when(F.col("length") <= exact, F.col("length")).otherwise(
        F.lit(exact) + F.ceil(F.col("length") / F.lit(grain))).cast("long")
    pieces = pieces.withColumn("unit", unit)
    blocks = max(1, -(-pieces.count() // block_rows))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    per = pieces.groupBy("unit", "block").agg(F.count(F.lit(1)).alias("n"))
    per = stash(per, "pack-histogram")
    before = Window.partitionBy("unit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("unit", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("unit", "block").orderBy("row", "start")
    ranked = (pieces.withColumn("k", F.row_number().over(inside) - 1).join(offsets, ["unit", "block"])
              .withColumn("rank", (F.col("first") + F.col("k")).cast("long"))
              .select("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "unit", "rank"))
    placed = ranked.mapInArrow(_place(table), "row long, doc_id long, start long, length long, ids_crc32 long, "
                                              "doc_tokens long, sequence_id long, slot long")
    order = Window.partitionBy("sequence_id").orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long").alias("offset"))
