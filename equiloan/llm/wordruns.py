"""Periodic runs of words, found on a grammar (operator 12).

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``max(min_words, 2 q)`` long, that no neighbouring
word extends. Documents spread over Spark's tasks; inside one:

1. Words become ids. Words outside every candidate stretch are set aside: a
   run of 12 or more words with two or more periods is covered by windows of
   six words that occur again one period on, so a word in no six-word window
   that recurs in its stretch lies in no run. This repeats inside the
   stretches that are left.
2. Re-Pair turns each stretch into a straight-line grammar: the pair of
   neighbouring symbols that occurs most often (oldest pair first among
   equals) becomes a nonterminal, until no pair occurs twice. What is left is
   joined by a balanced tree of nonterminals that occur once.
3. Every nonterminal X -> Y Z is looked at once: the maximal repetitions of its
   expansion that cross the boundary between Y and Z, for all periods at once,
   from longest common extensions on both sides of it. Every run of the text
   lies in the smallest nonterminal that contains it, and crosses its boundary.
4. Those intervals are translated to all positions at which X occurs in the
   derivation. An interval that touches the end of X may go on outside; the
   full run is then found at a larger nonterminal, and merging keeps the
   maximal interval of each period and the smallest period of each interval.

``periodic_runs`` works on whole documents and has no bound on lengths,
periods or the number of runs. A document must fit in a task (about 200 bytes
a word of its candidate stretches).

Cases: null and empty texts and texts of white space have no words and no run;
very long texts are one document each; the longest run is told apart from
others as long by the smallest start (no two runs share start and period).
Rows that share a doc_id, and equal rows, are documents of their own; a null
doc_id is never rewritten by ``planted``. An empty table gives an empty result.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship
from equiloan.llm.textops import CHUNK, chunks, distinct, mix, span_hashes, texts, words

MIN_WORDS = 12


# --- grammar -------------------------------------------------------------------

class Grammar:
    """Re-Pair grammar of a word-id sequence: ``left``, ``right``, ``size`` by
    nonterminal (numbered from ``base``), ``root`` the symbol of the whole."""

    def __init__(self, ids: list[int]):
        self.base = max(ids, default=-1) + 1
        self.left: list[int] = []
        self.right: list[int] = []
        self.size: list[int] = []
        top = self._pair(list(ids))
        while len(top) > 1:  # balanced tree over what is left
            half = [self._new(a, b) for a, b in zip(top[0::2], top[1::2], strict=False)]
            top = half + top[len(half) * 2:]
        self.root = top[0] if top else None

    def _new(self, a: int, b: int) -> int:
        self.left.append(a)
        self.right.append(b)
        self.size.append(self.length(a) + self.length(b))
        return self.base + len(self.left) - 1

    def length(self, symbol: int) -> int:
        return 1 if symbol < self.base else self.size[symbol - self.base]

    def _pair(self, seq: list[int]) -> list[int]:
        n = len(seq)
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))  # n and -1: none
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            places.setdefault((seq[i], seq[i + 1]), []).append(i)
        # Entries: minus the number of places noted, age, pair. The number is
        # a bound; a pair whose places have gone comes back with fewer.
        age = 0
        heap = []
        for pair, at in places.items():
            age += 1
            if len(at) > 1:
                heap.append((-len(at), age, pair))
        heapify(heap)
        while heap:
            bound, old, pair = heappop(heap)
            noted = places.get(pair)
            if noted is None:
                continue
            a, b = pair
            found, end = [], -1
            for i in noted:
                if seq[i] == a and i > end:
                    j = follow[i]
                    if j < n and seq[j] == b:
                        found.append(i)
                        end = j if a == b else i
            if len(found) < 2:
                del places[pair]
                continue
            if len(found) < -bound and heap and -heap[0][0] > len(found):
                places[pair] = found
                heappush(heap, (-len(found), old, pair))
                continue
            del places[pair]
            x = self._new(a, b)
            touched: set[tuple[int, int]] = set()
            for i in found:
                j = follow[i]
                after, prior = follow[j], before[i]
                seq[i], seq[j] = x, -1
                follow[i] = after
                if after < n:
                    before[after] = i
                    key = (x, seq[after])
                    places.setdefault(key, []).append(i)
                    touched.add(key)
                if prior >= 0:
                    key = (seq[prior], x)
                    places.setdefault(key, []).append(prior)
                    touched.add(key)
            for key in sorted(touched):
                at = places[key]
                if len(at) > 1:
                    at.sort()
                    age += 1
                    heappush(heap, (-len(at), age, key))
        return [s for s in seq if s >= 0]

    def occurrences(self) -> list[np.ndarray]:
        """Start positions of every nonterminal in the derivation."""
        held: list[list[np.ndarray]] = [[] for _ in self.left]
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(self.left)
        if self.root is not None and self.root >= self.base:
            held[self.root - self.base].append(np.zeros(1, np.int64))
        # Children are older than their parents, but for the balanced tree's
        # leftovers, which are older too: descending order meets parents first.
        for k in range(len(self.left) - 1, -1, -1):
            at = held[k][0] if len(held[k]) == 1 else np.concatenate(held[k])
            held[k] = []
            out[k] = at
            a, b = self.left[k], self.right[k]
            if a >= self.base:
                held[a - self.base].append(at)
            if b >= self.base:
                held[b - self.base].append(at + self.length(a))
        return out


# --- repetitions across a boundary ------------------------------------------------

class _Extensions:
    """Longest common extensions of a sequence, for many pairs of places at
    once: ranks of all windows of 1, 2, 4, ... words, compared from the longest."""

    def __init__(self, ids: np.ndarray):
        self.rank = [ids.astype(np.int64)]
        width = 1
        while 2 * width <= len(ids):
            r = self.rank[-1]
            both = r[: len(r) - width] * (int(r.max()) + 1) + r[width:]
            self.rank.append(np.unique(both, return_inverse=True)[1].astype(np.int64))
            width *= 2

    def forward(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Equal words from a and b on, at most ``room`` (b + room in range)."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            r, width = self.rank[k], 1 << k
            fits = np.flatnonzero(got + width <= room)
            if len(fits):
                x, y = a[fits] + got[fits], b[fits] + got[fits]
                got[fits[r[x] == r[y]]] += width
        return got

    def backward(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Equal words before a and b, at most ``room`` (a - room in range)."""
        got = np.zeros(len(a), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            r, width = self.rank[k], 1 << k
            fits = np.flatnonzero(got + width <= room)
            if len(fits):
                x, y = a[fits] - got[fits] - width, b[fits] - got[fits] - width
                got[fits[r[x] == r[y]]] += width
        return got


def crossing(ext: _Extensions, at: int, cut: int, end: int, least: int) -> list[tuple[int, int, int]]:
    """(start, stop, period) of the maximal repetitions of words at..end that
    cross ``cut`` and hold two periods and ``least`` words: for each period the
    words equal on both sides of the cut, one period apart, are counted."""
    word = ext.rank[0]
    found: dict[tuple[int, int], int] = {}

    def keep(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> None:
        good = (stop - start >= np.maximum(2 * period, least)) & (start < cut) & (stop > cut)
        for s, e, q in zip(start[good].tolist(), stop[good].tolist(), period[good].tolist(), strict=True):
            if found.get((s, e), q) >= q:
                found[s, e] = q

    # A whole period lies right of the cut, or left of it.
    for rightwards in (True, False):
        period = np.arange(1, (end - cut if rightwards else cut - at) + 1)
        x = np.full(len(period), cut) if rightwards else cut - period
        y = x + period
        # A word next to the two places must agree with its partner.
        inside = y < end
        near = np.zeros(len(period), bool)
        near[inside] = word[x[inside]] == word[y[inside]]
        back = x - 1 >= at
        near[back] |= word[x[back] - 1] == word[y[back] - 1]
        x, y, period = x[near], y[near], period[near]
        if not len(period):
            continue
        right = ext.forward(x, y, end - y)
        left = ext.backward(x, y, x - at)
        keep(x - left, y + right, period)
    return [(s, e, q) for (s, e), q in found.items()]


def runs_of(ids: list[int] | np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """All runs (start, stop, smallest period) of a word-id sequence."""
    ids = np.asarray(ids, np.int64)
    if len(ids) < least:
        return []
    grammar = Grammar(ids.tolist())
    ext = _Extensions(ids)
    places = grammar.occurrences()
    parts: list[np.ndarray] = []
    for k, at in enumerate(places):
        size = grammar.size[k]
        if size < least or not len(at):
            continue
        home = int(at.min())
        cut = home + grammar.length(grammar.left[k])
        for s, e, q in crossing(ext, home, cut, home + size, least):
            parts.append(np.stack([at + (s - home), at + (e - home), np.full(len(at), q)], axis=1))
    return _merged(np.concatenate(parts)) if parts else []


def _merged(found: np.ndarray) -> list[tuple[int, int, int]]:
    """The maximal interval of each period, then the smallest period of each
    interval."""
    found = found[np.lexsort((-found[:, 1], found[:, 0], found[:, 2]))]
    best: dict[tuple[int, int], int] = {}
    period = reach = -1
    for s, e, q in found.tolist():
        if q != period:
            period, reach = q, -1
        if e > reach:
            reach = e
            best.setdefault((s, e), q)  # periods come in ascending order
    return sorted((s, e, q) for (s, e), q in best.items())


# --- candidate stretches ------------------------------------------------------------

def covered(h: np.ndarray, part: np.ndarray, width: int) -> np.ndarray:
    """Words in a window of ``width`` words that recurs in its part."""
    hit = np.zeros(len(h) + 1, np.int64)
    n = len(h) - width + 1
    if n < 2:
        return hit[:-1] > 0
    g = mix(part[:n].astype(np.uint64))
    for k, odd in enumerate(np.random.default_rng(12).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
        g = g + h[k:n + k] * odd
    at = np.flatnonzero(part[:n] == part[width - 1:])  # windows that stay within one part
    g = mix(g[at])
    ordered = np.sort(g)
    again = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        place = np.minimum(np.searchsorted(again, g), len(again) - 1)
        at = at[again[place] == g]
        hit[at] += 1
        hit[at + width] -= 1
    return np.cumsum(hit[:-1]) > 0


def stretches(h: np.ndarray, part: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Stretches of words in which alone runs can lie; ``part`` numbers the
    documents. A run of ``least`` words repeats at least half of them, rounded
    up, one period on. Narrowed until nothing changes, three times at most
    (narrowing saves work only)."""
    width = (least + 1) // 2
    live, n = covered(h, part, width), -1
    for _ in range(3):
        kept = int(live.sum())
        if kept == 0 or kept == n:
            break
        n = kept
        opens = np.concatenate(([True], (part[1:] != part[:-1]) | (live[1:] != live[:-1])))
        live &= covered(h, np.cumsum(opens), width)
    edge = np.concatenate(([True], (part[1:] != part[:-1]) | (live[1:] != live[:-1]))) if len(h) else np.empty(0, bool)
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(h))
    return [(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True) if live[a] and b - a >= least]


# --- documents ------------------------------------------------------------------------

def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word order of a document whose tail is made periodic (one in ten
    ids), or None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


_SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")
_ARROW = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in (
    "n_runs", "start", "length", "period", "exponent_milli")] + [("runs_sha256", pa.string()),
                                                                 ("collapsed_sha256", pa.string())])


def _document_runs(docs: list[bytes], orders: list[np.ndarray | None], least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of every document, in words of the (reordered) document."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    data, starts, ends, owner = words(docs)
    if not len(starts):
        return out
    h = span_hashes(data, starts, ends)
    first = np.searchsorted(owner, np.arange(len(docs) + 1))
    for d, order in enumerate(orders):
        if order is not None:
            span = slice(first[d], first[d + 1])
            h[span], starts[span], ends[span] = h[span][order], starts[span][order], ends[span][order]
    raw = data.tobytes()
    for a, b in stretches(h, owner, least):
        seen: dict[bytes, int] = {}
        ids = [seen.setdefault(raw[s:e], len(seen))
               for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
        d = int(owner[a])
        shift = a - int(first[d])
        out[d] += [(s + shift, e + shift, q) for s, e, q in runs_of(ids, least)]
    return out


def _task(least: int, order_of: Callable[[int | None, int], np.ndarray | None] | None):
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            bodies = texts(batch)
            rows = []
            for lo, hi in chunks(bodies, CHUNK):
                part = bodies[lo:hi]
                tokens = [t.split() for t in part]  # bytes: [\x20\x09-\x0D]+
                orders = [order_of(i, len(t)) if order_of else None for i, t in zip(ids[lo:hi], tokens, strict=True)]
                for i, own, order, runs in zip(ids[lo:hi], tokens, orders, _document_runs(part, orders, least),
                                               strict=True):
                    if order is not None:
                        own = [own[k] for k in order.tolist()]
                    rows.append((i, *_summary(own, runs)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)],
                                             schema=_ARROW)
    return run


def _summary(own: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    best = (None,) * 4
    if runs:
        s, e, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]))
        best = (s, e - s, q, 1000 * (e - s) // q)
        drop = np.zeros(len(own) + 1, np.int64)
        for s, e, q in runs:
            drop[s + q] += 1
            drop[e] -= 1
        stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
        own = [own[k] for k in stay.tolist()]
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(own)).hexdigest())


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS,
                  order_of: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period,
    exponent_milli), runs_sha256 and collapsed_sha256 of every document.
    ``order_of`` (a module-level function of doc_id and number of words) may
    give the words another order first."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _task(min_words, order_of), _SCHEMA)
