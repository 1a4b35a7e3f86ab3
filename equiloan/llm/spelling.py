"""Spelling variants, found in bit-sliced position indexes (operator 11).

Words are near if one inserted, deleted or replaced letter (code point) turns
one into the other. A word's form is its near word of largest count, if that
is at least ``ratio`` times the word's own; its root is the end of the chain
of forms.

1. Counting: every task counts the words of its documents in a bounded table
   that it hands on when full; one shuffle adds up. A word that a third of all
   documents hold is one row a task.
2. Groups that hold every near pair. A pair whose shorter word has c letters
   differs in one place, so of that word's two halves one is the same in both,
   at the same end. Each word goes, in class c = its length and in class c =
   its length - 1, to the group of its left half and to that of its right
   half. What the group shares is left out; the rest is the *hole*. A group of
   more than ``group_words`` words is halved again: the one difference lies in
   the hole, so half of the hole is shared too. This ends, at holes of one
   letter (two in the longer words), where a group is bounded by the alphabet.
   So no task meets a hot prefix or suffix as a whole, and no two blocks of a
   group have to be held against each other.
3. Inside a group the holes are indexed by position: for each (position,
   letter) the set of words that have it there, as one bit a word. A query
   reads its letters once and carries four sets for all words of the group at
   the same time: no error so far; one letter replaced; one letter of the word
   extra (positions shifted by one to the right); one missing (shifted to the
   left). A letter costs a handful of operations on whole bitsets.
4. Near words are counted and the best is kept by one aggregation; roots come
   from pointer jumping over the words that have a form (counts at least
   double along a chain, so a chain has at most 63 steps, 6 jumps).

A pair meets in both halves when the letter is put in at the border of the
halves; the right half's group then leaves it out, so every pair counts once.

Cases: null and empty texts have no words; very long texts are read whole, and
very long words are words; ties go to the smaller word in code-point order;
repeated rows and rows that share a doc_id count each time; a null doc_id is
written as nothing where ``typo`` hashes it. An empty table gives an empty
result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship, stash
from equiloan.llm.textops import texts

MIN_LETTERS = 5
MIN_COUNT = 3
RATIO = 2
GROUP_WORDS = 16_384
#: Entries of a task's counting table before it is handed on.
TABLE_WORDS = 300_000
#: Keys of large groups that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000

#: [A-Za-zÀ-ÿ]+ in UTF-8.
_RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")


# --- counting --------------------------------------------------------------------

def typo(doc_id: int | None) -> Callable[[bytes], bytes]:
    """The words of one document with a letter left out of one in 97."""
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))

    def change(word: bytes) -> bytes:
        h = zlib.crc32(word, start)
        if h % 97:
            return word
        letters = word.decode()
        at = h % len(letters)
        return (letters[:at] + letters[at + 1:]).encode()

    return change


def _letters(word: bytes) -> int:
    return len(word) - word.count(b"\xC3")


def _count_task(min_letters: int, change_of: Callable[[int | None], Callable[[bytes], bytes]] | None):
    def table(held: Counter) -> pa.RecordBatch:
        words = list(held)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()),
                                           pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, text in zip(ids, texts(batch), strict=True):
                change = change_of(doc_id) if change_of else None
                for word, n in Counter(_RUN.findall(text.lower())).items():
                    if change:
                        word = change(word)
                    if len(word) >= min_letters and _letters(word) >= min_letters:
                        held[word] += n
                if len(held) > TABLE_WORDS:
                    yield table(held)
                    held = Counter()
        yield table(held)
    return run


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
               change_of: Callable[[int | None], Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """word, n: the words with enough letters and occurrences in all texts."""
    ship(docs.sparkSession)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _count_task(min_letters, change_of), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- the index ---------------------------------------------------------------------

class PositionIndex:
    """For each (position, letter) the set of words that have that letter
    there: bit i stands for the i-th word."""

    def __init__(self, words: list[str]):
        self.slices: dict[tuple[int, str], int] = {}
        self.lengths: dict[int, int] = {}
        self.all = (1 << len(words)) - 1
        for i, word in enumerate(words):
            bit = 1 << i
            self.lengths[len(word)] = self.lengths.get(len(word), 0) | bit
            for place in enumerate(word):
                self.slices[place] = self.slices.get(place, 0) | bit

    def search(self, query: str) -> tuple[int, int]:
        """(words exactly one error from the query, words that begin with it)."""
        held = self.slices.get
        exact, replaced, extra, missing = self.all, 0, 0, 0
        for i, letter in enumerate(query):
            here, right = held((i, letter), 0), held((i + 1, letter), 0)
            left = held((i - 1, letter), 0)
            missing = (missing & left) | exact
            extra = (extra | exact) & right
            replaced = (replaced & here) | (exact & ~here)
            exact &= here
        n, size = self.lengths.get, len(query)
        near = (replaced & n(size, 0)) | (missing & n(size - 1, 0)) | ((extra | exact) & n(size + 1, 0))
        return near, exact


def members(bits: int) -> Iterator[int]:
    """The numbers of the set bits."""
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _near_in_group(rows: list[tuple[str, int]], c: int, a: int, b: int) -> Iterator[tuple[str, str, int]]:
    """(word, near, n of near) in both directions, for the pairs of the group
    whose shorter word has c letters."""
    if len(rows) < 2:
        return
    holes = [w[a:len(w) - b] for w, _ in rows]
    index = PositionIndex(holes)
    for i, (word, n) in enumerate(rows):
        if len(word) != c:
            continue
        near, begins = index.search(holes[i])
        if b:  # shares all letters left of the right part: the left half's group has it
            near &= ~begins
        for k in members(near):
            other, m = rows[k]
            yield word, other, m
            if len(other) > c:
                yield other, word, n


_NEAR = "word string, near string, near_n long"
_NEAR_ARROW = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _search_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups arrive one after another (sorted by key) and may span batches."""
    key, place, rows, out = None, (0, 0, 0), [], []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for next_key, word, n, c, a, b in zip(*columns, strict=True):
            if next_key != key:
                out += _near_in_group(rows, *place)
                key, place, rows = next_key, (c, a, b), []
                if len(out) > 50_000:
                    yield _near_batch(out)
                    out = []
            rows.append((word, n))
    out += _near_in_group(rows, *place)
    yield _near_batch(out)


def _near_batch(out: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _NEAR_ARROW, strict=True)],
                                      schema=_NEAR_ARROW)


# --- groups ------------------------------------------------------------------------

def _halved(rows: DataFrame) -> DataFrame:
    """Rows (word, n, c, a, b) in the groups of both halves of their hole;
    a and b letters are shared at the left and right end."""
    half = F.floor((F.col("c") - F.col("a") - F.col("b")) / F.lit(2)).cast("int")
    rest = F.col("c") - F.col("a") - F.col("b") - half
    sides = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")),
                    F.struct(F.col("a").alias("a"), (F.col("b") + rest).alias("b")))
    wide = rows.select("word", "n", "c", F.explode(sides).alias("side")).select(
        "word", "n", "c", F.col("side.a").alias("a"), F.col("side.b").alias("b"))
    shared = F.concat_ws("|", "c", "a", "b", F.substr("word", F.lit(1), F.col("a")),
                         F.substr("word", F.char_length("word") - F.col("b") + 1, F.col("b")))
    return wide.withColumn("key", shared)


def near_pairs(vocab: DataFrame, min_letters: int = MIN_LETTERS, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, near, near_n: every ordered pair of words one error apart, once.
    ``vocab`` (word, n) should be a stored table."""
    size = F.char_length("word")
    zero = F.lit(0)
    rows = (vocab.withColumn("c", F.explode(F.array(size, size - 1))).filter(F.col("c") >= min_letters)
            .select("word", "n", "c", zero.alias("a"), zero.alias("b")))
    found: DataFrame | None = None
    while True:
        grouped = _halved(rows)
        large = stash(grouped.filter(F.col("c") - F.col("a") - F.col("b") > 1).groupBy("key")
                      .agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > group_words).select("key"),
                      "large-groups")
        n = large.count()
        keys = F.broadcast(large) if n <= BROADCAST_KEYS else large
        ready = grouped.join(keys, "key", "left_anti") if n else grouped
        part = (ready.select("key", "word", "n", "c", "a", "b").repartition("key").sortWithinPartitions("key")
                .mapInArrow(_search_task, _NEAR))
        found = part if found is None else found.unionByName(part)
        if not n:
            return found
        rows = grouped.join(keys, "key", "left_semi").select("word", "n", "c", "a", "b")


# --- forms and roots -----------------------------------------------------------------

def roots(links: DataFrame) -> DataFrame:
    """word, root from (word, form): forms followed to the last, by pointer
    jumping. ``links`` should be a stored table."""
    at = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        at = stash(at.join(ahead, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO,
                      change_of: Callable[[int | None], Callable[[bytes], bytes]] | None = None,
                      group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.
    ``change_of`` (a module-level function of doc_id that gives a function of
    a lower-cased word) may change words before they are counted."""
    vocab = stash(vocabulary(docs, min_letters, min_count, change_of), "vocabulary")
    near = near_pairs(vocab, min_letters, group_words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    judged = vocab.join(best, "word", "left")
    takes = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    words = stash(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(words.filter("form is not null").select("word", "form"))
    return words.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
