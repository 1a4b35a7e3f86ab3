import hashlib
import random

import pytest
from llm_frames import LONG_LINE, ODD, docs_frame

from equiloan.llm import contentsort, linededup

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _norm(t):
    return (t or "").translate(ASCII_LOWER)


def _exact(rows, keep):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(_norm(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[_norm(t)] if x is not None]
        stay = (max(ids) if keep == "largest" else min(ids)) if ids else None
        out.append((i, stay, len(groups[_norm(t)]), i == stay, hashlib.sha256(_norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_content_sort_matches_grouping(spark, keep):
    rng = random.Random(1)
    rows = ODD + [(100 + i, rng.choice(["Copy A", "copy a", "B " * 50, "ÄB", "äb", ""]), "en", "a") for i in range(300)]
    df = docs_frame(spark, rows).repartition(7)
    got = contentsort.content_sort(df, keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == _exact(rows, keep)


def test_content_sort_empty(spark):
    assert contentsort.content_sort(docs_frame(spark, [])).count() == 0


BLANK = " \t\n\x0b\x0c\r"


def _lines(rows, min_chars, min_docs):
    holders = {}
    for i, t, *_ in rows:
        for k in {_norm(x.strip(BLANK)) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t, *_ in rows:
        parts = (t or "").split("\n")
        keys = [_norm(x.strip(BLANK)) for x in parts]
        stay = [x for x, k in zip(parts, keys) if k not in last or i is None or last[k] == i]
        out.append((i, len(parts), len(parts) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


def _line_rows():
    rng = random.Random(2)
    pool = [LONG_LINE, f"  {LONG_LINE.upper()}\r", "é" * 41, "é" * 39, "a line that is long enough to be counted once",
            "short", "", "another shared line of more than forty characters"]
    return ODD + [(50 + i, "\n".join(rng.choices(pool, k=rng.randint(1, 6)) + [f"line {i} of its own, long enough to count"]),
                   "en", "a") for i in range(40)]


@pytest.mark.parametrize("filter_bytes", [linededup.FILTER_BYTES, 0])
def test_line_dedup_matches_brute_force(spark, filter_bytes, monkeypatch):
    """With the filters broadcast and, above their size bound, by shard, with
    shards of two keys and groups of three lines."""
    if not filter_bytes:
        monkeypatch.setattr(linededup, "SHARD_KEYS", 2)
        monkeypatch.setattr(linededup, "PROBE_ROWS", 3)
    rows = _line_rows()
    got = linededup.line_dedup(docs_frame(spark, rows).repartition(5), filter_bytes=filter_bytes)
    got = got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == _lines(rows, 40, 5)


def test_line_dedup_empty(spark):
    assert linededup.line_dedup(docs_frame(spark, [])).count() == 0


def test_line_index_is_reversible(spark):
    rows = _line_rows()
    first, second = docs_frame(spark, rows[:35]), docs_frame(spark, rows[35:])
    index = linededup.LineIndex(spark).insert(first)
    before = sorted(map(tuple, index.counts().collect()))
    index.insert(second)
    both = sorted((tuple(r) for r in index.dedup(docs_frame(spark, rows)).select(
        "doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)
    assert both == _lines(rows, 40, 5)
    index.delete([i for i, *_ in rows[35:]])
    assert sorted(map(tuple, index.counts().collect())) == before


def test_cuckoo_filter():
    import numpy as np

    keys = np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64)
    f = linededup.CuckooFilter(1000)  # overfull on purpose: it grows
    f.insert(keys)
    f = linededup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys).all()
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all()
    assert f.contains(keys[:2500]).mean() < 0.05


def test_rows_of_one_document_count_once(spark):
    line = LONG_LINE + " once more"
    rows = [(1, line, "en", "a")] * 3 + [(2, line, "en", "a"), (3, line, "en", "a")]
    df = docs_frame(spark, rows)
    assert {r["n_dropped"] for r in linededup.line_dedup(df).collect()} == {0}
    five = docs_frame(spark, rows + [(4, line, "en", "a"), (None, line, "en", "a"), (None, line, "en", "a")])
    got = sorted(((r["doc_id"] or 0, r["n_dropped"]) for r in linededup.line_dedup(five).collect()))
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
    index = linededup.LineIndex(spark).insert(df).insert(df)
    assert [r["n_docs"] for r in index.counts().collect()] == [3]


def _slots(index):
    """(keys the filters say they hold, fingerprints in their tables)."""
    held = [(r["keys"], int((linededup.CuckooFilter.from_bytes(bytes(r["filter"])).table != 0).sum()))
            for r in index.filters.table.collect()]
    return sum(k for k, _ in held), sum(n for _, n in held)


@pytest.mark.parametrize("shard_keys", [1, 50_000])
def test_stored_filters_follow_insertions_and_deletions(spark, shard_keys, monkeypatch):
    """The stored filters hold exactly the repeated keys after every change,
    whether changed in place or built anew with more shards, and a dedup that
    probes them by shard equals the brute force over the documents held."""
    monkeypatch.setattr(linededup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(linededup, "PROBE_ROWS", 5)
    rows = [r for r in _line_rows() if r[0] is not None]
    index = linededup.LineIndex(spark, filter_bytes=0)
    assert _slots(index) == (0, 0)
    index.insert(docs_frame(spark, rows[:30])).insert(docs_frame(spark, rows[30:]))
    n = index.counts().filter("n_docs >= 5").count()
    assert n >= 4 and _slots(index) == (n, n)
    assert (index.filters.shards > 1) == (shard_keys == 1)
    got = index.dedup(docs_frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _lines(rows, 40, 5)
    left = rows[:18]
    index.delete({i for i, *_ in rows[18:]} - {i for i, *_ in left})
    fewer = index.counts().filter("n_docs >= 5").count()
    assert fewer < n and _slots(index) == (fewer, fewer)
    got = index.dedup(docs_frame(spark, left)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _lines(left, 40, 5)
    index.delete([i for i, *_ in rows])
    assert index.counts().count() == 0 and _slots(index) == (0, 0)
    assert index.dedup(docs_frame(spark, [])).count() == 0


def test_filter_tables_survive_many_changes():
    import numpy as np

    rng = np.random.default_rng(3)
    f, held = linededup.CuckooFilter(64), set()
    for _ in range(60):
        new = rng.integers(0, 2**64, 20, dtype=np.uint64)
        f.insert(new)
        held |= set(new.tolist())
        old = np.array(sorted(held), np.uint64)[rng.permutation(len(held))[:15]]
        f.delete(old)
        held -= set(old.tolist())
        assert f.contains(np.array(sorted(held), np.uint64)).all()
    assert int((f.table != 0).sum()) == len(held)
