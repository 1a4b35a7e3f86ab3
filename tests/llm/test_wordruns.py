import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_frames import ODD, docs_frame

from equiloan.llm import wordruns


def _brute(ids, least=12):
    """Runs from the definition: maximal stretches of equal words q apart, the
    smallest period of each."""
    n, best = len(ids), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and ids[i] == ids[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                best.setdefault((s, i + q), q)
    return sorted((s, e, q) for (s, e), q in best.items())


def _words(rng):
    """Random words with repeated, nested and broken-off periodic parts."""
    out, letters = [], rng.choice([1, 2, 3, 6, 40])
    while len(out) < rng.choice([5, 30, 120, 300]):
        part = [rng.randrange(letters) for _ in range(rng.randrange(1, 15))]
        if rng.random() < 0.4 and out:
            a = rng.randrange(len(out))
            part = out[a:a + rng.randrange(1, 40)]
        out += part * rng.choice([1, 1, 2, 3, 7]) + part[:rng.randrange(len(part) + 1)]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_match_definition(seed):
    rng = random.Random(seed)
    for _ in range(60):
        ids, least = _words(rng), rng.choice([12, 12, 4, 2, 7])
        assert wordruns.runs_of(ids, least) == _brute(ids, least)


def test_grammar_spells_the_sequence():
    rng = random.Random(5)
    for _ in range(100):
        ids = _words(rng)
        g = wordruns.Grammar(ids)

        def spell(s, g=g):
            return [s] if s < g.base else spell(g.left[s - g.base]) + spell(g.right[s - g.base])

        assert spell(g.root) == ids
        for k, at in enumerate(g.occurrences()):
            for a in at.tolist():
                assert ids[a:a + g.size[k]] == spell(g.base + k)


def test_stretches_hold_every_run():
    rng = random.Random(9)
    for _ in range(80):
        ids = _words(rng)
        h = wordruns.mix(np.array(ids, np.uint64) + np.uint64(77))
        cut = wordruns.stretches(h, np.zeros(len(ids), np.int64))
        got = [(s + a, e + a, q) for a, b in cut for s, e, q in wordruns.runs_of(ids[a:b])]
        assert sorted(got) == _brute(ids)


def _expected(doc_id, text, plant=True):
    own = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(own)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = own[:a] + [own[a + (i - a) % p] for i in range(a, n)]
    runs = _brute(own) if n < 3000 else [(0, n, 1)]  # the one long text repeats a word
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    kept = " ".join(w for i, w in enumerate(own) if i not in gone)
    best = (None,) * 4
    if runs:
        s, e, q = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]))
        best = (s, e - s, q, 1000 * (e - s) // q)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
    return (doc_id, len(runs), *best, *sha)


def test_query_matches_definition(spark):
    rng = random.Random(2)
    rows = ODD + [(100 + i, rng.choice([" ", "\n", " \t"]).join(f"w{k}" for k in _words(rng)), "en", "a")
                  for i in range(150)]
    rows += rows[-20:] + [(None, "a b " * 30, "en", "a")]
    got = wordruns.periodic_runs(docs_frame(spark, rows).repartition(5), order_of=wordruns.planted).collect()
    want = sorted((_expected(i, t) for i, t, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert sum(r[1] for r in want) > 200
    plain = wordruns.periodic_runs(docs_frame(spark, rows[:60])).collect()
    assert sorted((tuple(r) for r in plain), key=repr) == sorted((_expected(i, t, False) for i, t, *_ in rows[:60]), key=repr)


def test_empty_table_and_words_alike_but_not_equal(spark):
    assert wordruns.periodic_runs(docs_frame(spark, [])).count() == 0
    text = " ".join(["é", "É", "é"] * 5)
    assert wordruns.periodic_runs(docs_frame(spark, [(1, text, None, None)])).first()["period"] == 3


def test_long_periodic_text():
    rng = random.Random(4)
    part = [rng.randrange(5000) for _ in range(7000)]
    ids = list(range(6000, 6500)) + part * 4 + part[:100] + list(range(7000, 7200))
    assert (500, 500 + 28100, 7000) in wordruns.runs_of(ids)
