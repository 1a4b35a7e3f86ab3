import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_frames import ODD, docs_frame

from equiloan.llm import nearsig, runindex
from equiloan.llm.components import connected_components

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _near(rows, width, percent):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        sets.append({tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width
                    else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            same = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            if same or (c and 100 * c >= percent * len(sets[a] | sets[b])):
                parent[find(a)] = find(b)
    best = {}
    for n, (i, *_) in enumerate(rows):
        if i is not None:
            best[find(n)] = min(best.get(find(n), i), i)
    return sorted([(i, len(sets[n]), i if not sets[n] else best.get(find(n), i)) for n, (i, *_) in enumerate(rows)],
                  key=repr)


def _copies():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.randint(3, 150))
        for _ in range(rng.choice([1, 2, 25])):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(w).title(), "en", f"s{base}"))
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_match_brute_force(spark, width):
    rows = ODD + _copies()
    got = nearsig.near_duplicates(docs_frame(spark, rows).repartition(6), width=width, percent=80)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == _near(
        rows, width, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_near_duplicates_empty(spark):
    assert nearsig.near_duplicates(docs_frame(spark, [])).count() == 0


def test_index_keys_meet_within_the_distance():
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 16, (200, 36)).astype(np.uint16)
    other = sig.copy()
    for row in other:
        row[rng.permutation(36)[:17]] += 1
    a, b = nearsig.index_keys(sig, 6, 2), nearsig.index_keys(other, 6, 2)
    assert (a == b).any(axis=1).all()
    assert (np.argmax(a == b, axis=1) == nearsig.first_shared(sig != other, 6, 2)).all()


def test_long_signatures_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    floor = nearsig.long_floor(80)
    for _ in range(60):
        common = rng.integers(0, 2**64, 400, dtype=np.uint64)
        a, b = (np.concatenate((common, rng.integers(0, 2**64, 50, dtype=np.uint64))) for _ in range(2))
        x, y = (np.frombuffer(nearsig.long_signature(s), np.uint8) for s in (a, b))
        assert nearsig._AGREE[x ^ y].sum() >= floor


def test_buckets_across_batches():
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted((rng.randrange(30), rng.randrange(1000)) for _ in range(200))
    rows = sorted(set(rows))
    batches = []
    at = 0
    while at < len(rows):
        n = rng.randint(1, 9)
        part = rows[at:at + n]
        batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part])],
                                                  names=["key", "node"]))
        at += n
    got = sorted(tuple(r.values()) for b in nearsig._buckets(batches) for r in b.to_pylist())
    groups = {}
    for k, n in rows:
        groups.setdefault(k, []).append(n)
    assert got == sorted((k, n) for k, v in groups.items() if len(v) > 1 for n in v)


def test_mixed_buckets_are_compared_in_bounded_groups(spark):
    """Any two rows of different components of a bucket meet in one group, and
    no group holds much more than two blocks."""
    rows = [(1, n, 7 if n % 3 else n, 900) for n in range(900)] + [(2, n, n, 40) for n in range(40)]
    got = nearsig.spread(spark.createDataFrame(rows, "key long, node long, component long, n long"), 50).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["key"], r["i"], r["j"]), []).append((r["node"], r["component"], r["second"]))
    assert max(map(len, groups.values())) < 4 * 50
    assert sorted(g for g in groups if g[0] == 2) == [(2, 0, 0)] and len(groups) > 50
    met = Counter()
    for (key, i, j), members in groups.items():
        for a, x, s in members:
            for b, y, t in members:
                met[key, a, b] += a < b and x != y and (i == j or s != t)
    for key, n in ((1, 900), (2, 40)):
        comp = {r[1]: r[2] for r in rows if r[0] == key}
        assert all(met[key, a, b] == (comp[a] != comp[b]) for a in range(n) for b in range(a + 1, n))


def test_near_duplicates_do_not_depend_on_the_blocks(spark):
    """A template family whose members differ by more than the threshold."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(60), rng.choice((1, 2, 3, 4))):
            words[at] = f"v{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(words), "en", "web"))
    frame = docs_frame(spark, rows)
    want = _near(rows, 4, 80)
    for block_rows in (5, 4096):
        got = nearsig.near_duplicates(frame, width=4, percent=80, block_rows=block_rows).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 150)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 150, 150: 150}


def _passages(rows, length):
    bodies = [(t or "").encode() for _, t, *_ in rows]
    count = Counter(b[i:i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(rows, bodies):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if count[b[j:j + length]] > 1:
                gone[j:j + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _passage_rows():
    rng = random.Random(6)
    letters = "abcdefgh é"
    text = lambda n: "".join(rng.choices(letters, k=n))
    shared = [text(n) for n in (60, 130, 205, 400)]
    rows = []
    for i in range(60):
        rows.append((300 + i, "".join(x for _ in range(rng.randint(1, 3)) for x in (text(rng.randint(0, 90)), rng.choice(shared))),
                     "en", "a"))
    return rows + [(900, "ab" * 300, "en", "a"), (901, "z" * 199, "en", "a"), (902, "z" * 200, "en", "a")]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 19), (4000, 700)])
@pytest.mark.parametrize("length,seed", [(200, 64), (60, 16)])
def test_passages_match_brute_force(spark, sizes, length, seed):
    """In one shard, and with anchors cut finer over many shards."""
    rows = [r for r in ODD if r[0] != 7] + _passage_rows()
    got = runindex.suffix_dedup(docs_frame(spark, rows).repartition(5), length, seed, *sizes)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == _passages(rows, length)


def test_passages_empty(spark):
    assert runindex.suffix_dedup(docs_frame(spark, [])).count() == 0


def test_run_index_against_plain_search():
    rng = random.Random(7)
    for _ in range(30):
        pool = ["".join(rng.choices("ab", k=rng.randint(5, 60))) for _ in range(4)]
        bodies = sorted({("".join(rng.choices(pool, k=2)) + rng.choice(pool)[:9]).encode() for _ in range(12)})
        rng.shuffle(bodies)
        index = runindex.RunIndex(bodies)
        assert int(index.lengths.sum()) == len(index.text)
        n = 20
        count = Counter(b[i:i + n] for b in bodies for i in range(len(b) - n + 1))
        want = [count[b[i:i + n]] > 1 if i + n <= len(b) else False for b in bodies for i in range(len(b) + 1)]
        assert index.repeated(n).tolist() == want


def test_settle_hot_key_in_pieces(monkeypatch):
    """A key with more rows than may be held gives the same rows."""
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted((rng.choice([1, 1, 1, 2, 3]), rng.randrange(40)) for _ in range(150))
    def batches():
        for at in range(0, len(rows), 7):
            part = rows[at:at + 7]
            zero = [0] * len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(([r[0] for r in part], [r[1] for r in part], zero,
                                                      list(range(at, at + len(part))), *[zero] * 6), runindex._ROW)],
                schema=runindex._ROW)
    def out():
        return sorted((r["kind"], r["doc_id"]) for b in runindex._settle(batches()) for r in b.to_pylist())
    whole = out()
    monkeypatch.setattr(runindex, "HELD_ROWS", 10)
    assert out() == whole
