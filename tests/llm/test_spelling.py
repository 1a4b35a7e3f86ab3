import random
import re
import zlib
from collections import Counter

import pytest
from llm_frames import ODD, docs_frame

from equiloan.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _one_off(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _changed(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1:] if h % 97 == 0 else run


def _expected(rows, letters=5, least=3, ratio=2):
    n = Counter(_changed(i, r.translate(LOWER)) for i, t, *_ in rows for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= least}
    near = {w: [v for v in n if _one_off(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            v = min(others, key=lambda v: (-n[v], v))
            if n[v] >= ratio * n[w]:
                form[w] = v
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def _rows(rng):
    letters = "abé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(150)]
    words += ["running", "runing", "runnning", "runnin", "Running", "ÀRbeit", "arbeit", "Àrbeit", "Arbeits", "aaaaa", "aaaaaa",
              "aaaa", "aaaaaaa", "x" * 400, "x" * 401, "x×y÷zz", "straße", "strasse", "ſtrange", "naïve", "naive"]
    weight = [rng.choice([1, 1, 2, 8, 40]) for _ in words]
    return [(i, " ".join(rng.choices(words, weight, k=rng.randrange(0, 60))), "en", "a") for i in range(200)]


@pytest.mark.parametrize("group_words", [spelling.GROUP_WORDS, 3])
def test_variants_match_definition(spark, group_words):
    rng = random.Random(group_words)
    rows = ODD + _rows(rng)
    rows += [(300 + i, "letters " * 30 + "leters " * 6 + "letrs", "en", "a") for i in range(5)]
    rows += rows[20:40] + [(None, "running runing arbeit " * 3, None, None)]
    got = spelling.spelling_variants(docs_frame(spark, rows).repartition(5), change_of=spelling.typo,
                                     group_words=group_words).collect()
    want = _expected(rows)
    assert sorted(tuple(r) for r in got) == want
    assert sum(r[4] for r in want) > 50 and any(r[2] != r[1] and r[1] for r in want)


def test_every_pair_once_at_any_group_size(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(2, 12))) for _ in range(500)})
    vocab = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long").cache()
    want = sorted((a, b) for a in words for b in words if _one_off(a, b))
    for size in (1, 5, 60, 10_000):
        got = spelling.near_pairs(vocab, 2, size).collect()
        assert sorted((r["word"], r["near"]) for r in got) == want


def test_index_tracks_one_error():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in range(300)]
    index = spelling.PositionIndex(words)
    for query in words[:120] + ["", "abcabcabc"]:
        near, begins = index.search(query)
        assert {words[i] for i in spelling.members(near)} == {w for w in words if _one_off(query, w)}
        assert {words[i] for i in spelling.members(begins)} == {w for w in words if w.startswith(query)}


def test_counting_in_small_tables(spark, monkeypatch):
    rows = _rows(random.Random(3))
    df = docs_frame(spark, rows)
    whole = sorted(map(tuple, spelling.vocabulary(df, 4, 2).collect()))
    task = spelling._count_task(4, None)
    monkeypatch.setattr(spelling, "TABLE_WORDS", 20)
    tables = list(task(df.select("doc_id", "text").toArrow().to_batches()))
    held = Counter()
    for t in tables:
        held.update(dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist())))
    assert len(tables) > 3 and sorted((w, n) for w, n in held.items() if n >= 2) == whole


def test_long_chain_and_empty_table(spark):
    links = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(63)], "word string, form string")
    assert {r["root"] for r in spelling.roots(links).collect()} == {"w63"}
    assert spelling.spelling_variants(docs_frame(spark, [])).count() == 0
    assert spelling.spelling_variants(docs_frame(spark, [(1, None, None, None), (2, "a b c", None, None)])).count() == 0
