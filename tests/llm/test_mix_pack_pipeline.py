import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_frames import ODD, docs_frame

import corpus_pipeline
from equiloan.llm import mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def _targets(sizes, weights=(1, 2, 3), limit=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(out.values())
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > limit * sizes[s]}
        if not over:
            out.update({s: level * w[s] for s in free})
            break
        out.update({s: limit * sizes[s] for s in over})
        free -= over
    return out


def _mix_rows():
    rng = random.Random(1)
    return [r for r in ODD if r[0] != 7] + [
        (100 + i, "w " * rng.randint(0, 40), "en", rng.choice(["hot"] * 6 + ["b", "c", "d", "E", None])) for i in range(900)]


@pytest.mark.parametrize("block_rows,fan", [(mixing.BLOCK_ROWS, 64), (40, 3)])
def test_mixing(spark, block_rows, fan):
    rows = _mix_rows()
    df = docs_frame(spark, rows)
    got = mixing.mix_sources(df.repartition(6), block_rows=block_rows, fan=fan).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = _targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        ratio = want[r["source"]] / max(sizes[r["source"]], 1)
        if r["size"]:
            assert np.floor(ratio) <= r["copies"] <= np.ceil(ratio + 1e-9)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    again = mixing.mix_sources(df.repartition(3), block_rows=block_rows, fan=fan).collect()
    key = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rs)
    assert key(got) == key(again)


def test_pivot_keeps_expectations():
    hits, n = np.zeros(5), 4000
    part, size = [0.2, 0.5, 0.7, 0.35, 0.9], [3, 10, 4, 7, 2]
    for seed in range(n):
        decided, open_row, p = mixing.pivot(range(5), part, size, seed)
        hits += [decided.get(i, p if i == open_row else None) for i in range(5)]
        mass = sum(decided.get(i, p if i == open_row else 0) * size[i] for i in range(5))
        assert abs(mass - np.dot(part, size)) < 1e-6
    assert np.abs(hits / n - part).max() < 0.03


def test_mixing_empty(spark):
    assert mixing.mix_sources(docs_frame(spark, [])).count() == 0
    assert mixing.mixed(docs_frame(spark, [])).count() == 0


def test_mixed_repeats_whole_rows(spark):
    rows = _mix_rows()
    df = docs_frame(spark, rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = sum(r["copies"] for r in mixing.mix_sources(df).collect())
    assert out.count() == copies


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    encoder = packing.WordEncoder(PATH)
    rng = random.Random(2)
    letters = "abcDEFghiéÉßçñÜœŒ'.,;!?-_0123456789$%&\"()[]{}|#@²½ªºµ×÷İıſŉΣσς中文あ한😀́‍\u0000\x1c\x85 "
    words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(4000)]
    words += ["it's", "'Tis", "we'll'd", "I'VE", "don't.", "<|endoftext|>", "a<|startoftext|>b", "x" * 900, "...", "ΟΔΟΣ"]
    for text in words + [" ".join(rng.choices(words, k=8)) for _ in range(300)]:
        parts = [encoder._other(w) for w in re.split("[ \t\n\r\x0b\x0c]+", text) if w] if packing._NOT_SPACE.search(
            text) else [encoder[w] for w in text.split()]
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def _check_packing(rows, got, length):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    want = sorted((i if i is not None else -1, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2]))
                  for i, t, *_ in rows)
    by_doc = {}
    for i, ids in want:
        by_doc.setdefault(i, []).append(ids)
    for r in got:
        i = r["doc_id"] if r["doc_id"] is not None else -1
        crcs = {zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
                for ids in by_doc[i] if len(ids) == r["doc_tokens"]}
        assert r["ids_crc32"] in crcs
    assert sum(r["length"] for r in got) == sum(len(ids) for _, ids in want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / sum(r["length"] for r in got)


def test_packing(spark):
    rng = random.Random(3)
    rows = ODD + [(100 + i, " ".join(rng.choices(["some", "words", "here", "unbelievably"], k=rng.randint(1, 700))), "en", "a")
                  for i in range(400)]
    df = docs_frame(spark, rows)
    got = packing.pack(df.repartition(4), PATH, length=512, grain=4, block_rows=60).collect()
    assert _check_packing(rows, got, 512) < 0.05


def test_short_documents_are_packed_by_their_exact_lengths(spark):
    """The production parameters: 17 tokens a document, 240 to a sequence."""
    lengths = np.zeros(packing.LENGTH, np.int64)
    lengths[16] = 2400
    lengths[packing.LENGTH - 1] = 3
    exact, patterns = packing.plan(lengths, packing.GRAIN, packing.EXACT)
    assert exact and sum(u for u, _ in patterns) == 13
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["some", "words", "here"], k=16)), "en", "a") for i in range(2400)]
    got = packing.pack(docs_frame(spark, rows), PATH).collect()
    assert _check_packing(rows, got, packing.LENGTH) < 0.01
    mixed = np.zeros(packing.LENGTH, np.int64)
    for n in [rng.choice((rng.randint(1, 256), rng.randint(257, 4096))) for _ in range(3000)]:
        mixed[n - 1] += 1
    exact, patterns = packing.plan(mixed, packing.GRAIN, packing.EXACT)
    total = sum(u * p for u, p in patterns)
    unit = -(-np.arange(1, packing.LENGTH + 1) // packing.GRAIN) - 1
    assert (total[:exact] == mixed[:exact]).all()
    assert (total[exact:] == np.bincount(unit[exact:], weights=mixed[exact:], minlength=256)).all()


def test_packing_empty(spark):
    assert packing.pack(docs_frame(spark, []), PATH).count() == 0


def test_patterns_cover_exactly_and_nearly_without_waste():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 400, 64)
    patterns = packing.solve(counts)
    assert (sum(u * p for u, p in patterns) == counts).all()
    size = np.arange(1, 65)
    assert all((p * size).sum() <= 64 for _, p in patterns)
    used = sum(u for u, _ in patterns)
    assert used <= np.ceil((counts * size).sum() / 64) * 1.02 + 2
    assert packing.solve(np.zeros(8, np.int64)) == []


def test_pipeline_on_awkward_rows(spark, tmp_path):
    rng = random.Random(5)
    talk = [f"w{i}" for i in range(300)]
    rows = list(ODD)
    for i in range(120):
        w = rng.choices(talk, k=rng.randint(20, 80))
        rows.append((100 + i, " ".join(w), "en", f"s{i % 4}"))
        if i % 10 == 0:
            rows.append((400 + i, " ".join(w).upper(), "en", "s1"))
            w[3] = "changed"
            rows.append((600 + i, " ".join(w), "en", "s2"))
        if i % 4 == 1:
            rows.append((800 + i, " ".join([*w, "vileword"]), "en", "s0"))
    marks = [(i, 1, int("vileword" in (t or ""))) for i, t, *_ in rows if i is not None]
    docs_frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == columns and out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name] = [tuple(r) for r in docs.select("doc_id", *(["text"] if name != "pack" else [])).collect()]
    texts = [t or "" for _, t in seen["toxicity"]]
    assert not any("vileword" in t for t in texts) and len(texts) >= len([1 for _, t, *_ in rows if "vileword" not in (t or "")])
    lower = [t.lower() if t and t.isascii() else t or "" for _, t in seen["exact_dedup"]]
    assert len(lower) == len(set(lower))
    kept = {i for i, _ in seen["near_dedup"]}
    assert not any(100 + i in kept and 600 + i in kept for i in range(0, 120, 10))
    assert len(seen["pack"]) >= len(seen["mix"]) > 0


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs = docs_frame(spark, [])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_exact_stage_keeps_one_row_of_every_text(spark):
    rows = [(9, "text A", "en", "a"), (5, "text A", "en", "a"), (5, "text B", "en", "a"), (None, "text A", "en", "b"),
            (None, "TEXT z", None, "b"), (None, "text z", "en", "b"), (5, "Text B", "en", "a"), (7, None, "en", "a"), (8, "", "en", "a")]
    got = corpus_pipeline.exact_dedup(spark, docs_frame(spark, rows), "").collect()
    assert sorted(((r["doc_id"] or 0), (r["text"] or "").lower()) for r in got) == [
        (0, "text z"), (5, "text b"), (8, ""), (9, "text a")]


def test_null_and_repeated_ids_spread_over_blocks(spark, monkeypatch):
    """No group of the first level grows with the rows that share an id."""
    held = []
    plain = mixing._level

    def watched(seed, last):
        run = plain(seed, last)

        def seen(table):
            out = run(table)
            return out.append_column("rows", pa.array([table.num_rows] * table.num_rows, pa.int64()))
        return seen
    monkeypatch.setattr(mixing, "_level", watched)
    monkeypatch.setattr(mixing, "_ROUND", mixing._ROUND + ", rows long")
    stash = mixing.stash

    def kept(df, name):
        out = stash(df, name)
        if name == "mix-level":
            held.append(out.agg({"rows": "max"}).first()[0])
        return out
    monkeypatch.setattr(mixing, "stash", kept)
    rows = [(None if i % 2 else 7, f"word {i} " * (1 + i % 5), "en", "ab"[i % 3 == 0]) for i in range(3000)]
    got = mixing.mix_sources(docs_frame(spark, rows), block_rows=100)
    assert got.count() == 3000 and held[0] < 300
    per = got.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 15 for r in per)
