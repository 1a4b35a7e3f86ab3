import random

import numpy as np
import pytest
from llm_frames import ODD, docs_frame
from pyspark.sql import functions as F

from equiloan.llm import langid, quality, topk, toxicity
from equiloan.llm.runtime import fold
from equiloan.llm.sampling import bounded_sample

VOCABULARY = {"en": ["the", "and", "house", "with", "thing"], "de": ["der", "und", "Haus", "nicht", "schön"],
              "fr": ["le", "maison", "être", "avec", "où"]}


def _talk(rng, lang, n=30):
    return " ".join(rng.choices(VOCABULARY[lang], k=n))


def test_language_id_held_out_accuracy_and_odd_texts(spark):
    rng = random.Random(1)
    rows = [(1000 + i, _talk(rng, g), g, "s") for i in range(150) for g in [rng.choice(list(VOCABULARY))]]
    rows += [(5000, "1234 ... \n", "en", "s"), (5001, None, "en", "s"), (5002, "", None, "s"), (5003, "le", None, "s")]
    out = {r["doc_id"]: r for r in langid.language_id(docs_frame(spark, rows), fold("doc_id", 5) == 0).collect()}
    assert len(out) == len(rows)
    held = [(out[i]["lang_pred"], g) for i, _, g, _ in rows[:150] if out[i]["held_out"]]
    assert held and all(a == b for a, b in held)
    assert all((out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0) for i in (5000, 5001, 5002))
    assert out[5003]["lang_pred"] in VOCABULARY and 0 <= out[5003]["score"] <= 1


def test_language_id_rows_empty_and_unlabelled(spark):
    assert langid.language_id(docs_frame(spark, []), fold("doc_id", 5) == 0).count() == 0
    got = langid.language_id(docs_frame(spark, ODD), fold("doc_id", 5) == 0).collect()
    assert len(got) == len(ODD)
    blind = docs_frame(spark, [(1, "some words", None, "a")])
    assert [r["lang_pred"] for r in langid.language_id(blind, F.lit(False)).collect()] == ["und"]
    one = docs_frame(spark, [(1, "some words", "en", "a"), (2, "more", None, "a")])
    assert {r["lang_pred"] for r in langid.language_id(one, F.lit(False)).collect()} == {"en"}


def test_features_do_not_depend_on_neighbours():
    docs = [b"some text", b"", b"x", "é à".encode()]
    together = langid.features(docs)
    for i, d in enumerate(docs):
        assert np.array_equal(together[i], langid.features([d])[0])


@pytest.mark.parametrize("classes", [2, 3, 6, 9, 20])
def test_codewords(classes):
    code = langid.codewords(classes)
    assert len({tuple(r) for r in code.tolist()}) == classes
    gaps = (code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(classes, dtype=bool)]
    assert gaps.min() >= max(1, 2 ** (classes - 2) if classes <= 6 else 5)


def test_decoding_corrects_a_wrong_bit():
    code = langid.codewords(5)
    margin = code.astype(float).copy()
    margin[:, 0] *= -1
    best, _, score, _ = langid.decode(margin, code, np.full(code.shape[1], 1 / code.shape[1]), 1.0)
    assert best.tolist() == list(range(5)) and (score <= 1).all()


def _toxic_rows(rng, n=400):
    calm = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(calm, k=rng.randint(3, 200))
        bad = rng.random() < 0.25
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Vilest", "nastyword", "horrid"])
        rows.append((i, " ".join(words), "en", "s"))
        if rng.random() < 0.6:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out_and_odd_rows(spark):
    rng = random.Random(2)
    rows, labels = _toxic_rows(rng)
    truth = {i: any(w in t.lower() for w in ("vilest", "nastyword", "horrid")) for i, t, *_ in rows}
    extra = [(10_000 + n, *r[1:]) for n, r in enumerate(ODD)] + [(None, "vilest", "en", "s"), (3, "repeated id", "en", "s")]
    marks = spark.createDataFrame([*labels, (4, None, None), (None, 1, 1), (5, 0, 1), (5, 0, 0)],
                                  "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs_frame(spark, rows + extra), marks, fold("doc_id", 3) == 1).collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    # The same text scores the same wherever it stands.
    again = toxicity.toxicity(docs_frame(spark, rows + extra).repartition(5), marks, fold("doc_id", 3) == 1).collect()
    key = lambda rs: sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in rs)
    assert key(got) == key(again)


def test_near_copies_are_found():
    rng = random.Random(8)
    base = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=120)).encode() for _ in range(40)]
    copies = [b.replace(b"w3 ", b"w4 ", 1) for b in base[:20]]
    docs = [*base, *copies, b"", b"one", b"ONE", b"two words"]
    keep = toxicity.apart(np.zeros(len(docs), int), toxicity.copy_keys(docs))
    assert keep[:40].sum() >= 38 and keep[40:60].sum() <= 2
    assert keep[60:].tolist() == [False, True, False, True]
    assert np.array_equal(toxicity.copy_keys(docs)[41], toxicity.copy_keys([docs[41]])[0])


def test_non_negative_risk_keeps_bias_sane():
    rng = np.random.default_rng(0)
    label = np.array([1] * 50 + [0] * 500)
    rows = [[7] if (y == 1 or rng.random() < 0.1) else [int(rng.integers(100, 200))] for y in label]
    flat = np.array([x for r in rows for x in r], np.int32)
    w, bias = toxicity.fit_pu(label, flat, np.arange(len(label) + 1), prior=0.3)
    assert w[7] + bias > 0.8 and bias < 0


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, None)], [(1, 0, 1)]])
def test_classifiers_with_hardly_any_labels(spark, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_frame(spark, ODD)
    for out in (toxicity.toxicity(docs, marks, F.lit(False)), quality.quality(docs, marks, F.lit(False))):
        rows = out.collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    empty = docs_frame(spark, [])
    assert toxicity.toxicity(empty, marks, F.lit(False)).count() == 0
    assert quality.quality(empty, marks, F.lit(False)).count() == 0


def test_quality_held_out(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = ["w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(5, 80))]
        junk = rng.random() < 0.4
        if junk:
            words = rng.choice([[w.upper() + "!!" for w in words], [words[0]] * len(words), ["|".join(words)] * 2])
        rows.append((i, " ".join(words), "en", "s"))
        if rng.random() < 0.8:
            labels.append((i, int(not junk), 0))
    truth = {i: q for i, q, _ in labels}
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality(docs_frame(spark, rows), marks, fold("doc_id", 4) == 2).collect()
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_bounded_sample(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4900, "a").otherwise("b").alias("g"))
    got = {r["g"]: r["count"] for r in bounded_sample(rows, 400, by="g").groupBy("g").count().collect()}
    assert got["b"] == 100 and 140 < got["a"] < 260
    assert 300 < bounded_sample(rows, 400).count() < 500
    assert bounded_sample(rows, 400).count() == bounded_sample(rows.repartition(9), 400).count()


def _top(rows, k):
    import math

    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, x in fine:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("blocks", [(1024, 16384), (2, 23)])
def test_top_k_matches_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 0.2, (6, 40))
    rows = [(i, [float(x) for x in (base[i % 6] + rng.normal(0, 0.05, 40)).astype(np.float32)]) for i in range(250)]
    rows += [(300 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(400, None), (401, [None] * 40), (402, [float("nan")] * 40), (403, [float("inf")] + [0.0] * 39),
             (None, [0.5] * 40), (500, [0.25] * 7), (404, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, v string")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, 10, 1024, *blocks).collect()
    assert {tuple(r) for r in got} == _top(rows, 10) and len(got) == len(_top(rows, 10))


def test_top_k_few_rows_and_large_numbers(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    rows = [(0, [1e6, 3.0]), (1, [1e6, 1.0]), (2, [-1e6, 2.0])]  # products beyond 2^53
    got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect()
    assert {tuple(r) for r in got} == _top(rows, 10)


def test_samples_are_bounded_for_repeated_and_null_ids(spark):
    """A third of the rows hold one null id, a third are one row again and
    again: each text counts once, and the null rows are neither all in nor out."""
    from equiloan.llm.sampling import bounded_sample

    rows = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END AS doc_id",
        "CASE WHEN id % 3 = 1 THEN 'again' ELSE concat('text ', id) END AS text", "CAST(id % 2 AS INT) AS label")
    got = bounded_sample(rows.select("doc_id", "text"), 600).collect()
    assert 480 < len(got) < 720 and 200 < sum(r["doc_id"] is None for r in got) < 400
    assert sum(r["text"] == "again" for r in got) <= 1
    by = bounded_sample(rows, 600, by="label").collect()
    assert 480 < len(by) < 720 and 200 < sum(r["label"] for r in by) < 400
    assert bounded_sample(rows.select("doc_id", "text"), 10_000).count() == 4001
    assert bounded_sample(rows.limit(0), 10, by="label").count() == 0
