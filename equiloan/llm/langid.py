"""Language identification with error-correcting output codes (operator 1).

Each known language has a codeword of ``bits`` signs; one binary n-gram
classifier per bit predicts that sign from hashed byte n-grams of the
lower-cased text. Decoding sums, over the bits, the logistic loss between the
classifier's margin and the codeword's sign, weighted by how reliable the bit
was in training, and takes the codeword with the least loss. A text whose two
best codewords are close is flagged ambiguous.

Codes: up to 6 languages get the exhaustive code (every split of the
languages into two groups); more get the random code of ``10 log2 K`` bits
with the best smallest distance out of a fixed number of draws.

Learning reads a bounded sample (``train_rows``, spread evenly over the
languages); prediction reads every whole text. A null text, or one without
any letter, is ``und`` with score 0. With no labelled row at all everything
is ``und``; with one known language every text with a letter is that one. Ties
go to the language first in code point order. Rows that share a doc_id are
predicted each on their own; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship
from equiloan.llm.sampling import bounded_sample
from equiloan.llm.textops import chunks, texts

BUCKETS = 4096
TRAIN_ROWS = 3000
#: Softmax margin under which the decision is called ambiguous.
AMBIGUOUS = 0.2
_LETTER = re.compile(r"[^\W\d_]")


def features(docs: list[bytes]) -> np.ndarray:
    """Rows of L2-normalised square-root counts of hashed byte 1- to 3-grams.
    ``docs`` are lower-cased; every document is followed by spaces, so no
    n-gram spans two."""
    n = len(docs)
    data = np.frombuffer(b"   ".join(docs) + b"   ", np.uint8).astype(np.uint32)
    size = np.array([len(t) for t in docs])
    # The n-grams that begin in the padding belong to nobody (row n).
    owner = np.repeat(np.stack([np.arange(n), np.full(n, n)], axis=1).ravel(),
                      np.stack([size, np.full(n, 3)], axis=1).ravel())[: len(data) - 2] * BUCKETS
    a, b, c = data[:-2], data[1:-1], data[2:]
    out = np.zeros((n + 1) * BUCKETS)
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    for h in (a * np.uint32(0x27D4EB2F), two, two * np.uint32(0xC2B2AE3D) + c * np.uint32(0x165667B1) + np.uint32(1)):
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out += np.bincount(owner + (h >> np.uint32(20)), minlength=len(out))
    x = np.sqrt(out.reshape(n + 1, BUCKETS)[:n])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x.astype(np.float32)


def codewords(classes: int, seed: int = 1) -> np.ndarray:
    """(classes, bits) of -1 and 1."""
    if classes < 2:
        return np.ones((classes, 1), np.int8)
    if classes <= 6:
        bits = [[1 if i == 0 or (m >> (i - 1)) & 1 else -1 for i in range(classes)]
                for m in range((1 << (classes - 1)) - 1)]
        return np.array(bits, np.int8).T
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(classes)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, length))
        gap = int((length - code.astype(int) @ code.T.astype(int))[~np.eye(classes, dtype=bool)].min())
        if gap > apart and (np.abs(code.sum(axis=0)) < classes).all():
            best, apart = code, gap
    return best


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 200, ridge: float = 1e-4):
    """Logistic classifiers for all bits at once (accelerated gradient).
    Returns (weights, bias, weight of each bit)."""
    signs = code[y].astype(np.float32)
    w = np.zeros((x.shape[1] + 1, code.shape[1]), np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    rare = np.bincount(y, minlength=len(code))[y]
    weight = (len(y) / (len(code) * rare)).astype(np.float32)[:, None] / len(y)  # classes count alike
    ahead, rate, momentum = w, 1.0, 1.0
    for _ in range(steps):
        m = x1 @ ahead
        g = x1.T @ (-weight * signs / (1 + np.exp(np.clip(signs * m, -30, 30)))) + ridge * ahead
        new = ahead - 2 * rate * g
        nxt = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, w, momentum = new + np.float32((momentum - 1) / nxt) * (new - w), new, nxt
    right = ((x1 @ w) * signs > 0).astype(np.float64)
    accuracy = (right * weight).sum(axis=0) / weight.sum()
    bits = np.maximum(accuracy - 0.5, 1e-3)
    scale = 1 / max(float(np.abs(x1 @ w).mean()), 1e-6)
    return w[:-1], w[-1], bits / bits.sum(), scale


def decode(margin: np.ndarray, code: np.ndarray, bits: np.ndarray, scale: float):
    """(best, second, score of the best, ambiguous) of each row of margins by
    loss-weighted decoding."""
    z = margin * scale * 2
    loss = np.stack([(np.logaddexp(0, -z * c) * bits).sum(axis=1) for c in code], axis=1)
    p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    order = np.argsort(-p, axis=1, kind="stable")
    best = order[:, 0]
    score = p[np.arange(len(p)), best]
    if p.shape[1] == 1:
        return best, best, score, np.zeros(len(p), bool)
    second = order[:, 1]
    return best, second, score, score - p[np.arange(len(p)), second] < AMBIGUOUS


def _lowered(batch) -> list[bytes]:
    return [t.decode("utf-8", "replace").lower().encode() for t in texts(batch)]


def _vectors(batches):
    for batch in batches:
        docs = _lowered(batch)
        for a, b in chunks(docs, rows=256):
            x = features(docs[a:b]).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("lang")).slice(a, b - a),
                 pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                        ("score", pa.float64()), ("lang_second", pa.string()), ("ambiguous", pa.bool_())])


def _predict(model):
    def run(batches):
        langs, code, w, bias, bits, scale = model.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            held = batch.column(batch.schema.get_field_index("held_out"))
            raw = [t.decode("utf-8", "replace") for t in texts(batch)]
            docs = [t.lower().encode() for t in raw]
            for a, b in chunks(docs, rows=256):
                known = [i for i in range(a, b) if langs and _LETTER.search(raw[i])]
                lang, second = ["und"] * (b - a), [None] * (b - a)
                score, unsure = np.zeros(b - a), np.zeros(b - a, bool)
                if known:
                    margin = features([docs[i] for i in known]) @ w + bias
                    for i, best, other, p, flag in zip(known, *decode(margin, code, bits, scale), strict=True):
                        lang[i - a], score[i - a], unsure[i - a] = langs[best], p, flag
                        second[i - a] = langs[other] if len(langs) > 1 else None
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), held.slice(a, b - a), pa.array(lang), pa.array(score),
                     pa.array(second, pa.string()), pa.array(unsure)], schema=_PREDICTED)
    return run


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """The model from rows (doc_id, text, lang): (languages, code, weights,
    bias, bit weights, scale)."""
    ship(labelled.sparkSession)
    sample = bounded_sample(labelled.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang"),
                            train_rows, by="lang")
    rows = sample.select("lang", "text").mapInArrow(_vectors, "lang string, x binary").toArrow()
    names = rows.column("lang").to_pylist()
    langs = sorted(set(names))
    if not langs:
        return [], None, None, None, None, 1.0
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(len(names), -1).astype(np.float32)
    code = codewords(len(langs))
    place = {v: i for i, v in enumerate(langs)}
    y = np.array([place[v] for v in names])
    order = np.lexsort((x.sum(axis=1), y))  # the rows arrive in no fixed order
    return langs, code, *fit(x[order], y[order], code)


def language_id(docs: DataFrame, held_out, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_second, ambiguous for every
    row. ``held_out`` is the boolean column expression of rows never learnt
    from (null counts as held out)."""
    spark = docs.sparkSession
    ship(spark)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                         F.col("lang").cast("string").alias("lang"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    model = spark.sparkContext.broadcast(train(marked.filter(~F.col("held_out")), train_rows))
    return marked.select("doc_id", "text", "held_out").mapInArrow(
        _predict(model), "doc_id long, held_out boolean, lang_pred string, score double, lang_second string, "
                         "ambiguous boolean")
