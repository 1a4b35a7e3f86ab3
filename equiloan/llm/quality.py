"""Quality by naive Bayes support vectors (operator 6).

The indicators of a document's n-grams are scaled by the class log-count ratio
r = log((p / |p|) / (q / |q|)) of naive Bayes (p, q: smoothed counts of
documents with the n-gram in either class), and a linear hinge-loss model on
the scaled indicators is fitted by dual coordinate descent (Hsieh et al. 2008),
interpolated with its mean weight (Wang and Manning 2012). A sigmoid fitted to
the margins of rows that the model was not fitted on turns them into scores.

N-grams: single words; word pairs; and n-grams of word shapes up to three, where
a shape says how a word is written (cases, digits, other signs at either end,
repeats the word before), which carries over to words never seen.

Learning reads a bounded sample (``train_rows``, spread evenly over the two
classes); scoring reads every whole text. Empty and null texts get the score
of no n-gram at all. With only one class among the labelled rows every score
is that class's share (1 or 0); with none it is 0.5. Rows that share a doc_id
are scored each on their own; a doc_id labelled more than once takes the
smallest label; null labels are no labels; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship
from equiloan.llm.sampling import bounded_sample
from equiloan.llm.textops import chunks, distinct, mix, span_hashes, texts, words

BUCKETS = 1 << 18
TRAIN_ROWS = 8000
THRESHOLD = 0.7

#: Classes of bytes: 0 space, 1 lower case or any byte of a longer character,
#: 2 upper case, 3 digit, and every other sign itself.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[32, 9, 10, 11, 12, 13]] = 0


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One shape key per word."""
    kind = _KIND[data].astype(np.uint64)
    upper = np.concatenate(([0], np.cumsum(kind == 2)))
    digit = np.concatenate(([0], np.cumsum(kind == 3)))
    other = np.concatenate(([0], np.cumsum(kind > 3)))
    size = ends - starts
    few = lambda total: np.minimum(total[ends] - total[starts], 3).astype(np.uint64)
    first, last = kind[starts], kind[ends - 1]
    before = kind[np.maximum(ends - 2, starts)]
    same = np.zeros(len(word), np.uint64)
    if len(word) > 1:
        same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    key = np.minimum(size, 2).astype(np.uint64)
    for part, room in ((few(upper), 4), (few(digit), 4), (few(other), 4), (first, 256), (last, 256), (before, 256),
                       (same, 2)):
        key = key * np.uint64(room) + part
    return mix(key + np.uint64(0x51ED270B))


def ngrams(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct n-grams of each document, in order."""
    data, starts, ends, owner = words(docs)
    word = span_hashes(data, starts, ends)
    shape = _shapes(data, starts, ends, owner, word)
    kinds, owners = [word, shape], [owner, owner]
    if len(word) > 1:
        two = np.flatnonzero(owner[1:] == owner[:-1])
        kinds += [mix(word[two] * np.uint64(3) + word[two + 1]), mix(shape[two] * np.uint64(5) + shape[two + 1])]
        owners += [owner[two], owner[two]]
    if len(word) > 2:
        three = np.flatnonzero(owner[2:] == owner[:-2])
        kinds.append(mix((shape[three] * np.uint64(7) + shape[three + 1]) * np.uint64(11) + shape[three + 2]))
        owners.append(owner[three])
    key = distinct(np.concatenate(owners).astype(np.int64) * BUCKETS
                   + (np.concatenate(kinds) >> np.uint64(46)).astype(np.int64))
    return key // BUCKETS, key % BUCKETS


def _rows(batches):
    for batch in batches:
        docs = texts(batch)
        label = batch.column(batch.schema.get_field_index("label"))
        for a, b in chunks(docs):
            owner, bucket = ngrams(docs[a:b])
            cut = np.searchsorted(owner, np.arange(b - a + 1))
            body = bucket.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [label.slice(a, b - a),
                 pa.array([body[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["label", "x"])


def fit_nbsvm(label: np.ndarray, flat: np.ndarray, bounds: np.ndarray, cost: float = 0.05, rounds: int = 12,
              beta: float = 0.75, least: int = 3, seed: int = 3):
    """(bucket weights, sigmoid slope, sigmoid offset); labels 0 and 1."""
    row = np.repeat(np.arange(len(label)), np.diff(bounds))
    fitted = np.random.default_rng(seed).random(len(label)) < 0.8  # the rest calibrates
    on = fitted[row]
    p = np.bincount(flat[on & (label[row] == 1)], minlength=BUCKETS).astype(float)
    q = np.bincount(flat[on & (label[row] == 0)], minlength=BUCKETS).astype(float)
    seen = p + q >= least
    n_p, n_q = max((label[fitted] == 1).sum(), 1), max((label[fitted] == 0).sum(), 1)
    # Document frequencies of either class, smoothed.
    r = np.where(seen, np.log(((p + 1) / (n_p + 2)) / ((q + 1) / (n_q + 2))), 0.0)
    used = seen[flat]
    flat, row = flat[used], row[used]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(label)))))
    w, bias = np.zeros(BUCKETS), 0.0
    sign = np.where(label == 1, 1.0, -1.0)
    rows = np.flatnonzero(fitted)
    x = {i: (flat[bounds[i]:bounds[i + 1]], r[flat[bounds[i]:bounds[i + 1]]]) for i in rows}
    norm = {i: float((v * v).sum()) + 1 for i, (_, v) in x.items()}
    alpha = dict.fromkeys(rows.tolist(), 0.0)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(rows).tolist():
            at, v = x[i]
            g = sign[i] * (w[at] @ v + bias) - 1
            old = alpha[i]
            new = min(max(old - g / norm[i], 0.0), cost)
            if new != old:
                step = (new - old) * sign[i]
                w[at] += step * v  # a row's buckets are distinct
                bias += step
                alpha[i] = new
                moved = max(moved, abs(new - old))
        if moved < 1e-5 * cost:
            break
    w = (1 - beta) * np.abs(w[seen]).mean() * np.sign(w) + beta * w if seen.any() else w
    weights = w * r
    margin = np.bincount(row, weights=weights[flat], minlength=len(label)) + bias
    rest = ~fitted if (~fitted).any() and len(set(label[~fitted])) == 2 else fitted
    slope, offset = _sigmoid(margin[rest], label[rest])
    return weights.astype(np.float32), slope, slope * bias + offset


def _sigmoid(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid by Newton steps; both classes count alike."""
    n1, n0 = max((label == 1).sum(), 1), max((label == 0).sum(), 1)
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(label == 1, 0.5 / n1, 0.5 / n0)
    scale = max(float(np.abs(margin).mean()), 1e-9)
    m = np.stack([margin / scale, np.ones(len(margin))])
    v = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(v @ m, -30, 30)))
        g = m @ (weight * (p - target)) + 1e-4 * v
        h = (m * (weight * p * (1 - p))) @ m.T + 1e-4 * np.eye(2)
        v = v - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(v[0], 1e-3) / scale), float(v[1])


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                     ("predicted", pa.int32())])


def _score(model, threshold: float):
    def run(batches):
        at, value, slope, offset = model.value
        weights = np.zeros(BUCKETS, np.float32)
        weights[at] = value
        for batch in batches:
            docs = texts(batch)
            z = np.full(len(docs), offset)
            for a, b in chunks(docs):
                owner, bucket = ngrams(docs[a:b])
                z[a:b] += slope * np.bincount(owner, weights=weights[bucket], minlength=b - a)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")),
                 batch.column(batch.schema.get_field_index("held_out")), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32))], schema=_SCORED)
    return run


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """(weights, slope, offset) from rows (doc_id, text) that may be learnt
    from and labels (doc_id, quality)."""
    ship(docs.sparkSession)
    marks = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min(F.col("quality").cast("int")).alias("label")))
    sample = bounded_sample(marks.join(docs.select("doc_id"), "doc_id", "left_semi"), train_rows, by="label")
    # The sample is bounded by ``train_rows``, so its ids may be broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "label")), "doc_id")
    got = (bounded_sample(found, train_rows, by="label")  # an id may have any number of rows
           .select("text", "label").mapInArrow(_rows, "label int, x binary").toArrow())
    rows = sorted(zip(got.column("label").to_pylist(), got.column("x").to_pylist(), strict=True))
    label = np.array([r[0] for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), 1.0, 0.0 if not len(label) else (30.0 if label[0] == 1 else -30.0)
    size = np.array([len(r[1]) // 4 for r in rows], np.int64)
    flat = np.frombuffer(b"".join(r[1] for r in rows), np.int32)
    return fit_nbsvm(label, flat, np.concatenate(([0], np.cumsum(size))))


def quality(docs: DataFrame, labels: DataFrame, held_out, threshold: float = THRESHOLD,
            train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.
    ``held_out`` is the boolean column expression of rows never learnt from."""
    spark = docs.sparkSession
    ship(spark)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                         F.coalesce(held_out, F.lit(True)).alias("held_out"))
    weights, slope, offset = train(marked.filter(~F.col("held_out")), labels, train_rows)
    at = np.flatnonzero(weights)
    model = spark.sparkContext.broadcast((at, weights[at], slope, offset))
    return marked.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
