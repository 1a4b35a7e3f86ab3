"""Toxicity by non-negative positive-unlabelled learning (operator 5).

Positives are the confirmed toxic documents, the other side is unlabelled
text as it comes (it holds toxic documents too). With class prior p, a linear
logistic model f minimises the corrected risk

    p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)])

whose second term, the estimated risk on negatives, is kept from going below
zero (Kiryo et al. 2017): where a step finds it negative, the step goes up
that term instead, which stops the model from memorising positives.

Features are indicators of hashed words, word openings (4 and 5 bytes) and word
pairs of the lower-cased text, restricted to those that are more frequent in
positives than the prior and chance explain, near copies in the samples counted
once. A document's margin is a sum over
the distinct features it holds, so one insult counts the same in a short and in
a very long text.

The class prior is the share of toxic rows among the labelled rows that may be
learnt from, unless given, and at most what the unlabelled frequency of the
kept features allows. Both samples are bounded (``positive_rows``,
``unlabelled_rows``); scoring reads every whole text. Empty and null texts
get the model's score for no feature at all. Without any confirmed toxic row
every score is the prior (0 if nothing is labelled). Rows that share a doc_id
are scored each on their own; a doc_id labelled more than once counts as toxic
if any label says so; null labels are no labels; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiloan.llm.runtime import ship
from equiloan.llm.sampling import bounded_sample
from equiloan.llm.textops import chunks, distinct, mix, span_hashes, texts, words

BUCKETS = 1 << 20
POSITIVE_ROWS = 3000
UNLABELLED_ROWS = 6000
THRESHOLD = 0.7


def token_features(docs: list[bytes], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct features of each document, in order;
    with ``useful`` (a mask over buckets), only of those."""
    data, starts, ends, owner = words([t.lower() for t in docs])
    one = span_hashes(data, starts, ends)
    kinds = [one]
    owners = [owner]
    for k in (4, 5):
        long = np.flatnonzero(ends - starts > k)
        kinds.append(mix(span_hashes(data, starts[long], starts[long] + k) + np.uint64(k)))
        owners.append(owner[long])
    if len(one) > 1:
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        kinds.append(mix(one[pair] * np.uint64(3) + one[pair + 1]))
        owners.append(owner[pair])
    bucket = np.concatenate(kinds) >> np.uint64(44)
    owner = np.concatenate(owners).astype(np.int64)
    if useful is not None:
        hit = useful[bucket]
        bucket, owner = bucket[hit], owner[hit]
    key = distinct(owner * BUCKETS + bucket.astype(np.int64))
    return key // BUCKETS, key % BUCKETS


BANDS, DEPTH = 8, 3


def copy_keys(docs: list[bytes]) -> np.ndarray:
    """(documents, BANDS) banded MinHash keys of each document's word pairs
    (its words, if it has no pair): two texts that share four fifths of their
    pairs share a key with a probability of 0.997, two that share a tenth with
    0.01."""
    data, starts, ends, owner = words([t.lower() for t in docs])
    one = span_hashes(data, starts, ends)
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(one) > 1 else np.zeros(0, np.int64)
    alone = np.flatnonzero(np.bincount(owner, minlength=len(docs))[owner] == 1) if len(one) else pair
    at = np.sort(np.concatenate((pair, alone)))
    following = np.where(np.isin(at, alone), np.uint64(0), one[np.minimum(at + 1, max(len(one) - 1, 0))])
    x, row = mix(one[at] * np.uint64(3) + following), owner[at]
    out = np.zeros((len(docs), BANDS), np.uint64)
    if len(x):
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        rng = np.random.default_rng(11)
        for b in range(BANDS):
            key = np.full(len(first), b + 1, np.uint64)
            for _ in range(DEPTH):
                scale, shift = rng.integers(1, 2**63, 2, dtype=np.uint64)
                low = np.minimum.reduceat(mix(x * (scale * np.uint64(2) + np.uint64(1)) + shift), first)
                key = mix(key * np.uint64(31) + low)
            out[row[first], b] = key
    return out


def apart(label: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of rows that are no near copy of an earlier row of their label. A
    text that is copied many times would otherwise make all of its words look
    typical of its label."""
    keep, seen = np.ones(len(label), bool), set()
    for i, (y, row) in enumerate(zip(label.tolist(), keys.tolist(), strict=True)):
        own = {(y, b, k) for b, k in enumerate(row) if k}
        keep[i] = bool(own) and not own & seen
        seen |= own
    return keep


def _rows(batches):
    for batch in batches:
        docs = texts(batch)
        label = batch.column(batch.schema.get_field_index("label"))
        for a, b in chunks(docs):
            owner, bucket = token_features(docs[a:b])
            cut = np.searchsorted(owner, np.arange(b - a + 1))
            body = bucket.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [label.slice(a, b - a),
                 pa.array([body[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                 pa.array([k.tobytes() for k in copy_keys(docs[a:b])], pa.binary())],
                names=["label", "x", "keys"])


def collect_rows(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, flat buckets, row bounds) of a bounded sample (text, label)
    without near copies, in an order that does not depend on how the rows
    arrive."""
    got = sample.select("text", "label").mapInArrow(_rows, "label int, x binary, keys binary").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("label", "x", "keys")), strict=True))
    keys = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(-1, BANDS)
    rows = [r for r, own in zip(rows, apart(np.array([r[0] for r in rows]), keys), strict=True) if own]
    label = np.array([r[0] for r in rows], np.int64)
    size = np.array([len(r[1]) // 4 for r in rows], np.int64)
    return label, np.frombuffer(b"".join(r[1] for r in rows), np.int32), np.concatenate(([0], np.cumsum(size)))


def fit_pu(label: np.ndarray, flat: np.ndarray, bounds: np.ndarray, prior: float, steps: int = 400,
           ridge: float = 1e-3, least: int = 3, chance: float = 1e-6):
    """(bucket weights as a dense vector, bias). ``label`` is 1 for positives
    and 0 for unlabelled rows."""
    row = np.repeat(np.arange(len(label)), np.diff(bounds))
    n_pos, n_unl = max(int((label == 1).sum()), 1), max(int((label == 0).sum()), 1)
    pos = np.bincount(flat[label[row] == 1], minlength=BUCKETS)
    unl = np.bincount(flat[label[row] == 0], minlength=BUCKETS)
    # Kept: buckets that positives hold more often than the rest of the
    # unlabelled text explains, by Chernoff's bound on the Poisson tail with
    # the rest's rate taken two documents too high.
    a, b = pos / n_pos, unl / n_unl
    rest = np.maximum(b - prior * a, 0) / max(1 - prior, 1e-9)
    expected = n_pos * (rest + 2 / n_unl)
    tail = pos - expected - pos * np.log(np.maximum(pos, 1) / expected)
    keep = (pos >= least) & (pos > 3 * expected) & (tail < np.log(chance))
    if keep.any():
        # What occurs in (nearly) no negative occurs in unlabelled text as
        # often as the prior says; a prior above that would have the model
        # punished for finding the positives among the unlabelled.
        prior = min(prior, float(b[keep].sum() / a[keep].sum()))
    place = np.cumsum(keep) - 1
    used = keep[flat]
    col, row = place[flat[used]], row[used]
    m = int(keep.sum())
    w, bias = np.zeros(m), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    is_pos = label == 1
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=len(label)) + bias
        up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # d l(-z) / dz; d l(z) / dz = up - 1
        loss_neg = np.logaddexp(0, z)
        negative = loss_neg[~is_pos].sum() / n_unl - prior * loss_neg[is_pos].sum() / n_pos
        g = np.zeros(len(label))
        if negative >= 0:
            g[is_pos] = prior * (up[is_pos] - 1) / n_pos - prior * up[is_pos] / n_pos
            g[~is_pos] = up[~is_pos] / n_unl
        else:
            g[is_pos] = prior * up[is_pos] / n_pos
            g[~is_pos] = -up[~is_pos] / n_unl
        grad = np.append(np.bincount(col, weights=g[row], minlength=m) + ridge * w / max(m, 1), g.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[keep] = w
    return weights, float(bias)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                     ("predicted", pa.int32())])


def _scores(batches, model):
    """(batch, score of each of its texts)."""
    at, value, bias = model.value
    weights = np.zeros(BUCKETS, np.float32)
    weights[at] = value
    useful = weights != 0
    for batch in batches:
        docs = texts(batch)
        margin = np.full(len(docs), bias)
        for a, b in chunks(docs):
            owner, bucket = token_features(docs[a:b], useful)
            margin[a:b] += np.bincount(owner, weights=weights[bucket], minlength=b - a)
        yield batch, 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _score(model, threshold: float):
    def run(batches):
        for batch, score in _scores(batches, model):
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")),
                 batch.column(batch.schema.get_field_index("held_out")), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32))], schema=_SCORED)
    return run


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positive_rows: int = POSITIVE_ROWS,
          unlabelled_rows: int = UNLABELLED_ROWS):
    """(weights, bias) from rows (doc_id, text) that may be learnt from and
    labels (doc_id, toxic)."""
    ship(docs.sparkSession)
    marks = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    ids = docs.select("doc_id")
    known = marks.join(ids, "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).first()
    if not known["n"] or not known["k"]:
        return np.zeros(BUCKETS, np.float32), -30.0
    if prior is None:
        prior = known["k"] / known["n"]
    toxic = bounded_sample(marks.filter("toxic = 1").join(ids, "doc_id", "left_semi"), positive_rows)
    # The sample is bounded by ``positive_rows``, so its ids may be broadcast.
    pos = (docs.select("doc_id", "text").join(F.broadcast(toxic.select("doc_id")), "doc_id", "left_semi")
           .withColumn("label", F.lit(1)))
    pos = bounded_sample(pos, positive_rows)  # an id may have any number of rows
    unl = bounded_sample(docs.select("doc_id", "text"), unlabelled_rows).withColumn("label", F.lit(0))
    return fit_pu(*collect_rows(pos.unionByName(unl)), prior=min(max(prior, 1e-4), 1 - 1e-4))


def toxicity(docs: DataFrame, labels: DataFrame, held_out, threshold: float = THRESHOLD, prior: float | None = None,
             positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.
    ``held_out`` is the boolean column expression of rows never learnt from."""
    spark = docs.sparkSession
    ship(spark)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                         F.coalesce(held_out, F.lit(True)).alias("held_out"))
    weights, bias = train(marked.filter(~F.col("held_out")), labels, prior, positive_rows, unlabelled_rows)
    at = np.flatnonzero(weights)
    model = spark.sparkContext.broadcast((at, weights[at], bias))
    return marked.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def _accept(model, threshold: float):
    """Whole rows whose text is under the threshold."""
    def run(batches):
        for batch, score in _scores(batches, model):
            yield batch.filter(pa.array(score < threshold))
    return run


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, prior: float | None = None,
             positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic; every
    labelled row may be learnt from."""
    spark = docs.sparkSession
    ship(spark)
    weights, bias = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, prior,
                          positive_rows, unlabelled_rows)
    at = np.flatnonzero(weights)
    model = spark.sparkContext.broadcast((at, weights[at], bias))
    return docs.mapInArrow(_accept(model, threshold), docs.schema)
