"""Vectorised text primitives on UTF-8 bytes, for use inside Arrow tasks.

Documents of a batch are handled in chunks of about a megabyte, joined by
spaces so that no word or n-gram crosses two documents; a single longer
document is one chunk of its own (memory follows the longest document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

#: [\x20\x09-\x0D], the white space of every contract here.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(20240501).integers(1, 2**64, 256, dtype=np.uint64)
_LETTER[IS_SPACE] = 0
_POWERS: dict[str, np.ndarray] = {}


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.type != pa.binary():
        col = col.cast(pa.binary())
    return [b"" if t is None else t for t in col.to_pylist()]


def chunks(docs: list[bytes], limit: int = CHUNK, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes and at most ``rows`` rows."""
    start = size = 0
    for i, t in enumerate(docs):
        if i > start and (size + len(t) > limit or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(docs):
        yield start, len(docs)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order (a sort; much faster here than the hash
    table behind np.unique)."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1]))]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        inverse = pow(int(_BASE), -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", np.uint64(inverse))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"]


def words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, document of each word) of the words
    ``[^\\x20\\x09-\\x0D]+`` of ``docs``; ``data`` is the joined bytes."""
    data = np.frombuffer(b" ".join(docs) + b" ", np.uint8)
    solid = ~IS_SPACE[data]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    first = np.cumsum([0] + [len(t) + 1 for t in docs])
    return data, starts, ends, np.searchsorted(first, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (a polynomial over mixed letters, from
    one running sum, then finalised with the length)."""
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
