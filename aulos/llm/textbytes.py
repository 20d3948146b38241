"""Vectorised words over Arrow text columns: whole texts as one byte array, never row by row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once; a longer single text is worked on alone.
PIECE_BYTES = 512 << 10
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P ** i and P ** -i modulo 2 ** 64 for i below n at least."""
    if not _powers or len(_powers["up"]) < n:
        m = max(1 << 16, 1 << int(n).bit_length())
        for name, base in (("up", _P), ("down", _INV)):
            ones = np.full(m, base, np.uint64)
            ones[0] = 1
            _powers[name] = np.multiply.accumulate(ones)
        if n > 4 * PIECE_BYTES:  # one very long text: don't keep its tables
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts): each text followed by one line feed, starts has one entry more than rows.

    Null texts count as empty.
    """
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    lo, held = 0, 0
    for hi, n in enumerate([*sizes, PIECE_BYTES + 1]):
        if (held + n > PIECE_BYTES or hi == len(sizes)) and hi > lo:
            ended = pc.binary_join_element_wise(texts.slice(lo, hi - lo), *(pa.scalar(x, pa.large_string()) for x in ("", "\n")))
            offsets = np.frombuffer(ended.buffers()[1], np.int64, hi - lo + 1, ended.offset * 8)
            data = np.frombuffer(ended.buffers()[2] or b"", np.uint8)
            yield batch.slice(lo, hi - lo), data[offsets[0] : offsets[-1]], offsets - offsets[0]
            lo, held = hi, 0
        held += n


def words(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which ``is_word`` holds; the last byte never does."""
    mask = np.concatenate(([False], is_word[data]))
    edge = np.flatnonzero(mask[1:] != mask[:-1])
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, doc) of the distinct k-word shingles of each document, sorted by document and hash.

    ``hashes`` and ``doc`` are those of the words in order. A document with fewer than k words
    has its whole sequence as its one shingle; one without words has none.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        made = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            made = mix64(made * _P + hashes[i : n - k + 1 + i])
        whole = doc[: n - k + 1] == doc[k - 1 :]
        made, at = made[whole], doc[: n - k + 1][whole]
    else:
        made, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            there = counts[short] > i
            step = mix64(extra * _P + hashes[np.minimum(first + i, n - 1)] + np.uint64(1))
            extra = np.where(there, step, extra)
        made, at = np.concatenate((made, extra + np.uint64(7))), np.concatenate((at, short))
    order = np.lexsort((made, at))
    made, at = made[order], at[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (at[1:] != at[:-1])
    return made[new], at[new]


def doc_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, starts, "right") - 1
