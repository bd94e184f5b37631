"""Vectorised text helpers for Arrow batches: words, shingles and 64-bit mixing in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by the numpy kernels; a longer document is a block of its own.
BLOCK_BYTES = 2_000_000
#: Bytes that are cut into words at once.
PIECE_BYTES = 4_000_000
SHINGLE = 5

_U = np.uint64
_BASE = _U(0x100000001B3)
_BASE_INV = _U(pow(0x100000001B3, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift), elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each (or of one longer row)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def _edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of `inside`; runs end where a row does."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = inside[first]
    ends[first[1:] - 1] = inside[first[1:] - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, bytes, offsets in it) of pieces of about PIECE_BYTES that cut no word."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + PIECE_BYTES, n)
        while hi < n:
            gaps = np.flatnonzero(~_IN_WORD[_LOWER[data[hi:hi + PIECE_BYTES]]])
            if len(gaps):
                hi += int(gaps[0])
                break
            hi = min(hi + PIECE_BYTES, n)
        inner = offsets[np.searchsorted(offsets, lo, "right"):np.searchsorted(offsets, hi, "left")]
        yield lo, data[lo:hi], np.concatenate([[0], inner - lo, [hi - lo]]).astype(np.int64)
        lo = hi


def words_at(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the row, and the start and end byte of each.

    A word is a run of ASCII letters and digits and of bytes beyond ASCII; A-Z
    count as a-z. The hash is a polynomial over the word's bytes, mixed. Bytes are
    handled piece by piece, so that a long text takes little more memory than its words.
    """
    parts = []
    for base, raw, off in _pieces(data, offsets):
        low = _LOWER[raw]
        s, e = _edges(_IN_WORD[low], off)
        n = len(low)
        power = np.full(n + 1, _BASE, _U)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(n + 1, _U)
        np.cumsum((low.astype(_U) + _U(1)) * power[:n], out=total[1:])
        inverse = np.full(n + 1, _BASE_INV, _U)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        parts.append((mix((total[e] - total[s]) * inverse[s] + (e - s).astype(_U)), s + base, e + base))
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, none
    hashes, s, e = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, np.searchsorted(offsets, s, "right") - 1, s, e


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the row of each."""
    return words_at(data, offsets)[:2]


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and the row of each; a row of fewer words has one shingle of them all."""
    count = np.bincount(rows, minlength=n_rows)
    begin = np.zeros(n_rows + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    out = np.zeros(max(len(hashes) - size + 1, 0), _U)
    for j in range(size):
        out += hashes[j:j + len(out)] * _U(2 * pow(31, 3 * j + 3, 2**63) + 1)
    ok = rows[:len(out)] == rows[size - 1:] if len(out) else np.zeros(0, bool)
    long, owner = mix(out[ok]), rows[:len(out)][ok]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        whole = np.zeros(len(few), _U)
        for j in range(size - 1):
            has = count[few] > j
            whole[has] += hashes[begin[few[has]] + j] * _U(2 * pow(31, 3 * j + 3, 2**63) + 1)
        long, owner = np.concatenate([long, mix(whole + _U(77))]), np.concatenate([owner, few])
    return long, owner


def multiset(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) with their counts, in no particular order of rows."""
    key = values ^ mix(rows.astype(_U) + _U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return values[order[at]], rows[order[at]], np.diff(np.append(at, len(key)))


def small_batches(spark) -> None:
    """Fewer rows to an Arrow batch than the default, for this session: a batch of very long texts must fit a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
