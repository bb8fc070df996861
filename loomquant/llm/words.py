"""Vectorised word splitting and hashing over Arrow string columns.

Texts are handled as one UTF-8 byte buffer with row offsets, so a batch of
documents is tokenised with a handful of numpy passes. Both word definitions
used in this package are byte-level: every byte of a non-ASCII code point is at
least 0x80, and the separators are all ASCII.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64


def give_back() -> None:
    """Returns what the allocators hold unused to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """A map function that gives memory back after each batch and when its task ends: Spark keeps Python workers for
    later tasks, and what the allocator holds counts against the executor."""

    def each(batches):
        for batch in batches:
            yield batch
            give_back()

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(each(batches))
        finally:
            gc.collect()
            give_back()

    return wrapped


CHUNK = 1 << 18
SPACE = b" \t\n\v\f\r"


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    return _splitmix(np.asarray(x, dtype=U64) + U64(0x9E3779B97F4A7C15))


def _is_word(kind: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    if kind == "space":  # [^\x20\x09-\x0D]
        table[:] = True
        table[0x20] = False
        table[0x09:0x0E] = False
    elif kind == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased
        table[0x30:0x3A] = True
        table[0x41:0x5B] = True
        table[0x61:0x7B] = True
        table[0x80:] = True
    else:
        raise ValueError(f"unknown word kind {kind!r}")
    return table


IS_WORD = {k: _is_word(k) for k in ("space", "alnum")}


def _byte_values(lower: bool, seed: int) -> np.ndarray:
    codes = np.arange(256, dtype=U64)
    if lower:
        codes[0x41:0x5B] += U64(32)
    return mix(codes + U64(seed) * U64(1_000_003))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n, kept between calls."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(CHUNK + 4096, n)
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, dtype=U64)
            p[0] = 1
            filled = 1
            while filled < size:
                step = min(filled, size - filled)
                p[filled : filled + step] = p[:step] * U64(pow(b, filled, 1 << 64))
                filled += step
            out.append(p)
        have = _POWERS[which] = (out[0], out[1])
    return have


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """Words of a batch: `hashes[i]` covers bytes `starts[i]:ends[i]`; row r owns words `rows[r]:rows[r+1]`."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def split_words(raw: np.ndarray, off: np.ndarray, kind: str = "space", lower: bool = False, seed: int = 1) -> Words:
    """Words of every row with a 64-bit hash each. Works through fixed byte chunks cut between words, so
    temporary memory does not follow the longest text (only the longest single word)."""
    table, values = IS_WORD[kind], _byte_values(lower, seed)
    n, at = len(raw), 0
    hashes, starts, ends = [], [], []
    edges = off[1:-1]
    while at < n:
        to = min(n, at + CHUNK)
        while to < n and table[raw[to]] and table[raw[to - 1]]:  # move the cut out of a word
            ahead = table[raw[to : to + 4096]]
            gap = np.flatnonzero(~ahead)
            to = to + int(gap[0]) if len(gap) else min(n, to + 4096)
        part = raw[at:to]
        inside = table[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, to, "left")] - at
        if len(cut):
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
        s = np.flatnonzero(first)
        e = np.flatnonzero(last) + 1
        if len(s):
            up, down = powers(len(part) + 1)
            total = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(values[part] * up[: len(part)], out=total[1:])
            h = (total[e] - total[s]) * down[s] + (e - s).astype(U64)
            hashes.append(mix(h))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if hashes:
        h, s, e = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    else:
        h, s, e = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    return Words(h, s, e, np.searchsorted(s, off, "left"))


def rolling(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of hashes[i:i+k] for every i (windows that leave a row are the caller's to drop)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    if k <= 12:
        base = U64(_BASES[which])
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= base
            out += hashes[j : j + n]
        return mix(out)
    up, down = powers(len(hashes) + 1, which)
    total = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def inside_rows(rows: np.ndarray, k: int, n: int) -> np.ndarray:
    """For windows of k words at 0..n-1: whether the window stays within its row."""
    end = np.repeat(rows[1:], np.diff(rows))[:n]
    return np.arange(n) + k <= end


def bounded(batches, column: str = "text", limit: int = 2 << 20):
    """Record batches cut so that their texts hold about `limit` bytes (or one row)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.nbytes <= limit:
            yield batch
            continue
        _, off = as_bytes(texts)
        at = 0
        while at < len(off) - 1:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def row_sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set flags between consecutive offsets."""
    out = np.zeros(len(off) - 1, dtype=np.int64)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        out[full] = np.add.reduceat(flags.view(np.uint8), off[full], dtype=np.int64)
    return out
