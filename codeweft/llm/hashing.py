"""Tokens of many texts at once, as 64-bit hashes, in numpy on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

_ALL = np.arange(256, dtype=np.uint8)
#: A-Z to a-z.
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: Anything but ASCII white space.
NON_SPACE = ~np.isin(_ALL, [32, 9, 10, 11, 12, 13])
#: ASCII letters and digits, and every byte of other characters.
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mixed(a * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F) + np.uint64(salt))


def _power(kind: int, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        with np.errstate(over="ignore"):
            _powers[kind] = np.cumprod(np.full(n, _P_INVERSE if kind else _P, np.uint64))
    return _powers[kind][:n]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a binary or string Arrow array without nulls."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def tokens(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray, prefixes: tuple[int, ...] = ()):
    """Hash of every token (A-Z lower-cased) and the number of tokens of each row.

    With ``prefixes``, also the hash of the first so many bytes of every token; 0 where it has no more than these.
    """
    rows = len(offsets) - 1
    if not len(raw):
        none = np.zeros(0, np.uint64)
        return (none, np.zeros(rows, np.int64), *(none for _ in prefixes))
    inside = word[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((LOWER[raw].astype(np.uint64) + np.uint64(1)) * _power(0, len(raw)), out=sums[1:])
        inverse = _power(1, len(raw))[starts]
        hashes = [mixed((sums[ends] - sums[starts]) * inverse)]
        for n in prefixes:
            head = mixed((sums[np.minimum(ends, starts + n)] - sums[starts]) * inverse)
            hashes.append(np.where(ends - starts > n, head, np.uint64(0)))
    return hashes[0], np.diff(np.searchsorted(starts, offsets)), *hashes[1:]
