"""Words of a whole Arrow text column at once, as 64-bit hashes, without a Python object for each.

The text is read as UTF-8 bytes.  A word is a maximal run of word bytes inside one row; A-Z count as a-z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
P = 0x9E3779B97F4A7C17 | 3
P_INV = pow(P, -1, 1 << 64)
TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: all but space and 0x09-0x0D; and letters, digits and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, U(base))
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the rows one after another, and the rows' offsets in them."""
    a = a.fill_null("") if a.null_count else a
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    _, offsets, data = a.buffers()
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most so many bytes each (a longer row stands alone)."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


@dataclass
class Words:
    hashes: np.ndarray  # of each word, in order
    begin: np.ndarray  # byte positions
    end: np.ndarray
    row: np.ndarray  # len(rows) + 1 offsets into the words


def hash_ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[begin:end], for 64-bit values, whatever the place they stand at."""
    n = len(values)
    acc = np.zeros(n + 1, U)
    np.cumsum(values * powers(P, n), out=acc[1:])
    return mix((acc[end] - acc[begin]) * powers(P_INV, n + 1)[begin])


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Of rows whose bytes are data[offsets[0]:offsets[-1]]; the rows should be of a few MB."""
    base = offsets[0]
    low, at = LOWER[data[base : offsets[-1]]], offsets - base
    n = len(low)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(U), none, none, np.zeros(len(at), np.int64))
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = is_word[low]
    edge = np.diff(inside)
    starts, ends = edge[:n] == 1, edge[1:] == -1
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[(inside[cut] & inside[cut + 1]).astype(bool)]  # a row ends inside a run
    starts[cut], ends[cut - 1] = True, True
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    h = hash_ranges(TABLE[low], begin, end)
    return Words(h, begin + base, end + base, np.searchsorted(begin, at))


def run_lengths(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def expand(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """begin[i], begin[i]+1, ... (count[i] of them) for each i, and the i of each."""
    who = np.repeat(np.arange(len(begin)), count)
    first = np.cumsum(count) - count
    return np.arange(len(who)) - first[who] + begin[who], who
