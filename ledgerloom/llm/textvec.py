"""Words, lines and shingles of many texts at once, as NumPy arrays.

Texts come as one Arrow string column. A slice of it is one byte array and one
offset array, so every step below runs over all texts of the slice together and
memory stays within a few times ``SLICE_BYTES`` (or the longest single text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

SPACES = np.ones(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = False  # words between white space

PLAIN = np.zeros(256, bool)  # words of digits, letters and all beyond ASCII
PLAIN[0x30:0x3A] = PLAIN[0x41:0x5B] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: a worker serves many stages, and its executor's limit counts it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """P**0 .. P**(n-1) modulo 2**64."""
    name = "inverse" if inverse else "power"
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = np.full(max(n, SLICE_BYTES + 1), _P_INVERSE if inverse else _P, np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHashes:
    """Hashes of any byte spans of one byte array from one pass over it.

    For short spans: modulo 2**64 some strings of 1,024 bytes collide.
    """

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = powers(len(self.sums), inverse=True)
        return mix((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = (1_234_821_209, 902_716_343)
_CHUNK = 1 << 22  # bytes added up before the sum is reduced again
_prime_powers: dict[tuple[int, bool], np.ndarray] = {}


def _powers_of(which: int, n: int, inverse: bool) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, by doubling."""
    have = _prime_powers.get((which, inverse))
    if have is None or len(have) < n:
        prime = _PRIMES[which]
        base = pow(_BASES[which], -1 if inverse else 1, prime)
        have = np.ones(max(n, SLICE_BYTES + 1), np.uint32)  # all below 2**31
        done = 1
        while done < len(have):
            step = min(done, len(have) - done)
            have[done : done + step] = have[:step].astype(np.int64) * pow(base, done, prime) % prime
            done += step
        if len(have) <= 4 * SLICE_BYTES:
            _prime_powers[which, inverse] = have
    return have[:n]


class PrimeHashes:
    """62-bit hashes of any byte spans of one byte array, however long.

    Two polynomials modulo primes: unlike sums modulo a power of two they have
    no strings that collide whatever the base.
    """

    def __init__(self, data: np.ndarray):
        self.sums = []
        for which, prime in enumerate(_PRIMES):
            total = np.zeros(len(data) + 1, np.int64)
            np.multiply(data.astype(np.int64) + 1, _powers_of(which, len(data), False), out=total[1:])
            for at in range(0, len(data), _CHUNK):
                part = total[at + 1 : at + 1 + _CHUNK]
                np.cumsum(part, out=part)
                part += total[at] % prime
            self.sums.append(total)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = []
        for which, prime in enumerate(_PRIMES):
            total = self.sums[which]
            back = _powers_of(which, len(total), True)
            out.append((total[ends] - total[starts]) % prime * back[starts].astype(np.int64) % prime)
        return mix((out[0].astype(np.uint64) << np.uint64(31) | out[1].astype(np.uint64)) ^ mix((ends - starts).astype(np.uint64)))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``, cut at text borders."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | border[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def owners(counts: np.ndarray) -> np.ndarray:
    """Row number of each item, given how many items each row has."""
    return np.repeat(np.arange(len(counts)), counts)


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the first word's number per text."""
    starts, ends = runs(inside[data], offsets)
    return PrimeHashes(data).of(starts, ends), np.searchsorted(starts, offsets)


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * _P) | np.uint64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words per text, and the first one's number per text.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    counts = np.diff(first)
    total = np.zeros(len(words), np.uint64)
    for k in range(size):
        left = len(words) - k
        if left > 0:
            total[:left] += words[k:] * _STEPS[k]
    position = np.arange(len(words)) - np.repeat(first[:-1], counts)
    whole = position + size <= np.repeat(counts, counts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    for row in short.tolist():
        span = words[first[row] : first[row + 1]]
        total[first[row]] = (span * _STEPS[: len(span)]).sum(dtype=np.uint64) + np.uint64(len(span))
    whole[first[short]] = True
    n_shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return mix(total[whole]), np.concatenate([[0], np.cumsum(n_shingles)])


def repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each item, how many items of the same row have its key."""
    salted = mix(keys ^ mix(rows.astype(np.uint64) + np.uint64(1)))
    _, inverse, counts = np.unique(salted, return_inverse=True, return_counts=True)
    return counts[inverse]
