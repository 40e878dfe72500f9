"""Helpers shared by the corpus operators: vectorised text hashing, and the tables that cut a lineage."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sparkloom.sources.shared import materialize, release, temporary_tables  # noqa: F401  used by the operators

#: ASCII white space that separates words: space and \t \n \v \f \r.
SPACES = np.array([32, 9, 10, 11, 12, 13], dtype=np.uint8)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, as F.col takes it."""
    return "`" + name.replace("`", "``") + "`"


def lower_ascii(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of a span beyond which it is hashed by itself.
LONG_SPAN = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions up to n."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for_base = np.full(size, _BASE, dtype=np.uint64)
            for_inverse = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            for_base[0] = for_inverse[0] = 1
            _powers, _inverse = np.multiply.accumulate(for_base), np.multiply.accumulate(for_inverse)
    return _powers, _inverse


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for all spans at once, eight bytes a step, each through the finaliser.

    No sum of powers is involved, whose terms cancel for some long words. Spans over LONG_SPAN bytes go one by one."""
    size = codes.itemsize
    data = np.zeros(codes.nbytes + 8, dtype=np.uint8)
    data[: codes.nbytes] = np.ascontiguousarray(codes).view(np.uint8)
    eights = np.ndarray(shape=(codes.nbytes + 1,), dtype="<u8", buffer=data.data, strides=(1,))
    at, left = starts * size, (ends - starts) * size
    h = mix((left.astype(np.uint64) + np.uint64(_BASE)) ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
    now, step = np.flatnonzero((left > 8) & (left <= LONG_SPAN)), 8
    while len(now):
        rest = left[now] - step
        h[now] = mix(h[now] ^ (eights[at[now] + step] & _MASKS[np.minimum(rest, 8)]))
        now, step = now[rest > 8], step + 8
    for i in np.flatnonzero(left > LONG_SPAN):
        h[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + left[i]])
    return h


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k codes, for a small k: sums of powers modulo 2**64."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    power, inverse = _tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in an array of bytes or code points."""
    inside = np.zeros(len(codes) + 2, dtype=bool)
    inside[1:-1] = (codes > 32) | (codes < 9) | ((codes > 13) & (codes < 32))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def utf8(text: str | None) -> np.ndarray:
    """The bytes of a text; a null counts as empty."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def lowered(codes: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, everything else as it is."""
    return np.where((codes >= 65) & (codes <= 90), codes + np.asarray(32, dtype=codes.dtype), codes)


def rolling_word_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words, from the hashes of the words; with fewer words, one for the whole sequence."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    k_used = min(k, len(words))
    n = len(words) - k_used + 1
    h = np.full(n, k_used, dtype=np.uint64)
    for i in range(k_used):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix(h)
