"""Word and n-gram hashes of whole Arrow batches in a few NumPy passes.

A word is a maximal run of bytes that are not ASCII white space (0x20, 0x09-0x0D). Its hash is
a polynomial over its bytes modulo 2**64, taken from prefix sums, so a batch needs no Python
object for each word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 20
_U = np.uint64
TOP = _U(0xFFFFFFFFFFFFFFFF)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = ~SPACE
#: Bytes of tokens: digits, letters, and all beyond ASCII.
TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = _U(0xD6E8FEB86659FD93)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_STEP = _U(0x9E3779B97F4A7C15)
_STEP_INVERSE = _U(pow(int(_STEP), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    p = np.full(n, base, _U)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


_BYTE = mix(np.arange(1, 257, dtype=_U))
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        _tables[name] = powers(_BASE if name == "up" else _BASE_INVERSE, PIECE + 1)
    return _tables[name]


@dataclass
class Words:
    """hash, start, end: of each word, start and end as byte positions in data. first: the number
    of each text's first word, and last the number of words."""

    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(column: pa.Array | pa.ChunkedArray, fold_case: bool = False, inside: np.ndarray = _WORD) -> Words:
    """The words of each text; fold_case: A-Z hash as a-z. inside: which bytes words are runs of."""
    data, offsets = text_bytes(column)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, np.zeros(0, _U), none, none, np.zeros(len(offsets), np.int64))
    word = inside[data]
    head = word.copy()
    head[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    head[begins] = word[begins]
    tail = word.copy()
    tail[:-1] &= ~word[1:]
    lasts = begins[begins > 0] - 1
    tail[lasts] = word[lasts]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    out = np.empty(len(start), _U)
    values = _FOLD if fold_case else _BYTE
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + PIECE, "right"))
        if j <= i:
            long_word = data[start[i] : end[i]].tobytes()
            out[i] = xxhash.xxh3_64_intdigest(_lower(long_word) if fold_case else long_word)
            i += 1
            continue
        low, high = start[i], end[j - 1]
        sums = np.zeros(high - low + 1, _U)
        np.cumsum(values[data[low:high]] * _table("up")[: high - low], out=sums[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * _table("down")[s] + (e - s).astype(_U) * _STEP)
        i = j
    return Words(data, offsets, out, start, end, np.searchsorted(start, offsets))


def _lower(b: bytes) -> bytes:
    return b.lower()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each position on; k - 1 fewer than h, none if h is shorter than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for i in range(k):
        out = out * _STEP + h[i : i + n]
    return mix(out + _U(k))


class Ranges:
    """Hashes of runs of words of any length, from prefix sums."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, _U)
        np.cumsum(h * powers(_STEP, len(h)), out=self.sums[1:])
        self.down = powers(_STEP_INVERSE, len(h) + 1)

    def hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(_U))


def slide(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values; width - 1 fewer than a."""
    f, have = (np.minimum if least else np.maximum), 1
    while have * 2 <= width:
        a = f(a[:-have], a[have:]) if len(a) > have else a[:0]
        have *= 2
    rest = width - have
    return f(a[:-rest], a[rest:]) if rest and len(a) > rest else a[:0] if rest else a


def shingle_sets(column: pa.Array | pa.ChunkedArray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z as a-z; of a text
    with fewer words, one hash of the whole sequence; of one without words, none."""
    words = hash_words(column, fold_case=True)
    g, out = grams(words.hash, k), []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(distinct(g[a : b - k + 1]))
        elif b > a:
            out.append(grams(words.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, _U))
    return out


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    a = np.sort(a)
    keep = np.ones(len(a), bool)
    keep[1:] = a[1:] != a[:-1]
    return a[keep]
