"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string arrays.  A slice of them is laid out as one array
of code points with document offsets; words, pre-tokens and n-grams are then
found and hashed by whole-array NumPy operations.
"""

from __future__ import annotations

import ctypes
import platform
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_libc = ctypes.CDLL("libc.so.6") if platform.libc_ver()[0] == "glibc" else None
if _libc:
    _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays from 1 MB on go back to the system as they are freed
    pa.set_memory_pool(pa.system_memory_pool())
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(None)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    major = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[_WHITE] = SPACE
    return table


@lru_cache(None)
def lower_table() -> np.ndarray:
    """Simple one-to-one lower-casing of every code point."""
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(None)
def char_codes() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _pow(which: str, n: int) -> np.ndarray:
    """At least n powers of the base (or of its inverse) modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        a = np.ones(size, np.uint64)
        a[1:] = np.uint64(_BASE if which == "up" else _INVERSE)
        have = _powers[which] = np.cumprod(a)
    return have


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end), equal for equal contents wherever they stand."""
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(char_codes()[cp] * _pow("up", len(cp))[: len(cp)], out=total[1:])
    h = (total[ends] - total[starts]) * _pow("down", len(cp) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, or of one longer text."""
    if not len(texts):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a, n = 0, len(size)
    while a < n:
        base = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, base + limit, "right")))
        yield a, b
        a = b
    release()


def release() -> None:
    """Give memory that was freed back to the system: a worker lives on between stages, beside others."""
    pa.default_memory_pool().release_unused()
    if _libc:
        _libc.malloc_trim(0)


_held: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None] | None = None) -> None:
    """What an operator begins with in a worker: what others left there for their next task is dropped, and drop will drop its own."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    if others:
        release()
    if drop:
        _held[name] = drop


class Slice:
    """Code points of a range of texts; null counts as empty.

    cp: code points; at: the offsets of the texts, one more than texts; raw: the UTF-8 bytes.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        self.at = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=self.at[1:])
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        data = texts.buffers()[2] if len(texts) else None
        self.byte_at = offsets.astype(np.int64) - int(offsets[0])
        self.raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.cp = np.frombuffer(self.raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.n = len(lengths)

    def word_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased code points, and starts and ends of the words in them: maximal runs of letters and numbers."""
        low = lower_table()[self.cp]
        inside = (kind := classes()[self.cp]) == LETTER
        inside |= kind == NUMBER
        edge = np.zeros(len(low) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        if len(low):
            edge[0], edge[-1] = inside[0], inside[-1]
            mid = self.at[1:-1]
            mid = mid[(mid > 0) & (mid < len(low))]
            cut = mid[inside[mid] & inside[mid - 1]]  # a text that ends within a word next to one that begins with one
        else:
            cut = np.zeros(0, np.int64)
        points = np.flatnonzero(edge)
        s, e = points[::2], points[1::2]
        if len(cut):
            cut = np.unique(cut)
            s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
        return low, s, e

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' hashes, their starts, and the text that each is in."""
        low, s, e = self.word_spans()
        if not len(s):
            return np.zeros(0, np.uint64), s, s
        return span_hashes(low, s, e), s, np.searchsorted(self.at, s, "right") - 1


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of range(start, start + length) over all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
