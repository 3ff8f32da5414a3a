"""Word hashes of whole batches of texts in Python workers, shared by the operators on words and shingles."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is hashed by itself.
CHUNK_BYTES = 1 << 20
#: Powers of the word polynomial that are kept; bytes further into a word start over with another factor.
POWERS = 4096

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with the memory that its task has freed given back to the system at the end.

    Python workers outlive their tasks, and what their allocators keep adds up over the stages of a job.
    """

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit values that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
_POWER = np.cumprod(np.array([1] + [0xD1342543DE82EF95] * (POWERS - 1), np.uint64))


def hash_words(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the runs of bytes that aren't in gap; data and gap have one entry a byte.

    A hash is a 64-bit polynomial of the word's bytes, mixed; equal words have equal hashes wherever they stand.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    np.logical_not(gap, out=inside[1:-1].view(bool))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    values = _BYTE[data[~gap]]
    if sizes.max() > POWERS:
        values *= mix((place // POWERS).astype(np.uint64)) | np.uint64(1)
        place %= POWERS
    values *= _POWER[place]
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64)), starts, ends


def chunks(texts: Iterable[pa.StringScalar]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts (null: empty) in UTF-8, so many at once, and where each starts when they are joined by one byte."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = text.as_buffer()
        held.append(raw.to_pybytes() if raw is not None else b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield held, _starts(held)
            held, size = [], 0
    if held:
        yield held, _starts(held)


def _starts(texts: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.cumsum(sizes) - sizes


def shingle_sets(texts: Iterable[pa.StringScalar], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; of the whole sequence if it is shorter.

    Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased. Null and wordless texts have no hashes.
    """
    for held, starts in chunks(texts):
        data = np.frombuffer(b"\n".join(held).translate(_LOWER), np.uint8)
        words, at, _ = hash_words(data, _BLANK[data])
        bounds = np.append(np.searchsorted(at, starts), len(words))
        whole = words[: max(0, len(words) - k + 1)].copy()
        for i in range(1, k):
            whole = mix(whole * STEP + words[i : len(whole) + i])
        whole = mix(whole + np.uint64(k))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if high - low >= k:
                found = np.sort(whole[low : high - k + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            else:
                yield _short(words[low:high])


def _short(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    h = words[:1].copy()
    for w in words[1:]:
        h = mix(h * STEP + w)
    return mix(h + np.uint64(len(words)))
