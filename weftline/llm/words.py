"""Words of texts inside tasks: splitting, numbers for equal words, and hashes of stretches of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words that are worked on at a time, where texts allow it: bounds a task's arrays.
GROUP_WORDS = 200_000
MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[bytes]:
    """Maximal runs without space and U+0009 to U+000D: what bytes split at by themselves."""
    return (text or "").encode().split()


def grouped(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Rows from the given one on, with their words, some ``GROUP_WORDS`` words together; a text is never divided."""
    first, held, count = 0, [], 0
    for i, text in enumerate(texts):
        held.append(words(text.as_py()))
        count += len(held[-1])
        if count >= GROUP_WORDS:
            yield first, held
            first, held, count = i + 1, [], 0
    if held:
        yield first, held


def coded(texts: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A number for each word of all texts on end, the distinct words by number, and where each text begins (and the last ends)."""
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    return flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist(), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def word_hashes(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent halves of a 128-bit hash of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * MULTIPLIERS[0]
    z = (z ^ (z >> np.uint64(29))) * MULTIPLIERS[1]
    return z ^ (z >> np.uint64(32))


def ahead(x: np.ndarray, by: int, fill: int = 0) -> np.ndarray:
    out = np.full(len(x), fill, x.dtype)
    out[: max(len(x) - by, 0)] = x[by:]
    return out


def rolled(x: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` entries from each place on, from stretches of doubled length."""
    out, done, part, length = None, 0, x, 1
    while size:
        if size & 1:
            piece = ahead(part, done)
            out = piece if out is None else mixed(out * MULTIPLIERS[0] + piece)
            done += length
        size >>= 1
        if size:
            part, length = mixed(part * MULTIPLIERS[1] + ahead(part, length)), 2 * length
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of the ``size`` entries from each place on."""
    most, length = 2**64 - 1, 1
    while 2 * length <= size:
        x, length = np.minimum(x, ahead(x, length, most)), 2 * length
    return np.minimum(x, ahead(x, size - length, most)) if length < size else x


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts, on end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
