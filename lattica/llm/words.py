"""Word hashes for the operators that work on n-grams: NumPy over whole texts, many at a time."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_GROUP = 1 << 18  # bytes hashed at once
_LONG = 1 << 16  # bytes; longer words are hashed one by one
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(words: np.ndarray, n: int, factor: np.uint64 = _ODD) -> np.ndarray:
    """A hash for each run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * factor + words[k : len(words) - n + 1 + k]
    return mixed(h)


def _spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of some bytes."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate(([0], edges))
    if not space[-1]:
        edges = np.concatenate((edges, [len(data)]))
    return edges[::2], edges[1::2]


def _hashed(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words. Each eight bytes of a word are mixed with their place in it, then summed:
    unlike powers of a base modulo 2^64, that has no strings which meet whatever the seed."""
    starts, ends = _spans(data)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    sizes = ends - starts
    eights = np.ndarray(len(data), "<u8", data + bytes(8), 0, (1,))  # the eight bytes from each place on
    first = np.minimum(sizes, 8)
    own = mixed(np.uint64(seed) + sizes.astype(np.uint64) * _STEP)
    h = mixed((eights[starts] << (8 * (8 - first)).astype(np.uint64)) ^ own)
    long = np.flatnonzero(sizes > 8)
    if len(long):
        pieces = (sizes[long] - 1) // 8
        of = np.repeat(long, pieces)
        begun = np.cumsum(pieces) - pieces
        nth = np.arange(len(of)) - np.repeat(begun, pieces) + 1
        left = np.minimum(sizes[of] - 8 * nth, 8)
        value = eights[starts[of] + 8 * nth] << (8 * (8 - left)).astype(np.uint64)
        h[long] += np.add.reduceat(mixed(mixed(value ^ own[of]) + nth.astype(np.uint64) * _ODD), begun)
    return starts, mixed(h)


def _long_text(text: bytes, seed: int) -> np.ndarray:
    """The words of a text of any length, in groups; a word over _LONG bytes is hashed by itself."""
    out, group, size = [], [], 0
    for word in text.split():
        if len(word) > _LONG or size > _GROUP:
            if group:
                out.append(_hashed(b" ".join(group), seed)[1])
            group, size = [], 0
        if len(word) > _LONG:
            out.append(np.array([xxhash.xxh3_64_intdigest(word, seed)], np.uint64))
        else:
            group.append(word)
            size += len(word) + 1
    if group:
        out.append(_hashed(b" ".join(group), seed)[1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes | None], seed: int = 0) -> list[np.ndarray]:
    """For each text a 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, in order; other seeds give independent ones."""
    out: list = [None] * len(texts)
    group, size = [], 0

    def flush() -> None:
        starts, h = _hashed(b"\n".join([texts[i] for i in group]), seed)
        cuts = np.searchsorted(starts, np.cumsum([len(texts[i]) + 1 for i in group]))
        for i, a, b in zip(group, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            out[i] = h[a:b]

    for i, text in enumerate(texts):
        if not text or len(text) > _LONG:
            out[i] = _long_text(text or b"", seed)
            continue
        group.append(i)
        size += len(text) + 1
        if size > _GROUP:
            flush()
            group, size = [], 0
    if group:
        flush()
    return out
