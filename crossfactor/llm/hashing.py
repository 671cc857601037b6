"""Vectorised word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from crossfactor.llm.common import SLICE_BYTES

U64 = np.uint64
#: A random value for each byte and an odd base: words hash as polynomials modulo 2**64.
BYTE_VALUES = np.random.default_rng(20240917).integers(0, 1 << 63, 256, dtype=np.int64).view(U64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Powers of a base that a worker keeps: 8 bytes each.
KEPT = SLICE_BYTES + 4096
powers: dict[int, np.ndarray] = {}


def power_table(base: int, size: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; the first ``KEPT`` stay between calls, longer tables do not."""
    have = powers.get(base)
    if have is None or len(have) < size:
        out = np.full(max(size, KEPT), base, U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        if size <= KEPT:
            powers[base] = have
    return have[:size]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def slices(texts: Sequence[bytes], size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes; a longer text makes a run of its own."""
    begin = held = 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > size:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def byte_spans(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each text closed by a space, and the place where each text begins."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), np.cumsum(sizes) - sizes


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUES[data] * power_table(BASE, len(data)), out=sums[1:])
        raw = (sums[end] - sums[begin]) * power_table(INVERSE, len(data))[begin]
        return mixed(raw + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word, a run of bytes other than ASCII white space."""
    data, starts = byte_spans(texts)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    begin, end = edge[::2], edge[1::2]
    return span_hashes(data, begin, end), np.searchsorted(starts, begin, "right") - 1


def shingles(texts: Sequence[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts: hash, text number, count; by text, then hash.

    A text of fewer than ``width`` words, but one, has one shingle: all its words.
    """
    word, owner = words(texts)
    with np.errstate(over="ignore"):
        steps = power_table(0xC2B2AE3D27D4EB4F, width)
        n = max(len(word) - width + 1, 0)
        sums = np.zeros(n, U64)
        for j in range(width):
            sums += word[j : j + n] * steps[j]
        whole = owner[:n] == owner[width - 1 : width - 1 + n]
        found, place = mixed(sums[whole]), owner[:n][whole]
        count = np.bincount(owner, minlength=len(texts))
        if len(short := np.flatnonzero((count > 0) & (count < width))):
            first = np.cumsum(count) - count
            extra = np.array([int((word[first[i] : first[i] + count[i]] * steps[: count[i]]).sum()) & (1 << 64) - 1 for i in short], U64)
            found, place = np.concatenate((found, mixed(extra + count[short].astype(U64)))), np.concatenate((place, short))
    order = np.lexsort((found, place))
    found, place = found[order], place[order]
    if not len(found):
        return found, place, np.zeros(0, np.int64)
    new = np.concatenate(([True], (found[1:] != found[:-1]) | (place[1:] != place[:-1])))
    at = np.flatnonzero(new)
    return found[at], place[at], np.diff(np.concatenate((at, [len(found)])))
