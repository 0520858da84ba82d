"""Shingle sets of many texts at once, in numpy over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; memory is some 40 times as much.
PIECE = 1 << 18
_RANDOM = np.random.default_rng(1)
#: One for each word of a shingle, and one for each byte of a word; blanks have 0. Any odd numbers will do.
MULTIPLIERS = np.array([m | 1 for m in _RANDOM.integers(0, 2**64, 64, dtype=np.uint64).tolist()], np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUES = np.where(_BLANK, np.uint64(0), _RANDOM.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1))
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _place_factors(start: int, stop: int) -> np.ndarray:
    """Odd factors of the places of a word's bytes."""
    return mixed(np.arange(start + 1, stop + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_FACTORS = _place_factors(0, 1 << 16)


def _sums(data: np.ndarray, breaks: np.ndarray, inside: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum over the bytes, start) of every word, and how many bytes long the last one is, 0 where a blank ends it. Words end at blanks and at
    breaks; inside: so many bytes of the first word came before."""
    word = ~_BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[breaks] = word[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, 0
    body, at = data[starts[0] :], starts - starts[0]
    lengths = np.diff(np.append(at, len(body)))
    place = np.arange(len(body)) - np.repeat(at, lengths)
    if inside and starts[0] == 0:
        place[: lengths[0]] += inside
    top = int(place.max()) + 1
    if top <= len(_FACTORS):
        factors = _FACTORS[place]
    else:
        factors = mixed((place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.add.reduceat(_VALUES[body] * factors, at), starts, int(place[-1]) + 1 if word[-1] else 0


def _long_text(data: np.ndarray) -> np.ndarray:
    """Word sums of one text, piece by piece; a word may go on over pieces, as its sum does."""
    out, inside, none = [], 0, np.zeros(0, np.int64)
    for at in range(0, len(data), PIECE):
        sums, starts, after = _sums(data[at : at + PIECE], none, inside)
        if inside and len(starts) and starts[0] == 0:
            out[-1][-1:] += sums[:1]
            sums = sums[1:]
        inside = after
        if len(sums):
            out.append(sums)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _unique(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _of_words(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    out = h[k - 1 :] * MULTIPLIERS[k - 1] + np.uint64(k)
    for i in range(k - 1):
        out += h[i : len(h) - k + 1 + i] * MULTIPLIERS[i]
    return mixed(out)


def _set(h: np.ndarray, words: int) -> np.ndarray:
    return _unique(_of_words(h, min(words, len(h)))) if len(h) else h


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted set of its shingles' hashes: all runs of `words` words, or the whole of fewer; A-Z count as a-z, words are
    parted by ASCII white space. Null texts have none."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, places, values = texts.buffers()
    ends = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PIECE, "right")) - 1)
        if j == i + 1:
            yield _set(mixed(_long_text(data[ends[i] : ends[j]])), words)
        else:
            own = data[ends[i] : ends[j]]
            breaks = ends[i:j] - ends[i]
            sums, starts, _ = _sums(own, breaks[breaks < len(own)])
            h = mixed(sums)
            runs = _of_words(h, words) if len(h) >= words else h[:0]
            cuts = np.searchsorted(starts, np.append(breaks, len(own))).tolist()
            for a, b in zip(cuts, cuts[1:]):
                yield _unique(runs[a : b - words + 1]) if b - a >= words else _set(h[a:b], words)
        i = j


def shingles(text: str, words: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text]), words))
