"""Hashes of words and of runs of words, for whole batches of texts at once.

A text is a byte string in UTF-8; the separators are ASCII, so bytes are enough. A word's hash is the mixed sum of one random 64-bit
number for each of its bytes and their places; a run's hash joins those of its halves by a multiplication and a mixing, so
no run of words has the algebra of a polynomial. Two independent hashes of every word are there where 128 bits are wanted.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time: intermediate arrays have eight bytes for each of them.
PIECE = 1 << 18
_U = np.uint64
_JOIN, _PLACE, _SALTS = _U(0xD6E8FEB86659FD93), _U(0x9E3779B97F4A7C15), (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344))
#: Places in a word whose numbers are looked up; those further back are worked out.
_NEAR = 32
_tables: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words without ASCII punctuation, for matching across formatting.
LOOSE = SPACE.copy()
LOOSE[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _numbers(key: np.ndarray, salt: int) -> np.ndarray:
    """The random number of each (place << 8 | byte)."""
    return mix((key.astype(_U) + _U(1)) * _PLACE ^ _SALTS[salt])


def _words(b: np.ndarray, at: np.ndarray, place: np.ndarray, first: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    """The hashes of words whose bytes are b[at], at ``place`` in their word; word i has size[i] bytes from at[first[i]] on."""
    if salt not in _tables:
        _tables[salt] = _numbers(np.arange(_NEAR << 8), salt)
    key = (place << 8) | b[at]
    found = _tables[salt][np.minimum(key, (_NEAR << 8) - 1)]
    far = np.flatnonzero(place >= _NEAR)
    if len(far):
        found[far] = _numbers(key[far], salt)
    return mix(np.add.reduceat(found, first) + size.astype(_U) * _JOIN)


def _pieces(texts: list[bytes | None], separators: np.ndarray):
    """(buffer, [(text number, start in buffer)]): texts joined by a separator to about PIECE bytes; longer ones are cut where a word ends."""
    parts, at, size, glue = [], [], 0, bytes([np.flatnonzero(separators)[0]])
    for i, text in enumerate(texts):
        if not text:
            continue
        begin, n = 0, len(text)
        while begin < n:
            end = n
            if n - begin > 2 * PIECE:
                view = np.frombuffer(text, np.uint8, PIECE, begin + PIECE)
                cut = np.flatnonzero(separators[view])
                end = begin + PIECE + int(cut[0]) if len(cut) else min(n, _word_end(text, begin + 2 * PIECE, separators))
            if size and size + end - begin > PIECE:
                yield glue.join(parts), at
                parts, at, size = [], [], 0
            at.append((i, size))
            parts.append(text[begin:end] if begin or end < n else text)
            size += end - begin + 1
            begin = end
    if parts:
        yield glue.join(parts), at


def groups(texts: list[bytes | None], size: int = 4 * PIECE):
    """(start, stop) of consecutive texts of about ``size`` bytes together, so that arrays for their words stay small."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text or b"") > size:
            yield start, i
            start, total = i, 0
        total += len(text or b"")
    if start < len(texts):
        yield start, len(texts)


def _word_end(text: bytes, at: int, separators: np.ndarray) -> int:
    while at < len(text):
        cut = np.flatnonzero(separators[np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at)])
        if len(cut):
            return at + int(cut[0])
        at += PIECE
    return len(text)


def word_hashes(texts: list[bytes | None], lower: bool, separators: np.ndarray = SPACE, salts: tuple[int, ...] = (0,)):
    """(hashes, ..., bounds), hashes once for each salt: the words of text i are hashes[bounds[i]:bounds[i + 1]], in order."""
    found, counts = [[] for _ in salts], np.zeros(len(texts) + 1, np.int64)
    for buffer, at in _pieces(texts, separators):
        b = np.frombuffer(buffer, np.uint8)
        if lower:
            b = _LOWER[b]
        word = ~separators[b]
        edge = np.empty(len(b) + 1, bool)
        edge[0], edge[-1] = word[0], word[-1]
        np.not_equal(word[1:], word[:-1], out=edge[1:-1])
        edges = np.flatnonzero(edge)
        starts, size = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            first = np.cumsum(size) - size
            inside = np.flatnonzero(word)
            place = np.arange(len(inside)) - np.repeat(first, size)
            for out, salt in zip(found, salts, strict=True):
                out.append(_words(b, inside, place, first, size, salt))
        marks = np.searchsorted(starts, [s for _, s in at] + [len(b)])
        np.add.at(counts, [i + 1 for i, _ in at], np.diff(marks))
    return (*(np.concatenate(of) if of else np.zeros(0, _U) for of in found), np.cumsum(counts))


def _every_run(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k hashes from each place on where there are as many: halves are joined, then halves of halves."""
    join = lambda a, b: mix(a * _JOIN + b)
    power, size, out, covered = hashes, 1, None, 0
    while True:
        if k & size:
            out = power if out is None else join(power[: len(hashes) - covered - size + 1], out[size:])
            covered += size
        if 2 * size > k:
            return out if k > 1 else mix(out ^ _PLACE)
        power, size = join(power[:-size], power[size:]), 2 * size


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the runs of k consecutive words; those of text i are in order of their start."""
    n = np.diff(bounds)
    many = np.maximum(n - k + 1, 0)
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(many, out=out[1:])
    if not out[-1]:
        return np.zeros(0, _U), out
    starts = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], many)
    return _every_run(hashes, k)[starts], out


def runs(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One hash for hashes[first[i]:first[i] + size[i]], for every i; sizes are 1 or more."""
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    each = mix(hashes[np.repeat(first, size) + place] + (place + 1).astype(_U) * _PLACE)
    return mix(np.add.reduceat(each, begin) + size.astype(_U) * _JOIN) if len(size) else np.zeros(0, _U)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As windows(), but a text of fewer words, if it has any, gives the whole sequence as its one shingle."""
    n = np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < k))
    h, out = windows(hashes, bounds, k)
    if not len(short):
        return h, out
    return np.insert(h, out[short], runs(hashes, bounds[short], n[short])), out + np.searchsorted(short, np.arange(len(out)))


def positive(h: np.ndarray) -> np.ndarray:
    """63 bits, as Spark's long."""
    return (h >> _U(1)).astype(np.int64)
