"""Shingle sets and SuperMinHash signatures in numpy, many texts at a time."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

from sparkcomm.llm.common import byte_words

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
#: Elements that take later steps of SuperMinHash together; each holds a permutation of the slots.
TOGETHER = 40_000
#: Words whose hashes a worker keeps.
HASHES = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes(dict):
    """64-bit hashes by word; emptied when full and when a task ends (workers live on)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HASHES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = Hashes()


def forget() -> None:
    """Give back what the hashes of this task take."""
    _HASHES.clear()


def _chain(h: np.ndarray, width: int, n: int) -> np.ndarray:
    out = np.full(n, width, _U)
    for i in range(width):
        out = mix(out * _U(_GOLD) + h[i : i + n])
    return out


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of the whole sequence if shorter; empty without words."""
    words = [byte_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), _U, int(sizes.sum()))
    runs = _chain(h, width, max(len(h) - width + 1, 0))
    out, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            s = np.sort(runs[at : at + n - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(_chain(h[at : at + n], n, 1) if n else h[:0])
        at += n
    return out


def _step(elements: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Place swapped with place j, and the offer, of every element at step j."""
    u = mix(elements + _U(((j + 1) * _GOLD) & (2**64 - 1)))
    return j + (((u & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64), (_U(j) << _U(32)) | (u >> _U(32))


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of m values a set; all ones for an empty set.

    An element offers j + r (r random, below 1) to the slot that a random permutation of its own names at step
    j, and a slot keeps the least offer. Steps run over all elements of all sets at once. As step j offers no
    less than j, a set is done when all its slots hold less than the next step's number: most are after one.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    best = np.full((len(sets), m), ~_U(0), _U)
    if not sizes.sum():
        return best
    owner = np.repeat(np.arange(len(sets)), sizes)
    elements = np.concatenate(sets)
    place, offer = _step(elements, 0, m)
    np.minimum.at(best.reshape(-1), owner * m + place, offer)
    left = np.flatnonzero((best.max(1) == ~_U(0)) & (sizes > 0))
    ends = np.cumsum(sizes[left])
    for part in np.split(left, np.unique(np.searchsorted(ends, np.arange(TOGETHER, ends[-1], TOGETHER)))) if len(left) else []:
        mine = np.isin(owner, part)
        _later_steps(best, owner[mine], elements[mine], m)
    return best


def _later_steps(best: np.ndarray, owner: np.ndarray, elements: np.ndarray, m: int) -> None:
    if not len(owner):
        return
    order = np.empty((len(elements), m), np.int16)
    order[:] = np.arange(m, dtype=np.int16)
    rows = np.arange(len(elements))
    place, _ = _step(elements, 0, m)
    order[rows, place] = 0
    order[:, 0] = place
    for j in range(1, m):
        place, offer = _step(elements, j, m)
        slot = order[rows, place].astype(np.int64)
        order[rows, place] = order[:, j]
        np.minimum.at(best.reshape(-1), owner * m + slot, offer)
        open_ = (best.max(1) >> _U(32) > _U(j))[owner]
        if not open_.any():
            return
        if open_.sum() < 0.6 * len(open_):
            owner, elements, order = owner[open_], elements[open_], order[open_]
            rows = np.arange(len(elements))
