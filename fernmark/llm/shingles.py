"""Hashed word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_LONG = 512
_MULT = np.random.default_rng(104729).integers(0, 1 << 63, _LONG, np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Sets:
    """Distinct shingles of texts: ``tokens[offsets[i]:offsets[i + 1]]``, ascending, are text i's."""

    tokens: np.ndarray
    offsets: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.sizes)


def chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    held, room = [], 0
    for t in texts:
        held.append(t)
        room += len(t or "") + 1
        if room >= _CHUNK:
            yield held
            held, room = [], 0
    if held:
        yield held


def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and its text."""
    parts = [(t or "").encode() + b"\n" for t in texts]
    begin = np.cumsum([0, *map(len, parts)])
    raw = np.frombuffer(b"".join(parts), np.uint8)
    inside = ~_WHITE[raw]
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1 - start
    letters = _FOLD[raw[inside]]
    first = np.cumsum(size) - size
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
    long = np.flatnonzero(size > _LONG)
    if len(long):
        place %= _LONG
    h = np.add.reduceat(_MULT[place] * (letters + np.uint64(1)), first)
    for k in long.tolist():
        h[k] = xxhash.xxh3_64_intdigest(letters[first[k] : first[k] + size[k]].tobytes())
    return mix(h + size.astype(np.uint64)), np.searchsorted(begin, start, side="right") - 1


def shingle_sets(texts: list[str | None], n: int = 5) -> Sets:
    """Sets of ``n``-word shingles; a text of fewer words is one shingle, one without words none."""
    words, text = _word_hashes(texts)
    count = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    short = (count > 0) & (count < n)
    hashes, owners = [], []
    if len(words) >= n:
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total += mix(words[k : len(words) - n + 1 + k] * np.uint64(2 * k + 3))
        whole = text[: len(total)] == text[n - 1 :]
        hashes.append(mix(total[whole]))
        owners.append(text[: len(total)][whole])
    if short.any():
        mine = short[text]
        w, t = words[mine], text[mine]
        first = np.flatnonzero(np.diff(t, prepend=-1))
        place = np.arange(len(w)) - np.repeat(first, np.diff(first, append=len(w)))
        hashes.append(mix(np.add.reduceat(mix(w * (2 * place + 3).astype(np.uint64)), first) + np.uint64(1)))
        owners.append(t[first])
    if not hashes:
        return Sets(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return Sets(h, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(texts)))]).astype(np.int64))
