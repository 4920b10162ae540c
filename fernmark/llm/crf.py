"""A two-label linear-chain conditional random field over the words of lines, in numpy.

A chain is a line of a text. Words are runs of ASCII letters, digits,
apostrophes and bytes over 0x7F, with A-Z lower-cased. Scripts that put no
blanks between words (characters of three bytes or more, but for the block of
general punctuation and symbols) are read by overlapping runs of characters:
each character is a word that looks as far as the three after it. A word's features are
the hash of all its bytes, its first 3 to 8 bytes and its last 4; a hashed weight each. All
chains of a chunk run together, longest first, so a step of the forward or
backward recursion is a few numpy calls for as many chains as are that long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

BITS = 18
_PREFIXES = (3, 4, 5, 6, 7, 8)
N_FEATURES = len(_PREFIXES) + 2
_CHUNK = 1 << 20
_KEEP = np.zeros(256, bool)
_KEEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = True
#: First bytes of characters that are words of their own.
_WIDE = np.zeros(256, bool)
_WIDE[[0xE0, 0xE1, *range(0xE3, 0xF8)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of some texts: bytes [start, end) of the joined texts, the text and the chain each is in."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    chain: np.ndarray
    features: np.ndarray  # (words, N_FEATURES), hashed
    begin: np.ndarray  # of the texts in the joined bytes


def _cut(raw: np.ndarray, run_start: np.ndarray, run_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in runs, and how far each looks: to its end, or four characters on in scripts without blanks."""
    wide = _WIDE[raw]
    if not wide.any():
        return run_start, run_end, run_end
    lead = np.flatnonzero(_KEEP[raw] & ((raw & 0xC0) != 0x80))  # first bytes of characters
    begins = wide[lead].copy()
    begins[1:] |= wide[lead[:-1]]
    start = np.union1d(run_start, lead[begins])
    stop = run_end[np.searchsorted(run_end, start, side="right")]  # of the run
    end = np.minimum(np.append(start[1:], len(raw)), stop)
    at = np.searchsorted(lead, start)
    ahead = np.append(lead, np.full(4, len(raw)))[at + 4]
    return start, end, np.where(wide[start], np.minimum(ahead, stop), end)


def _whole(folded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, all of them."""
    if not len(start):
        return np.zeros(0, np.uint64)
    upto = np.cumsum(size)
    place = np.arange(upto[-1]) - np.repeat(upto - size, size)
    value = folded[np.repeat(start, size) + place].astype(np.uint64) + np.uint64(1)
    return np.add.reduceat(_mix((place.astype(np.uint64) << np.uint64(9)) + value), upto - size)


def words_of(texts: list[str | None]) -> Words:
    parts = [(t or "").encode() + b"\n" for t in texts]
    begin = np.cumsum([0, *map(len, parts)])
    raw = np.frombuffer(b"".join(parts) + b"\n" * 24, np.uint8)
    keep = _KEEP[raw]
    edge = np.diff(keep.astype(np.int8), prepend=0)
    run_start, run_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    start, end, look = _cut(raw, run_start, run_end)
    lines = np.cumsum(raw == 0x0A)
    folded = _FOLD[raw]
    size = look - start
    eight = folded[start[:, None] + np.arange(8)].reshape(-1, 8).view("<u8").ravel() if len(start) else np.zeros(0, np.uint64)
    first = eight & _MASKS[np.minimum(size, 8)]
    whole = _mix(_whole(folded, start, size) + size.astype(np.uint64))
    last = folded[np.maximum(look[:, None] - np.arange(4, 0, -1), start[:, None])].reshape(-1, 4).view("<u4").ravel().astype(np.uint64)
    keys = [whole, _mix(last + (np.uint64(99) << np.uint64(48)))]
    for n in _PREFIXES:
        cut = first & _MASKS[np.minimum(size, n)]
        keys.append(np.where(size >= n, _mix(cut ^ (np.uint64(n) << np.uint64(60)) ^ np.uint64(n * 7919)), np.uint64(n)))  # one feature for all shorter words
    return Words(start, end, np.searchsorted(begin, start, side="right") - 1, lines[start], np.stack(keys, axis=1), begin)


def chunks(texts: list[str | None], size: int = _CHUNK) -> Iterator[list[str | None]]:
    held, room = [], 0
    for t in texts:
        held.append(t)
        room += len(t or "") + 1
        if room >= size:
            yield held
            held, room = [], 0
    if held:
        yield held


@dataclass
class Crf:
    """weights: of features, for label 1 over label 0; moves[a, b]: from label a to b; bias: of label 1."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = -3.0

    def slots(self, w: Words) -> np.ndarray:
        return (w.features >> np.uint64(64 - BITS)).astype(np.int32)

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(axis=1) + self.bias

    def marginals(self, e: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of label 1 at each word by forward and backward; and the forward and backward log odds."""
        n = len(e)
        a, b = e.copy(), np.zeros(n)
        if n:
            first = np.flatnonzero(np.diff(chain, prepend=chain[0] - 1))
            size = np.diff(first, append=n)
            order = np.argsort(-size, kind="stable")
            first, size = first[order], size[order]
            active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # chains longer than t
            m = np.exp(self.moves)
            for t in range(1, len(active)):
                at = first[: active[t]] + t
                x = np.exp(np.clip(a[at - 1], -30, 30))
                a[at] += np.log((m[0, 1] + m[1, 1] * x) / (m[0, 0] + m[1, 0] * x))
            for t in range(len(active) - 2, -1, -1):
                at = first[: active[t + 1]] + t
                x = np.exp(np.clip(e[at + 1] + b[at + 1], -30, 30))
                b[at] = np.log((m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x))
        return a + b, a, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[Words], labels: list[np.ndarray], *, steps: int = 300, rate: float = 0.5, decay: float = 1e-6) -> Crf:
    """Fit by Adagrad on the log likelihood of labelled words; one step for each entry of ``texts``, 3 to 15 rounds."""
    crf = Crf()
    seen, seen_moves, seen_bias = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    slots = [crf.slots(w) for w in texts]
    for _ in range(min(15, max(3, steps // max(1, len(texts))))):
        for w, s, y in zip(texts, slots, labels):
            if not len(y):
                continue
            e = crf.emissions(s)
            log_odds, a, b = crf.marginals(e, w.chain)
            miss = y - sigmoid(log_odds)
            grad = np.bincount(s.ravel(), weights=np.repeat(miss, N_FEATURES), minlength=1 << BITS) - decay * crf.weights * len(y)
            seen += grad**2
            crf.weights += rate * grad / np.sqrt(seen)
            same = np.flatnonzero(w.chain[1:] == w.chain[:-1])
            if len(same):
                # Pair marginals: p(u, v) is proportional to alpha_u * move_uv * psi_v * beta_v.
                tail = e[same + 1] + b[same + 1]
                scores = np.stack([crf.moves[u, v] + u * a[same] + v * tail for u in (0, 1) for v in (0, 1)])
                p = np.exp(scores - scores.max(axis=0))
                p /= p.sum(axis=0)
                u, v = y[same].astype(int), y[same + 1].astype(int)
                g = (np.bincount(u * 2 + v, minlength=4) - p.sum(axis=1)).reshape(2, 2)
                seen_moves += g**2
                crf.moves += rate * g / np.sqrt(seen_moves)
                crf.moves -= crf.moves[0, 0]
            g = miss.sum()
            seen_bias += g**2
            crf.bias += rate * g / np.sqrt(seen_bias)
    return crf
