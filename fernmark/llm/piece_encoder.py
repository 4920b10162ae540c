"""Byte-level BPE through the tokenizers library, one call per distinct piece.

A byte-level BPE tokenizer first cuts a text into pieces (words with their
leading space, numbers, signs, white space) and merges inside each piece only.
So the ids of a text are the ids of its pieces joined, and a piece that was
seen before need not be merged again. Pieces are cut and looked up by hash with
numpy, and compared with what stands there, character by character; the library
encodes each distinct piece once per worker. Texts with a piece that differs from
its namesake go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTER, _NUMBER, _SPACE = 1, 2, 3
#: Unicode's White_Space property. Fixed values.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe as a piece of its own. Fixed values.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LONG = 512
_MAX_CACHED = 1_000_000
_MAX_SEEN = 1 << 24
_CHUNK = 1 << 19


def _classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[list(_WHITE)] = _SPACE
    return table


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``start``, one after another."""
    upto = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


class PieceEncoder:
    """``encode(texts)`` gives (ids of all texts joined, number of ids of each)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        spec = json.loads(self._tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level tokenizers without normalizer or prefix space")
        self._added = [t["content"] for t in spec["added_tokens"]]
        self.dtype = np.uint16 if self._tok.get_vocab_size() <= 1 << 16 else np.uint32
        self._table = _classes()
        self._mult = np.random.default_rng(20240229).integers(0, 1 << 63, _LONG, np.uint64) * np.uint64(2) + np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        #: Keys in order and the slots they have: a search instead of a table of objects.
        self._sorted, self._slot_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: By slot: key, place and number of its ids, place and number of its characters, and whether it was met again.
        self._keys, self._off, self._seen_at = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._len, self._seen_len, self._again = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, bool)
        self._flat, self._seen = np.zeros(1 << 14, self.dtype), np.zeros(1 << 14, np.uint32)
        self._used = self._seen_used = 0

    def _compact(self) -> None:
        """Keeps the pieces that were met again since they came, or since the last time; most others never come again."""
        keep = np.flatnonzero(self._again[: len(self._sorted)])
        if len(keep) > _MAX_CACHED * 3 // 4 or self._seen_len[keep].sum() > _MAX_SEEN * 3 // 4:
            keep = keep[:0]
        keys, lens, sizes = self._keys[keep], self._len[keep], self._seen_len[keep]
        flat, seen = self._flat[_runs(self._off[keep], lens)], self._seen[_runs(self._seen_at[keep], sizes)]
        self._forget()
        self._add(keys, lens, flat, sizes, seen)

    def _add(self, keys: np.ndarray, lens: np.ndarray, flat: np.ndarray, sizes: np.ndarray, chars: np.ndarray) -> None:
        first = len(self._sorted)
        last = first + len(keys)
        while last > len(self._off):
            for name in ("_keys", "_off", "_seen_at", "_len", "_seen_len", "_again"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while self._used + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while self._seen_used + len(chars) > len(self._seen):
            self._seen = np.concatenate([self._seen, np.zeros_like(self._seen)])
        self._flat[self._used : self._used + len(flat)] = flat
        self._seen[self._seen_used : self._seen_used + len(chars)] = chars
        self._keys[first:last], self._len[first:last], self._seen_len[first:last] = keys, lens, sizes
        self._off[first:last] = self._used + np.cumsum(lens) - lens
        self._seen_at[first:last] = self._seen_used + np.cumsum(sizes) - sizes
        self._used += len(flat)
        self._seen_used += len(chars)
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(self._sorted, keys[order])
        self._sorted, self._slot_of = np.insert(self._sorted, at, keys[order]), np.insert(self._slot_of, at, first + order)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of keys, and whether there is one."""
        if not len(self._sorted):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self._sorted, keys), len(self._sorted) - 1)
        return self._slot_of[at], self._sorted[at] == keys

    def _store(self, keys: np.ndarray, pieces: list[str]) -> None:
        encoded = [e.ids for e in self._tok.encode_batch_fast(pieces, add_special_tokens=False)]
        lens = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter(chain.from_iterable(encoded), self.dtype, int(lens.sum()))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self._add(keys, lens, flat, sizes, np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4"))

    def _starts(self, cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin; ``ends``: ends of the texts in ``cp``."""
        n = len(cp)
        kind = self._table[cp]
        edge = np.zeros(n + 1, bool)
        edge[0] = True
        edge[ends] = True
        start = edge[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        white = kind == _SPACE
        # The last of some white space before something else stands alone, or, if it is U+0020, begins that.
        last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n])
        start[last] = True
        joined = last[cp[last] == 0x20] + 1
        start[joined] = False
        quotes = np.flatnonzero((cp == 0x27) & start)
        for i in quotes.tolist():
            stop = int(ends[np.searchsorted(ends, i, side="right")])
            after = "".join(map(chr, cp[i + 1 : min(i + 3, stop)].tolist()))
            found = next((c for c in _CONTRACTIONS if after.startswith(c)), None)
            if found:
                start[i + 1] = False
                if i + 1 + len(found) < n:
                    start[i + 1 + len(found)] = True
        return np.flatnonzero(start)

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not joined:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        if len(self._sorted) > _MAX_CACHED or self._seen_used > _MAX_SEEN:
            self._compact()
        cp = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        begin = self._starts(cp, ends)
        size = np.diff(begin, append=len(cp))
        place = np.arange(len(cp), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
        long = np.flatnonzero(size > _LONG)
        if len(long):
            place %= _LONG
        keys = np.add.reduceat(self._mult[place] * (cp + np.uint32(1)), begin) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
        if len(long):  # no two long pieces share a key
            keys[long] = np.fromiter((hash(("long", joined[b : b + s])) & (2**64 - 1) for b, s in zip(begin[long].tolist(), size[long].tolist())), np.uint64, len(long))
        back, keys = pd.factorize(keys)
        at = np.empty(len(keys), np.int64)
        at[back[::-1]] = np.arange(len(back) - 1, -1, -1)  # first place of each
        slots, known = self._find(keys)
        self._again[slots[known]] = True
        if not known.all():
            new = np.flatnonzero(~known)
            b, s = begin[at[new]].tolist(), size[at[new]].tolist()
            self._store(keys[new], [joined[x : x + y] for x, y in zip(b, s)])
            slots = self._find(keys)[0]
        slots = slots[back]
        if not np.array_equal(self._seen[np.minimum(np.repeat(self._seen_at[slots], size) + np.arange(len(cp)) - np.repeat(begin, size), len(self._seen) - 1)], cp):
            encoded = [e.ids for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([x for ids in encoded for x in ids], self.dtype), np.fromiter(map(len, encoded), np.int64, len(encoded))
        lens = self._len[slots].astype(np.int64)
        total = np.cumsum(lens)
        ids = self._flat[_runs(self._off[slots], lens)]
        upto = np.searchsorted(begin, ends)  # pieces before each text's end
        counts = np.diff(np.concatenate([[0], total])[upto], prepend=0)
        return ids, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner, text_no, room = [], [], 0, 0
        out_ids: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)

        def flush() -> None:
            nonlocal room
            if parts:
                ids, n = self._encode_chunk(parts)
                out_ids.append(ids)
                np.add.at(counts, owner, n)
            parts.clear()
            owner.clear()
            room = 0

        for text_no, text in enumerate(texts):
            text = text or ""
            if any(a in text for a in self._added):  # the library cuts these out first
                flush()
                ids = np.array(self._tok.encode(text, add_special_tokens=False).ids, self.dtype)
                out_ids.append(ids)
                counts[text_no] += len(ids)
                continue
            while len(text) > _CHUNK and (m := _CUT.search(text, _CHUNK)):
                flush()
                parts.append(text[: m.start()])
                owner.append(text_no)
                text = text[m.start() :]
            parts.append(text)
            owner.append(text_no)
            room += len(text)
            if room >= _CHUNK:
                flush()
        flush()
        return (np.concatenate(out_ids) if out_ids else np.zeros(0, self.dtype)), counts
