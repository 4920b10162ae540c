"""Hashes that occur more than once in a corpus, by two Bloom filters a shard."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernmark.llm._common import materialize

#: Total size of the twice-seen filters up to which they are broadcast.
MAX_BROADCAST_BYTES = 64 << 20
BLOOM_BITS, _HASHES = 12, 6
_FIRST = 1 << 14


class Bloom:
    """A Bloom filter over 64-bit hashes that grows by parts: each part has twice the bits of the one before."""

    def __init__(self, parts: list[tuple[np.ndarray, int]] | None = None):
        self.parts = parts or []
        self._room = 0

    @staticmethod
    def _places(h: np.ndarray, n_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a = h * np.uint64(0x9E3779B97F4A7C15)
        b = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
        for k in range(_HASHES):
            at = ((a + np.uint64(k) * b) >> np.uint64(11)) % np.uint64(n_bits)
            yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for bits, _ in self.parts:
            here = np.ones(len(h), bool)
            for byte, mask in self._places(h, len(bits) * 8):
                here &= (bits[byte] & mask) != 0
            found |= here
        return found

    def add(self, h: np.ndarray) -> None:
        while len(h):
            if not self._room:
                self._room = _FIRST << len(self.parts)
                self.parts.append((np.zeros(self._room * BLOOM_BITS // 8, np.uint8), self._room))
            now, h = h[: self._room], h[self._room :]
            bits = self.parts[-1][0]
            for byte, mask in self._places(now, len(bits) * 8):
                np.bitwise_or.at(bits, byte, mask)
            self._room -= len(now)


@dataclass
class Repeated:
    """``filters``: (shard, part, bits) rows of the twice-seen filters."""

    filters: DataFrame
    shards: int

    def small(self) -> bool:
        """Whether all tasks may get the filters."""
        return (self.filters.agg(F.sum(F.length("bits"))).first()[0] or 0) <= MAX_BROADCAST_BYTES


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)) % np.uint64(shards)


def _send(hashes_of: Callable, shards: int):
    """Once for each flush: (shard, the hash, whether it was there before). So no hash, however hot, fills a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        room = 0

        def flush() -> pa.RecordBatch:
            codes, h = pd.factorize(np.concatenate(held).view(np.uint64))
            twice = np.bincount(codes, minlength=len(h)) > 1
            return pa.RecordBatch.from_arrays([pa.array(shard_of(h, shards).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(twice)], ["shard", "h", "twice"])

        for some in hashes_of(batches):
            held.append(some)
            room += len(some)
            if room >= 1 << 18:
                yield flush()
                held, room = [], 0
        if room:
            yield flush()

    return run


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of some shards in; at the end each shard's twice-seen filter."""
    once: dict[int, Bloom] = {}
    twice: dict[int, Bloom] = {}
    for batch in batches:
        shard = batch.column(0).to_numpy()
        h, again = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
        for s in np.unique(shard).tolist():
            seen, more = once.setdefault(s, Bloom()), twice.setdefault(s, Bloom())
            here = shard == s
            codes, keys = pd.factorize(h[here])
            repeated = np.bincount(codes, weights=1.0 + again[here], minlength=len(keys)) > 1
            known = seen.has(keys)
            seen.add(keys[~known])
            found = keys[known | repeated]
            more.add(found[~more.has(found)])
    yield from _parts(twice)


def _parts(filters: dict[int, Bloom]) -> Iterator[pa.RecordBatch]:
    for s, bloom in filters.items():
        for k, (bits, _) in enumerate(bloom.parts):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["shard", "part", "bits"])


def repeated_hashes(rows: DataFrame, hashes_of: Callable) -> Repeated:
    """``hashes_of`` (batches of ``rows`` -> int64 arrays, in parts that count as one each) names what is hashed.

    A hash that occurs twice in the corpus always passes the filters. So do a few
    that occur once: confirm them.
    """
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    sent = rows.mapInArrow(_send(hashes_of, shards), "shard int, h long, twice boolean")
    return Repeated(materialize(sent.repartition("shard").mapInArrow(_filter, "shard int, part int, bits binary"), "repeats"), shards)


def shard_filters(keyed: DataFrame) -> DataFrame:
    """(shard, part, bits): a Bloom filter for each shard of (shard, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, Bloom] = {}
        for batch in batches:
            shard, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for s in np.unique(shard).tolist():
                filters.setdefault(s, Bloom()).add(h[shard == s])
        yield from _parts(filters)

    return materialize(keyed.repartition("shard").mapInArrow(run, "shard int, part int, bits binary"), "filters")


def send_filters(filters: DataFrame):
    """A broadcast of {shard: bits of its parts}; the caller knows that they are small."""
    parts: dict[int, list] = {}
    for r in filters.orderBy("shard", "part").toLocalIterator():
        parts.setdefault(r["shard"], []).append(bytes(r["bits"]))
    return filters.sparkSession.sparkContext.broadcast(parts)


def opened(cache: dict[int, Bloom], parts: dict[int, list], shard: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is in its shard's filter; ``cache`` keeps the filters of a task."""
    out = np.zeros(len(h), bool)
    order = np.argsort(shard, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(own) and (s := int(shard[own[0]])) in parts:
            if s not in cache:
                cache[s] = Bloom([(np.frombuffer(b, np.uint8), 0) for b in parts[s]])
            out[own] = cache[s].has(h[own])
    return out


def suspects(cache: dict[int, Bloom], parts: dict[int, list], shards: int, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be repeated."""
    return opened(cache, parts, shard_of(h, shards).astype(np.int64), h)


def probed_by_shard(rows: DataFrame, repeated: Repeated) -> DataFrame:
    """Of rows (shard, h, ...) those that may be repeated, where the filters are too large for one place.

    Rows go to their shard's filter, which stands before them in the sorted partition.
    """
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        cache: dict[int, Bloom] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, bits = batch.column(0).to_numpy(), batch.column(len(columns))
            is_filter = bits.is_valid().to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(is_filter).tolist():
                parts.setdefault(int(shard[k]), []).append(bits[k].as_py())
            h = batch.column(1).fill_null(0).to_numpy().view(np.uint64)
            passed = ~is_filter
            passed[passed] = opened(cache, parts, shard[passed].astype(np.int64), h[passed])
            last = int(shard[-1])  # shards come one after another
            parts, cache = {s: b for s, b in parts.items() if s == last}, {s: b for s, b in cache.items() if s == last}
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in range(len(columns))], columns).filter(pa.array(passed))

    both = rows.unionByName(repeated.filters, allowMissingColumns=True).select(*columns, "bits", "part")
    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("bits").isNull(), "part")
    return dealt.mapInArrow(run, rows.schema)
