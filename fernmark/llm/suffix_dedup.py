"""Removal of byte strings of ``length`` bytes that occur more than once in a corpus.

A suffix array of a whole corpus can't be sorted by parts, so the suffixes are
sampled so that equal strings keep the same samples: of the ``length - GRAM + 1``
grams (``GRAM`` bytes) of each string, the one with the lowest hash is an anchor.
Strings that occur twice contain an anchor at the same offset. The suffixes at
anchors with equal grams, and the reversed prefixes before them, are sorted by
deep-shallow sorting (``deep_shallow``). The common prefixes of sorted neighbours
say which strings around the anchor occur elsewhere, exactly: with left classes
of depth o and right classes of depth ``length - o``, two anchors hold the same
string at offset o if both their classes agree.

A context (what a string can hold around an anchor) that occurs often is sent
once by each task with a count. Gram groups of more than ``MAX_GROUP`` contexts
are split by ranges of the offset: all strings of a range hold a longer core in
common, whose hash splits the group. What is left in a range of one offset holds
one string throughout, so there is nothing to sort: it is counted by the string's
hash of 128 bits, as are contexts and rows told apart.

Defined cases: a null text is empty; texts shorter than ``length`` keep every
byte, though they are compared like all; repeated rows and repeated or null ids
are documents of their own; very long texts are read in overlapping pieces; an
empty table gives an empty result; ids may be of any type that casts to a string;
other columns are ignored. Removal may cut inside a UTF-8 character: the result
is bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.llm._common import broadcast_if_small, materialize, pieces, row_key, table, under
from fernmark.llm.deep_shallow import sort_group

GRAM = 64
#: Most contexts of one group that are sorted in one task.
MAX_GROUP = 20_000
#: Most rows (16 to 40 bytes) that are broadcast.
MAX_BROADCAST_ROWS = 1_000_000
#: Anchors of a gram, or places of a context, from which on it may be dealt to several tasks.
HOT = 10_000
_MOST_SALTS = 1 << 16
_CHUNK = 1 << 20
_PIECE = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * _CHUNK)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram hash) of the anchors of texts [begin, end) of ``data``, at most 2**24 bytes."""
    n, width = len(data), length - GRAM + 1
    grams = n - GRAM + 1
    if grams < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _pow(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[:n])])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[:grams]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    # Leftmost of the lowest: the place breaks ties.
    value = (h & np.uint64(~0xFFFFFF & (2**64 - 1))) | np.arange(grams, dtype=np.uint64)
    blocks = -(-grams // width)
    padded = np.full(blocks * width, 2**64 - 1, np.uint64)
    padded[:grams] = value
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = grams - width + 1
    lowest = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    valid = np.zeros(windows + 1, np.int32)
    for sign, at in ((1, begin), (-1, np.maximum(begin, end - length + 1))):
        np.add.at(valid, np.minimum(at, windows), sign)
    lowest = lowest[np.cumsum(valid[:-1]) > 0]
    place = (lowest & np.uint64(0xFFFFFF)).astype(np.int64)
    place = place[np.diff(place, prepend=-1) != 0]
    return place, h[place]


def anchors_of(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place in it, gram hash) of all anchors, by chunks."""
    some: list[int] = []
    room = 0

    def run() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(texts[k] for k in some), np.uint8)
        end = np.cumsum([len(texts[k]) for k in some])
        begin = end - [len(texts[k]) for k in some]
        place, h = anchors(data, begin, end, length)
        which = np.searchsorted(end, place, side="right")
        return np.array(some)[which], place - begin[which], h

    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > _PIECE:  # by overlapping pieces: every string of ``length`` bytes is in one
            found = []
            for at in range(0, len(text) - length + 1, _PIECE):
                piece = np.frombuffer(text[at : at + _PIECE + length - 1], np.uint8)
                place, h = anchors(piece, np.zeros(1, np.int64), np.array([len(piece)]), length)
                found.append((place + at, h))
            place, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
            yield np.full(len(place), k), place, np.concatenate([h for _, h in found])[first]
            continue
        some.append(k)
        room += len(text)
        if room >= _CHUNK:
            yield run()
            some, room = [], 0
    if some:
        yield run()


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in column]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, place, h in anchors_of(_texts(batch.column(1)), length):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(which)), pa.array(place.astype(np.int32))], ["g", "rid", "pos"])

    return run


def _contexts(length: int):
    """For each anchor (rid, pos, c), and once for each flush the context c itself with its count."""
    names = ["kind", "c", "g", "rid", "pos", "n", "cut", "ctx"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        room = 0

        def flush() -> pa.RecordBatch:
            rows = [(1, c, g, None, None, n, cut, ctx) for c, (g, n, cut, ctx) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows = []
            for rid, text, at in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2)):
                for found in at.as_py():
                    pos, g = found["pos"], found["g"]
                    low = max(0, pos - (length - GRAM))
                    ctx = text[low : pos + length]
                    c = xxhash.xxh3_128_digest(ctx, seed=g & 0xFFFFFFFF ^ (pos - low))
                    rows.append((0, c, g, rid, pos, None, None, None))
                    if c in held:
                        held[c][1] += 1
                    else:
                        held[c] = [g, 1, pos - low, ctx]
                        room += len(ctx)
                        if room >= 16 << 20:
                            yield flush()
                            held, room = {}, 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
        if held:
            yield flush()

    return run


def _ordered(strings: list[bytes], groups: list[list[int]], shared: int) -> tuple[np.ndarray, np.ndarray]:
    """All groups one after another: order, and common prefixes with the string before (-1 at a group's first)."""
    pairs = [p for g in groups for p in sort_group(strings, g, shared)]
    return np.array([s for s, _ in pairs], np.int64), np.array([lcp for _, lcp in pairs], np.int64)


def repeated_offsets(contexts: list[tuple[int, bytes]], counts: np.ndarray, groups: list[list[int]], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context (cut, bytes): lowest and highest offset in [low, high) at which its string occurs elsewhere; (length, -1) if none."""
    cuts = np.array([c for c, _ in contexts], np.int64)
    rights = [ctx[c:] for c, ctx in contexts]
    lefts = [ctx[:c][::-1] for c, ctx in contexts]
    reach = np.array([len(r) for r in rights], np.int64)
    orders = []
    for strings, shared in ((rights, GRAM), (lefts, 0)):
        order, lcp = _ordered(strings, groups, shared)
        orders.append((order, lcp))
    n = len(contexts)
    least, most = np.full(n, length), np.full(n, -1)
    # Copies of one context share all its strings.
    first, last = np.maximum(length - reach, low), np.minimum(cuts, high - 1)
    copies = (counts > 1) & (first <= last)
    least[copies], most[copies] = first[copies], last[copies]
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(low.min()), int(high.max())):
        valid = (first <= o) & (o <= last)
        if valid.sum() < 2:
            continue
        right[orders[0][0]] = np.cumsum(orders[0][1] < length - o)
        left[orders[1][0]] = np.cumsum(orders[1][1] < o) if o else np.cumsum(orders[1][1] < 0)
        here = np.flatnonzero(valid)
        key = left[here] * (n + 1) + right[here]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(here), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        found = here[twice]
        least[found] = np.minimum(least[found], o)
        most[found] = np.maximum(most[found], o)
    return least, most


def _sort(length: int):
    """Rows (key, low, high, c, n, cut, ctx), sorted by key: (c, least, most, n) of those that occur elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[bytes, bytes], list] = {}  # (key, c) -> [low, high, n, cut, ctx]
        key = None
        room = 0

        def solve() -> pa.RecordBatch:
            kept = list(rows.items())
            by_key: dict[bytes, list[int]] = {}
            for i, ((k, _), _) in enumerate(kept):
                by_key.setdefault(k, []).append(i)
            counts = np.array([r[2] for _, r in kept], np.int64)
            low, high = np.array([r[0] for _, r in kept]), np.array([r[1] for _, r in kept])
            least, most = repeated_offsets([(r[3], r[4]) for _, r in kept], counts, list(by_key.values()), low, high, length)
            found = np.flatnonzero(most >= 0)
            return pa.RecordBatch.from_arrays([pa.array([kept[i][0][1] for i in found], pa.binary()), pa.array(least[found].astype(np.int32)), pa.array(most[found].astype(np.int32)), pa.array(counts[found])], ["c", "least", "most", "n"])

        for batch in batches:
            for r in zip(*(col.to_pylist() for col in batch.columns)):
                if r[0] != key and room >= 8 << 20:
                    yield solve()
                    rows.clear()
                    room = 0
                key = r[0]
                own = rows.setdefault((key, r[3]), [r[1], r[2], 0, r[5], r[6]])
                own[2] += r[4]
                room += len(r[6]) if own[2] == r[4] else 0
        if rows:
            yield solve()

    return run


def _split(length: int, parts: int = 8):
    """A row for each part of a row's range of offsets, keyed by the core that all strings of the part hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, low, high, c, n, cut, ctx in zip(*(col.to_pylist() for col in batch.columns)):
                step = max(1, -(-(high - low) // parts))
                for a in range(low, high, step):
                    b = min(high, a + step)
                    start, stop = cut - a, cut + length - (b - 1)  # what strings of offsets a .. b - 1 share
                    if cut - a < 0 or len(ctx) - cut < length - (b - 1):
                        continue  # no string of this part lies within the text
                    out.append((xxhash.xxh3_128_digest(ctx[start:stop], seed=a), a, b, c, n, cut, ctx))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), batch.schema.types)], batch.schema.names)

    return run


_GROUP_SCHEMA = "key binary, low int, high int, c binary, n long, cut int, ctx binary"
_OFFSETS = "c binary, least int, most int, n long"


def _solve(groups: DataFrame, length: int, max_group: int) -> DataFrame:
    """(c, least, most, n) for contexts in groups; groups that are too large are split until they aren't."""
    def hot_keys() -> DataFrame:
        sizes = groups.groupBy("key").agg(F.count("*").alias("rows"))
        return materialize(sizes.where(F.col("rows") > max_group).select("key"), "hot")

    def sort(hot: DataFrame | None) -> None:
        rest = groups if hot is None else groups.join(broadcast_if_small(hot, MAX_BROADCAST_ROWS), "key", "left_anti")
        done.append(rest.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(length), _OFFSETS))

    done, level = [], 0
    while True:
        hot = hot_keys()
        if hot.isEmpty():
            sort(None)
            break
        sort(hot)
        groups = groups.join(broadcast_if_small(hot, MAX_BROADCAST_ROWS), "key", "left_semi").select(*groups.columns)
        if not level:
            # Tasks have sent their own counts of a context: of a frequent gram these are added up, away from its key.
            rest = [F.first(c).alias(c) for c in ("low", "high", "cut", "ctx")]
            groups = materialize(groups.groupBy("key", "c").agg(F.sum("n").alias("n"), *rest).select("key", "low", "high", "c", "n", "cut", "ctx"), "added")
            hot = hot_keys()
            sort(hot)
            if hot.isEmpty():
                break
            groups = groups.join(broadcast_if_small(hot, MAX_BROADCAST_ROWS), "key", "left_semi").select(*groups.columns)
        level += 1
        groups = materialize(groups.mapInArrow(_split(length), _GROUP_SCHEMA), f"level{level}")
        # A range of one offset: all rows of a key hold the same string, so they are counted, not sorted.
        single = groups.where("high - low = 1")
        total = materialize(single.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key"), "alike")
        done.append(single.join(broadcast_if_small(total, MAX_BROADCAST_ROWS), "key", "left_semi").select("c", F.col("low").alias("least"), F.col("low").alias("most"), "n"))
        groups = groups.where("high - low > 1")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.groupBy("c").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("n").alias("n"))


def _often(counted: DataFrame) -> int:
    """The least count, HOT or more, that at most MAX_BROADCAST_ROWS rows of ``counted`` (n) reach."""
    steps = [HOT * 4**k for k in range(24)]
    many = counted.agg(*[F.count(F.when(F.col("n") >= s, 1)) for s in steps]).first()
    return next(s for s, n in zip(steps, many) if n <= MAX_BROADCAST_ROWS)


def _spanned(places: DataFrame, repeats: DataFrame) -> DataFrame:
    """``places`` (c, rid, pos) with the offsets of ``repeats``: by a broadcast of all, or of the frequent ones before the others are shuffled."""
    if under(repeats, MAX_BROADCAST_ROWS):
        return places.join(F.broadcast(repeats), "c")
    least = _often(repeats)
    known = places.join(F.broadcast(repeats.where(F.col("n") >= least)), "c", "left")
    rest = known.where("least is null").select(*places.columns).join(repeats.where(F.col("n") < least), "c")
    return known.where("least is not null").unionByName(rest)


def _remove(with_bytes: bool):
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: 5 + 2 * with_bytes]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 8 << 20, 1000):
                rows = []
                for text, found in zip(_texts(batch.column(1)), batch.column(2).to_pylist()):
                    spans: list[list[int]] = []
                    for r in sorted(found or (), key=lambda r: r["start"]):
                        if spans and r["start"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r["end"])
                        else:
                            spans.append([r["start"], r["end"]])
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(text[at:a])
                        at = b
                    left = b"".join([*kept, text[at:]])
                    rows.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left, [{"start": a, "end": b} for a, b in spans]))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))][: len(names)], names)

    return run


def remove_repeats(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP, with_bytes: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and, unless ``with_bytes`` is off, kept (bytes) and spans."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("rid"))
    found = materialize(rows.select("rid", "text").mapInArrow(_anchor_rows(length), "g long, rid binary, pos int"), "anchors")
    repeated = materialize(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    # Anchors of frequent grams are dealt to as many tasks as their count asks for.
    hot = F.broadcast(repeated.where(F.col("n") >= _often(repeated)).select("g", F.least(F.ceil(F.col("n") / HOT), F.lit(_MOST_SALTS)).alias("salts")))
    dealt = found.join(hot, "g", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("rid", "pos"), F.col("salts")), F.lit(0)))
    wanted = repeated.select("g").join(hot, "g", "left").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    candidates = dealt.join(wanted, ["g", "salt"], "left_semi").select("g", "rid", "pos")
    places = candidates.groupBy("rid").agg(F.collect_set(F.struct("pos", "g")).alias("at"))
    around = rows.select("rid", "text").join(places, "rid").select("rid", "text", "at")
    around = materialize(around.mapInArrow(_contexts(length), "kind int, c binary, g long, rid binary, pos int, n long, cut int, ctx binary"), "contexts")
    groups = around.where("kind = 1").select(F.unhex(F.hex("g")).alias("key"), F.lit(0).alias("low"), F.lit(length - GRAM + 1).alias("high"), "c", "n", "cut", "ctx")
    repeats = materialize(_solve(groups, length, max_group), "offsets")
    spans = _spanned(around.where("kind = 0").select("c", "rid", "pos"), repeats)
    spans = spans.select("rid", F.struct((F.col("pos") - F.col("most")).cast("long").alias("start"), (F.col("pos") + length - F.col("least")).cast("long").alias("end")).alias("span"))
    spans = spans.groupBy(F.col("rid").alias("its")).agg(F.collect_set("span").alias("spans"))
    joined = rows.join(spans, F.col("rid") == F.col("its"), "left").select("id", "text", "spans")
    schema = f"id {dict(rows.dtypes)['id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:long,end:long>>" * with_bytes
    return joined.mapInArrow(_remove(with_bytes), schema).withColumnRenamed("id", id_col)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
