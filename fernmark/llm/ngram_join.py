"""Exact Jaccard self-join of word shingles by universe partition, and its components.

Two sets of sizes a <= b with a Jaccard similarity of at least t differ in at
most (1 - t) / (1 + t) * (a + b) shingles. Hashing splits the universe of
shingles into segments, more of them than sets of a size band can differ in; by
the pigeonhole principle two similar sets agree on some of their segments.

* Size bands are powers of 4; a pair meets in the smaller set's band, so a set
  signs for its own band and, if it may be the larger one of a pair, for the one
  below. A band of sizes under h has 4h segments.
* A set signs with its subset of each segment it has shingles in. If it can
  differ from a partner in at most H shingles, of its H + 1 + T first signatures,
  in any order that all sets share, T + 1 are the partner's too. The order is by
  cost: how many documents have the segment's rarest shingle (from a count of
  the frequent ones), so hot signatures are used last. T, a tenth of the size,
  drops sets that share only a passage before anything is verified.
* A set with so few used segments that a partner could fall short of H + 1 + T
  signs with single shingles as well.
* Sets of 3 to 6 shingles can differ in one only: for them the allocation is one
  segment with its one-deletion neighbourhood, each set's signatures being
  itself and itself without each of its shingles.

Equal sets are one node. The members of a signature meet in the block of its
centre, the member that is most like others, so that the signatures of a group
of near copies share one block, and any two sets with a common signature share a
block. A block verifies on the whole sets, all of them against each other as a
matrix product, and returns only a spanning forest of its links. A large block
is dealt to chunks, each with the centre; only members that aren't tied to it
meet the other chunks.

Shingles are 64-bit hashes, which is where "exact" ends.

Defined cases: null and empty texts, and texts of white space only, have no
shingle and link with nothing; rows that share an id stay nodes of their own
texts (rows are told apart by 128 bits of id and text); a null id has a null
component unless linked; very long texts are shingled whole, one text at a time;
an empty table gives an empty result; ids may be of any orderable type that
casts to a string; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.llm._common import broadcast_if_small, materialize, row_key, table, without
from fernmark.llm.components import components
from fernmark.llm.shingles import Sets, chunks, mix, shingle_sets

#: Most entries of the table of frequent shingles; it only orders signatures.
MAX_COSTS = 400_000
#: Most signatures, nodes or pairs (8 to 16 bytes each) that are broadcast.
MAX_BROADCAST_ROWS = 2_000_000
#: Sets of a block, and shingles of these, that are verified in one task.
BLOCK = 1024
TOKENS = 1 << 23
#: Kinds of groups that are verified.
WHOLE, CHUNK = -1, -2
#: Documents with a shingle from which on its signatures skip the count.
HOT = 1000
_FLUSH = 1 << 21
#: A set has one spare signature for so many shingles.
_SPARE = 10


def _segmented(values: np.ndarray, first: np.ndarray, how=np.add) -> np.ndarray:
    return how.reduceat(values, first) if len(first) else values[:0]


def set_hashes(sets: Sets) -> np.ndarray:
    """One hash for each set; 0 for empty ones."""
    out = np.zeros(len(sets.offsets) - 1, np.uint64)
    full = sets.sizes > 0
    out[full] = mix(np.add.reduceat(mix(sets.tokens), sets.offsets[:-1][full]) + sets.sizes[full].astype(np.uint64))
    return out


def _cheapest(owner: np.ndarray, keys: np.ndarray, cost: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places of each owner's first ``most[owner]`` keys by (cost, key)."""
    order = np.lexsort((keys, cost, owner))
    o = owner[order]
    first = np.flatnonzero(np.diff(o, prepend=-1))
    rank = np.arange(len(o)) - np.repeat(first, np.diff(first, append=len(o)))
    return order[rank < most[o]]


def signatures(sets: Sets, percent: int, cost_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, signature, cost) of all sets."""
    sizes, owner, tokens = sets.sizes, sets.owner, sets.tokens
    mixed = mix(tokens)
    cost = cost_of(tokens)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    t = percent / 100
    # One segment with its one-deletion neighbourhood: for pairs that differ in one shingle.
    tiny_low, tiny_high = 3, 6
    tiny = (sizes >= tiny_low) & (sizes <= tiny_high)
    if tiny.any():
        mine = tiny[owner]
        o, x = owner[mine], mixed[mine]
        first = np.flatnonzero(np.diff(o, prepend=-1))
        total = np.add.reduceat(x, first)
        # The cost, like the key, is that of the shingles signed with, so that a set and the larger one without a shingle agree on it.
        c = cost[mine]
        order = np.lexsort((c, o))
        least, second = c[order[first]], c[order[first + 1]]
        rest = np.repeat(least, np.diff(first, append=len(o)))
        rest[order[first]] = second
        out.append((o[first], mix(total ^ np.uint64(0x5EED)), least))
        out.append((o, mix((np.repeat(total, np.diff(first, append=len(o))) - x) ^ np.uint64(0x5EED)), rest))

    band = np.zeros(len(sizes), np.int64)
    large = sizes >= tiny_high
    band[large] = np.floor(np.log2(sizes[large]) / 2 + 1e-12).astype(np.int64)
    for below in (0, 1):
        b = band - below
        low = np.left_shift(1, 2 * np.maximum(b, 0))
        high = 4 * low
        takes = large & (b >= 1)
        if below:
            takes &= sizes * t < high  # a partner may be in that band
        if not takes.any():
            continue
        smaller = np.where(below, np.minimum(high - 1, sizes), sizes)
        largest = np.where(below, sizes, np.floor(sizes / t))
        differ = np.floor((1 - t) / (1 + t) * (smaller + largest) + 1e-9).astype(np.int64)
        most = differ + 1 + sizes // _SPARE
        mine = takes[owner]
        o, x, c = owner[mine], mixed[mine], cost[mine]
        segment = (x >> np.uint64(20)) % (4 * high[o]).astype(np.uint64)
        order = np.lexsort((segment, o))
        so, ss = o[order], segment[order]
        first = np.flatnonzero((np.diff(so, prepend=-1) != 0) | (np.diff(ss.astype(np.int64), prepend=-1) != 0))
        salt = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        seg_owner, seg_key = so[first], mix(_segmented(x[order], first) ^ salt[so[first]])
        seg_cost = _segmented(c[order], first, np.minimum)
        chosen = _cheapest(seg_owner, seg_key, seg_cost, most)
        out.append((seg_owner[chosen], seg_key[chosen], seg_cost[chosen]))
        # A partner could be short of segments, or this set is: single shingles too.
        used = np.bincount(seg_owner, minlength=len(sizes))
        short = takes & (used <= sizes * (1 - t) + sizes / t * ((1 - t) / (1 + t) * (1 + 1 / t) + 1 / _SPARE))
        if short.any():
            few = short[o]
            fo, fk, fc = o[few], mix(x[few] ^ salt[o[few]] ^ np.uint64(0xA11CE)), c[few]
            chosen = _cheapest(fo, fk, fc, most)
            out.append((fo[chosen], fk[chosen], fc[chosen]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])


def _first_pass(n: int):
    """Nodes (kind 0: id, rid, n, node) and, as kind 1, shingles seen more than once since the last flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "rid", "n", "node"]
        held: list[np.ndarray] = []
        room = 0
        kind = pa.null()

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int32)), pa.nulls(len(tokens), kind), pa.nulls(len(tokens), pa.binary()), pa.array(counts.astype(np.int64)), pa.array(tokens.view(np.int64))], names)

        for batch in batches:
            at, kind = 0, batch.column(0).type
            for some in chunks(batch.column(2).to_pylist()):
                sets = shingle_sets(some, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int32)), batch.column(0).slice(at, len(some)), batch.column(1).slice(at, len(some)), pa.array(sets.sizes), pa.array(set_hashes(sets).view(np.int64))], names)
                at += len(some)
                held.append(sets.tokens)
                room += len(sets.tokens)
                if room >= _FLUSH:
                    yield flush()
                    held, room = [], 0
        if held:
            yield flush()

    return run


def _sign(n: int, percent: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        seen: set[int] = set()  # rows alike in id and text are told apart by nothing: one of a task signs

        def cost_of(tokens: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.zeros(len(tokens), np.int64)
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            return np.where(known[at] == tokens, counts[at], 0)

        for batch in batches:
            for some in chunks(batch.column(0).to_pylist()):
                sets = shingle_sets(some, n)
                nodes = set_hashes(sets).view(np.int64)
                owner, keys, cost = signatures(sets, percent, cost_of)
                fresh = _fresh(seen, nodes)[owner]
                owner, keys, cost = owner[fresh], keys[fresh], cost[fresh]
                salt = np.where(cost >= HOT, nodes[owner] % 4096 + 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[owner]), pa.array(salt)], ["key", "node", "salt"])

    return run


def _fresh(seen: set[int], nodes: np.ndarray) -> np.ndarray:
    """Which nodes were not seen before; they are from now on (of the last million or so)."""
    if len(seen) > 1 << 20:
        seen.clear()
    return np.array([k not in seen and not seen.add(k) for k in nodes.tolist()], bool)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for some in chunks(batch.column(0).to_pylist()):
                sets = shingle_sets(some, n)
                nodes = set_hashes(sets).view(np.int64)
                blobs = [sets.tokens[a:b].tobytes() for a, b in zip(sets.offsets[:-1], sets.offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(blobs, pa.binary())], ["node", "tokens"]).filter(pa.array(_fresh(seen, nodes)))

    return run


def linked(sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that join up all similar ones of these sets; with ``sides`` (0 or 1), only between the sides.

    Intersections come from products of membership matrices, a slab of shingles
    at a time. Of the links found a spanning forest is returned.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(token)[token] > 1  # others are in one set only
    owner, token = owner[often], token[often]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    left = np.flatnonzero(sides == 0) if sides is not None else np.arange(len(sets))
    right = np.flatnonzero(sides == 1) if sides is not None else left
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, (at, at + width))
        slab = np.zeros((len(sets), width), np.float32)
        slab[owner[a:b], token[a:b] - at] = 1
        both += slab[left] @ slab[right].T
    similar = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, row in zip(left.tolist(), similar):
        for j in right[np.flatnonzero(row)].tolist():
            if i != j and root(i) != root(j):
                parent[root(i)] = root(j)
                out.append((i, j))
    return out


def _unlinked(n: int, pairs: list[tuple[int, int]], centre: int) -> list[int]:
    """Which of ``n`` sets no chain of links ties to the centre."""
    near: dict[int, list[int]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    seen, stack = {centre}, [centre]
    while stack:
        for x in near.get(stack.pop(), ()):
            if x not in seen:
                seen.add(x)
                stack.append(x)
    return [k for k in range(n) if k not in seen]


def _link(percent: int):
    """Rows (center, i, j, node, side, tokens), sorted by group: links (u, v) within each group, as kind 0.

    j says what a group is: WHOLE, a block; CHUNK, a part of one with its centre,
    whose members that aren't tied to the centre come back as kind 1 (center,
    node, part); otherwise a part (side 0) and some such members of others (side 1).
    """
    names = ["kind", "u", "v", "part"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, sets = None, [], [], []
        out: list[tuple[int, int, int, int]] = []

        def solve() -> None:
            center, i, j = key
            pairs = linked(sets, np.array(sides) if j >= 0 else None, percent) if len(nodes) > 1 else []
            out.extend((0, nodes[a], nodes[b], 0) for a, b in pairs)
            if j == CHUNK:
                out.extend((1, center, nodes[k], i) for k in _unlinked(len(nodes), pairs, nodes.index(center)))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kinds)], names)
            out.clear()
            return made

        for batch in batches:
            for k in range(batch.num_rows):
                now = tuple(batch.column(c)[k].as_py() for c in range(3))
                if now != key:
                    if key is not None:
                        solve()
                        nodes, sides, sets = [], [], []
                    key = now
                if nodes and nodes[-1] == batch.column(3)[k].as_py():
                    continue  # the set of another row alike in id and text
                nodes.append(batch.column(3)[k].as_py())
                sides.append(batch.column(4)[k].as_py())
                sets.append(np.frombuffer(batch.column(5)[k].as_py(), np.uint64))
            yield batch_of()
        if key is not None:
            solve()
            yield batch_of()

    return run


def _ship(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """What ``_link`` finds in groups (center, i, j, node, side)."""
    groups = broadcast_if_small(materialize(groups, "groups"), MAX_BROADCAST_ROWS // 4)
    shipped = sets.join(groups, "node").select("center", "i", "j", "node", "side", "tokens").repartition("center", "i", "j").sortWithinPartitions("center", "i", "j", "node")
    return materialize(shipped.mapInArrow(_link(percent), "kind int, u long, v long, part int"), "links")


def block_links(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that tie together all similar sets of each block; ``blocks``: center, node, n (its size).

    A block of more than BLOCK sets, or of more than TOKENS shingles, is dealt to
    chunks, and each chunk, with the centre, is verified by itself. Members tied to
    the centre are in one component then. Only members that aren't have to meet the
    other chunks, so work is linear in a group of near copies; it grows with the
    square of the members that are unlike their centre.
    """
    parts = blocks.groupBy("center").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / TOKENS)).cast("int").alias("parts")).where("parts > 1")
    parts = broadcast_if_small(materialize(parts, "parts"), MAX_BROADCAST_ROWS)
    dealt = blocks.select("center", "node").join(parts, "center", "left")
    dealt = materialize(dealt.select("center", "node", "parts", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).cast("int").alias("part")), "dealt")
    whole = F.when(F.col("parts").isNull(), WHOLE).otherwise(CHUNK)
    members = dealt.select("center", F.col("part").alias("i"), whole.alias("j"), "node", F.lit(0).alias("side"))
    everywhere = dealt.where("node = center and parts > 1").select("center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), "part", "node")
    everywhere = everywhere.where("i <> part").select("center", "i", F.lit(CHUNK).alias("j"), "node", F.lit(0).alias("side"))
    made = _ship(sets, members.unionByName(everywhere), percent)
    links = made.where("kind = 0").select("u", "v")
    missed = made.where("kind = 1").select(F.col("u").alias("center"), F.col("v").alias("node"), "part")
    if missed.isEmpty():
        return links
    some = broadcast_if_small(materialize(missed.groupBy("center").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("others")), "others"), MAX_BROADCAST_ROWS)
    left = dealt.where("parts > 1").join(some, "center").select("center", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"), "node", F.lit(0).alias("side"))
    right = missed.join(some, "center").join(parts, "center").withColumn("j", F.pmod(F.xxhash64("node"), F.col("others")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.where("i <> part").select("center", "i", "j", "node", F.lit(1).alias("side"))
    return links.unionByName(_ship(sets, left.unionByName(right), percent).where("kind = 0").select("u", "v"))


def _costs(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most MAX_COSTS, and their counts."""
    steps = [4**k for k in range(2, 20)]
    totals = materialize(seen.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= steps[0]), "costs")
    many = totals.agg(*[F.count(F.when(F.col("n") >= s, 1)) for s in steps]).first()
    least = next((s for s, k in zip(steps, many) if k <= MAX_COSTS), steps[-1])
    rows = totals.where(F.col("n") >= least).toPandas()
    order = np.argsort(rows["node"].to_numpy(np.int64).view(np.uint64))
    return rows["node"].to_numpy(np.int64).view(np.uint64)[order], rows["n"].to_numpy(np.int64)[order]


def components_of_rows(docs: DataFrame, *, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rid (``row_key``), n (shingles) and component (a number; null without shingles) of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    first = materialize(rows.mapInArrow(_first_pass(n), f"kind int, id {dict(rows.dtypes)['id']}, rid binary, n long, node long"), "shingled")
    nodes = first.where("kind = 0").select("id", "rid", "n", "node")
    sent = spark.sparkContext.broadcast(_costs(first.where("kind = 1").select("node", "n")))
    # Of equal sets one signs.
    several = nodes.groupBy("node").agg(F.min("rid").alias("signs"), F.count("*").alias("rows")).where("rows > 1").select("node", "signs")
    silent = nodes.join(broadcast_if_small(several, MAX_BROADCAST_ROWS), "node").where("rid <> signs").select("rid").distinct()
    signing = rows.select("rid", "text").join(broadcast_if_small(materialize(silent, "silent"), MAX_BROADCAST_ROWS), "rid", "left_anti")
    signed = signing.select("text").mapInArrow(_sign(n, percent, sent), "key long, node long, salt int")
    # One shuffle counts signatures and keeps the shared ones. Hot ones are shared for certain: they are salted, not counted.
    rows_of = F.count("*").over(Window.partitionBy("key", "salt"))
    shared = signed.withColumn("rows", rows_of).where("rows > 1 or salt > 0").select("key", "node")
    members = materialize(shared, "shared")
    # A set shares at least as many signatures as its smallest partner has spare ones, and one.
    enough = F.floor(F.ceil(F.col("n") * percent / 100) / _SPARE) + 1
    sizes = nodes.select("node", "n").distinct()
    likely = members.groupBy("node").count().join(sizes, "node").where(F.col("count") >= enough).select("node", "n", "count")
    members = members.join(broadcast_if_small(materialize(likely, "likely"), MAX_BROADCAST_ROWS), "node")
    # The most typical member of a signature, with the largest share of signatures that others have, is its centre.
    rank = F.struct((F.col("count") / F.col("n")).alias("share"), F.col("node"))
    centers = members.groupBy("key").agg(F.max(rank).alias("c"), F.count("*").alias("rows")).where("rows > 1").select("key", F.col("c.node").alias("center"))
    blocks = materialize(members.select("key", "node", "n").join(centers, "key").select("center", "node", "n").distinct(), "blocks")

    wanted = blocks.select("node").distinct()
    # Copies are aggregated before any join on their node, so none is hot there.
    ids = materialize(nodes.groupBy("node").agg(F.min("rid").alias("rid")).join(wanted, "node", "left_semi").select("rid"), "ids")
    chosen = rows.select("rid", "text").join(broadcast_if_small(ids.distinct(), MAX_BROADCAST_ROWS), "rid", "left_semi")
    sets = materialize(chosen.select("text").mapInArrow(_sets(n), "node long, tokens binary"), "sets")
    links = block_links(sets, blocks, percent)
    found = materialize(components(links), "components")

    labelled = nodes.join(broadcast_if_small(found, MAX_BROADCAST_ROWS), "node", "left")
    return labelled.select("id", "rid", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable over links of at least ``percent`` per cent)."""
    rows = components_of_rows(docs, id_col=id_col, **options)
    # Groups of one row need no lookup; the others are aggregated before any shuffle, however large.
    lowest = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    out = rows.join(broadcast_if_small(materialize(lowest, "several"), MAX_BROADCAST_ROWS), "component", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when each group of linked documents keeps one.

    That is the one with the lowest id (a null id comes last); of rows alike in id
    and text one stays, the least by its columns written as JSON, so these may be
    of any type, maps included. Rows without shingles link with nothing, so all of them stay.
    """
    rows = materialize(components_of_rows(docs, id_col=id_col, text_col=text_col, **options).where("component is not null"), "labelled")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))
    several = rows.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("component", F.col("first.rid").alias("stays"))
    grouped = rows.join(broadcast_if_small(materialize(several, "several"), MAX_BROADCAST_ROWS), "component")
    kept = without(docs, grouped.where("rid <> stays").select("rid"), id_col, text_col, MAX_BROADCAST_ROWS)
    repeated = materialize(grouped.where("rid = stays").groupBy("rid").count().where("count > 1").select("rid"), "repeated")
    if repeated.isEmpty():
        return kept
    again = broadcast_if_small(repeated.toDF("fernmark row key"), MAX_BROADCAST_ROWS)
    same = row_key(id_col, text_col) == again["fernmark row key"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(again, same, "left_semi").groupBy(row_key(id_col, text_col).alias("key")).agg(F.min_by(row, F.to_json(row)).alias("r"))
    return kept.join(again, same, "left_anti").unionByName(one.select("r.*"))
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
