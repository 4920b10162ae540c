"""Presence priors: how often a kind is seen on checklists, by place and time.

Observations have (loc, time, checklist, kind). ``n`` counts the distinct
checklists of a bin, ``n_present`` those that have the kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.functions import bars, geo


def presence(obs: DataFrame, bins: Sequence[str], checklist: str, kind: str) -> DataFrame:
    """bins, kind, n_present, n, p. Both counts come from the distinct (bins, kind, checklist), whose shuffle they share."""
    once = obs.select(*bins, kind, checklist).distinct()
    # Rows whose checklist is null count for nothing, as in a distinct count, but their bins stay.
    total = once.select(*bins, checklist).distinct().groupBy(*bins).agg(F.count(checklist).alias("n"))
    seen = once.groupBy(*bins, kind).agg(F.count(checklist).alias("n_present"))
    return seen.join(total, list(bins)).withColumn("p", F.col("n_present") / F.col("n"))


def nested_presence(obs: DataFrame, lat: str, lon: str, precisions: Sequence[int], bins: Sequence[str], checklist: str, kind: str) -> DataFrame:
    """bits, loc, bins, kind, n_present, n, p at several precisions at once.

    One shuffle by checklist finds its kinds and its finest cell, which no other
    precision needs to look at again: counts of finest cells add up to those of
    the cells that hold them, by one grouping-sets aggregate. A checklist with several
    finest cells in one bin would count in each, so such checklists are counted once in every
    cell that holds any of them.
    """
    fine = max(precisions)
    x, y = geo.cell_x(F.col(lon), fine), geo.cell_y(F.col(lat), fine)
    seen = obs.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*bins, checklist, kind, x.alias("_x"), y.alias("_y"))
    seen = seen.select(*bins, checklist, F.struct(geo.number_of(F.col("_x"), F.col("_y"), fine).alias("c"), F.col(kind).alias("k")).alias("_e"))
    by_list = seen.groupBy(*bins, checklist).agg(F.collect_set("_e").alias("_s"))

    def at(seen_at: Column, bits: int) -> Column:
        """The number of the cell of ``bits`` bits that holds a finest cell."""
        return F.shiftright(seen_at["c"], fine - bits)

    # Of each cell at each precision one finest cell counts for the checklist, with each kind there and once without a kind.
    names = [f"_c{b}" for b in precisions]
    lone = F.size(F.array_distinct(F.transform("_s", lambda s: at(s, fine)))) == 1
    alone = F.transform(F.array_union(F.transform("_s", lambda s: s["k"]), F.array(F.lit(None))), lambda k: F.struct(*[at(F.get("_s", F.lit(0)), b).alias(n) for b, n in zip(precisions, names)], k.alias("kind")))

    def spread(b: int, n: str) -> Column:
        """Of a checklist in several cells: each of its cells at one precision once, with each kind and without; nulls elsewhere."""
        row = lambda c, k: F.struct(*[(c if m == n else F.lit(None).cast("long")).alias(m) for m in names], k.alias("kind"))
        return F.concat(F.transform("_s", lambda s: row(at(s, b), s["k"])), F.transform("_s", lambda s: row(at(s, b), F.lit(None).cast("string"))))

    several = F.array_distinct(F.concat(*[spread(b, n) for b, n in zip(precisions, names)]))
    rows = by_list.select(*bins, F.inline(F.when(lone, alone).otherwise(several)))
    finest = rows.groupBy(*bins, *names, "kind").agg(F.count("*").alias("n"))
    sets = [[*bins, n, "kind"] for n in names]
    summed = finest.groupingSets([[F.col(c) for c in s] for s in sets], *bins, *names, "kind").agg(F.sum("n").alias("n"), F.grouping_id().alias("_g"))
    # The set is told by its id: names and then the kind are its last bits, 0 where they are grouped by.
    order = [*bins, *names, "kind"]
    ids = [sum(1 << (len(order) - 1 - order.index(c)) for c in order if c not in s) for s in sets]
    which = F.array_position(F.array(*map(F.lit, ids)), F.col("_g").cast("int")) - 1
    counted = summed.withColumn("_w", which.cast("int")).withColumn("_cell", F.coalesce(*names)).where("_cell IS NOT NULL")
    whole = Window.partitionBy("_w", "_cell", *bins)  # a row for each kind of one bin
    shares = counted.withColumn("_n", F.max(F.when(F.col("kind").isNull(), F.col("n"))).over(whole)).where(F.col("kind").isNotNull())
    bits = F.element_at(F.array(*map(F.lit, precisions)), F.col("_w") + 1)
    loc = geo.number_text(F.col("_cell"), bits, fine)
    return shares.select(bits.alias("bits"), loc.alias("loc"), *bins, F.col("kind").alias(kind), F.col("n").alias("n_present"), F.col("_n").alias("n"), (F.col("n") / F.col("_n")).alias("p"))


def smoothed_presence(obs: DataFrame, x: str, y: str, bits: int, checklist: str, kind: str) -> DataFrame:
    """loc, kind, n_present, n, p with each checklist counted in its cell and the neighbours.

    One shuffle by checklist; those in one cell (most) are counted there first,
    and counts are spread to neighbours. Of a checklist in several cells the
    cells around any of them count once.
    """
    pair = F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(kind).alias("k"))
    by_list = obs.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(checklist).isNotNull()).groupBy(checklist).agg(F.collect_set(pair).alias("_s"), (F.min(x) == F.max(x)).alias("_ox"), (F.min(y) == F.max(y)).alias("_oy"))
    lone = F.col("_ox") & F.col("_oy")
    first = F.get("_s", F.lit(0))
    cells = F.when(lone, F.array(F.struct(first["x"].alias("x"), first["y"].alias("y")))).otherwise(F.array_distinct(F.flatten(F.transform("_s", lambda s: geo.around(s["x"], s["y"], bits)))))
    here = by_list.select(lone.alias("_lone"), cells.alias("_cells"), "_s")
    total = F.transform("_cells", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), F.lit(None).cast(obs.schema[kind].dataType).alias("k")))
    kinds = F.when(F.col("_lone"), F.col("_s")).otherwise(F.array_distinct(F.flatten(F.transform("_s", lambda s: F.transform(geo.around(s["x"], s["y"], bits), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), s["k"].alias("k")))))))
    counted = here.select("_lone", F.explode(F.concat(kinds, total)).alias("e")).groupBy("_lone", "e.x", "e.y", "e.k").agg(F.count("*").alias("n"))
    around = F.when(F.col("_lone"), geo.around(F.col("x"), F.col("y"), bits)).otherwise(F.array(F.struct(F.col("x"), F.col("y"))))
    spread = counted.select(F.explode(around).alias("c"), "k", "n").groupBy("c", "k").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("c")  # a row for each kind
    shares = spread.withColumn("_n", F.max(F.when(F.col("k").isNull(), F.col("n"))).over(whole)).where(F.col("k").isNotNull())
    return shares.select(geo.cell_text(F.col("c.x"), F.col("c.y"), bits).alias("loc"), F.col("k").alias(kind), F.col("n").alias("n_present"), F.col("_n").alias("n"), (F.col("n") / F.col("_n")).alias("p"))


def presence_sketched(obs: DataFrame, bins: Sequence[str], checklist: str, kind: str, precision: int = 14) -> DataFrame:
    """Sketches instead of counts: ``merge_sketched`` adds bins up without the rows."""
    as_text = F.col(checklist).cast("string")
    return obs.groupBy(*bins, kind).agg(F.hll_sketch_agg(as_text, precision).alias("sketch"))


def merge_sketched(sketches: DataFrame, bins: Sequence[str], kind: str) -> DataFrame:
    """Estimates of n_present, n and p over coarser bins."""
    total = sketches.groupBy(*bins).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    seen = sketches.groupBy(*bins, kind).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_present"))
    return seen.join(total, list(bins)).withColumn("p", F.col("n_present") / F.col("n"))


def smooth_places(obs: DataFrame, x: str, y: str, bits: int, keep: Sequence[str]) -> DataFrame:
    """Observations counted in their cell and its neighbours: ``loc`` replaces (x, y).

    Distinct rows are expanded, nine to one at most, before any counting.
    """
    cells = obs.select(x, y, *keep).distinct().withColumn("_c", F.explode(geo.around(F.col(x), F.col(y), bits)))
    return cells.select(geo.cell_text(F.col("_c.x"), F.col("_c.y"), bits).alias("loc"), *keep).distinct()


def add_counters(counts: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Sums of counters (n of each bin once, n_present by kind) over coarser keys; needs a ``bin`` column."""
    total = counts.groupBy(*keys, "bin").agg(F.max("n").alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"))
    seen = counts.groupBy(*keys, kind).agg(F.sum("n_present").alias("n_present"))
    joined = seen.join(total, list(keys)) if keys else seen.crossJoin(F.broadcast(total))
    return joined.withColumn("p", F.col("n_present") / F.col("n"))


def predict(counts: DataFrame, locs: Column, dates: Column, points: DataFrame, kind: str) -> DataFrame:
    """Presence at points: counters of the point's cells and date bins, added up; absent bins don't count.

    ``points`` has ``point``; ``locs`` and ``dates`` are arrays of its bins. Bins
    of points join counts on (loc, date_bin), which both sides hash on.
    """
    wanted = points.select("point", F.explode(locs).alias("loc"), dates.alias("_d")).select("point", "loc", F.explode("_d").alias("date_bin"))
    hit = wanted.join(counts, ["loc", "date_bin"])
    total = hit.select("point", "loc", "date_bin", "n").distinct().groupBy("point").agg(F.sum("n").alias("n"))
    seen = hit.groupBy("point", kind).agg(F.sum("n_present").alias("n_present"))
    return seen.join(total, "point").withColumn("p", F.col("n_present") / F.col("n"))


def charted(priors: DataFrame) -> DataFrame:
    return priors.withColumn("width", bars.bar_width(F.col("p"))).withColumn("bar", bars.bar(F.col("p")))
