"""Presence priors over ``events``: a checklist is a user's day, the kind is the event type, and a user's place is
made from the id by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernmark import scratch
from fernmark.functions import bars, dates, geo
from fernmark.operators import places, priors
from fernmark.plans.registry import query, read

_WEEK = "((month(ts) - 1) * 4 + least((day(ts) - 1) // 7, 3))::INT"
_LAT, _LON = "(user_id * 7919 % 18000) / 100.0 - 90", "(user_id * 104729 % 36000) / 100.0 - 180"
_OBS = f"""obs AS (SELECT *, strftime(ts, '%Y-%m-%d') || '/' || user_id AS checklist, {_WEEK} AS week,
  ({_LAT})::DOUBLE AS lat, ({_LON})::DOUBLE AS lon FROM events)"""
_SHARE = f"""WITH {_OBS}, t AS (SELECT week, count(DISTINCT checklist) AS n FROM obs GROUP BY week),
s AS (SELECT week, event_type, count(DISTINCT checklist) AS n_present FROM obs GROUP BY week, event_type)"""
_BAR = "(" + " + ".join(f"(p >= {s})::INT" for s in bars.STEPS) + ")"


def _obs(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.withColumns({
        "checklist": F.concat(day, F.lit("/"), F.col("user_id").cast("string")), "week": dates.week(F.col("ts")),
        "lat": (F.col("user_id") * 7919 % 18000) / 100.0 - 90, "lon": (F.col("user_id") * 104729 % 36000) / 100.0 - 180,
    })


@query("event_week_bins", f"""WITH {_OBS} SELECT week, (week // 4 * 4)::INT AS bin4, strftime(make_date(2024, week // 4 + 1, week % 4 * 7 + 1), '%Y-%m-%d') AS first_day, count(*) AS n FROM obs GROUP BY week""")
def event_week_bins(spark, sf_dir):
    w = F.col("week")
    return _obs(spark, sf_dir).groupBy("week").agg(F.count("*").alias("n")).select("week", dates.date_bin(w, 4).alias("bin4"), dates.first_day(w, 2024).cast("string").alias("first_day"), "n")


@query("event_presence_exact", _SHARE + " SELECT week, event_type, n_present, n, round(n_present / n, 6) AS p FROM s JOIN t USING (week)")
def event_presence_exact(spark, sf_dir):
    return priors.presence(_obs(spark, sf_dir), ["week"], "checklist", "event_type").withColumn("p", F.round("p", 6))


@query("event_bar_chart", _SHARE + f""", b AS (SELECT week, event_type, n_present / n AS p FROM s JOIN t USING (week))
SELECT week, event_type, round(p, 6) AS p, {_BAR} AS width, repeat('■', {_BAR}) || repeat('—', 9 - {_BAR}) AS bar FROM b""")
def event_bar_chart(spark, sf_dir):
    shares = priors.presence(_obs(spark, sf_dir), ["week"], "checklist", "event_type")
    return priors.charted(shares).select("week", "event_type", F.round("p", 6).alias("p"), "width", "bar")


@query("event_presence_two_grain", f"""WITH {_OBS}, a AS (SELECT user_id, week, event_type, count(DISTINCT checklist) AS n_present FROM obs GROUP BY ALL), t AS (SELECT user_id, week, count(DISTINCT checklist) AS n FROM obs GROUP BY ALL)
SELECT user_id, week, event_type, n_present, n FROM a JOIN t USING (user_id, week)""")
def event_presence_two_grain(spark, sf_dir):
    return priors.presence(_obs(spark, sf_dir), ["user_id", "week"], "checklist", "event_type").drop("p")


@query("event_presence_hll")
def event_presence_hll(spark, sf_dir):
    """Sketches by week, merged into months: estimates, so no SQL gives the same numbers."""
    sketches = priors.presence_sketched(_obs(spark, sf_dir), ["week"], "checklist", "event_type")
    return priors.merge_sketched(sketches.withColumn("bin4", dates.date_bin(F.col("week"), 4)), ["bin4"], "event_type")


@query("counters_summed", _SHARE + """, c AS (SELECT * FROM s JOIN t USING (week)), k AS (SELECT sum(n)::BIGINT AS n FROM t)
SELECT event_type, sum(n_present)::BIGINT AS n_present, any_value(k.n) AS n, round(sum(n_present) / any_value(k.n), 6) AS p FROM c, k GROUP BY event_type""")
def counters_summed(spark, sf_dir):
    counts = priors.presence(_obs(spark, sf_dir), ["week"], "checklist", "event_type").withColumnRenamed("week", "bin")
    return priors.add_counters(counts, [], "event_type").withColumn("p", F.round("p", 6))


@query("date_smooth_bins", f"""WITH {_OBS}, d AS (SELECT DISTINCT ts::DATE AS day, week FROM obs), b AS (SELECT day, week, week // 4 * 4 AS bin4 FROM d),
o AS (SELECT *, ((CASE WHEN week / 4.0 - floor(week / 4.0) < 0.5 THEN bin4 - 4 ELSE bin4 + 4 END) + 48) % 48 AS o4,
  ((CASE WHEN least(day(day) - 1, 27) / 7.0 - floor(least(day(day) - 1, 27) / 7.0) < 0.5 THEN week - 1 ELSE week + 1 END) + 48) % 48 AS o1 FROM b)
SELECT strftime(day, '%Y-%m-%d') AS day, array_to_string(list_sort([week::INT, o1::INT]), ',') AS bins1, array_to_string(list_sort([bin4::INT, o4::INT]), ',') AS bins4 FROM o""")
def date_smooth_bins(spark, sf_dir):
    days = _obs(spark, sf_dir).select(F.to_date("ts").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"), *[F.array_join(dates.enclosing_bins(F.col("day"), w).cast("array<string>"), ",").alias(f"bins{w}") for w in (1, 4)])


def _sql_geohash(lat: str, lon: str, bits: int) -> str:
    """The text of a point's cell, written out."""
    ox, oy = (bits + 1) // 2, bits // 2
    x, y = f"(floor(({lon} + 180) / 360 * {1 << ox}))::BIGINT", f"(floor(({lat} + 90) / 180 * {1 << oy}))::BIGINT"
    chars = []
    for at in range(0, bits, 5):
        terms = []
        for k in range(at, min(at + 5, bits)):
            axis, left = (x, ox - 1 - k // 2) if k % 2 == 0 else (y, oy - 1 - k // 2)
            terms.append(f"(({axis} >> {left}) & 1) * {1 << (4 - (k - at))}")
        chars.append(f"substr('{geo.ALPHABET}', ({' + '.join(terms)})::INT + 1, 1)")
    return " || ".join(chars)


@query("geohash_bins", f"""WITH {_OBS}, u AS (SELECT DISTINCT user_id, lat, lon FROM obs)
SELECT user_id, {_sql_geohash('lat', 'lon', 15)} AS g15, {_sql_geohash('lat', 'lon', 21)} AS g21 FROM u""")
def geohash_bins(spark, sf_dir):
    users = _obs(spark, sf_dir).select("user_id", "lat", "lon").distinct()
    return users.select("user_id", *[geo.geohash(F.col("lat"), F.col("lon"), b).alias(f"g{b}") for b in (15, 21)])


def _sql_cell(x: str, y: str, bits: int) -> str:
    ox, oy = (bits + 1) // 2, bits // 2
    chars = []
    for at in range(0, bits, 5):
        terms = [f"((({x if k % 2 == 0 else y}) >> {(ox if k % 2 == 0 else oy) - 1 - k // 2}) & 1) * {1 << (4 - (k - at))}" for k in range(at, min(at + 5, bits))]
        chars.append(f"substr('{geo.ALPHABET}', ({' + '.join(terms)})::INT + 1, 1)")
    return " || ".join(chars)


_CELLS9 = f"""cells AS (SELECT DISTINCT user_id, checklist, event_type, floor((lon + 180) / 360 * 32)::BIGINT AS x, floor((lat + 90) / 180 * 16)::BIGINT AS y FROM obs),
around AS (SELECT DISTINCT checklist, event_type, ((x + dx) + 32) % 32 AS x, y + dy AS y FROM cells, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE y + dy BETWEEN 0 AND 15)"""


@query("geohash_neighbors", f"""WITH {_OBS}, c AS (SELECT DISTINCT user_id, floor((lon + 180) / 360 * 32)::BIGINT AS x, floor((lat + 90) / 180 * 16)::BIGINT AS y FROM obs)
SELECT DISTINCT user_id, {_sql_cell('((x + dx) + 32) % 32', 'y + dy', 9)} AS cell FROM c, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE y + dy BETWEEN 0 AND 15""")
def geohash_neighbors(spark, sf_dir):
    users = _obs(spark, sf_dir).select("user_id", "lat", "lon").distinct()
    return users.select("user_id", F.explode(geo.expand(geo.geohash(F.col("lat"), F.col("lon"), 9), 9)).alias("cell"))


@query("geo_smooth_counts", f"""WITH {_OBS}, {_CELLS9}, t AS (SELECT x, y, count(DISTINCT checklist) AS n FROM around GROUP BY x, y), s AS (SELECT x, y, event_type, count(DISTINCT checklist) AS n_present FROM around GROUP BY x, y, event_type)
SELECT {_sql_cell('x', 'y', 9)} AS loc, event_type, n_present, n, round(n_present / n, 6) AS p FROM s JOIN t USING (x, y)""")
def geo_smooth_counts(spark, sf_dir):
    obs = _obs(spark, sf_dir).select("checklist", "event_type", geo.cell_x(F.col("lon"), 9).alias("x"), geo.cell_y(F.col("lat"), 9).alias("y"))
    return priors.smoothed_presence(obs, "x", "y", 9, "checklist", "event_type").withColumn("p", F.round("p", 6))


_TEN = list(range(3, 23, 2))


def _sql_nested(bits: int) -> str:
    loc = _sql_geohash("lat", "lon", bits)
    return f"""SELECT {bits} AS bits, loc, week, event_type, n_present, n, round(n_present / n, 6) AS p FROM (SELECT {loc} AS loc, week, event_type, count(DISTINCT checklist) AS n_present FROM obs GROUP BY ALL)
JOIN (SELECT {loc} AS loc, week, count(DISTINCT checklist) AS n FROM obs GROUP BY ALL) USING (loc, week)"""


@query("nested_presence", f"WITH {_OBS} " + " UNION ALL ".join(map(_sql_nested, _TEN)))
def nested_presence(spark, sf_dir):
    """Shares of checklists by week and cell at ten precisions, from one pass."""
    return priors.nested_presence(_obs(spark, sf_dir), "lat", "lon", _TEN, ["week"], "checklist", "event_type").withColumn("p", F.round("p", 6))


@query("prior_predict", f"""WITH {_OBS}, b AS (SELECT DISTINCT {_sql_geohash('lat', 'lon', 7)} AS loc, week // 4 * 4 AS date_bin, checklist, event_type FROM obs),
t AS (SELECT loc, date_bin, count(DISTINCT checklist) AS n FROM b GROUP BY ALL), s AS (SELECT loc, date_bin, event_type, count(DISTINCT checklist) AS n_present FROM b GROUP BY ALL),
u AS (SELECT DISTINCT user_id, lat, lon FROM obs),
l AS (SELECT DISTINCT user_id, ((floor((lon + 180) / 360 * 32)::BIGINT + dx + 32) % 32) >> 1 AS x, (floor((lat + 90) / 180 * 16)::BIGINT + dy) >> 1 AS y
      FROM u, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE floor((lat + 90) / 180 * 16)::BIGINT + dy BETWEEN 0 AND 15),
w AS (SELECT user_id, {_sql_cell('x', 'y', 7)} AS loc, d.date_bin FROM l, (SELECT unnest([0, 44]) AS date_bin) d),
h AS (SELECT user_id, sum(n) AS n FROM w JOIN t USING (loc, date_bin) GROUP BY user_id)
SELECT user_id AS point, event_type, sum(n_present)::BIGINT AS n_present, any_value(h.n)::BIGINT AS n, round(sum(n_present) / any_value(h.n), 6) AS p FROM w JOIN s USING (loc, date_bin) JOIN h USING (user_id) GROUP BY user_id, event_type""")
def prior_predict(spark, sf_dir):
    """Users at 1 January: four cells and two date bins each."""
    obs = _obs(spark, sf_dir)
    binned = obs.select("checklist", "event_type", geo.geohash(F.col("lat"), F.col("lon"), 7).alias("loc"), dates.date_bin(F.col("week"), 4).alias("date_bin"))
    counts = priors.presence(binned, ["loc", "date_bin"], "checklist", "event_type")
    points = obs.select(F.col("user_id").alias("point"), "lat", "lon").distinct()
    locs, bins = geo.smooth(F.col("lat"), F.col("lon"), 7), dates.enclosing_bins(F.lit("2024-01-01").cast("date"), 4)
    return priors.predict(counts, locs, bins, points, "event_type").withColumn("p", F.round("p", 6))


_HAV = "2 * 6371008.8 * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1.0)))"
_KM = _HAV.format(a="lat", b="37.9", c="lon", d="-122.0")


@query("radius_filter", f"WITH {_OBS}, u AS (SELECT DISTINCT user_id, lat, lon FROM obs) SELECT user_id, round({_KM} / 1000, 3) AS km FROM u WHERE {_KM} <= 4000000")
def radius_filter(spark, sf_dir):
    users = _obs(spark, sf_dir).select("user_id", "lat", "lon").distinct().where(geo.within_m(F.col("lat"), F.col("lon"), 37.9, -122.0, 4e6))
    return users.select("user_id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(37.9), F.lit(-122.0)) / 1000, 3).alias("km"))


@query("radius_pruned", f"WITH {_OBS}, u AS (SELECT DISTINCT user_id, lat, lon FROM obs) SELECT user_id, round({_KM} / 1000, 3) AS km FROM u WHERE {_KM} <= 4000000")
def radius_pruned(spark, sf_dir):
    """The rows of ``radius_filter`` from a table laid out by cell, of which only ranges that the circle needs are read."""
    path = scratch.path(spark, "places")
    places.write_layout(_obs(spark, sf_dir).select("user_id", "lat", "lon").distinct(), "lat", "lon", path, files=16)
    found = places.within(spark.read.parquet(path), "lat", "lon", 37.9, -122.0, 4e6)
    return found.select("user_id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(37.9), F.lit(-122.0)) / 1000, 3).alias("km"))


@query("all_cells", f"""WITH {_OBS}, c AS (SELECT DISTINCT floor((lon + 180) / 360 * 32)::BIGINT AS x, floor((lat + 90) / 180 * 16)::BIGINT AS y FROM obs),
a AS (SELECT {_sql_cell('x', 'y', 9)} AS cell, {_sql_cell('((x + dx) + 32) % 32', 'y + dy', 9)} AS other FROM c, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE y + dy BETWEEN 0 AND 15)
SELECT cell, array_to_string(list_sort(list(DISTINCT other)), ',') AS around FROM a GROUP BY cell""")
def all_cells(spark, sf_dir):
    """The cells that events have, each with its neighbours."""
    return geo.cells_with_neighbours(_obs(spark, sf_dir), "lat", "lon", 9).select("cell", F.array_join("around", ",").alias("around"))


@query("nearest_points", f"WITH {_OBS}, u AS (SELECT DISTINCT user_id, lat, lon FROM obs) SELECT user_id, round({_KM} / 1000, 3) AS km FROM u ORDER BY km, user_id LIMIT 10")
def nearest_points(spark, sf_dir):
    users = _obs(spark, sf_dir).select("user_id", "lat", "lon").distinct()
    far = F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(37.9), F.lit(-122.0)) / 1000, 3)
    return users.select("user_id", far.alias("km")).orderBy("km", "user_id").limit(10)
