"""Plans of work, views, collected values, and signals and streams made of events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark import scratch
from fernmark.operators import collected, filters, signal, views, worklists
from fernmark.plans.registry import query, read
from fernmark.streaming import aggregates, closing, framing

_AUDIO = "(CASE WHEN p_size % 2 = 0 THEN 'cache/' ELSE 'raw/' END || p_partkey || CASE WHEN p_size > 25 THEN '.wav' ELSE '.mp3' END)"


@query("transcode_plan", f"""WITH a AS (SELECT p_partkey, p_size, {_AUDIO} AS audio FROM part), f AS (SELECT audio || '.enc(wav)' AS file FROM a WHERE p_partkey % 3 = 0),
o AS (SELECT *, p_size > 25 AS resample, audio || CASE WHEN p_size > 25 THEN '.resample(22050,1,16)' ELSE '' END || '.enc(wav)' AS output FROM a), w AS (SELECT *, output NOT IN (SELECT file FROM f) AS write FROM o)
SELECT p_partkey, audio, output, resample, write, CASE WHEN resample AND starts_with(audio, 'cache/') THEN 'resampled before' WHEN write AND NOT starts_with(output, 'cache/') THEN 'outside the cache' END AS refused FROM w""")
def transcode_plan(spark, sf_dir):
    """Files to make of recordings of two rates, of which a third are there."""
    parts = read(spark, sf_dir, "part")
    rate = F.when(F.col("p_size") > 25, 44100).otherwise(22050)
    recs = parts.select("p_partkey", F.expr(_AUDIO).alias("audio"), rate.alias("rate"), F.lit(1).alias("channels"), F.lit(16).alias("bits"))
    files = recs.where("p_partkey % 3 = 0").select(F.concat("audio", F.lit(".enc(wav)")).alias("audio"))
    plan = worklists.transcode_plan(recs, files, worklists.Target(22050, 1, 16, "wav"))
    return plan.select("p_partkey", "audio", "output", "resample", "write", "refused")


_SHOWN = """CASE WHEN {x} IS NULL THEN '' WHEN abs({x}) <= 0.001 THEN '0' WHEN {x} >= 10 THEN round_even({x}, 0)::BIGINT::VARCHAR
ELSE ltrim((round_even({x} * pow(10.0, 1 - floor(log10(abs({x})))), 0) / pow(10.0, 1 - floor(log10(abs({x})))))::VARCHAR, '0') END"""


@query("record_views", f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS remark, year(o_orderdate) AS y, strftime(o_orderdate, '%m-%d') AS md, o_totalprice / 100000 AS price, o_custkey / 4000.0 AS score,
  'Town ' || o_custkey || ', ' || o_orderstatus || ', Land' AS place FROM orders)
SELECT o_orderkey, coalesce(remark, '') AS remark, coalesce(remark, '') || CASE WHEN remark IS NULL THEN '' ELSE ' ' END || 'x' AS tags, 'Land, ' || split_part(place, ', ', 2) || ', ' || split_part(place, ', ', 1) AS place,
  {_SHOWN.format(x='price')} AS price, {_SHOWN.format(x='score')} AS score, y || '-' || md AS date FROM r""")
def record_views(spark, sf_dir):
    """Orders as a page shows them."""
    o = read(spark, sf_dir, "orders")
    remark = F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.concat(F.lit("<b>"), "o_orderpriority", F.lit("</b>")))
    rows = o.select(
        "o_orderkey", remark.alias("remark"), F.array_compact(F.array(remark, F.lit("<i>x</i>"))).alias("tags"), F.year("o_orderdate").alias("y"), F.date_format("o_orderdate", "MM-dd").alias("md"),
        (F.col("o_totalprice") / 100000).alias("price"), (F.col("o_custkey") / 4000.0).alias("score"), F.concat(F.lit("Town "), F.col("o_custkey").cast("string"), F.lit(", "), "o_orderstatus", F.lit(", Land")).alias("place"),
    )
    return views.record_view(rows, keep=["o_orderkey"], texts=["remark"], lists=["tags"], places=["place"], numbers=["price", "score"], dates={"date": ("y", "md")})


@query("lists_per_user", """WITH l AS (SELECT user_id, array_to_string(list(event_type ORDER BY event_id), ',') AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 20 GROUP BY user_id),
m AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL), k AS (SELECT user_id, array_to_string(list(event_type || '=' || round(v * 100)::BIGINT ORDER BY event_type), ',') AS latest FROM m GROUP BY user_id)
SELECT user_id, kinds, latest FROM l JOIN k USING (user_id)""")
def lists_per_user(spark, sf_dir):
    """Each user's first twenty kinds in order, and the last value of each kind."""
    e = read(spark, sf_dir, "events")
    lists = collected.lists_per_key(e, ["user_id"], "event_type", ["event_id"], most=20).select("user_id", F.array_join("event_type", ",").alias("kinds"))
    maps = collected.map_per_key(e, ["user_id"], "event_type", "value", ["event_id"])
    latest = F.transform(F.map_entries("map"), lambda p: F.concat(p["key"], F.lit("="), F.round(p["value"] * 100).cast("long").cast("string")))
    return lists.join(maps.select("user_id", F.array_join(latest, ",").alias("latest")), "user_id")


@query("passed_through", "SELECT n_nationkey, n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def passed_through(spark, sf_dir):
    """Customers by nation, with names that the nation determines, checked."""
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return collected.passed_through(rows, ["n_nationkey"], ["n_name", "r_name"], [F.count("*").alias("n")])


def _signals(spark, sf_dir):
    """Each user's values in order, as the samples of a recording."""
    return collected.lists_per_key(read(spark, sf_dir, "events"), ["user_id"], "value", ["event_id"]).withColumnRenamed("value", "samples")


_X = "x AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"


@query("quiet_runs", f"""WITH {_X}, f AS (SELECT user_id, i // 4 AS k, sqrt(avg(v * v)) < 40 AS quiet FROM x GROUP BY user_id, i // 4 HAVING count(*) = 4),
g AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, quiet ORDER BY k) AS run FROM f)
SELECT user_id, min(k)::BIGINT * 4 AS start, max(k)::BIGINT * 4 + 4 AS stop FROM g WHERE quiet GROUP BY user_id, run HAVING count(*) >= 2""")
def quiet_runs(spark, sf_dir):
    """Where at least eight values in a row are quiet, four by four."""
    found = _signals(spark, sf_dir).select("user_id", F.explode(signal.quiet(F.col("samples"), 4, 40.0, 8)).alias("r"))
    return found.select("user_id", F.col("r.start").alias("start"), F.col("r.end").alias("stop"))


@query("spectrogram_frames", f"""WITH {_X}, n AS (SELECT user_id, max(i) + 1 AS n FROM x GROUP BY user_id), k AS (SELECT user_id, unnest(range(0, (n - 16) // 8 + 1)) AS frame FROM n WHERE n >= 16),
s AS (SELECT k.user_id, frame, i - frame * 8 AS j, v FROM k JOIN x ON x.user_id = k.user_id AND i BETWEEN frame * 8 AND frame * 8 + 15),
m AS (SELECT *, (v - avg(v) OVER (PARTITION BY user_id, frame)) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS y FROM s)
SELECT user_id, frame::INT AS frame, f::INT AS f, round(sqrt(pow(sum(y * cos(2 * pi() * f * j / 16)), 2) + pow(sum(y * sin(2 * pi() * f * j / 16)), 2)) / 8, 4) AS level FROM m, (SELECT unnest(range(0, 9)) AS f) GROUP BY user_id, frame, f""")
def spectrogram_frames(spark, sf_dir):
    """Spectra of sixteen values every eight."""
    frames = _signals(spark, sf_dir).select("user_id", F.posexplode(signal.spectra(F.col("samples"), 16.0, 16, 8)).alias("frame", "s"))
    return frames.select("user_id", "frame", F.posexplode("s").alias("f", "v")).select("user_id", "frame", "f", F.round("v", 4).alias("level"))


@query("low_passed", f"""WITH RECURSIVE {_X}, c AS (SELECT tan(pi() * 2 / 16) / (1 + tan(pi() * 2 / 16)) AS b, (tan(pi() * 2 / 16) - 1) / (1 + tan(pi() * 2 / 16)) AS a),
y AS (SELECT user_id, i, v, b * v AS y FROM x, c WHERE i = 0 UNION ALL SELECT x.user_id, x.i, x.v, c.b * (x.v + y.v) - c.a * y.y FROM y JOIN x ON x.user_id = y.user_id AND x.i = y.i + 1, c)
SELECT user_id, i::INT AS place, round(y, 4) AS value FROM y""")
def low_passed(spark, sf_dir):
    """Each user's values through a Butterworth low pass of order one, at an eighth of the rate."""
    sections = filters.butterworth(1, 16.0, high=2.0)
    found = _signals(spark, sf_dir).select("user_id", F.posexplode(filters.filtered(F.col("samples"), sections)).alias("place", "v"))
    return found.select("user_id", "place", F.round("v", 4).alias("value"))


@query("stream_frames", f"""WITH {_X}, f AS (SELECT user_id AS id, i, sum(v) OVER w AS total, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
SELECT id, i // 4 AS frame, i AS start, round(total, 4) AS total FROM f WHERE i % 4 = 0 AND n = 8""")
def stream_frames(spark, sf_dir):
    """Frames of eight samples every four, from a stream of chunks of seven."""
    source, out, log = (scratch.path(spark, name) for name in ("chunks", "frames", "frames-log"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "value", F.floor(place / 7).cast("long").alias("seq"))
    collected.lists_per_key(rows, ["id", "seq"], "value", ["event_id"]).withColumnRenamed("value", "samples").write.parquet(source)
    stream = spark.readStream.schema("id long, seq long, samples array<double>").parquet(source)
    framing.frames(stream, 8, 4).writeStream.option("checkpointLocation", log).foreachBatch(closing.append_once(out)).trigger(availableNow=True).start().awaitTermination()
    return closing.appended(spark, out).select("id", "frame", "start", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("stream_upserts", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_upserts(spark, sf_dir):
    """The last event of each user, kept by a stream in a table of buckets."""
    schema = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    table, log = scratch.path(spark, "upserts"), scratch.path(spark, "upserts-log")
    rows.writeStream.option("checkpointLocation", log).foreachBatch(aggregates.upsert_latest(table, "user_id", "event_id", buckets=8)).trigger(availableNow=True).start().awaitTermination()
    return aggregates.upserted(spark, table)
