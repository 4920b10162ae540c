"""Fields of catalogue rows: keys, names, licences, places, cells, orders and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernmark.functions import arrays, dates, geo, intervals, text, vectors
from fernmark.operators import evals, profile, sampling, segments, taxonomy, topk
from fernmark.plans.eval_plans import _CLASSES, _S, _V, _matrix, _scored
from fernmark.plans.prior_plans import _OBS, _obs, _sql_cell, _sql_geohash
from fernmark.plans.registry import query, read
from fernmark.sources import readers


@query("week_normalised", "SELECT event_id, ((event_id * 7 - 5000) % 48 + 48) % 48 AS week FROM events")
def week_normalised(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", dates.normal_week(F.col("event_id") * 7 - 5000).cast("long").alias("week"))


def _places(spark, sf_dir):
    return _obs(spark, sf_dir).select("user_id", "lat", "lon").distinct()


_U = f"{_OBS}, u AS (SELECT DISTINCT user_id, lat, lon FROM obs)"


@query("geohash_cut", f"WITH {_U} SELECT user_id, {_sql_geohash('lat', 'lon', 13)} AS g13, ({_sql_geohash('lat', 'lon', 21)}) || '0' AS g30 FROM u")
def geohash_cut(spark, sf_dir):
    """A geohash of 21 bits cut to 13, and padded to 30."""
    g = geo.geohash(F.col("lat"), F.col("lon"), 21)
    return _places(spark, sf_dir).select("user_id", geo.at_bits(g, 13).alias("g13"), geo.at_bits(g, 30).alias("g30"))


@query("geohash_box", f"""WITH {_U}, c AS (SELECT user_id, floor((lon + 180) / 360 * 256) AS x, floor((lat + 90) / 180 * 128) AS y FROM u)
SELECT user_id, round(y * (180.0 / 128) - 90, 6) AS south, round(x * (360.0 / 256) - 180, 6) AS west, round((y + 1) * (180.0 / 128) - 90, 6) AS north, round((x + 1) * (360.0 / 256) - 180, 6) AS east FROM c""")
def geohash_box(spark, sf_dir):
    edges = geo.box(*geo.cell_of_text(geo.geohash(F.col("lat"), F.col("lon"), 15), 15), 15)
    return _places(spark, sf_dir).select("user_id", *[F.round(c, 6).alias(k) for k, c in edges.items()])


@query("wrapped_longitudes", f"WITH {_U} SELECT user_id, round(lon + 270 - 360 * floor((lon + 270) / 360) - 270, 6) AS lon FROM u")
def wrapped_longitudes(spark, sf_dir):
    return _places(spark, sf_dir).select("user_id", F.round(geo.wrap_longitude(F.col("lon")), 6).alias("lon"))


_AUDIO = "'xc/' || p_partkey || CASE WHEN p_size > 25 THEN '.wav' ELSE '.mp3' END"


@query("operation_strings", f"""WITH a AS (SELECT p_partkey, p_size, {_AUDIO} AS audio FROM part) SELECT p_partkey, CASE WHEN p_size > 25 THEN audio ELSE audio || '.enc(wav)' END AS as_wav, p_size > 25 AS noop,
CASE WHEN p_size > 25 THEN 'audio/wav' ELSE 'audio/mpeg' END AS kind, 'audio/wav' AS kind_as_wav, audio || '.resample(22050,1,16)' AS resampled FROM a""")
def operation_strings(spark, sf_dir):
    """What a transcoder would do, what it would leave, and media types before and after."""
    audio = F.concat(F.lit("xc/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, ".wav").otherwise(".mp3"))
    rows = read(spark, sf_dir, "part").select("p_partkey", audio.alias("audio")).withColumn("as_wav", text.with_operation(F.col("audio"), "enc(wav)"))
    twice = text.with_operation(text.with_operation(F.col("audio"), "resample(22050,1,16)"), "resample(22050,1,16)")
    return rows.select("p_partkey", "as_wav", text.is_noop(F.col("audio"), "enc(wav)").alias("noop"), text.media_type(F.col("audio")).alias("kind"), text.media_type(F.col("as_wav")).alias("kind_as_wav"), twice.alias("resampled"))


@query("license_fields", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'by-sa' ELSE 'by-nc' END AS kind, CASE WHEN p_size < 10 THEN 'by-sa' ELSE p_size || '.0' END AS detail FROM part")
def license_fields(spark, sf_dir):
    path = F.when(F.col("p_size") < 10, F.lit("by-sa/")).otherwise(F.concat(F.lit("by-nc/"), F.col("p_size").cast("string"), F.lit(".0/")))
    kind, detail = text.license_parts(F.concat(F.lit("//creativecommons.org/licenses/"), path))
    return read(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), detail.alias("detail"))


@query("page_keys", """SELECT c_custkey AS id, c_name AS com_name, c_mktsegment AS sci_name, 'heard near ' || c_nationkey AS remarks, 'yes' AS seen, 'no' AS playback, 'st' || c_nationkey AS country FROM customer""")
def page_keys(spark, sf_dir):
    """Title, description and table of recording pages, here of pages made from customers."""
    part = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    html = part(
        '<meta property="og:title" content="XC', key, " ", F.col("c_name"), " (", F.col("c_mktsegment"), ')"><meta property="og:description" content="bird-seen:yes\nplayback-used:no\nheard near ', nation,
        '"><table class="key-value"><tr><td>Country</td><td>st', nation, "</td></tr><tr><td>Time</td><td>07:30</td></tr></table>",
    )
    found = readers.page_fields(read(spark, sf_dir, "customer").select(html.alias("html")))
    return found.select("id", "com_name", "sci_name", "remarks", F.col("flags")["bird-seen"].alias("seen"), F.col("flags")["playback-used"].alias("playback"), F.col("fields")["country"].alias("country"))


@query("place_abbreviations", "SELECT c_custkey, 'US, st' || c_nationkey || ', ' || CASE c_mktsegment WHEN 'BUILDING' THEN 'BLD' ELSE c_mktsegment END AS place FROM customer")
def place_abbreviations(spark, sf_dir):
    place = F.concat("c_mktsegment", F.lit(", st"), F.col("c_nationkey").cast("string"), F.lit(", United States"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.abbreviated(place, {"United States": "US", "BUILDING": "BLD"}).alias("place"))


@query("checklist_ids", "SELECT event_id, CASE WHEN event_type = 'view' THEN -user_id ELSE event_id END AS checklist FROM events")
def checklist_ids(spark, sf_dir):
    """Views stand for group checklists, which come before an event's own id."""
    group = F.when(F.col("event_type") == "view", F.concat(F.lit("G"), F.col("user_id").cast("string")))
    return read(spark, sf_dir, "events").select("event_id", text.checklist_id(group, F.concat(F.lit("S"), F.col("event_id").cast("string"))).alias("checklist"))


@query("source_keys", "SELECT c_custkey, 'user' AS kind, c_custkey || ':' || c_nationkey AS key FROM customer")
def source_keys(spark, sf_dir):
    kind, key = text.source_parts(text.source_id("user", F.concat_ws(":", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"))))
    return read(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), key.alias("key"))


@query("clamped_prices", "SELECT p_partkey, least(greatest(p_retailprice, 950.0), 1500.0)::DOUBLE AS price FROM part")
def clamped_prices(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", intervals.clamp(F.col("p_retailprice"), intervals.interval(F.lit(950), F.lit(1500))).alias("price"))


@query("arranged_columns", "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal / 1000 AS thousands, c_nationkey FROM customer")
def arranged_columns(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    return profile.arranged(rows, rename={"c_custkey": "id", "c_mktsegment": "segment"}, assign={"thousands": F.col("c_acctbal") / 1000}, drop=["c_acctbal", "c_name"], first=["id", "segment"], last=["c_nationkey"])


@query("columns_once", "SELECT c_custkey, c_name FROM customer")
def columns_once(spark, sf_dir):
    return profile.columns_once(read(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_custkey"])


def _species(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.select(F.lower("n_name").alias("species_code"), F.concat(F.lit("Natio "), "n_name").alias("sci_name"), F.col("n_name").alias("com_name"), F.upper(F.substring("n_name", 1, 4)).alias("banding_code"))


@query("synthetic_species", """SELECT lower(n_name) AS species_code, 'Natio ' || n_name AS sci_name, n_name AS com_name, upper(substr(n_name, 1, 4)) AS banding_code FROM nation
UNION ALL SELECT k, k, k, k FROM (SELECT unnest(['_UNK', '_MUL', '_NON']) AS k)""")
def synthetic_species(spark, sf_dir):
    return taxonomy.with_synthetic(_species(spark, sf_dir))


@query("taxonomic_order", """WITH s AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_name) - 1 AS taxon_ord FROM nation) SELECT c_custkey, taxon_ord FROM customer LEFT JOIN s ON c_nationkey = n_nationkey ORDER BY taxon_ord, c_custkey LIMIT 60""")
def taxonomic_order(spark, sf_dir):
    """The first rows of a listing by taxonomic order: nations stand for species, their regions for families."""
    species = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    rows = taxonomy.with_ordinal(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), species, "c_nationkey", [F.col("n_regionkey"), F.col("n_name")])
    return topk.top_n(rows.select("c_custkey", "taxon_ord"), [F.col("taxon_ord"), F.col("c_custkey")], 60)


_LISTED = {"quality": "ASC", "species": "ASC", "place": "ASC", "date": "DESC", "lat": "DESC"}


@query("enumerated_orders", """WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS quality, o_orderstatus AS species, o_custkey AS place, o_orderdate AS date, o_totalprice AS lat FROM orders) """ + " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS by, id, row_number() OVER (ORDER BY {c} {way}, id DESC) AS place FROM r) WHERE place <= 8" for c, way in _LISTED.items()))
def enumerated_orders(spark, sf_dir):
    """The first rows in each of the named orders, whose direction depends on the column."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("quality"), F.col("o_orderstatus").alias("species"), F.col("o_custkey").alias("place"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("lat"))
    found = None
    for name in _LISTED:
        first = topk.placed(topk.top_n(rows, topk.orders()[name], 8), topk.orders()[name]).select(F.lit(name).alias("by"), "id", "place")
        found = first if found is None else found.unionByName(first)
    return found


@query("background_list", "SELECT n_nationkey, array_to_string([n_nationkey::VARCHAR, 'Nowhere bird (Nowhere)', 'just words'], '|') AS species FROM nation")
def background_list(spark, sf_dir):
    """Names in brackets are looked up among nations; others stay as they are."""
    nations = read(spark, sf_dir, "nation")
    codes = nations.agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string")))).alias("codes"))
    heard = F.array(F.concat(F.lit("Some bird ("), "n_name", F.lit(")")), F.lit(" Nowhere bird (Nowhere) "), F.lit(""), F.lit("just words"))
    return nations.crossJoin(F.broadcast(codes)).select("n_nationkey", F.array_join(text.background_species(heard, F.col("codes")), "|").alias("species"))


@query("merged_places", "SELECT n_nationkey, n_name || ',shared,' || r_name AS species FROM nation JOIN region ON n_regionkey = r_regionkey")
def merged_places(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = F.array(F.array("n_name", F.lit("shared")), F.array(F.lit("shared"), "r_name", "n_name"))
    return rows.select("n_nationkey", F.array_join(text.merged_unique(lists), ",").alias("species"))


@query("rewritten_names", r"SELECT p_partkey, regexp_replace(regexp_replace(p_type, '^(\w+) ', '\1-'), '[aeiou]', '_', 'g') AS name FROM part")
def rewritten_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.rewritten(F.col("p_type"), {r"^(\w+) ": "$1-", "[aeiou]": "_"}).alias("name"))


@query("sha1_keys", "SELECT c_custkey, sha1(c_custkey || chr(31) || c_name || chr(31)) AS key FROM customer")
def sha1_keys(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.sha1_key(F.col("c_custkey"), F.col("c_name"), F.lit(None)).alias("key"))


@query("rms_matrix", f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), r AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v[1:12], lambda x: x * x)) / 12) AS rms FROM e)
SELECT vec_id, k::INT AS row, round(list_sum(list_transform(v[4 * k + 1:4 * k + 4], lambda x: abs(x) / rms)), 5) AS size FROM r, (SELECT unnest([0, 1, 2]) AS k)""")
def rms_matrix(spark, sf_dir):
    found = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.rms_normalised(_matrix())).alias("row", "f"))
    return found.select("vec_id", "row", F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("size"))


@query("array_agg_differences", f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), d AS (SELECT vec_id, [v[i + 1] - v[i] FOR i IN range(1, 64)] AS d, [v[i + 2] - 2 * v[i + 1] + v[i] FOR i IN range(1, 63)] AS d2 FROM e)
SELECT vec_id, round(list_stddev_pop(d), 5) AS dstd, round(list_avg(d2), 5) + 0.0 AS d2mean, round(list_stddev_pop(d2), 5) AS d2std FROM d""")
def array_agg_differences(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select("vec_id", *[(F.round(arrays.SUMMARIES[k](v), 5) + 0.0).alias(k) for k in ("dstd", "d2mean", "d2std")])


@query("feature_vectors", f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), f AS (SELECT vec_id, [list_max(v[1:4]), list_max(v[5:8]), list_max(v[9:12]), list_avg(v[1:4]), list_avg(v[5:8]), list_avg(v[9:12])] AS f FROM e)
SELECT vec_id, array_to_string(list_transform(f, lambda x: round(x * 10000)::BIGINT), ',') AS features FROM f""")
def feature_vectors(spark, sf_dir):
    """Summaries of matrix rows, one summary of all rows after another."""
    found = arrays.feature_vector(_matrix(), ("max", "mean"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(found, lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("features"))


@query("time_slices", f"WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings) SELECT vec_id, round(v[2] + v[3] + v[6] + v[7] + v[10] + v[11], 5) + 0.0 AS total, '0.0,0.5' AS times FROM e")
def time_slices(spark, sf_dir):
    """The middle two of four columns, with their times counted anew."""
    cut, times = arrays.slice_times(_matrix(), F.array(*map(F.lit, (0.0, 0.5, 1.0, 1.5))), F.lit(0.5), F.lit(1.5))
    total = F.aggregate(F.flatten(cut), F.lit(0.0), lambda a, x: a + x)
    return read(spark, sf_dir, "embeddings").select("vec_id", (F.round(total, 5) + 0.0).alias("total"), F.array_join(F.transform(times, lambda t: t.cast("string")), ",").alias("times"))


@query("valid_recordings", "SELECT p_partkey, p_size FROM part WHERE p_size <> 0 AND p_retailprice / 10 <= 100")
def valid_recordings(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 10).alias("mb"))
    return sampling.valid(rows, "p_size", "mb").drop("mb")


@query("batch_counts", "SELECT (('0x' || substr(md5(event_id::VARCHAR || 'b'), 1, 8))::BIGINT % 7)::INT AS batch, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def batch_counts(spark, sf_dir):
    rows = sampling.batched(read(spark, sf_dir, "events"), "event_id", 7, "b")
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("known_class_rows", "SELECT label, count(*) AS n FROM embeddings WHERE label IN (0, 2, 4, 6) GROUP BY label")
def known_class_rows(spark, sf_dir):
    return evals.known_classes(read(spark, sf_dir, "embeddings").select("label"), "label", [0, 2, 4, 6]).groupBy("label").agg(F.count("*").alias("n"))


@query("merged_confusion", f"""WITH l AS (SELECT label, unnest(range(0, 10))::INT AS class, unnest(list_transform({_S}, lambda s: abs(s))) AS s FROM embeddings), t AS (SELECT label, class, sum(s) AS total FROM l GROUP BY ALL)
SELECT label, class, round(total, 4) AS total, round(sum(total) OVER (PARTITION BY label), 4) AS row_total, round(total / sum(total) OVER (PARTITION BY label), 5) AS share FROM t""")
def merged_confusion(spark, sf_dir):
    """Confusions of three folds, drawn by id, put together: that of all rows."""
    rows = sampling.batched(_scored(spark, sf_dir), "vec_id", 3, "fold", "fold")
    folds = [evals.confusion(rows.where(F.col("fold") == k), "label", F.array(*map(F.lit, _CLASSES)), F.transform("scores", lambda s: F.abs(s))) for k in range(3)]
    m = evals.merged_confusion(folds, "label")
    return m.select("label", "class", F.round("total", 4).alias("total"), F.round("row_total", 4).alias("row_total"), F.round("share", 5).alias("share"))


@query("box_filter", f"WITH {_U} SELECT user_id FROM u WHERE lat BETWEEN -60 AND 60 AND (lon >= 100 OR lon <= -20)")
def box_filter(spark, sf_dir):
    """A box from 100 degrees east over the date line to 20 degrees west."""
    return _places(spark, sf_dir).where(geo.in_box(F.col("lat"), F.col("lon"), -60, 100, 60, -20)).select("user_id")


@query("packed_vectors", f"SELECT vec_id, round(sqrt(list_dot_product({_V}, {_V})), 6) AS norm, 64 AS n FROM embeddings")
def packed_vectors(spark, sf_dir):
    """A column for each component, and one array again."""
    flat = read(spark, sf_dir, "embeddings").select("vec_id", *vectors.unpack(F.col("embedding").cast("array<double>"), 64, "v"))
    back = flat.select("vec_id", vectors.pack([f"v_{k}" for k in range(64)]).alias("v"))
    return back.select("vec_id", F.round(vectors.norm(F.col("v")), 6).alias("norm"), F.size("v").alias("n"))


@query("json_labels", """SELECT c_custkey, '{"segment":"' || c_mktsegment || '","nation":' || c_nationkey || '}' AS label FROM customer""")
def json_labels(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))).alias("label"))


@query("json_numbers", """SELECT p_partkey, CASE WHEN p_size < 5 THEN '"Infinity"' WHEN p_size < 9 THEN '"-Infinity"' WHEN p_size < 12 THEN '"NaN"' ELSE (p_size::DOUBLE)::VARCHAR END AS size FROM part""")
def json_numbers(spark, sf_dir):
    size = F.col("p_size")
    x = F.when(size < 5, float("inf")).when(size < 9, float("-inf")).when(size < 12, float("nan")).otherwise(size.cast("double"))
    return read(spark, sf_dir, "part").select("p_partkey", intervals.json_number(x).alias("size"))


@query("edited_samples", f"WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings) SELECT vec_id, 9 AS n, round(v[3] * 10, 4) + 0.0 AS first, round(v[1] + v[2], 4) + 0.0 AS last, 0.0::DOUBLE AS padding FROM e")
def edited_samples(spark, sf_dir):
    """Two clips of a recording, one of them louder, one after another, and zeros up to nine samples."""
    clip = lambda lo, hi, gain: F.struct(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")).alias("time"), F.lit(gain).cast("double").alias("gain"))
    samples = segments.edited(F.col("embedding").cast("array<double>"), 2.0, F.array(clip(1.0, 2.0, 20.0), clip(0.0, 1.0, None)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", segments.padded(samples, 9).alias("s"))
    return rows.select("vec_id", F.size("s").alias("n"), (F.round(F.col("s")[0], 4) + 0.0).alias("first"), (F.round(F.col("s")[2] + F.col("s")[3], 4) + 0.0).alias("last"), F.aggregate(F.slice("s", 5, 5), F.lit(0.0), lambda a, x: a + x).alias("padding"))


@query("known_fields", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type <> 'view' AND json_extract_string(props, '$.k') IS NOT NULL""")
def known_fields(spark, sf_dir):
    """Rows that have all of some fields."""
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    rows = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k string")["k"].cast("int").alias("k"), kind.alias("kind"))
    return rows.dropna(subset=["k", "kind"]).drop("kind")
