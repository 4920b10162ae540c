"""Round trips: tables written by a sink and read again by the reader of that format."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from fernmark import scratch
from fernmark.plans.registry import query, read
from fernmark.sources import readers, sinks


@query("csv_round_trip", "SELECT c_custkey, c_name || ' é' AS c_name, c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    """Compressed CSV in Latin-1."""
    path = scratch.path(spark, "csv")
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" é")).alias("c_name"), "c_acctbal")
    rows.write.option("header", True).option("encoding", "ISO-8859-1").option("compression", "gzip").csv(path)
    return readers.csv(spark, path, "c_custkey long, c_name string, c_acctbal double", encoding="ISO-8859-1")


@query("tsv_columns", "SELECT s_suppkey::VARCHAR AS supp_key, s_name AS supp_name FROM supplier")
def tsv_columns(spark, sf_dir):
    """Two columns of a wide file, by their headings."""
    path = scratch.path(spark, "tsv")
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("SuppKey"), "s_nationkey", F.col("s_name").alias("Supp Name"), "s_acctbal")
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return readers.csv_columns(spark, path, ["SuppKey", "Supp Name"])


@query("json_round_trip", "SELECT event_id, event_type, value FROM events")
def json_round_trip(spark, sf_dir):
    path = scratch.path(spark, "json")
    sinks.json_lines(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return readers.json_lines(spark, path, "event_id long, event_type string, value double")


@query("file_manifest", "SELECT r_name AS part, 1::BIGINT AS n FROM region")
def file_manifest(spark, sf_dir):
    """Folders by key, and their files as rows."""
    path = scratch.path(spark, "parts")
    sinks.by_species(read(spark, sf_dir, "region").select("r_regionkey", "r_name"), path, "r_name")
    found = readers.files(spark, path, "*.parquet").where("length > 0")
    return found.groupBy(F.replace(F.regexp_extract("path", "r_name=([^/]*)/", 1), F.lit("%20"), F.lit(" ")).alias("part")).agg(F.count("*").alias("n"))


@query("species_folders", "SELECT p_partkey, p_brand FROM part")
def species_folders(spark, sf_dir):
    path = scratch.path(spark, "brands")
    sinks.by_species(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), path, "p_brand")
    return spark.read.schema("p_partkey long, p_brand string").parquet(path)


@query("fixed_width_round_trip", "SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def fixed_width_round_trip(spark, sf_dir):
    path = scratch.path(spark, "fixed")
    sinks.fixed_width(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), path, {"key": 6, "name": 25})
    return readers.fixed_width(spark, path, ["key", "name"], "key")


@query("xml_round_trip", "SELECT n_nationkey AS nation_key, n_name AS nation_name FROM nation")
def xml_round_trip(spark, sf_dir):
    path = scratch.path(spark, "xml")
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nationKey"), F.col("n_name").alias("nationName"))
    rows.write.format("xml").option("rowTag", "nation").option("rootTag", "nations").save(path)
    return readers.xml(spark, path, "nation", "nationKey int, nationName string")


@query("multi_label_round_trip", "SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN -1 WHEN p_size < 20 THEN 0 ELSE 2 END::INT AS n_labels, CASE WHEN p_size >= 20 THEN p_size + 1 ELSE 0 END::INT AS total FROM part")
def multi_label_round_trip(spark, sf_dir):
    """Unknown labels, none, and two."""
    path = scratch.path(spark, "labels")
    size = F.col("p_size")
    labels = F.when(size < 10, ",?").when(size < 20, "").otherwise(F.concat(F.lit(","), size.cast("string"), F.lit(",1")))
    lines = read(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), labels).alias("value"))
    lines.write.text(path)
    found = readers.multi_label(spark, path)
    n = F.coalesce(F.when(F.col("labels").isNotNull(), F.size("labels")), F.lit(-1))
    return found.select("id", n.alias("n_labels"), F.coalesce(F.aggregate("labels", F.lit(0), lambda a, x: a + x), F.lit(0)).alias("total"))


@query("built_once", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def built_once(spark, sf_dir):
    """A cached table: the second call only reads."""
    root = scratch.path(spark, "cache")
    build = lambda: read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    sinks.materialize(spark, root, "counts", "v1", build)
    return sinks.materialize(spark, root, "counts", "v1", build, only_read=True)


@query("sampled_table", """SELECT user_id, count(*) AS n FROM events WHERE ('0x' || substr(md5(user_id::VARCHAR || 'p'), 1, 8))::BIGINT % 100 < 30 GROUP BY user_id""")
def sampled_table(spark, sf_dir):
    """A sample that is written once and then read."""
    root = scratch.path(spark, "samples")
    for _ in range(2):
        rows = sinks.sampled(spark, f"{sf_dir}/events.parquet", "user_id", 30, root, "p")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


@query("sqlite_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def sqlite_round_trip(spark, sf_dir):
    """Databases made by tasks and opened by tasks."""
    path = scratch.path(spark, "sqlite")
    sinks.sqlite_files(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "customer", rows_a_file=400)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for database in batch.column(0):
                found = sinks.open_sqlite(database.as_py()).execute("SELECT c_custkey, c_name, c_acctbal FROM customer").fetchall()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["c_custkey", "c_name", "c_acctbal"])

    return spark.read.parquet(path).select("database").mapInArrow(rows, "c_custkey long, c_name string, c_acctbal double")


@query("search_export", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, label, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1], 6) AS first, round(v[64], 6) AS last FROM e""")
def search_export(spark, sf_dir):
    """Vectors as columns for clients without arrays."""
    path = scratch.path(spark, "export")
    sinks.export_search(read(spark, sf_dir, "embeddings"), path, vector="embedding", n=64, id_col="vec_id", sort=["label"])
    return spark.read.parquet(path).select("vec_id", "label", F.round("norm_embedding", 6).alias("norm"), F.round(F.col("embedding_0").cast("double"), 6).alias("first"), F.round(F.col("embedding_63").cast("double"), 6).alias("last"))


@query("trimmed_dimension", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def trimmed_dimension(spark, sf_dir):
    used = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return sinks.trimmed(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), used, "n_nationkey")


@query("key_map_round_trip", "SELECT n_nationkey::VARCHAR AS key, n_name AS value FROM nation")
def key_map_round_trip(spark, sf_dir):
    path = scratch.path(spark, "keys")
    sinks.key_map(read(spark, sf_dir, "nation"), "n_nationkey", "n_name", path)
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string, string>")).alias("key", "value"))


@query("tag_metadata", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 ELSE 2 END::INT AS version, CASE WHEN p_size < 10 THEN '_UNK' ELSE p_brand END AS species, CASE WHEN p_size < 10 THEN 'no score' ELSE 'A' END AS quality, CASE WHEN p_size >= 10 THEN p_size * 0.5 END::DOUBLE AS clip_end FROM part")
def tag_metadata(spark, sf_dir):
    """JSON in a file's tags, written and read; some files have none."""
    size = F.col("p_size")
    clip = F.struct(F.struct(F.lit(0.0).alias("lo"), (size * 0.5).cast("double").alias("hi")).alias("time"), F.lit(1.0).alias("gain"))
    tags = readers.tag_json(F.lit(2), F.col("p_brand"), F.lit("A"), F.array(F.struct(F.array(clip).alias("clips"))))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(size >= 10, tags).otherwise("{}").alias("tags"))
    found = rows.select("p_partkey", readers.tag_metadata().alias("m"))
    return found.select("p_partkey", "m.version", "m.species", "m.quality", F.get(F.get("m.edits", F.lit(0))["clips"], F.lit(0))["time"]["hi"].alias("clip_end"))
