"""Clusters, signals, classifiers and streams: no SQL gives the same; tests hold them against brute force."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from fernmark import scratch
from fernmark.operators import clustering, collected, evals, microclusters, models, projection, sampling, signal
from fernmark.plans.registry import ORACLES, query, read
from fernmark.plans.segment_plans import _flags as segments_of
from fernmark.streaming import aggregates, closing


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


@query("kmeans_labels")
def kmeans_labels(spark, sf_dir):
    return clustering.kmeans(_vectors(spark, sf_dir), "embedding", 8).select("vec_id", "cluster")


@query("spherical_kmeans_labels")
def spherical_kmeans_labels(spark, sf_dir):
    return clustering.spherical_kmeans(_vectors(spark, sf_dir), "vec_id", "embedding", 8)[1]


@query("agglom_leaf_order")
def agglom_leaf_order(spark, sf_dir):
    return microclusters.agglomerate(_vectors(spark, sf_dir), "label", "vec_id", "embedding", 3, cosine=True)


@query("pca_projection")
def pca_projection(spark, sf_dir):
    rows, _ = models.pca_normalised(_vectors(spark, sf_dir), "embedding", 4)
    return rows.select("vec_id", F.transform("projected", lambda v: F.round(v, 4)).alias("projected"))


@query("classifier_coverage")
def classifier_coverage(spark, sf_dir):
    """Coverage errors of a naive Bayes classifier over labels, on the fifth of the rows that it wasn't fitted on."""
    rows = sampling.stratified_split(_vectors(spark, sf_dir), "label", "vec_id", 0.2, "t")
    rows = models.with_features(rows, "embedding")
    fitted = models.classifier("nb").fit(rows.where("not is_test"))
    found = models.probabilities(fitted.transform(rows.where("is_test")))
    classes = F.array(*[F.lit(k) for k in range(fitted.stages[-1].numClasses)])
    return found.select("vec_id", "label", evals.coverage_error(classes, F.col("p"), F.col("label")).alias("coverage"))


@query("whitened_projection")
def whitened_projection(spark, sf_dir):
    """Products of whitened vectors with a dictionary of eight unit vectors, negative ones cut."""
    dictionary = projection.fit_dictionary(_vectors(spark, sf_dir), "vec_id", "embedding", 8, retain=0.95)
    found = projection.transformed(_vectors(spark, sf_dir), "embedding", partial(dictionary, rectify=True), "projected")
    return found.select("vec_id", F.transform("projected", lambda v: F.round(v, 4)).alias("projected"))


def _prices(spark, sf_dir):
    """Each supplier's prices in the order of their lines, less 38,000 (about their middle), as the samples of a recording."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("id"), "l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 38_000).alias("samples"))
    return collected.lists_per_key(rows, ["id"], "samples", ["l_orderkey", "l_linenumber"])


@query("thumbnail_starts")
def thumbnail_starts(spark, sf_dir):
    """Where a second of each supplier's prices, a hundred a second, starts that is around the loudest moment."""
    return signal.thumbnails(_prices(spark, sf_dir), 100.0, nperseg=64, hop=32)


@query("mel_of_tones")
def mel_of_tones(spark, sf_dir):
    """Mel spectra of each supplier's prices: what band is loudest."""
    mel = signal.mel_features(_prices(spark, sf_dir), 22050.0).where(F.size(F.get("mel", F.lit(0))) > 0)
    level = F.transform("mel", lambda band: F.aggregate(band, F.lit(0.0), lambda a, v: a + v))
    return mel.select("id", (F.array_position(level, F.array_max(level)) - 1).cast("int").alias("loudest_band"))


@query("sliding_frames", """WITH e AS (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS f FROM events)
SELECT user_id, event_id, round(list_sum(f), 4) AS total FROM e WHERE len(f) = 4""")
def sliding_frames(spark, sf_dir):
    found = signal.frames(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", "event_id", "user_id", 4)
    return found.select("user_id", "event_id", F.round(F.aggregate("frame", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


def _event_stream(spark, sf_dir, *columns):
    """The events file as a stream: file streams take folders, and it is one file beside others."""
    schema = read(spark, sf_dir, "events").select(*columns).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _finished(spark, result, label):
    """The last snapshot of a stream that took all there is; results stay in files, not on the driver."""
    path, log = scratch.path(spark, label), scratch.path(spark, label + "-log")
    result.writeStream.outputMode("complete").option("checkpointLocation", log).foreachBatch(aggregates.keep_result(path)).trigger(availableNow=True).start().awaitTermination()
    return aggregates.last_result(spark, path)


@query("stream_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    """The final state of a stream over the events file."""
    raw = _event_stream(spark, sf_dir, "event_id", "ts", "event_type")
    counts = aggregates.daily_counts(raw.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return _finished(spark, counts, "daily").select(F.col("day").cast("string").alias("day"), "event_type", "n")


@query("stream_running_range", "SELECT user_id, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY user_id")
def stream_running_range(spark, sf_dir):
    """Smallest and largest values so far, at the end of the stream."""
    return _finished(spark, aggregates.running_range(_event_stream(spark, sf_dir, "user_id", "value"), "user_id", "value"), "range")


@query("stream_events", ORACLES["merged_events"])
def stream_events(spark, sf_dir):
    """Events of each user as a stream closes them: all rows, then a restart with late rows that only move the watermark on."""
    closing.with_rocksdb(spark)
    source, out, log = (scratch.path(spark, name) for name in ("flags", "events", "events-log"))
    flags = segments_of(spark, sf_dir).select("user_id", "event_id", "flag", F.col("ts").cast("timestamp").alias("ts"))
    flags.write.parquet(source)
    last = flags.agg(F.max("ts").alias("ts"))

    def run():
        rows = spark.readStream.schema(flags.schema).parquet(source)
        found = closing.closed_events(rows, "user_id", "event_id", "flag", "ts", least=4, gap=1, silence="30 days")
        found.writeStream.option("checkpointLocation", log).foreachBatch(closing.append_once(out)).trigger(availableNow=True).start().awaitTermination()

    run()
    for days in (100, 200):
        later = last.select(F.lit(None).cast("long").alias("user_id"), F.lit(0).cast("long").alias("event_id"), F.lit(False).alias("flag"), (F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"))
        later.write.mode("append").parquet(source)
        run()
    return closing.appended(spark, out).where("user_id IS NOT NULL")
