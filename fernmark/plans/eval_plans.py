"""Evaluation and array queries; scores are the first ten components of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernmark.functions import arrays
from fernmark.operators import evals
from fernmark.plans.registry import query, read

_S = "list_transform(embedding[1:10], lambda x: x::DOUBLE)"
_CLASSES = list(range(10))


def _scored(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 10).cast("array<double>").alias("scores"), F.array(*map(F.lit, _CLASSES)).alias("classes"))


_COV = f"c AS (SELECT vec_id, label, len(list_filter({_S}, lambda s: s >= ({_S})[label + 1]))::DOUBLE AS coverage FROM embeddings)"


@query("coverage_error", f"WITH {_COV} SELECT vec_id, coverage FROM c")
def coverage_error(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", evals.coverage_error(F.col("classes"), F.col("scores"), F.col("label")).alias("coverage"))


@query("coverage_by_label", f"WITH {_COV} SELECT label, -quantile_cont(coverage, 0.5) AS score, quantile_cont(coverage, 0.25) AS p25, quantile_cont(coverage, 0.5) AS p50, quantile_cont(coverage, 0.75) AS p75, count(*) AS n FROM c GROUP BY label")
def coverage_by_label(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("label", evals.coverage_error(F.col("classes"), F.col("scores"), F.col("label")).alias("coverage"))
    return evals.score(rows, "coverage", ["label"])


@query("ranked_classes", f"""WITH l AS (SELECT vec_id, unnest(range(0, 10)) AS class, unnest({_S}) AS p FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS rank FROM l)
SELECT vec_id, class::INT AS class, round(p, 6) AS p, rank::INT AS rank FROM r WHERE rank <= 3""")
def ranked_classes(spark, sf_dir):
    ranked = _scored(spark, sf_dir).select("vec_id", F.posexplode(F.slice(evals.ranked_classes(F.col("classes"), F.col("scores")), 1, 3)).alias("at", "z"))
    return ranked.select("vec_id", F.col("z.class").alias("class"), F.round("z.p", 6).alias("p"), (F.col("at") + 1).alias("rank"))


@query("class_probabilities", f"SELECT vec_id, unnest(range(0, 10))::INT AS class, round(unnest({_S}), 6) AS score FROM embeddings")
def class_probabilities(spark, sf_dir):
    return evals.long_scores(_scored(spark, sf_dir), F.col("classes"), F.col("scores"), ["vec_id"]).withColumn("score", F.round("score", 6))


@query("confusion_prob", f"""WITH l AS (SELECT label, unnest(range(0, 10))::INT AS class, unnest(list_transform({_S}, lambda s: abs(s))) AS s FROM embeddings), t AS (SELECT label, class, sum(s) AS total FROM l GROUP BY ALL)
SELECT label, class, round(total, 4) AS total, round(sum(total) OVER (PARTITION BY label), 4) AS row_total, round(total / sum(total) OVER (PARTITION BY label), 5) AS share FROM t""")
def confusion_prob(spark, sf_dir):
    m = evals.confusion(_scored(spark, sf_dir), "label", F.col("classes"), F.transform("scores", lambda s: F.abs(s)))
    return m.select("label", "class", F.round("total", 4).alias("total"), F.round("row_total", 4).alias("row_total"), F.round("share", 5).alias("share"))


@query("box_stats", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
count(DISTINCT l_extendedprice) FILTER (l_extendedprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag, q1, med, q3""")
def box_stats(spark, sf_dir):
    found = evals.box_stats(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return found.withColumns({c: F.round(c, 4) for c in ("q1", "med", "q3")})


_M = "m AS (SELECT o_orderstatus AS model, round(avg(o_totalprice), 3) AS split0_train, round(min(o_totalprice), 3) AS split0_test, round(max(o_totalprice), 3) AS split1_train, round(median(o_totalprice), 3) AS split1_test FROM orders GROUP BY 1)"


def _metrics(spark, sf_dir):
    price = F.col("o_totalprice")
    aggs = {"split0_train": F.avg(price), "split0_test": F.min(price), "split1_train": F.max(price), "split1_test": F.median(price)}
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("model")).agg(*[F.round(a, 3).alias(k) for k, a in aggs.items()])


@query("unpivot_metrics", f"WITH {_M} SELECT model, name, value FROM m UNPIVOT (value FOR name IN (split0_train, split0_test, split1_train, split1_test))")
def unpivot_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).unpivot("model", ["split0_train", "split0_test", "split1_train", "split1_test"], "name", "value")


@query("unpivot_splits", f"WITH {_M} SELECT model, 0 AS split, split0_test AS test, split0_train AS train FROM m UNION ALL SELECT model, 1, split1_test, split1_train FROM m")
def unpivot_splits(spark, sf_dir):
    return evals.unpivot_splits(_metrics(spark, sf_dir), ["model"])


_V = "list_transform(embedding, lambda x: x::DOUBLE)"
_MOM = "list_sum(list_transform(v, lambda x: pow(x - list_avg(v), {k}))) / len(v)"


@query("array_agg_stats", f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings) SELECT vec_id, round(list_avg(v), 5) + 0.0 AS mean, round(sqrt({_MOM.format(k=2)}), 5) AS std, round(list_min(v), 5) AS "min", round(list_max(v), 5) AS "max", round(list_median(v), 5) + 0.0 AS median,
round({_MOM.format(k=3)} / pow({_MOM.format(k=2)}, 1.5), 4) AS skew, round({_MOM.format(k=4)} / pow({_MOM.format(k=2)}, 2) - 3, 4) AS kurtosis, round((v[64] - v[1]) / 63, 5) + 0.0 AS dmean FROM e""")
def array_agg_stats(spark, sf_dir):
    v = F.col("v")
    digits = {"skew": 4, "kurtosis": 4}
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.select("vec_id", *[(F.round(arrays.SUMMARIES[k](v), digits.get(k, 5)) + 0.0).alias(k) for k in ("mean", "std", "min", "max", "median", "skew", "kurtosis", "dmean")])


def _matrix():
    """Rows of four numbers from the first twelve components."""
    return F.array(*[F.slice(F.col("embedding").cast("array<double>"), 1 + 4 * k, 4) for k in range(3)])


@query("array_patches", f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings) SELECT vec_id, i::INT AS at, array_to_string(list_transform([v[i + 1], v[i + 2], v[i + 5], v[i + 6], v[i + 9], v[i + 10]], lambda x: round(x * 10000)::BIGINT), ',') AS patch FROM e, (SELECT unnest([0, 1, 2]) AS i)""")
def array_patches(spark, sf_dir):
    found = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.patches(_matrix(), 2)).alias("at", "p"))
    return found.select("vec_id", "at", F.array_join(F.transform("p", lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("patch"))


@query("median_clip_per_freq", f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), r AS (SELECT vec_id, k::INT AS row, v[4 * k + 1:4 * k + 4] AS f FROM e, (SELECT unnest([0, 1, 2]) AS k))
SELECT vec_id, row, round(list_sum(list_transform(f, lambda x: greatest(x - list_median(f), 0.0))), 5) AS clipped FROM r""")
def median_clip_per_freq(spark, sf_dir):
    found = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.median_clipped(_matrix())).alias("row", "f"))
    return found.select("vec_id", "row", F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 5).alias("clipped"))


@query("relative_entropy", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT n / sum(n) OVER () AS p, count(*) OVER () AS k FROM c) SELECT round(-sum(p * ln(p)) / ln(any_value(k)), 6) AS entropy FROM p")
def relative_entropy(spark, sf_dir):
    """How evenly labels are hit: 1 if all alike."""
    counts = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    p = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).agg(F.round(-F.sum(p * F.ln(p)) / F.ln(F.max("k")), 6).alias("entropy"))
