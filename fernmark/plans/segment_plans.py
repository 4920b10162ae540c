"""Runs, events, subsets of groups, aliases and funnel statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernmark.operators import profile, sampling, search, segments, topk
from fernmark.plans.registry import query, read

_FLAG = "f AS (SELECT user_id, event_id, value > 50 AS flag FROM events)"


def _flags(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") > 50).alias("flag"))


@query("majority_filter", f"WITH {_FLAG} SELECT user_id, event_id, sum(flag::INT) OVER w * 2 > count(*) OVER w AS smooth FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def majority_filter(spark, sf_dir):
    return segments.majority(_flags(spark, sf_dir), "user_id", "event_id", "flag", 2).select("user_id", "event_id", "smooth")


_RUNS = f"""{_FLAG}, c AS (SELECT *, CASE WHEN flag = lag(flag) OVER w THEN 0 ELSE 1 END AS change FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT user_id, run::BIGINT AS run, flag, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, run, flag)"""


@query("flag_runs", f"WITH {_RUNS} SELECT * FROM r")
def flag_runs(spark, sf_dir):
    return segments.runs(_flags(spark, sf_dir), "user_id", "event_id", "flag")


@query("merged_events", f"""WITH {_RUNS}, k AS (SELECT *, flag OR (n <= 1 AND lag(flag) OVER w IS NOT NULL AND lead(flag) OVER w IS NOT NULL) AS inside FROM r WINDOW w AS (PARTITION BY user_id ORDER BY run)),
d AS (SELECT *, CASE WHEN inside = lag(inside) OVER (PARTITION BY user_id ORDER BY run) THEN 0 ELSE 1 END AS c FROM k), e AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS event FROM d)
SELECT user_id, min(first) AS first, max(last) AS last, sum(n)::BIGINT AS n FROM e WHERE inside GROUP BY user_id, event HAVING sum(n) >= 4""")
def merged_events(spark, sf_dir):
    return segments.events(_flags(spark, sf_dir), "user_id", "event_id", "flag", least=4, gap=1)


@query("top_groups_then_rows", """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id <> 0),
s AS (SELECT DISTINCT label FROM e), t AS (SELECT label, round(-ln(1.0 / (2 + label)), 6) AS slp FROM s ORDER BY slp, label LIMIT 4),
d AS (SELECT vec_id, label, slp, round(1 - list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS d_cosine FROM e JOIN t USING (label), q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d_cosine, vec_id) AS rank FROM d) SELECT vec_id, label, slp, d_cosine FROM r WHERE rank <= 3 ORDER BY slp, d_cosine, vec_id LIMIT 12""")
def top_groups_then_rows(spark, sf_dir):
    """ceil(12 / 3) likeliest labels among those that survive the filter, then rows of these only."""
    vectors = read(spark, sf_dir, "embeddings")
    rows = vectors.where("vec_id <> 0")
    likely = rows.select("label").distinct().withColumn("p", F.lit(1.0) / (F.lit(2) + F.col("label")))
    found = search.top_groups(rows, vectors.where("vec_id = 0"), "embedding", "vec_id", "label", 3, 12, likely)
    return found.select("vec_id", "label", "slp", "d_cosine")


@query("subtotal_shares", """WITH t AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(total, 2) AS total, round(sum(total) OVER (PARTITION BY l_returnflag), 2) AS subtotal, round(total / sum(total) OVER (), 6) AS share FROM t""")
def subtotal_shares(spark, sf_dir):
    totals = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("total"))
    subtotals = totals.groupBy("l_returnflag").agg(F.sum("total").alias("subtotal"))
    whole = totals.agg(F.sum("total").alias("whole"))
    joined = totals.join(F.broadcast(subtotals), "l_returnflag").crossJoin(F.broadcast(whole))
    return joined.select("l_returnflag", "l_linestatus", F.round("total", 2).alias("total"), F.round("subtotal", 2).alias("subtotal"), F.round(F.col("total") / F.col("whole"), 6).alias("share"))


@query("funnel_stats", """WITH a AS (SELECT p_partkey, p_brand FROM part), b AS (SELECT * FROM a WHERE p_brand IN (SELECT p_brand FROM a GROUP BY p_brand HAVING count(*) >= 5)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR || 'f'), p_partkey) AS n FROM b)
SELECT 0 AS stage, count(*) AS n_rows, count(DISTINCT p_brand) AS n_groups FROM a UNION ALL SELECT 1, count(*), count(DISTINCT p_brand) FROM b UNION ALL SELECT 2, count(*), count(DISTINCT p_brand) FROM r WHERE n <= 4""")
def funnel_stats(spark, sf_dir):
    """Rows and groups left after each stage of a funnel."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    large = sampling.groups_at_least(rows, "p_brand", 5)
    few = sampling.sample_per_group(large, "p_brand", "p_partkey", 4, "f")
    stats = [df.agg(F.count("*").alias("n_rows"), F.countDistinct("p_brand").alias("n_groups")).select(F.lit(k).alias("stage"), "n_rows", "n_groups") for k, df in enumerate((rows, large, few))]
    return stats[0].unionByName(stats[1]).unionByName(stats[2])


@query("alias_keys", """WITH k AS (SELECT n_name AS key, n_nationkey AS id FROM nation), a AS (SELECT 'USA' AS alias, 'UNITED STATES' AS target UNION ALL SELECT 'UK', 'UNITED KINGDOM' UNION ALL SELECT 'CHN', (SELECT min(n_name) FROM nation))
SELECT key, id FROM k UNION ALL SELECT alias, k.id FROM a JOIN k ON a.target = k.key""")
def alias_keys(spark, sf_dir):
    """Further names for keys, where the key exists."""
    keys = read(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("id"))
    fixed = spark.createDataFrame([("USA", "UNITED STATES"), ("UK", "UNITED KINGDOM")], "alias string, target string")
    aliases = fixed.unionByName(keys.agg(F.min("key").alias("target")).select(F.lit("CHN").alias("alias"), "target"))
    return keys.unionByName(aliases.join(keys, F.col("target") == F.col("key")).select(F.col("alias").alias("key"), "id"))


@query("sorted_listing", "SELECT p_partkey, p_type, p_size FROM part ORDER BY p_type, p_size DESC, p_partkey DESC LIMIT 30")
def sorted_listing(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return topk.top_n(rows, [F.col("p_type"), F.desc("p_size"), F.desc("p_partkey")], 30)


@query("nonempty_profile", "SELECT c_mktsegment AS segment, count(*) AS n, sum((c_acctbal < 0)::INT)::BIGINT AS n_negative FROM customer GROUP BY 1")
def nonempty_profile(spark, sf_dir):
    rows = profile.require_columns(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_acctbal"])
    return profile.require_rows(rows).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum((F.col("c_acctbal") < 0).cast("long")).alias("n_negative"))
