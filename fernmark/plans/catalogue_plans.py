"""Catalogue algebra: lookups, audits, samples, duplicates, totals. Orders and parts stand for recordings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernmark.functions import intervals
from fernmark.operators import dedup, evals, lookup, profile, sampling, search
from fernmark.plans.registry import query, read


@query("recs_for_group", "SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS n_segment FROM customer")
def recs_for_group(spark, sf_dir):
    return lookup.group_counts(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "n_segment")


@query("dim_lookup", """SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dim_lookup(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    return c.join(F.broadcast(places), c.c_nationkey == places.n_nationkey, "left").select("c_custkey", "n_name", "r_name")


@query("left_joins_with_defaults", """WITH o AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey), f AS (SELECT o_custkey, count(*) AS n_done FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_done, 0) AS n_done FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN f ON c_custkey = f.o_custkey""")
def left_joins_with_defaults(spark, sf_dir):
    """Both aggregates hash on the customer, so the joins reuse their partitioning."""
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    n = orders.groupBy("c_custkey").agg(F.count("*").alias("n_orders"))
    done = orders.where("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.count("*").alias("n_done"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").join(done, "c_custkey", "left").fillna(0)


@query("unmatched_keys", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unmatched_keys(spark, sf_dir):
    """Documents without a label."""
    return lookup.audit(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")["left_only"]


@query("full_outer_audit", """WITH a AS (SELECT DISTINCT floor(o_totalprice / 1000)::BIGINT AS k FROM orders), b AS (SELECT DISTINCT floor(s_acctbal / 100)::BIGINT AS k FROM supplier)
SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_orders, b.k IS NOT NULL AS in_suppliers FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_audit(spark, sf_dir):
    """Classes of two tables' amounts: those that either side lacks, and the common ones."""
    a = read(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 1000).alias("k")).distinct().withColumn("a", F.lit(True))
    b = read(spark, sf_dir, "supplier").select(F.floor(F.col("s_acctbal") / 100).alias("k")).distinct().withColumn("b", F.lit(True))
    return lookup.audit(a, b, "k")["both"].select("k", F.coalesce("a", F.lit(False)).alias("in_orders"), F.coalesce("b", F.lit(False)).alias("in_suppliers"))


@query("missing_ids", "WITH r AS (SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM labels))) AS k) SELECT k AS doc_id FROM r WHERE k NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, sf_dir):
    """Every id up to the last one that no label has."""
    return dedup.missing_ids(read(spark, sf_dir, "labels"), "doc_id")


@query("cascade_lookup", """SELECT p_partkey, coalesce(n1.n_name, n2.n_name, n3.n_name, '_UNK') AS n_name FROM part
LEFT JOIN nation n1 ON p_size = n1.n_nationkey AND n1.n_nationkey < 5 LEFT JOIN nation n2 ON p_size - 10 = n2.n_nationkey AND n2.n_nationkey < 10 LEFT JOIN nation n3 ON p_size - 20 = n3.n_nationkey""")
def cascade_lookup(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("k1"), (F.col("p_size") - 10).alias("k2"), (F.col("p_size") - 20).alias("k3"))
    tables = [(n.where("n_nationkey < 5"), "k1", "n_nationkey"), (n.where("n_nationkey < 10"), "k2", "n_nationkey"), (n, "k3", "n_nationkey")]
    return lookup.cascade(parts, tables, "n_name", "_UNK").select("p_partkey", "n_name")


@query("priority_lookup", """WITH e AS (SELECT p_partkey AS id, 0 AS rank, lower(replace(p_name, '''', '')) AS key FROM part UNION ALL SELECT p_partkey, 1, lower(p_type) FROM part UNION ALL SELECT p_partkey, 2, lower(p_brand) FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, id DESC) AS n FROM e WHERE key <> '') SELECT key, id FROM k WHERE n = 1""")
def priority_lookup(spark, sf_dir):
    return lookup.key_table(read(spark, sf_dir, "part"), ["p_name", "p_type", "p_brand"], "p_partkey", "p_partkey")


@query("latest_per_key", """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id, event_type FROM r WHERE n = 1""")
def latest_per_key(spark, sf_dir):
    return dedup.latest(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("keep_first", """WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_type, event_id FROM r WHERE n = 1""")
def keep_first(spark, sf_dir):
    return dedup.keep_one(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("first_seen_order", """WITH f AS (SELECT event_type, min(event_id) AS first_position FROM events GROUP BY event_type) SELECT event_type, first_position, (row_number() OVER (ORDER BY first_position, event_type) - 1)::INT AS seen_order FROM f""")
def first_seen_order(spark, sf_dir):
    return dedup.first_seen(read(spark, sf_dir, "events"), "event_type", "event_id")


@query("group_share", "SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderpriority")
def group_share(spark, sf_dir):
    return profile.shares(read(spark, sf_dir, "orders"), "o_orderpriority").withColumn("share", F.round("share", 6))


@query("rollup_totals", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_totals(spark, sf_dir):
    return profile.with_totals(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("total", F.round("total", 2))


@query("cube_totals", """SELECT coalesce(c_mktsegment, '*') AS c_mktsegment, coalesce(c_nationkey, -1) AS c_nationkey, round(sum(c_acctbal), 2) AS total, count(*) AS n, grouping_id(c_mktsegment, c_nationkey)::INT AS level FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""")
def cube_totals(spark, sf_dir):
    return profile.with_totals(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal", cube=True).withColumn("total", F.round("total", 2)).fillna({"c_mktsegment": "*", "c_nationkey": -1})


@query("groups_at_least", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 70")
def groups_at_least(spark, sf_dir):
    rows = sampling.groups_at_least(read(spark, sf_dir, "events").select("user_id"), "user_id", 70)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


@query("sample_rows", "SELECT event_id, event_type FROM events ORDER BY md5(event_id::VARCHAR || 's'), event_id LIMIT 50")
def sample_rows(spark, sf_dir):
    return sampling.sample_rows(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 50, "s")


@query("sample_n_groups", """WITH g AS (SELECT DISTINCT p_brand FROM part), c AS (SELECT p_brand FROM g ORDER BY md5(p_brand || 's'), p_brand LIMIT 4) SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM c)""")
def sample_n_groups(spark, sf_dir):
    return sampling.sample_groups(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 4, "s")


@query("sample_n_per_group", """WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR || 's'), p_partkey) AS n FROM part) SELECT p_partkey, p_brand FROM r WHERE n <= 3""")
def sample_n_per_group(spark, sf_dir):
    return sampling.sample_per_group(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 3, "s")


@query("funnel_sampling", """WITH b AS (SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 5)), g AS (SELECT DISTINCT p_brand FROM b),
c AS (SELECT p_brand FROM g ORDER BY md5(p_brand || 'f'), p_brand LIMIT 6), r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR || 'f'), p_partkey) AS n FROM b WHERE p_brand IN (SELECT p_brand FROM c))
SELECT p_partkey, p_brand FROM r WHERE n <= 4""")
def funnel_sampling(spark, sf_dir):
    return sampling.funnel(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", least=5, n_groups=6, per_group=4, seed="f")


@query("stratified_split", """WITH r AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS size, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR || 't'), vec_id) AS n FROM embeddings)
SELECT vec_id, label, size >= 2 AND n <= ceil(size * 0.2) AS is_test FROM r""")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.2, "t")


@query("sample_by_checklist", """SELECT user_id, count(*) AS n FROM events WHERE ('0x' || substr(md5(user_id::VARCHAR || 'c'), 1, 8))::BIGINT % 100 < 20 GROUP BY user_id""")
def sample_by_checklist(spark, sf_dir):
    return sampling.sample_share(read(spark, sf_dir, "events"), "user_id", 20, "c").groupBy("user_id").agg(F.count("*").alias("n"))


@query("exclude_with_override", """SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') OR p_type IN (SELECT min(p_type) FROM part)""")
def exclude_with_override(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    spared = parts.agg(F.min("p_type").alias("spared"))
    chosen = search.Filters(exclude_groups=["Brand#11", "Brand#12"]).condition(species="p_type", group="p_brand")
    return parts.crossJoin(F.broadcast(spared)).where(chosen | (F.col("p_type") == F.col("spared"))).drop("spared")


@query("filtered_head", """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey DESC LIMIT 20""")
def filtered_head(spark, sf_dir):
    keep = search.Filters(quality=["1-URGENT", "2-HIGH"], species=["O"]).condition(quality="o_orderpriority", species="o_orderstatus")
    return read(spark, sf_dir, "orders").where(keep).select("o_orderkey", "o_orderstatus", "o_orderpriority").orderBy(F.desc("o_orderkey")).limit(20)


@query("distinct_values", "SELECT DISTINCT p_type FROM part WHERE p_size > 40")
def distinct_values(spark, sf_dir):
    return read(spark, sf_dir, "part").where("p_size > 40").select("p_type").distinct()


@query("day_sections", """WITH n AS (SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts DESC, event_id DESC)::INT AS at FROM n""")
def day_sections(spark, sf_dir):
    found = profile.day_sections(read(spark, sf_dir, "events").select("event_id", "ts"), "ts", ["event_id"], 100)
    return found.select("event_id", F.col("day").cast("string").alias("day"), "at")


@query("recent_merged", """WITH u AS (SELECT event_id, ts, 'click' AS source FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, ts, 'view' FROM events WHERE event_type = 'view') SELECT event_id, source FROM u ORDER BY ts DESC, event_id DESC LIMIT 30""")
def recent_merged(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    parts = [e.where(F.col("event_type") == k).select("event_id", "ts", F.lit(k).alias("source")) for k in ("click", "view")]
    return dedup.concat_aligned(parts).orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "source")


@query("place_set_algebra", """WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(kinds, ['extra']))), ',') AS with_extra, array_to_string(list_filter(kinds, lambda k: k NOT IN ('click', 'view')), ',') AS without FROM s""")
def place_set_algebra(spark, sf_dir):
    kinds = read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    extra, gone = F.array(F.lit("extra")), F.array(F.lit("click"), F.lit("view"))
    return kinds.select("user_id", F.array_join(F.array_sort(F.array_union("kinds", extra)), ",").alias("with_extra"), F.array_join(F.array_except("kinds", gone), ",").alias("without"))


@query("profile_columns", """SELECT 'event_type' AS "column", 'string' AS kind, count(*) AS n, count(*) - count(event_type) AS n_null, count(DISTINCT event_type) AS n_distinct FROM events UNION ALL
SELECT 'user_id', 'bigint', count(*), count(*) - count(user_id), count(DISTINCT user_id) FROM events""")
def profile_columns(spark, sf_dir):
    return profile.summary(read(spark, sf_dir, "events").select("event_type", "user_id"))


@query("value_counts_exprs", """WITH v AS (SELECT 'size' AS name, (p_size // 10 * 10)::VARCHAR AS value FROM part UNION ALL SELECT 'brand', p_brand FROM part), c AS (SELECT name, value, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value NULLS LAST) AS rank FROM c) SELECT name, value, n, rank::INT AS rank FROM r WHERE rank <= 5""")
def value_counts_exprs(spark, sf_dir):
    return profile.value_counts(read(spark, sf_dir, "part"), {"size": "floor(p_size / 10) * 10", "brand": "p_brand"}, 5)


@query("zero_filled_grid", """WITH a AS (SELECT DISTINCT c_mktsegment FROM customer), b AS (SELECT DISTINCT c_nationkey FROM customer), c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY ALL)
SELECT a.c_mktsegment, b.c_nationkey, coalesce(n, 0) AS n FROM a CROSS JOIN b LEFT JOIN c ON a.c_mktsegment = c.c_mktsegment AND b.c_nationkey = c.c_nationkey""")
def zero_filled_grid(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumn("n", (F.col("c_acctbal") > 9000).cast("long"))
    return profile.zero_filled(rows, "c_mktsegment", "c_nationkey", "n")


@query("range_then_sum", """WITH r AS (SELECT l_returnflag, l_linestatus, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(sum(spread), 2) AS spread FROM r GROUP BY l_returnflag""")
def range_then_sum(spark, sf_dir):
    inner = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg((F.max("l_quantity") - F.min("l_quantity")).alias("spread"))
    return inner.groupBy("l_returnflag").agg(F.round(F.sum("spread"), 2).alias("spread"))


@query("cumulative_share", """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, n, round(sum(n) OVER (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS upto FROM c""")
def cumulative_share(spark, sf_dir):
    counts = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    upto = F.sum("n").over(everything.orderBy(F.desc("n"), "p_brand").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(everything)
    return counts.withColumn("upto", F.round(upto, 6))


@query("median_order", "SELECT l_shipyear, median_price FROM (SELECT year(l_shipdate)::INT AS l_shipyear, round(median(l_extendedprice), 4) AS median_price FROM lineitem GROUP BY 1) ORDER BY median_price, l_shipyear LIMIT 5")
def median_order(spark, sf_dir):
    years = read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("l_shipyear"), "l_extendedprice")
    found = evals.exact_quantiles(years, ["l_shipyear"], "l_extendedprice", {"median_price": 0.5})
    return found.withColumn("median_price", F.round("median_price", 4)).orderBy("median_price", "l_shipyear").limit(5)


@query("interval_algebra", """WITH i AS (SELECT p_partkey, p_size * 1.0 AS lo, p_size + p_partkey % 7 * 1.0 AS hi FROM part) SELECT p_partkey, 25 BETWEEN lo AND hi AS has25, lo <= 30 AND 20 <= hi AS overlaps, CASE WHEN lo <= 30 AND 20 <= hi THEN least(hi, 30) - greatest(lo, 20) END::DOUBLE AS shared,
(greatest(hi, 30) - least(lo, 20))::DOUBLE AS hull FROM i""")
def interval_algebra(spark, sf_dir):
    a = intervals.interval(F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 7)
    b = intervals.interval(F.lit(20), F.lit(30))
    both, hull = intervals.intersection(a, b), intervals.hull(a, b)
    return read(spark, sf_dir, "part").select("p_partkey", intervals.contains(a, F.lit(25.0)).alias("has25"), intervals.overlaps(a, b).alias("overlaps"), (both["hi"] - both["lo"]).alias("shared"), (hull["hi"] - hull["lo"]).alias("hull"))
