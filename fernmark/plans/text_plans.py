"""Free text, pages and fields: search, extraction, clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from fernmark.functions import text
from fernmark.plans.registry import query, read


@query("token_search", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a')) AND (contains(lower(p_name), 'e') OR contains(lower(p_type), 'e'))")
def token_search(spark, sf_dir):
    return read(spark, sf_dir, "part").where(text.matches_all_tokens("a e", [F.col("p_name"), F.col("p_type")])).select("p_partkey", "p_name")


@query("browse_filter", """WITH t AS (SELECT p_partkey, string_split(lower(p_type || ' ' || p_brand), ' ') AS tokens FROM part)
SELECT p_partkey FROM t WHERE (len(list_filter(tokens, lambda x: starts_with(x, 'eco'))) > 0 AND len(list_filter(tokens, lambda x: starts_with(x, 'br'))) > 0) OR len(list_filter(tokens, lambda x: starts_with(x, 'pro'))) > 0""")
def browse_filter(spark, sf_dir):
    tokens = F.split(F.lower(F.concat_ws(" ", "p_type", "p_brand")), " ")
    return read(spark, sf_dir, "part").where(text.browse_matches("eco br/pro", tokens)).select("p_partkey")


@query("word_match", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\b(licensed|the)\b')")
def word_match(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(text.has_word(F.col("text"), ["licensed", "the"])).select("doc_id")


@query("page_fields", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href="[^"]*"'))::INT AS n_links, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def page_fields(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit('<a [^>]*href="[^"]*"'), F.lit(0))).alias("n_links"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
    )


_STRIP = "regexp_replace(html, '<[^>]+>', '', 'g')"
for _entity, _char in text.ENTITIES.items():
    _STRIP = f"replace({_STRIP}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
_STRIP = rf"trim(regexp_replace({_STRIP}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query("html_strip", f"SELECT page_id, md5({_STRIP}) AS text_md5, length({_STRIP})::INT AS n FROM pages")
def html_strip(spark, sf_dir):
    stripped = text.strip_html(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(stripped.cast("binary")).alias("text_md5"), F.length(stripped).alias("n"))


@query("name_fields", """SELECT c_custkey, lower(replace(c_name, '#', '')) AS name, 'xc:' || c_custkey AS source_id, split_part(c_name, '#', 1) AS kind, CAST(split_part(c_name, '#', 2) AS BIGINT) AS key FROM customer""")
def name_fields(spark, sf_dir):
    parts = F.split("c_name", "#")
    return read(spark, sf_dir, "customer").select(
        "c_custkey", text.normal_query(F.replace("c_name", F.lit("#"), F.lit(""))).alias("name"), text.source_id("xc", F.col("c_custkey")).alias("source_id"), parts[0].alias("kind"), parts[1].cast("long").alias("key")
    )


@query("json_fields", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type || '/' || coalesce(json_extract_string(props, '$.k'), '?') AS label FROM events""")
def json_fields(spark, sf_dir):
    props = F.from_json("props", "k string")
    return read(spark, sf_dir, "events").select("event_id", props["k"].cast("int").alias("k"), F.concat_ws("/", "event_type", F.coalesce(props["k"], F.lit("?"))).alias("label"))


@query("date_fields", """SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, strftime(o_orderdate, '%m-%d') AS month_day, hour(o_orderdate)::INT AS hour FROM orders""")
def date_fields(spark, sf_dir):
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("year"), F.month(d).alias("month"), F.date_format(d, "MM-dd").alias("month_day"), text.hour_of(F.date_format(d, "HH:mm")).alias("hour"))


@query("repaired_dates", """WITH d AS (SELECT event_id, strftime(ts, '%Y') || CASE event_id % 3 WHEN 0 THEN '-00-00' WHEN 1 THEN strftime(ts, '-%m-00') ELSE '-13-40' END AS raw FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE replace(raw, '-00', '-01') END AS day FROM d""")
def repaired_dates(spark, sf_dir):
    ts = F.col("ts")
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("-00-00")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "-MM-'00'")).otherwise(F.lit("-13-40"))
    return read(spark, sf_dir, "events").select("event_id", text.repaired_date(F.concat(F.date_format(ts, "yyyy"), raw)).cast("string").alias("day"))


@query("place_fields", """SELECT c_custkey, 'st' || c_nationkey AS state_only, c_mktsegment || ', area' AS place_only, 'st' || c_nationkey || ', land' AS state, c_mktsegment || ', area, st' || c_nationkey || ', land' AS place FROM customer""")
def place_fields(spark, sf_dir):
    locality = F.concat("c_mktsegment", F.lit(", area, st"), F.col("c_nationkey").cast("string"))
    parts = text.place_parts(locality, F.lit("land"))
    return read(spark, sf_dir, "customer").select("c_custkey", *[parts[c].alias(c) for c in ("state_only", "place_only", "state", "place")])


@query("document_stats", r"""SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, sum(len(string_split(text, chr(10))))::BIGINT AS lines, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY lang""")
def document_stats(spark, sf_dir):
    lines = F.size(F.split("text", "\n"))
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.sum(lines).alias("lines"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("texts"))


@query("first_turns", """WITH r AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) SELECT conv_id, role, n::INT AS n FROM r WHERE place = 1""")
def first_turns(spark, sf_dir):
    found = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(F.struct("role", F.length("text").alias("n")), "turn").alias("r"))
    return found.select("conv_id", "r.role", "r.n")
