"""Readers of the catalogue's formats. Schemas are stated, so no reader scans twice to infer one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def csv(spark: SparkSession, path: str, schema: str, *, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV or TSV with a header and a stated schema; gzip by extension."""
    return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).schema(schema).csv(path)


def csv_columns(spark: SparkSession, path: str, columns: Sequence[str], *, sep: str = "\t") -> DataFrame:
    """Some columns of a file with a header, in snake case, as text: wide files are parsed for these only."""
    from fernmark.functions.text import snake_case

    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return raw.select(*[F.col(f"`{c}`").alias(snake_case(c)) for c in columns])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and time of files, without their content: it is pruned from the scan."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def fixed_width(spark: SparkSession, path: str, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """Columns divided by two spaces or more, after a header line; with ``key``, rows of one key must agree."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parts = F.split(F.trim("value"), r"\s{2,}")
    rows = lines.select(*[F.try_element_at(parts, F.lit(k + 1)).alias(c) for k, c in enumerate(columns)])
    rows = rows.where(F.col(columns[0]) != columns[0]).distinct()
    if key:
        several = rows.groupBy(key).count().where("count > 1").limit(5).collect()
        if several:
            raise ValueError(f"rows that disagree: {[r[key] for r in several]}")
    return rows


def multi_label(spark: SparkSession, path: str) -> DataFrame:
    """"id,label,label" lines after a header: id and an array of labels; "?" is null, a bare id no labels."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\d+"))
    parts = F.split("value", ",", 2)
    labels = F.try_element_at(parts, F.lit(2))
    made = F.when(labels == "?", F.lit(None)).when(labels.isNull() | (labels == ""), F.array().cast("array<int>")).otherwise(F.split(labels, ",").cast("array<int>"))
    return lines.select(parts[0].cast("long").alias("id"), made.alias("labels"))


def xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of an XML file with Spark's reader; columns in snake case."""
    from fernmark.functions.text import snake_case

    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return df.toDF(*map(snake_case, df.columns))


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Fields of recording pages: number, name and scientific name of the title, remarks, and the table of keys."""
    title = F.regexp_extract(html, r'property="og:title" content="([^"]*)"', 1)
    description = F.regexp_extract(html, r'property="og:description" content="([^"]*)"', 1)
    lines = F.split(description, r"\n")
    keyed = F.filter(lines, lambda s: s.rlike(r"^(bird-seen|playback-used):"))
    pattern = F.lit(r"<tr>\s*<td>([^<]*)</td>\s*<td>([^<]*)</td>\s*</tr>")
    pairs = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("v"))
    name = r"^XC(\d+) (.*) \(([^()]*)\)$"
    return pages.withColumns({
        "id": F.regexp_extract(title, name, 1).try_cast("long"), "com_name": F.regexp_extract(title, name, 2), "sci_name": F.regexp_extract(title, name, 3),
        "remarks": F.trim(F.array_join(F.array_except(lines, keyed), "\n")),
        "flags": F.map_from_entries(F.transform(keyed, lambda s: F.struct(F.substring_index(s, ":", 1), F.trim(F.substring_index(s, ":", -1))))),
        "fields": F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.lower(F.trim(p["k"])), F.trim(p["v"])))),
    })


def catalogue(raw: DataFrame) -> DataFrame:
    """Normalises raw catalogue rows: names, numbers, dates, licence, quality."""
    from fernmark.functions import text

    kind, detail = text.license_parts(F.col("lic"))
    quality = F.when(F.col("q").isin(list("ABCDE")), F.col("q")).otherwise("no score")
    return raw.select(
        F.col("id").try_cast("long").alias("id"), F.concat_ws(" ", "gen", "sp").alias("sci_name"), F.col("ssp").alias("subspecies"), F.col("en").alias("com_name"), F.col("rec").alias("recordist"),
        F.col("cnt").alias("country"), F.col("loc").alias("locality"), F.col("lat").try_cast("double").alias("lat"), F.col("lng").try_cast("double").alias("lng"), "type", quality.alias("quality"),
        F.array_position(F.array(*map(F.lit, [*"ABCDE", "no score"])), quality).cast("int").alias("quality_ord"), text.repaired_date(F.col("date")).alias("date"),
        F.when(F.col("time") != "?", F.col("time")).alias("time"), text.hour_of(F.col("time")).alias("hour"), kind.alias("license_type"), detail.alias("license_detail"), "url", F.col("file").alias("download"),
    )


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _PagesReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.options = schema.fieldNames(), options

    def partitions(self):
        return [_Page(k) for k in range(1, int(self.options.get("pages", "1")) + 1)]

    def read(self, partition):
        import json
        import urllib.request

        with urllib.request.urlopen(self.options["path"].replace("{page}", str(partition.number))) as f:
            for row in json.load(f)["recordings"]:
                yield tuple(row.get(n) for n in self.names)


class PagedJson(DataSource):
    """Pages of a JSON service, one partition each: format "paged_json", options path (with {page}) and pages."""

    @classmethod
    def name(cls):
        return "paged_json"

    def schema(self):
        return "id string, gen string, sp string, q string"

    def reader(self, schema):
        return _PagesReader(schema, self.options)


def paged_json(spark: SparkSession, url: str, pages: int) -> DataFrame:
    """Rows of a paged service; ``url`` has {page}."""
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").option("pages", pages).load(url)


def snapshots(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Catalogue snapshots in files; the newest file's row of each key wins."""
    from fernmark.operators.dedup import latest

    rows = spark.read.schema(schema).json(path).withColumn("_file", F.col("_metadata.file_path"))
    return latest(rows, [key], "_file").drop("_file")


def tag_json(version: Column, species: Column, quality: Column, edits: Column) -> Column:
    """What ``tag_metadata`` reads."""
    return F.to_json(F.struct(version.alias("version"), species.alias("species"), quality.alias("quality"), edits.alias("edits")))


def tag_metadata(tags: str = "tags") -> Column:
    """Versioned JSON in a file's tags, as a struct with defaults for what is missing."""
    parsed = F.from_json(tags, "version int, species string, quality string, edits array<struct<clips: array<struct<time: struct<lo: double, hi: double>, gain: double>>>>")
    return F.struct(F.coalesce(parsed["version"], F.lit(0)).alias("version"), F.coalesce(parsed["species"], F.lit("_UNK")).alias("species"), F.coalesce(parsed["quality"], F.lit("no score")).alias("quality"), parsed["edits"].alias("edits"))

