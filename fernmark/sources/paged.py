"""A paged JSON service as a source that pages itself, in batches and as a stream.

A page is an object with "recordings" and "numPages". A batch read asks page one how
many pages there are, and then each page is a partition. A stream's offset is a page
and a row in it: a page that was short when it was read goes on from there, so
nothing is lost or read twice when the service grows.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "id string, gen string, sp string, q string"


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def fetch(url: str, number: int) -> dict:
    """One page; ``url`` has {page}."""
    with urllib.request.urlopen(url.replace("{page}", str(number))) as f:
        return json.load(f)


def _rows(page: dict, names: list[str], first: int = 0) -> Iterator[tuple]:
    for row in page.get("recordings", [])[first:]:
        yield tuple(None if row.get(n) is None else str(row[n]) for n in names)


class PagesReader(DataSourceReader):
    def __init__(self, names: list[str], url: str):
        self.names, self.url = names, url

    def partitions(self) -> list[Page]:
        """As many as page one says; one page for a service that doesn't say."""
        return [Page(k) for k in range(1, max(1, int(fetch(self.url, 1).get("numPages", 1))) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return _rows(fetch(self.url, partition.number), self.names)


class PagesStreamReader(SimpleDataSourceStreamReader):
    def __init__(self, names: list[str], url: str):
        self.names, self.url = names, url

    def initialOffset(self) -> dict:  # noqa: N802  as pyspark names it
        return {"page": 1, "row": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """What a page has from a row on; the next offset is the next page if there is one, else further down this one."""
        page = fetch(self.url, start["page"])
        rows = list(_rows(page, self.names, start["row"]))
        if start["page"] < int(page.get("numPages", 1)):
            return iter(rows), {"page": start["page"] + 1, "row": 0}
        return iter(rows), {"page": start["page"], "row": start["row"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The same rows again, after a restart."""
        at = dict(start)
        while at != end:
            page = fetch(self.url, at["page"])
            if at["page"] < end["page"]:
                yield from _rows(page, self.names, at["row"])
                at = {"page": at["page"] + 1, "row": 0}
            else:
                yield from list(_rows(page, self.names, at["row"]))[: end["row"] - at["row"]]
                at = dict(end)


class PagedService(DataSource):
    """Format "paged_service": load(url with {page})."""

    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagesReader:
        return PagesReader(schema.fieldNames(), self.options["path"])

    def simpleStreamReader(self, schema: StructType) -> PagesStreamReader:  # noqa: N802
        return PagesStreamReader(schema.fieldNames(), self.options["path"])


def pages(spark: SparkSession, url: str, schema: str = SCHEMA) -> DataFrame:
    """All rows of a paged service; values are strings."""
    spark.dataSource.register(PagedService)
    return spark.read.format("paged_service").schema(schema).load(url)


def page_stream(spark: SparkSession, url: str, schema: str = SCHEMA) -> DataFrame:
    """A page for each micro-batch, then what is added."""
    spark.dataSource.register(PagedService)
    return spark.readStream.format("paged_service").schema(schema).load(url)
