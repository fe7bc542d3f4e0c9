"""A paged JSON interface as a Spark source: a page is a partition, read where its task runs."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.names
        self.url, self.pages = options["url"], int(options["pages"])
        self.tries, self.wait = int(options.get("tries", "3")), float(options.get("wait", "1"))

    def partitions(self) -> list[InputPartition]:
        return [Page(n) for n in range(1, self.pages + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for record in self._fetch(self.url.format(page=partition.number)):
            yield tuple(record.get(n) for n in self.names)

    def _fetch(self, url: str) -> list[dict]:
        """One page; a failed try waits twice as long as the one before, the last failure is raised."""
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(url, timeout=30) as answer:
                    return json.load(answer)
            except OSError:
                if not left:
                    raise
                time.sleep(self.wait * 2 ** (self.tries - 1 - left))
        return []


class Paged(DataSource):
    """Options: ``url`` with ``{page}`` in it, ``pages``, ``tries``, ``wait`` in seconds."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


def paged_json(spark: SparkSession, url: str, pages: int, schema: str, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Records of pages 1 to ``pages`` of a JSON interface whose pages are arrays of objects; fields without a value are null."""
    spark.dataSource.register(Paged)
    return spark.read.format("paged_json").schema(schema).option("url", url).option("pages", pages).option("tries", tries).option("wait", wait).load()
