"""A data source of listing pages: one partition per page address, as a table or a stream.

``spark.read.format("listing_pages").option("url", ...).option("pages", n).load()`` yields
(page_order, url, html).  Any scheme the standard library opens works, so tests and
offline runs read ``file:`` addresses; ``{page}`` in the address is the page number.

A page that does not exist (no such file, or answered by 404 or 410) has no row: the
listing ends there.  Any other failure is tried again (option ``retries``, 2, with ``pause``
seconds, 1, in between) and then fails the task, so a page that could not be read is never
taken for the end.  As a stream (``readStream``) the offset is the last page of a micro-batch,
``step`` pages (default: all) at a time; a batch that fails is read again after a restart,
and a restart with more ``pages`` goes on behind the last committed one.
"""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEADERS = {"User-Agent": "Mozilla/5.0", "Accept": "text/html,application/xhtml+xml"}


class _Page(InputPartition):
    def __init__(self, number: int, url: str):
        self.number, self.url = number, url


class _Pages:
    """The pages that the options name, and how one is read."""

    def __init__(self, options):
        self.template = options["url"]
        self.count = int(options.get("pages", "1"))
        self.timeout = float(options.get("timeout", "60"))
        self.retries, self.pause = int(options.get("retries", "2")), float(options.get("pause", "1"))

    def span(self, first: int, last: int) -> list[_Page]:
        return [_Page(n, self.template.replace("{page}", str(n))) for n in range(first, last + 1)]

    def read(self, partition):
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        for attempt in range(self.retries + 1):
            try:
                with urlopen(Request(partition.url, headers=HEADERS), timeout=self.timeout) as response:
                    body = response.read().decode("utf-8", errors="replace")
                yield (partition.number, partition.url, body)
                return
            except (URLError, OSError) as error:
                if isinstance(error, HTTPError) and error.code in (404, 410) or isinstance(getattr(error, "reason", error), FileNotFoundError):
                    return
                if attempt == self.retries:
                    raise RuntimeError(f"page {partition.number} could not be read: {partition.url}") from error
                time.sleep(self.pause)


class _Reader(_Pages, DataSourceReader):
    def partitions(self):
        return self.span(1, self.count)


class _StreamReader(_Pages, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.step = int(options.get("step", "0")) or self.count
        self.reached = 0

    def initialOffset(self):
        return {"page": 0}

    def latestOffset(self):
        return {"page": min(self.count, self.reached + self.step)}

    def partitions(self, start, end):
        self.reached = max(self.reached, end["page"])
        return self.span(start["page"] + 1, end["page"])

    def commit(self, end):
        self.reached = max(self.reached, end["page"])


class ListingPages(DataSource):
    @classmethod
    def name(cls):
        return "listing_pages"

    def schema(self):
        return "page_order int, url string, html string"

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingPages)
