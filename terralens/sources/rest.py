"""Paged REST tables as Python data sources.

Where the number of rows is known (option ``total``) each page is a partition of
its own; else the pages follow one another in one task, since only the last page
tells that it is the last.

``spark.dataSource.register(OffsetPages)`` and then
``spark.read.format("offset_pages").option("url", ...).load()``. The fetch function
can be replaced, which is how tests run without a network.
"""

from __future__ import annotations

import json
import time
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, timeout: int = 60):
    with urlopen(url, timeout=timeout) as r:  # noqa: S310
        return json.loads(r.read())


def offset_page(get, url: str, page: int, at: int) -> list[dict]:
    return get(f"{url}?{urlencode({'$limit': page, '$offset': at})}")


def offset_pages(get, url: str, page: int = 5000, pause: float = 0.3):
    """Rows of a table paged by $limit and $offset. Empty rows are dropped; a page
    that arrives short, before that, is the last."""
    at = 0
    while True:
        rows = offset_page(get, url, page, at)
        yield from (r for r in rows if r)
        if len(rows) < page:
            return
        at += page
        time.sleep(pause)


def feature_page(get, url: str, fields: str, page: int, at: int) -> tuple[list[dict], bool]:
    """(attributes of the features from an offset on, whether rows were held back)"""
    query = {"where": "1=1", "outFields": fields, "returnGeometry": "false", "resultOffset": at, "resultRecordCount": page, "f": "json"}
    got = get(f"{url}/query?{urlencode(query)}")
    return [f.get("attributes", {}) for f in got.get("features", [])], bool(got.get("exceededTransferLimit"))


def feature_pages(get, url: str, fields: str = "*", page: int = 1000, pause: float = 0.3):
    """Attributes of a feature service paged by resultOffset, until the service no
    longer says that it held rows back."""
    at = 0
    while True:
        rows, more = feature_page(get, url, fields, page, at)
        yield from rows
        if not more or not rows:
            return
        at += len(rows)
        time.sleep(pause)


def feature_part(get, url: str, fields: str, page: int, at: int, pause: float = 0.3):
    """Attributes of the ``page`` features from an offset on, in as many requests as a
    service with a lower limit of its own needs."""
    end = at + page
    while at < end:
        rows, more = feature_page(get, url, fields, end - at, at)
        yield from rows
        if not more or not rows:
            return
        at += len(rows)
        if at < end:
            time.sleep(pause)


class Page(InputPartition):
    def __init__(self, at: int):
        self.at = at


class _Pages(DataSourceReader):
    """``rows(options)`` reads all pages, ``one(options, offset)`` those of a single one."""

    def __init__(self, options, schema, rows, one, size):
        self.options, self.schema, self.rows, self.one, self.size = options, schema, rows, one, size

    def partitions(self):
        total = self.options.get("total")
        return [Page(-1)] if total is None else [Page(at) for at in range(0, int(total), self.size)] or [Page(-1)]

    def read(self, partition):
        names = [f.name for f in self.schema.fields]
        for r in self.rows(self.options) if partition.at < 0 else self.one(self.options, partition.at):
            if not r:
                continue
            yield tuple(None if r.get(n) is None else str(r[n]) for n in names)


class OffsetPages(DataSource):
    """Table paged by offset; the schema (of strings) is given by the reader's schema()."""

    @classmethod
    def name(cls):
        return "offset_pages"

    def reader(self, schema):
        get, size = self.fetch, int(self.options.get("page", 5000))
        return _Pages(self.options, schema, lambda o: offset_pages(get, o["url"], size, float(o.get("pause", 0.3))), lambda o, at: offset_page(get, o["url"], size, at), size)

    fetch = staticmethod(fetch)


class FeaturePages(DataSource):
    """Feature service paged by result offset."""

    @classmethod
    def name(cls):
        return "feature_pages"

    def reader(self, schema):
        get, size = self.fetch, int(self.options.get("page", 1000))
        fields = self.options.get("fields", "*")
        return _Pages(self.options, schema, lambda o: feature_pages(get, o["url"], fields, size, float(o.get("pause", 0.3))), lambda o, at: feature_part(get, o["url"], fields, size, at, float(o.get("pause", 0.3))), size)

    fetch = staticmethod(fetch)
