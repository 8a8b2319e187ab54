"""A Spark data source of fetched pages: ``spark.read.format("tessera_pages")``.

Options: ``url`` with ``{page}`` in it (and ``{since}``, if given), ``pages``, ``first`` (0 or 1), ``since``, ``limit`` of
items, ``items`` (the field that lists them), ``per_second`` and ``burst`` of the token bucket, and ``stop``, a path
whose existence cancels the read. Rows: (page, body). Pages are read one after the other in one task, since a later
page is asked for only while items are missing; a page without items ends the read, a refused or malformed one fails it.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from tessera.sources import limits


def fetch(url: str) -> tuple[int, dict[str, str], str]:
    try:
        with urllib.request.urlopen(url, timeout=30) as answer:
            return getattr(answer, "status", None) or 200, {k.lower(): v for k, v in answer.headers.items()}, answer.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, ""


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple[int, str]]:
        o = self.options
        bucket = limits.TokenBucket(float(o.get("burst", 60)), float(o.get("per_second", 60 / 3600)))
        stopped = lambda: "stop" in o and Path(o["stop"]).exists()
        first, left = int(o.get("first", 1)), int(o.get("limit", 1 << 62))
        for page in range(first, first + int(o.get("pages", 1))):
            url = o["url"].format(page=page, since=o.get("since", ""))
            status, _, body = limits.polite(lambda: fetch(url), bucket, stopped)
            if status != 200:
                raise OSError(f"page {page}: status {status}")
            field = o.get("items", "items")
            content = json.loads(body)
            found = content[field][:left]
            if not found:
                return
            left -= len(found)
            yield page, json.dumps(content | {field: found})
            if not left:
                return


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_pages"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
