"""Paged, newest-first services as a Spark data source: a partition a channel, early stop at the channel's watermark.

    spark.dataSource.register(PagedRecords)
    spark.read.format("paged_records").option("fetch", "package.module:function").option("channels", "a,b").load()

``fetch(channel, page)`` returns the rows of a page, newest first, as dicts with ``id`` and ``time`` (whole seconds); an empty
page ends the channel. A read takes rows newer than ``since`` (JSON of channel to time) and stops at the first page that has
none. As a stream the offset is the newest time of every channel, so Spark commits the watermarks with its checkpoint, after what was
read has been written; a failed batch reads the same rows again.

Defined results: rows without an id or a time are left out; a channel that has no rows keeps its watermark; rows of one
channel and id are told as often as they are listed (see ``lifecycle.merge_channels`` for one row an item).
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "channel string, id string, time bigint, place int, payload string"


class Channel(InputPartition):
    """One channel's rows newer than ``since`` and up to ``until``."""

    def __init__(self, name: str, since: int, until: int | None = None):
        self.name, self.since, self.until = name, since, until


def _function(path: str) -> Callable[[str, int], list[dict]]:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class _Paged:
    def __init__(self, options: dict):
        self.fetch = options["fetch"]
        self.channels = [c.strip() for c in options["channels"].split(",") if c.strip()]
        self.since = {k: int(v) for k, v in json.loads(options.get("since", "{}")).items()}
        self.most_pages = int(options.get("mostpages", options.get("mostPages", 1000)))

    def rows(self, part: Channel) -> Iterator[tuple]:
        fetch, place = _function(self.fetch), 0
        for page in range(self.most_pages):
            rows = [r for r in fetch(part.name, page) if r.get("id") is not None and r.get("time") is not None]
            new = [r for r in rows if int(r["time"]) > part.since]
            for r in new:
                if part.until is None or int(r["time"]) <= part.until:
                    yield part.name, str(r["id"]), int(r["time"]), place, json.dumps(r, ensure_ascii=False, sort_keys=True)
                place += 1
            if not rows or len(new) < len(rows):  # the first row that is not newer: all after it are older
                return


class PagedReader(_Paged, DataSourceReader):
    def partitions(self) -> list[Channel]:
        return [Channel(c, self.since.get(c, -1)) for c in self.channels]

    def read(self, partition: Channel) -> Iterator[tuple]:
        return self.rows(partition)


class PagedStream(_Paged, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {c: self.since.get(c, -1) for c in self.channels}

    def latestOffset(self, *_) -> dict:
        fetch, found = _function(self.fetch), {}
        for c in self.channels:
            times = [int(r["time"]) for r in fetch(c, 0) if r.get("id") is not None and r.get("time") is not None]
            found[c] = max(times, default=self.since.get(c, -1))
        return found

    def partitions(self, start: dict, end: dict) -> list[Channel]:
        return [Channel(c, start.get(c, -1), end[c]) for c in self.channels if end[c] > start.get(c, -1)]

    def read(self, partition: Channel) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """The offsets are Spark's; a service that must be told can be told here."""


class PagedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)
