"""Paged listings as a Spark data source: cursors are followed inside tasks, and a listing that makes no progress ends.

A listing is a function fetch(cursor) that returns (items, next cursor); the first cursor is "", and None or "" ends it. `paged` makes a data source of it, to be registered with
spark.dataSource.register. Option `ranges` is a JSON list of [from, to] cursors: each is a partition of its own, so a listing whose cursors can be cut is read by many tasks. A range ends before its `to`. What
a service does wrong ends a range too: a cursor that it gave before, or a page without items.

As a stream, every page is one step of the offset, so that a restart goes on behind the last page committed; pages are read again by their cursors after a failure. At the end of the listing the
cursor stays, and what comes there later is read from it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

Fetch = Callable[[str], tuple[list[tuple], str | None]]
#: Pages of a stream that one step takes at most.
STEP = 10


class Range(InputPartition):
    """Cursors from one on, up to another one if that is named."""

    def __init__(self, start: str, stop: str | None):
        self.start, self.stop = start, stop


def followed(fetch: Fetch, start: str = "", stop: str | None = None) -> Iterator[list[tuple]]:
    """The pages from a cursor on, until the listing or the range ends or makes no progress."""
    seen, cursor = set(), start
    while cursor not in seen:
        seen.add(cursor)
        items, following = fetch(cursor)
        if not items:
            return
        yield items
        if not following or following == stop:
            return
        cursor = following


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, ranges: list[list[str | None]]):
        self.fetch, self.ranges = fetch, ranges

    def partitions(self) -> list[Range]:
        return [Range(start or "", stop) for start, stop in self.ranges]

    def read(self, partition: Range) -> Iterator[tuple]:
        for items in followed(self.fetch, partition.start, partition.stop):
            yield from items


class PagedStream(SimpleDataSourceStreamReader):
    """Offsets are the cursor of the next page, and how many of its items have been read: a last page can grow."""

    def __init__(self, fetch: Fetch):
        self.fetch = fetch

    def initialOffset(self) -> dict:
        return {"cursor": "", "taken": 0}

    def _step(self, start: dict) -> tuple[list[tuple], dict]:
        cursor, taken, out, seen = start["cursor"], start["taken"], [], set()
        for _ in range(STEP):
            seen.add(cursor)
            items, following = self.fetch(cursor)
            out += items[taken:]
            taken = max(taken, len(items))
            if not following or following in seen:
                break
            cursor, taken = following, 0
        return out, {"cursor": cursor, "taken": taken}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        items, end = self._step(start)
        return iter(items), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The items of a step that is repeated: from the start up to the offset where it ended."""
        cursor, taken, seen = start["cursor"], start["taken"], set()
        while cursor not in seen:
            seen.add(cursor)
            items, following = self.fetch(cursor)
            last = cursor == end["cursor"]
            yield from items[taken : end["taken"] if last else None]
            if last or not following:
                return
            cursor, taken = following, 0

    def commit(self, end: dict) -> None:
        pass


def paged(named: str, fetch: Fetch, schema: str) -> type[DataSource]:
    """A data source of that name over fetch, which goes to the tasks with it."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return named

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> PagedReader:
            return PagedReader(fetch, json.loads(self.options.get("ranges", '[["", null]]')))

        def simpleStreamReader(self, schema) -> PagedStream:
            return PagedStream(fetch)

    return Paged
