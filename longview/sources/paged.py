"""A service that answers in pages, as a source for batches and streams that goes on where it stopped.

A transport (`count()`, and `page(offset, size)` as a list of tuples) is given, since there is no network here. Each page is a
partition, fetched by the task that reads it, again after a growing pause where it fails; a page that fails for good fails its task, which
Spark tries again. A stream's offset is the number of the next id, so a restart from a checkpoint fetches what is missing and nothing that was written;
a batch takes all pages that are there by then.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Ids of a page, tries of a page, and the first pause in seconds, doubled each time.
PAGE, TRIES, PAUSE = 150, 5, 0.05


class Transport(Protocol):
    def count(self) -> int: ...

    def page(self, offset: int, size: int) -> list[tuple]: ...


class _Page(InputPartition):
    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


def again(call: Callable[[], list[tuple]], tries: int, pause: float) -> list[tuple]:
    """What call gives, tried up to tries times."""
    for turn in range(tries):
        try:
            return call()
        except OSError:  # what transports raise: refused, timed out, broken off
            if turn + 1 == tries:
                raise
            time.sleep(pause * 2**turn)
    raise ValueError("tries must be 1 or more")


def _pages(start: int, end: int, size: int) -> list[_Page]:
    return [_Page(at, min(size, end - at)) for at in range(start, end, size)]


class _Reading:
    def __init__(self, transport: Transport, options: dict):
        self.transport = transport
        self.size, self.tries = int(options.get("page", PAGE)), int(options.get("tries", TRIES))
        self.pause = float(options.get("pause", PAUSE))

    def read(self, page: _Page | None) -> Iterator[tuple]:
        if page is not None:  # a service without ids has no page
            yield from again(lambda: self.transport.page(page.offset, page.size), self.tries, self.pause)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[_Page]:
        return _pages(0, self.transport.count(), self.size)


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": self.transport.count()}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return _pages(start["next"], end["next"], self.size)


def paged_source(name: str, schema: str, transport: Transport) -> type[DataSource]:
    """A data source of that name, for `spark.dataSource.register`. Options: page, tries, pause."""
    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _Batch(transport, self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(transport, self.options)

    return Paged
