"""Paged external services as a Python data source with a pluggable fetcher; nothing here opens a connection itself."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRYABLE = frozenset({429, 500, 502, 503, 504})


def is_retryable(error: BaseException) -> bool:
    """Rate limits, server errors and broken connections; nothing else."""
    status = getattr(error, "status", getattr(error, "code", None))
    return status in RETRYABLE if isinstance(status, int) else isinstance(error, (ConnectionError, TimeoutError))


def with_retries(call: Callable, attempts: int = 6, base: float = 0.5, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """Calls until it works, waiting a random time that doubles; errors that a retry cannot help are raised at once."""
    for k in range(attempts):
        try:
            return call()
        except Exception as error:
            if k + 1 == attempts or not is_retryable(error):
                raise
            sleep(random.uniform(0, min(most, base * 2**k)))


class TokenBucket:
    """A rate limit: `rate` units in `period` seconds, at most `rate` at once. Divide the rate by the number of tasks."""

    def __init__(self, rate: float, period: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.rate, self.period, self.clock = rate, period, clock
        self.level, self.at = rate, clock()

    def _refill(self) -> None:
        now = self.clock()
        self.level = min(self.rate, self.level + (now - self.at) * self.rate / self.period)
        self.at = now

    def wait_for(self, units: float) -> float:
        """Seconds until so many units are there; more than fit never are."""
        self._refill()
        if units > self.rate:
            return float("inf")
        return max(0.0, (units - self.level) * self.period / self.rate)

    def take(self, units: float) -> bool:
        if self.wait_for(units) > 0:
            return False
        self.level -= units
        return True

    def sync(self, remaining: float) -> None:
        """What the service says is left, if that is less."""
        self._refill()
        self.level = min(self.level, remaining)


class RateLimiter:
    """Several buckets at once: all have room, or none is drawn from."""

    def __init__(self, **buckets: TokenBucket):
        self.buckets = buckets

    def take(self, **units: float) -> bool:
        if any(self.buckets[n].wait_for(u) > 0 for n, u in units.items()):
            return False
        for n, u in units.items():
            self.buckets[n].take(u)
        return True

    def wait_for(self, **units: float) -> float:
        return max((self.buckets[n].wait_for(u) for n, u in units.items()), default=0.0)


class PagedSource(DataSource):
    """`format("pages")`: one task for each page number; `fetch(page)` yields rows of the given schema."""

    fetch: Callable[[int], Iterator[tuple]] | None = None
    ddl = "page int, body string"

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return self.options.get("schema", self.ddl)

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(type(self).fetch, int(self.options.get("pages", "1")))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch, pages: int):
        if fetch is None:
            raise ValueError("no fetcher: set one on a subclass of PagedSource")
        self.fetch, self.pages = fetch, pages

    def partitions(self):
        return [InputPartition(k) for k in range(self.pages)]

    def read(self, partition):
        yield from with_retries(lambda: list(self.fetch(partition.value)))
