"""[S11 S12 S13 T07] Paged service connectors as a Python data source with an injected transport.

A transport is ``package.module:function`` taking (url, params) and returning the body; tests name one that replays files.
One input partition is one page.  Retries, pauses and quotas live here, outside the query engine.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import random
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def transport(name: str) -> Callable[[str, dict], str]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Throttled(Exception):
    """A service asks for a pause; ``after`` is what it asks for, in seconds, if anything."""

    def __init__(self, after: float | None = None):
        super().__init__("throttled")
        self.after = after


def pause(attempt: int, after: float | None, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: what is asked for up to two minutes, else doubling from two with jitter."""
    return min(after, 120.0) if after is not None else 2.0 * 2**attempt + jitter()


def patiently(call: Callable[[], str], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(attempts):
        try:
            return call()
        except Throttled as e:
            if attempt == attempts - 1:
                raise
            sleep(pause(attempt, e.after))
    raise AssertionError("no attempt")


class DailyQuota:
    """So many calls a day; the count lives with whoever owns the object."""

    def __init__(self, most: int = 100):
        self.most, self.day, self.used = most, None, 0

    def take(self, day: str) -> None:
        if day != self.day:
            self.day, self.used = day, 0
        self.used += 1
        if self.used > self.most:
            raise RuntimeError(f"more than {self.most} calls on {day}")


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PagedSource(DataSource):
    """``spark.read.format("paged")`` with options url, transport, records (key of the list), page_size, max_pages, cache, day.

    Every record is one row (page, place, raw_json).  With a cache folder on shared storage a page fetched that day is read
    from there.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, place int, raw_json string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [Page(i) for i in range(int(self.options.get("max_pages", 1)))]

    def read(self, page: Page) -> Iterator[tuple]:
        o = self.options
        params = {"page": page.number, "size": int(o.get("page_size", 100))}
        key = hashlib.sha256(json.dumps([o["url"], params], sort_keys=True).encode()).hexdigest()[:24]
        cached = Path(o["cache"], o.get("day", "any"), f"{key}.json") if "cache" in o else None
        if cached and cached.exists():
            body = cached.read_text()
        else:
            body = patiently(lambda: transport(o["transport"])(o["url"], params))
            if cached:
                cached.parent.mkdir(parents=True, exist_ok=True)
                cached.write_text(body)
        doc = json.loads(body)
        records = doc if isinstance(doc, list) else next((doc[k] for k in o.get("records", "results").split(",") if doc.get(k)), [])
        for i, r in enumerate(records):
            yield page.number, i, json.dumps(r)
