"""HTTP fetches: a list of urls as a Spark data source
(`spark.read.format("politefetch")`), a table of urls by `fetch_queues`.

Options: `urls` (JSON list of page urls; the data source), `userAgent`, `referrer`,
`timeout` (ms), `pauseMultiplier` and `pauseSummand` (ms; before each fetch the reader
waits rand() * multiplier + summand), `maxBodySize` (0: unlimited).  Urls of one host
are in one task, so a host is never asked twice at the same time (unless Spark is told
to run tasks twice by `spark.speculation`).
"""

from __future__ import annotations

import heapq
import json
import random
import time
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tables import FETCHES


class PoliteFetch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "politefetch"

    def schema(self) -> str:
        return FETCHES

    def reader(self, schema) -> PoliteReader:
        return PoliteReader(dict(self.options))


class Fetcher:
    """Fetches pages one by one as the options say."""

    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.headers = {"User-Agent": low.get("useragent", "tarnwell"), "Referer": low.get("referrer", "")}
        self.timeout = int(low.get("timeout", 120_000)) / 1000
        self.multiplier, self.summand = float(low.get("pausemultiplier", 15_000)), float(low.get("pausesummand", 1_000))
        self.most = int(low.get("maxbodysize", 0))

    def pause(self) -> float:
        """Seconds to wait before a fetch."""
        return (random.random() * self.multiplier + self.summand) / 1000

    def fetch(self, url: str) -> tuple[int | None, str | None, str | None, str | None, datetime]:
        """Code, content type, body, error, time.  A bad status is a code, not an error."""
        return *self._ask(url), datetime.now(timezone.utc)

    def _ask(self, url: str) -> tuple[int | None, str | None, str | None, str | None]:
        try:
            with urlopen(Request(url, headers=self.headers), timeout=self.timeout) as answer:
                body = answer.read(self.most) if self.most else answer.read()
                charset = answer.headers.get_content_charset() or "utf-8"
                return answer.status, answer.headers.get("Content-Type"), body.decode(charset, "replace"), None
        except HTTPError as e:
            return e.code, None, "", None
        except Exception as e:  # noqa: BLE001  any failure is the site's error text
            return None, None, None, str(e)

    def in_turns(self, queues: dict[str, deque]) -> Iterator[tuple]:
        """(entry, fetch) of all entries (url, ...) of the hosts' queues: the host that
        may be asked first comes first, so the pauses of different hosts pass together."""
        due = [(time.monotonic() + self.pause(), host) for host in queues]
        heapq.heapify(due)
        while due:
            at, host = heapq.heappop(due)
            time.sleep(max(0.0, at - time.monotonic()))
            entry = queues[host].popleft()
            yield entry, self.fetch(entry[0])
            if queues[host]:
                heapq.heappush(due, (time.monotonic() + self.pause(), host))


class PoliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = json.loads({k.lower(): v for k, v in options.items()}["urls"])
        self.fetcher = Fetcher(options)

    def partitions(self) -> list[InputPartition]:
        sites: dict[str, list[str]] = {}
        for url in self.urls:
            sites.setdefault(urlsplit(url).netloc, []).append(url)
        return [InputPartition(x) for x in sites.values()]

    def read(self, partition: InputPartition):
        for url in partition.value:
            time.sleep(self.fetcher.pause())
            yield (url, *self.fetcher.fetch(url))


def fetch(spark, urls: list[str], **options: str):
    """Fetch the urls now; a DataFrame of the fetches schema."""
    spark.dataSource.register(PoliteFetch)
    return spark.read.format("politefetch").option("urls", json.dumps(urls)).options(**options).load()


_FETCHED = pa.schema([("page_url", pa.string()), ("code", pa.int32()), ("content_type", pa.string()), ("body", pa.string()), ("error", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("tries", pa.int32())])
_ROWS, _BYTES = 256, 4 << 20


def fetch_queues(queue: DataFrame, tasks: int, **options: str) -> DataFrame:
    """Fetches, with ``tries``, of the urls of ``queue`` (host, page_url, tries).  A
    task holds the urls of its hosts; pages leave it a few megabytes at a time."""
    fetcher = Fetcher(options)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues: dict[str, deque] = {}
        for batch in batches:
            for host, url, tries in zip(*(batch[name].to_pylist() for name in ("host", "page_url", "tries")), strict=True):
                queues.setdefault(host, deque()).append((url, tries))
        rows, size = [], 0
        for (url, tries), answer in fetcher.in_turns(queues):
            rows.append((url, *answer, tries))
            size += len(answer[2] or "")
            if len(rows) == _ROWS or size > _BYTES:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FETCHED, strict=True)], schema=_FETCHED)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FETCHED, strict=True)], schema=_FETCHED)

    # a number of partitions that is asked for stays: urls are few bytes, and small partitions would be put together
    return queue.repartition(tasks, "host").mapInArrow(read, f"{FETCHES}, tries int")
