"""Status of sites as their fetches arrive.

What a log of fetches says about a site is a small fact: its first error, whether the
home page was there, the time of the last fetch.  Facts of parts of a log merge in any
order, and the same part twice changes nothing.  Each task merges the fetches of a
micro-batch before they are shuffled, so a site with a third of all fetches sends a
few rows; the state of a site is its row from before and its fact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.status import HOME_NOT_ACCESSIBLE, fold_status

_FACT = pa.schema([("site_url", pa.string()), ("ts", pa.int64()), ("path", pa.string()), ("error", pa.string()), ("home", pa.bool_()), ("last", pa.int64())])
_FACT_SQL = "site_url string, ts long, path string, error string, home boolean, last long"
_SITE = "site_url string, name string, status string, status_time long, last_error string"
CHANGE = f"{_SITE}, change long"
LOG = "site_url string, path string, code int, error string, ts timestamp"

#: ts, path and text of the first error (no text: none), home page seen, last time
Fact = tuple[int | None, str | None, str | None, bool, int | None]
NOTHING: Fact = (None, None, None, False, None)


def _order(fact: Fact) -> tuple:
    """As Spark orders (ts, path, error): nulls first, text by its bytes."""
    ts, path, error = fact[:3]
    return ts is not None, ts or 0, path is not None, (path or "").encode(), error.encode()


def merge(a: Fact, b: Fact) -> Fact:
    first = min((x for x in (a, b) if x[2] is not None), key=_order, default=a)
    times = [x[4] for x in (a, b) if x[4] is not None]
    return *first[:3], a[3] or b[3], max(times, default=None)


def facts(log: DataFrame) -> DataFrame:
    """A row for each site of each Arrow batch of (site_url, path, code, error, ts)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Fact] = {}
            for site, path, code, error, ts in zip(*(batch[k].to_pylist() for k in range(5)), strict=True):
                mine = (ts, path, error, path == "/" and code == 200, ts) if error is not None else (None, None, None, path == "/" and code == 200, ts)
                found[site] = merge(found.get(site, NOTHING), mine)
            columns = zip(*((site, *fact) for site, fact in found.items()), strict=True) if found else [[]] * len(_FACT)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _FACT, strict=True)], schema=_FACT)

    rows = log.filter("site_url IS NOT NULL").select("site_url", "path", F.col("code").cast("long"), "error", F.unix_micros(F.col("ts").cast("timestamp")))
    return rows.mapInArrow(read, _FACT_SQL)


class SiteStatus(StatefulProcessor):
    """Tells a site's row anew after each micro-batch with fetches of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "name string, status string, status_time long, last_error string")
        self.fact = handle.getValueState("fact", "ts long, path string, error string, home boolean, last long, change long")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: Any) -> None:
        self.before.update((initialState.name, initialState.status, initialState.status_time, initialState.last_error))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if not self.before.exists():
            return  # not one of the sites
        *held, change = self.fact.get() if self.fact.exists() else (*NOTHING, 0)
        fact: Fact = tuple(held)
        for r in rows:
            fact = merge(fact, (r.ts, r.path, r.error, r.home, r.last))
        self.fact.update((*fact, change + 1))
        name, status, at, old = self.before.get()
        error, home, last = fact[2:]
        failed = status == "FAILED"
        news = None if failed else error if error is not None else None if home else HOME_NOT_ACCESSIBLE
        times = [t for t in (at, last) if t is not None]
        yield Row(site_url=key[0], name=name, status="FAILED" if failed or error is not None or not home else "INDEXED", status_time=max(times, default=None), last_error=news or old, change=change + 1)

    def close(self) -> None:
        pass


def status_changes(sites: DataFrame, log: DataFrame) -> DataFrame:
    """A stream of sites' rows, as the fetches of the stream ``log`` (site_url, path,
    code, error, ts) change them; ``change`` numbers those of a site.  ``sites`` is
    the table from before, a row for each site; times are microseconds.  Fetches of
    other sites and without a site change nothing.  The session's state stores must be
    RocksDB's."""
    start = sites.select("site_url", "name", "status", F.unix_micros(F.col("status_time").cast("timestamp")).alias("status_time"), "last_error")
    return facts(log).groupBy("site_url").transformWithState(SiteStatus(), CHANGE, "Append", "None", initialState=start.groupBy("site_url"))


def current_status(sites: DataFrame, changes: DataFrame) -> DataFrame:
    """Sites after all ``changes`` (a table of what the stream told): what
    `fold_status` gives for the whole log.  A site without fetches is judged as by an
    empty log."""
    last = changes.groupBy("site_url").agg(F.max_by(F.struct("name", "status", F.timestamp_micros("status_time").alias("status_time"), "last_error"), "change").alias("now"))
    silent = sites.join(changes.select("site_url").distinct(), "site_url", "left_anti")
    nothing = sites.sparkSession.createDataFrame([], LOG)
    return last.select("site_url", "now.*").unionByName(fold_status(silent, nothing))


def follow(sites: DataFrame, log_folder: str, folder: str, files_at_once: int = 64) -> DataFrame:
    """Take in what is new in a folder of Parquet logs, micro-batch by micro-batch, and
    give the sites' status so far.  ``folder`` keeps checkpoint and changes: called
    again it goes on where it ended."""
    spark = sites.sparkSession
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_at_once).parquet(log_folder)
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, rocks)
    try:
        writer = status_changes(sites, log).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
    return current_status(sites, spark.read.schema(CHANGE).parquet(f"{folder}/changes"))
