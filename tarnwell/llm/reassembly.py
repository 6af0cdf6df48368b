"""Conversation turn reassembly (operator 13): transformWithState by conversation.

Turns of a conversation arrive in numbered batches, out of order and repeated.  A batch
is written with the smallest payload of each of its turns: all rows of a turn meet by
(conv_id, turn, batch), so a hot conversation is rid of its copies in as many tasks as
it has turns.  The sequencer's key is the conversation: it keeps the earliest payload of
a turn, releases the gapless run of kept turns from ``first`` on, closes a conversation
after ``idle`` batches without any of its arrivals, and rejects whatever arrives after
that.  A turn is a repeat if it lies before the next one to release or is among those
kept, so one state store a partition and start is enough.

The sequencer's state is a row of counts and, in pages of 64 turns, the payloads
kept but not yet released; a batch reads and writes only the pages that it touches,
and holds at most HELD of them.
The number of missing turns and of repeated roles is counted as turns come.

Each batch is one start of the streaming query on one checkpoint, and one more is
the end.  A row's event time is its batch number plus 1 in seconds and every batch
carries a marker row, so the watermark moves by a batch also where nothing arrives;
conversations close by event-time timers.  The file sink and the state are committed by micro-batch, so a
batch that is cut short is done again whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import move, shared_folder

N_BATCHES = 12
IDLE = 3
PAGE = 64
HELD = 4096

ARRIVAL = "conv_id long, turn long, first long, batch long, role string, payload string, ts timestamp"
EVENT = "event string, conv_id long, turn long, batch long, payload string, n_missing long, n_breaks long"
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # timers fire in the micro-batch of the next batch's rows, after those
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # every start has stores of its own: close them with their tasks, and no files larger than what is in them
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # all state stores of an executor share one bound on memory
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


class Sequencer(StatefulProcessor):
    """Releases, closes and rejects the turns of a conversation."""

    def __init__(self, n_batches: int, idle: int):
        self.n_batches, self.idle, self.most = n_batches, idle, HELD

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # next: the turn to release; role: of the turn before it, if released; last: batch of the last arrival
        self.counts = handle.getValueState("counts", "first long, next long, role string, largest long, kept long, breaks long, pending long, last long, closed boolean")
        self.pages = handle.getMapState("pages", "page long", "turns string")

    def _page(self, pages: dict[int, dict[int, list[str]]], number: int, stored: bool) -> dict[int, list[str]]:
        """turn -> [role, payload] of a page, read at its first use."""
        if number not in pages:
            found = stored and self.pages.containsKey((number,))
            pages[number] = {turn: rest for turn, *rest in json.loads(self.pages.getValue((number,))[0])} if found else {}
        return pages[number]

    def _put(self, pages: dict[int, dict[int, list[str]]], touched: set[int], stored: bool) -> None:
        """Write the touched pages and hold none."""
        for number in touched:
            if pages[number]:
                self.pages.updateValue((number,), (json.dumps([[t, *x] for t, x in sorted(pages[number].items())], ensure_ascii=False),))
            elif stored and self.pages.containsKey((number,)):
                self.pages.removeKey((number,))
        pages.clear()
        touched.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        conv = key[0]
        state = self.counts.get() if self.counts.exists() else None
        if state is not None and state[8]:
            for r in rows:
                if r.turn is not None:
                    yield Row(event="reject", conv_id=conv, turn=r.turn, batch=r.batch, payload=r.payload, n_missing=None, n_breaks=None)
            return
        pages: dict[int, dict[int, list[str]]] = {}
        touched: set[int] = set()
        batch = None
        if state is not None:
            first, following, role, largest, kept, breaks, pending, last, _ = state
            stored = pending > 0
        held = lambda turn: self._page(pages, turn // PAGE, stored).get(turn)
        for r in rows:
            if r.turn is None:
                continue  # the marker
            if state is None and batch is None:
                first, following, role, largest, kept, breaks, pending, last = r.first, r.first, None, r.first, 0, 0, 0, None
                stored = False
            batch = r.batch
            if r.turn < following or held(r.turn) is not None:
                continue  # a repeat
            before = role if r.turn == following and r.turn > first else (held(r.turn - 1) or [None])[0]
            after = (held(r.turn + 1) or [None])[0]
            breaks += (before == r.role) + (after == r.role)
            self._page(pages, r.turn // PAGE, stored)[r.turn] = [r.role, r.payload]
            touched.add(r.turn // PAGE)
            kept, pending, largest = kept + 1, pending + 1, max(largest, r.turn)
            if len(pages) > self.most:
                self._put(pages, touched, stored)
                stored = True
        if batch is None:
            return
        while pending and (found := held(following)) is not None:
            yield Row(event="release", conv_id=conv, turn=following, batch=batch, payload=found[1], n_missing=None, n_breaks=None)
            del pages[following // PAGE][following]
            touched.add(following // PAGE)
            role, following, pending = found[0], following + 1, pending - 1
            if len(pages) > self.most:
                self._put(pages, touched, stored)
                stored = True
        self._put(pages, touched, stored)
        if last is None:
            self._wait(batch)
        self.counts.update((first, following, role, largest, kept, breaks, pending, batch, False))

    def _wait(self, last: int) -> None:
        """A timer that fires in the batch ``idle`` after ``last``, or at the end:
        then the watermark stands at the batch before that one."""
        self.handle.registerTimer(self._due(last))

    def _due(self, last: int) -> int:
        return (last + self.idle) * 1000 - 500

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        first, following, role, largest, kept, breaks, pending, last, closed = self.counts.get()
        if closed:
            return
        if timerValues.getCurrentWatermarkInMs() < self._due(last):
            self._wait(last)  # there were arrivals since
            return
        turns = sorted(t[0] for _, page in self.pages.iterator() for t in json.loads(page[0])) if pending else []
        yield Row(event="close", conv_id=key[0], turn=-1, batch=min(last + self.idle, self.n_batches), payload=",".join(map(str, turns)), n_missing=largest - first + 1 - kept, n_breaks=breaks)
        self.pages.clear()
        self.counts.update((first, following, role, largest, kept, breaks, 0, last, True))

    def close(self) -> None:
        pass


def _start(spark: SparkSession, folder: str, n_batches: int, idle: int) -> None:
    """One start of the query: takes in what is new in the folder and ends."""
    arrivals = spark.readStream.schema(ARRIVAL).parquet(f"{folder}/in/*").withWatermark("ts", "0 seconds")
    events = arrivals.groupBy("conv_id").transformWithState(Sequencer(n_batches, idle), EVENT, "Append", "EventTime")
    query = events.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def reassemble(arrivals: DataFrame, n_batches: int = N_BATCHES, idle: int = IDLE) -> DataFrame:
    """Events of a stream of turns: event (release, reject, close), conv_id, turn (-1
    for close), batch, payload (for close the kept turns not released, ascending and
    comma-joined), n_missing and n_breaks (for close).

    ``arrivals`` has conv_id, turn, batch (0 to n_batches - 1), role and payload;
    other columns are not read.  Rows without turn or batch are dropped; a null role or
    payload is empty; rows without conv_id are one conversation with a null id.  Of
    equal payloads with different roles the smaller role is kept.  Repeated rows are
    one arrival.  No rows give no events.  The folder, with input, checkpoint and
    events, is a new one at every call and goes when the application ends.
    """
    spark = arrivals.sparkSession
    folder = shared_folder(spark, "reassembly")
    rows = arrivals.filter("turn IS NOT NULL AND batch IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("batch").cast("long").alias("batch"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("payload", F.lit("")).alias("payload"))
    smallest = rows.groupBy("conv_id", "turn", "batch").agg(F.min(F.struct("payload", "role")).alias("least"))
    first = rows.groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").alias("first"))
    rows = smallest.select("conv_id", "turn", "batch", "least.role", "least.payload").join(first, F.col("conv_id").eqNullSafe(F.col("id"))).drop("id")
    # the last batch's marker moves the watermark past all timers, so they fire at the end
    marker = spark.range(n_batches + 1).select(F.col("id").alias("batch"))
    after = F.when(F.col("turn").isNull() & (F.col("batch") == n_batches - 1), n_batches + idle).otherwise(F.col("batch"))
    rows = rows.unionByName(marker, allowMissingColumns=True).withColumn("ts", F.timestamp_seconds(after + 1))
    rows.withColumn("part", F.col("batch")).write.partitionBy("part").parquet(f"{folder}/batches")
    before = {k: spark.conf.get(k, None) for k in _CONF}
    try:
        for k, v in _CONF.items():
            spark.conf.set(k, v)
        for batch in range(n_batches + 1):
            move(spark, f"{folder}/batches/part={batch}", f"{folder}/in/{batch}")
            _start(spark, folder, n_batches, idle)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(EVENT).parquet(f"{folder}/out")


def op13_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` in 12 batches, with repeats; payloads as digests."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("turn IS NOT NULL")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    text = F.coalesce("text", F.lit(""))
    once = F.struct((h % 12).alias("batch"), F.coalesce("role", F.lit("")).alias("role"))
    again = F.struct(((h + 3) % 12).alias("batch"), F.lit("user").alias("role"))
    rows = rows.select("conv_id", "turn", text.alias("text"), F.explode(F.when(h % 7 < 2, F.array(once, again)).otherwise(F.array(once))).alias("x"))
    events = reassemble(rows.select("conv_id", "turn", "x.batch", "x.role", F.concat("x.role", F.lit("|"), "text").alias("payload")))
    return events.select("event", "conv_id", "turn", "batch", F.sha2("payload", 256).alias("sha256"), "n_missing", "n_breaks")
