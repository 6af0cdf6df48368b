"""Keep an index up to date from a stream of fetches.

Each micro-batch is an upsert of its pages.  A page keeps the time of its fetch,
and an older fetch that a later batch brings changes nothing; of equal times the
later batch wins.  A batch that is replayed after a failure puts the same pages in
again and changes nothing, which makes the sink idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources.tables import FETCHES


def fetch_stream(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """Fetches from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(FETCHES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def keep_index(engine: Engine, fetches: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the updates; ``once`` takes what is there and ends."""
    writer = fetches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: engine.apply_fetches(batch) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
