"""What micro-batches are observed to do, as rows."""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Observed(StreamingQueryListener):
    """Keeps what df.observe(name, ...) says of each micro-batch: a few numbers a batch, of at most `most` batches.

    A listener: it is told after each batch, beside the query, which it can't hold up or fail.
    """

    def __init__(self, name: str, most: int = 10_000):
        self.name, self.most, self.rows, self._lock = name, most, [], threading.Lock()
        self.ended: set[str] = set()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        got = event.progress.observedMetrics.get(self.name)
        if got is not None and event.progress.numInputRows:
            with self._lock:
                self.rows = [*self.rows, {"batch": event.progress.batchId, **got.asDict()}][-self.most :]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.add(str(event.id))


def observed(stream: DataFrame, name: str, metrics: dict[str, Column], seconds: int = 600) -> DataFrame:
    """Runs a stream over all that is there and gives a row for each micro-batch: batch, and the metrics (aggregates, as longs)."""
    spark: SparkSession = stream.sparkSession
    from ..scratch import folder

    told = Observed(name)
    spark.streams.addListener(told)
    try:
        watched = stream.observe(name, *(c.cast("long").alias(n) for n, c in metrics.items()))
        q = watched.writeStream.format("noop").option("checkpointLocation", folder(spark)).trigger(availableNow=True).start()
        if not q.awaitTermination(seconds):
            q.stop()
            raise TimeoutError(f"the stream took more than {seconds} seconds")
        until = time.time() + 30
        while str(q.id) not in told.ended and time.time() < until:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(told)
    schema = ", ".join(["batch long", *(f"`{n}` long" for n in metrics)])
    return spark.createDataFrame([tuple(r[c] for c in ("batch", *metrics)) for r in told.rows], schema)
