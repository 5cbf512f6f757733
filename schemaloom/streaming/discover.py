"""Discovery over streams: each micro-batch is a partial property table, and tables merge.

Every fact is a commutative aggregate, so a running schema is the union of the schemas of the batches seen. State is the
size of a schema, not of the data. It is written beside the stream's checkpoint after every batch, in two places by turns,
so that a crash while one is written leaves the other; a driver that starts again goes on from there.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from schemaloom.model import ZERO, Node, merge
from schemaloom.params import Params
from schemaloom.plans.discover import discover_schema
from schemaloom.streaming import state


class StreamingSchema:
    """The schema of all documents of a stream so far. Batches that are run again after a failure change nothing.

    Its state lies in the folder ``schema_state`` of the checkpoint, as rows (batch, schema).
    """

    def __init__(self, params: Params = Params(), on_change: Callable[[Node], None] | None = None):
        self.params, self.on_change = params, on_change
        self.schema: Node = ZERO
        self.last = -1  #: the last batch that the schema holds
        self.folder: str | None = None
        self._lock = threading.Lock()

    def restore(self, spark: SparkSession) -> None:
        for turn in (0, 1):
            try:
                r = spark.read.schema("batch long, schema string").parquet(f"{self.folder}/{turn}").first()
            except AnalysisException:  # never written
                continue
            if r and r.batch > self.last:
                self.last, self.schema = r.batch, state.from_text(r.schema)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        with self._lock:
            if batch_id <= self.last:
                return
            found = discover_schema(batch, self.params)
            whole = merge(self.schema, found, "union", self.params.relation)
            if self.folder:
                row = batch.sparkSession.createDataFrame([(batch_id, state.to_text(whole))], "batch long, schema string")
                row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{batch_id % 2}")
            self.schema, self.last = whole, batch_id
        if self.on_change:
            self.on_change(self.schema)

    def start(self, docs: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """docs: a streaming DataFrame (doc_id, json). The checkpoint must be a folder that outlives the driver."""
        self.folder = f"{checkpoint.rstrip('/')}/schema_state"
        self.restore(docs.sparkSession)
        writer = docs.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def key_counts(docs: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Presence of top-level keys per window of event time, with a watermark for late documents: (start, key, documents)."""
    keys = F.explode(F.json_object_keys("json")).alias("key")
    return docs.withWatermark(time, late).select(F.col(time), keys).groupBy(F.window(time, window).alias("w"), "key").agg(F.count("*").alias("documents")).select(F.col("w.start").alias("start"), "key", "documents")
