"""An extension: the review log read as a stream, with the current state and counts kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.review import latest
from ..schemas import REVIEW_EVENTS


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(REVIEW_EVENTS).parquet(folder)


def status_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Events by window of time, status and ``by``; in a stream, events later than the watermark are left out, and windows are put out when closed."""
    return (
        events.withWatermark("event_ts", late)
        .groupBy(F.window("event_ts", window).alias("w"), "status", *by)
        .agg(F.count("*").alias("events"))
        .select(*by, F.col("w.start").alias("window_start"), "status", "events")
    )


def keep_current(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Folds each batch into the last row of each (node, scope), written as a new version of the table."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = latest(batch, ["node_identity", "scope"], ["event_ts", "event_seq"])
        if batch_id:
            before = spark.read.schema(last.schema).parquet(f"{target}/v{batch_id - 1}")
            last = latest(before.unionByName(last), ["node_identity", "scope"], ["event_ts", "event_seq"])
        last.write.mode("overwrite").parquet(f"{target}/v{batch_id}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a key's state holds: the place of its last event in the log.
_STATE = "event_ts timestamp, event_seq long"


def changed_reviews(events: DataFrame) -> DataFrame:
    """The events that become the last of their node and scope, as a stream of updates: keyed state holds the last place of each key,

    so the work of a batch is in proportion to its events, and an event that comes late or again changes nothing.
    """
    keys, columns = ["node_identity", "scope"], events.columns

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, found = (state.get if state.exists else None), None
        for pdf in batches:
            # nulls in a batch, so no sort by frame: one row is looked for
            for row in pdf.itertuples(index=False):
                place = (row.event_ts.to_pydatetime(), int(row.event_seq))
                if last is None or place > (last[0], last[1]):
                    last, found = place, row
        if found is not None:
            state.update(last)
            yield pd.DataFrame([found], columns=pdf.columns)[columns]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return events.groupBy(*keys).applyInPandasWithState(fold, schema, _STATE, "update", GroupStateTimeout.NoTimeout)


def keep_changes(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's changes to a folder of its own; a batch that is run again writes the same folder again. ``current_changes`` reads them."""
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
    changes = changed_reviews(events)
    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_changes(spark: SparkSession, target: str) -> DataFrame:
    """The last event of each node and scope from the changes of all batches, a row or so for each key and batch that it was in."""
    return latest(spark.read.schema(REVIEW_EVENTS).parquet(f"{target}/batch=*"), ["node_identity", "scope"], ["event_ts", "event_seq"])
