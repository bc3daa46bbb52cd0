"""Holds as a Structured Streaming query: state per host, updated by refusals in the order they come."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import holds
from corpusloom.plans import derive as D


def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["secs", "req_id"])
    new = holds.fold(state.get if state.exists else None, zip(rows["secs"], rows["kind"], rows["retry_after"]))
    state.update(new)
    yield pd.DataFrame([(key[0], *new)], columns=["host", "n", "since", "until", "pace"])


def stream(events: DataFrame) -> DataFrame:
    """The latest hold of each host, emitted whenever it changes."""
    return events.groupBy("host").applyInPandasWithState(update, holds.SCHEMA, "n long, since long, until long, pace double", "update", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the query over the events there are and return the latest hold of each host. What each batch emits is kept in a
    table in the checkpoint folder; a host that changes in several batches has a row of each, the one of most refusals last."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", "events.parquet"), sf_dir
    events = reader.parquet(path)
    attempts = D.attempt(spark, sf_dir, source=events)
    at = f"{D.checkpoints(spark)}/holds-{uuid.uuid4().hex}"
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")  # noqa: E731  (a batch that is run again replaces itself)
    q = stream(holds.throttles(attempts)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(holds.SCHEMA).parquet(f"{at}/rows")
    return rows.groupBy("host").agg(F.max_by(F.struct("n", "since", "until", "pace"), "n").alias("s")).select("host", "s.*")
