"""Streams: event windows, rolling alerts, seen-set dedup, the information-gain stop."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import telemetry
from ..sources.scratch import own_dir


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


def run_once(stream: DataFrame, write, mode: str = "append") -> None:
    """Read all there is in batches, with a checkpoint in the shared folder, and stop.

    ``write`` gets each batch and its number and must be able to run a batch
    again: a restart after a lost driver repeats the last one.
    """
    place = f"{own_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def failure_windows(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Failures in tumbling windows of event time, late rows up to ``late`` behind."""
    hits = events.where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return hits.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("failures")).select(F.col("w.start").alias("start"), "failures")


def distinct_keys(events: DataFrame, key: str) -> DataFrame:
    """Rows with a key not seen before, by keyed state; bound the state with a watermark on endless streams."""
    return events.dropDuplicates([key])


class RollingAlerts:
    """Alert rates over the last n events; the events kept are a table of n rows."""

    def __init__(self, spark: SparkSession, n: int = telemetry.WINDOW):
        self.spark, self.n = spark, n
        self.path = f"{own_dir(spark)}/window-{uuid.uuid4().hex}"
        self.batch = None

    def write(self, batch: DataFrame, number: int) -> None:
        """Merge a batch into the table of the batch before; writing again gives the same table."""
        rows = batch
        before = number - 1
        if before >= 0 and self.batch is not None:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.path}/{before}"))
        telemetry.last_events(rows.dropDuplicates(["event_id"]), self.n).write.mode("overwrite").parquet(f"{self.path}/{number}")
        self.batch = number

    def snapshot(self) -> DataFrame:
        return telemetry.alert_snapshot(self.spark.read.parquet(f"{self.path}/{self.batch}"), self.n)


GAIN_OUT = "site long, stop_ord int"
GAIN_STATE = "n int, seen array<string>, recent array<int>, stop int"


def info_gain_stops(log: DataFrame, window: int = 3, threshold: float = 0.05, min_pages: int = 4) -> DataFrame:
    """(site, stop_ord) once a site's crawl stops gaining information; a site's rows must come in order.

    A site's state is its distinct signals, which its page budget bounds.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, seen, recent, stop = state.get if state.exists else (0, [], [], None)
        seen, recent = set(seen), list(recent)
        out = []
        for row in pd.concat(list(frames)).sort_values("ord").itertuples():
            n += 1
            if row.fetch_status == "success":
                recent = [*recent, int(row.signal not in seen)][-window:]
                seen.add(row.signal)
            if stop is None and n >= min_pages and len(recent) == window and sum(recent) / max(1, len(seen)) < threshold:
                stop = int(row.ord)
                out.append((key[0], stop))
        state.update((n, sorted(seen), recent, stop))
        yield pd.DataFrame(out, columns=["site", "stop_ord"])

    return log.groupBy("site").applyInPandasWithState(step, GAIN_OUT, GAIN_STATE, "append", "NoTimeout")
