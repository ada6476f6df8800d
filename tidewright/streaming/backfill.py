"""Backfill of daily series by a stream: deliveries land as files, a query takes them up, missing days follow from its state.

What has been delivered is kept as Parquet, a folder for each micro-batch under its number, so a batch that is run again
after a failure replaces what it wrote before. Of several values of a key that with the highest order counts, whenever it
arrived. compact() folds all batches up to the last one into a base; a batch that the base has already is not written.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.weather import download_tasks, missing_ranges


@dataclass
class SeriesStore:
    """Rows by key; values: the other columns; order: which of several rows of a key counts (the highest)."""

    spark: SparkSession
    folder: str
    schema: StructType
    keys: tuple[str, ...] = ("point_id", "obs_date")
    order: str = "path_seq"

    def _numbers(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path)]
        done = [n for n in names if n.startswith(f"{kind}-") and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix(f"{kind}-")) for n in done)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _last(self, rows: DataFrame) -> DataFrame:
        values = [f.name for f in self.schema if f.name not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.struct(self.order, *[v for v in values if v != self.order])).alias("_last"))
        return last.select(*self.keys, "_last.*").select(*self.schema.names)

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """Writes one row per key under the batch's number; the same batch again writes the same folder."""
        bases = self._numbers("base")
        if not bases or batch_id > bases[-1]:
            self._last(rows.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id}")

    def _parts(self) -> list[str]:
        bases = self._numbers("base")
        return [f"{self.folder}/base-{n}" for n in bases[-1:]] + [f"{self.folder}/batch-{n}" for n in self._numbers("batch") if not bases or n > bases[-1]]

    def series(self) -> DataFrame:
        """A row per key. Keys are spread by a hash; a batch sends one row per key."""
        return self._last(self._read(self._parts()))

    def compact(self) -> None:
        """Everything up to the last batch becomes one base; older folders go when it is written."""
        batches, bases = self._numbers("batch"), self._numbers("base")
        if not batches or bases and batches[-1] <= bases[-1]:
            return
        self.series().write.mode("overwrite").parquet(f"{self.folder}/base-{batches[-1]}")
        for old in [f"batch-{n}" for n in batches] + [f"base-{n}" for n in bases]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def missing(self, points: DataFrame, start: str, end: str) -> DataFrame:
        """point_id, start_date, end_date of the runs of days without a row."""
        return missing_ranges(points, self.series(), start, end)

    def completeness(self, points: DataFrame, start: str, end: str) -> DataFrame:
        """point_id, n_days, n_held, is_complete for every point."""
        held = self.series().where(F.col("obs_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("point_id").agg(F.count("*").alias("n_held"))
        days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
        out = points.select("point_id").distinct().join(held, "point_id", "left").select("point_id", days.alias("n_days"), F.coalesce("n_held", F.lit(0)).alias("n_held"))
        return out.withColumn("is_complete", F.col("n_held") == F.col("n_days"))


def backfill(deliveries: DataFrame, store: SeriesStore, checkpoint: str, *, sent: str = "sent", delay: str = "30 days") -> StreamingQuery:
    """Takes up all deliveries that have landed, and ends. deliveries: a stream with the store's columns and `sent`.

    A delivery that comes again within the delay is dropped by its key and order before anything is written; one that
    comes later changes nothing either, as the store keeps the highest order.
    """
    fresh = deliveries.withWatermark(sent, delay).dropDuplicatesWithinWatermark([*store.keys, store.order])
    return fresh.writeStream.foreachBatch(lambda rows, batch_id: store.upsert(rows, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fetch_missing(gaps: DataFrame, fetch: Callable[[list, str, str], list], size: int = 25) -> DataFrame:
    """point_id, start_date, end_date, payload: what `fetch` (points, start, end) answers for all gaps (see missing()).

    Requests of at most `size` points with one range each are spread over tasks; an answer has one record per point, in
    their order, as text or as something that JSON can hold. Another number of records fails the query.
    """
    tasks = download_tasks(gaps, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, end, points in zip(batch["start_date"], batch["end_date"], batch["points"], strict=True):
                points = points.tolist() if hasattr(points, "tolist") else list(points)
                answer = fetch(points, str(start), str(end))
                if len(answer) != len(points):
                    raise ValueError(f"{len(answer)} records for {len(points)} points")
                texts = [x if isinstance(x, str) else json.dumps(x) for x in answer]
                yield pd.DataFrame({"point_id": points, "start_date": start, "end_date": end, "payload": texts})

    kind = dict(gaps.dtypes)["point_id"]
    return tasks.repartition("start_date", "end_date", "batch").mapInPandas(run, f"point_id {kind}, start_date date, end_date date, payload string")
