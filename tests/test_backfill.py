"""The backfill: batches that are run again, deliveries that come again, what is missing."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StructType

from tidewright.streaming.backfill import SeriesStore, backfill, fetch_missing

SCHEMA = StructType().add("point_id", LongType()).add("obs_date", DateType()).add("value", DoubleType()).add("path_seq", LongType())
DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return SeriesStore(spark, f"file://{tmp_path}/state", SCHEMA)


def test_batches_again_change_nothing(spark, store):
    assert table(store.series()) == []
    first = spark.createDataFrame([(1, day(0), 1.0, 1), (1, day(1), 2.0, 1), (1, day(1), 2.5, 2), (2, day(0), None, 1)], SCHEMA)
    second = spark.createDataFrame([(1, day(0), 9.0, 0), (1, day(2), 3.0, 3), (2, day(0), 5.0, 4)], SCHEMA)
    want = [(1, day(0), 1.0, 1), (1, day(1), 2.5, 2), (1, day(2), 3.0, 3), (2, day(0), 5.0, 4)]
    for rows, n in ((first, 0), (second, 1), (second, 1), (first, 0)):
        store.upsert(rows, n)
    assert table(store.series()) == want
    store.compact()
    store.compact()
    assert store._numbers("base") == [1] and store._numbers("batch") == []
    store.upsert(first, 0)  # part of the base
    assert store._numbers("batch") == [] and table(store.series()) == want
    store.upsert(spark.createDataFrame([(1, day(0), 7.0, 5)], SCHEMA), 2)
    assert table(store.series())[0] == (1, day(0), 7.0, 5)


def test_stream(spark, store, tmp_path):
    rows = [(p, day(i), float(p * i), 1, datetime.datetime(2024, 3, 1)) for p in (1, 2, 3) for i in range(10) if (p, i) != (2, 4)]
    schema = "point_id bigint, obs_date date, value double, path_seq bigint, sent timestamp"
    landed = f"file://{tmp_path}/landed"

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)
        query = backfill(stream, store, f"file://{tmp_path}/checkpoint")
        query.awaitTermination()
        return query

    deliver(rows[:12])
    run()
    deliver(rows[8:])
    deliver(rows[:5])
    run()
    want = sorted(r[:4] for r in rows)
    assert table(store.series()) == want
    points = spark.createDataFrame([(1,), (2,), (4,)], "point_id bigint")
    gaps = store.missing(points, str(day(0)), str(day(9)))
    assert table(gaps) == [(2, day(4), day(4)), (4, day(0), day(9))]
    assert table(store.completeness(points, str(day(0)), str(day(9)))) == [(1, 10, 10, True), (2, 10, 9, False), (4, 10, 0, False)]
    # what is missing is fetched, delivered and then no longer missing
    got = fetch_missing(gaps, lambda points, start, end: [{"value": 1.5, "point": p} for p in points], size=1)
    days = got.select("point_id", F.explode(F.sequence("start_date", "end_date")).alias("obs_date"), F.get_json_object("payload", "$.value").cast("double").alias("value"), F.lit(2).cast("long").alias("path_seq"), F.lit("2024-03-02").cast("timestamp").alias("sent"))
    days.coalesce(1).write.mode("append").parquet(landed)
    run()
    assert table(store.missing(points, str(day(0)), str(day(9)))) == []


def test_wrong_number_of_records(spark, store):
    points = spark.createDataFrame([(1,), (2,)], "point_id bigint")
    gaps = store.missing(points, str(day(0)), str(day(1)))
    with pytest.raises(Exception, match="1 records for 2 points"):
        fetch_missing(gaps, lambda points, start, end: ["{}"]).collect()
