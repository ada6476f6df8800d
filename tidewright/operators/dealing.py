"""How rows that a step multiplies are dealt out first."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys over as many tasks as a shuffle has, two for each core at least.

    A small file is one task, and so would be all that is computed for its rows. The number is given, since Spark would
    put few bytes together again.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)
