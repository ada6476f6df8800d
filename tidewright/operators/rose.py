"""Wind roses: frequencies by direction sector and by speed class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import COMPASS_8, COMPASS_16, wrap360


def sector_of(direction: Column | str, sectors: int = 16) -> Column:
    if sectors < 4 or sectors % 2:
        raise ValueError("the number of sectors is even and 4 at least")
    step = 360.0 / sectors
    return F.least(F.floor(wrap360(wrap360(direction) + step / 2) / step), F.lit(sectors - 1)).cast("int")


def wind_rose(wind: DataFrame, keys: tuple[str, ...] = (), sectors: int = 16, speed: str = "ws_kmh", direction: str = "direction") -> DataFrame:
    """keys, sector, center_deg, frequency (0 .. 1), mean_speed: all sectors of each key; an empty one has zeros."""
    counted = (
        wind.where(F.col(speed).isNotNull() & F.col(direction).isNotNull())
        .groupBy(*keys, sector_of(direction, sectors).alias("sector"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(speed).alias("mean"))
    )
    rings = counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("sector", F.struct("n", "mean")))).alias("by"))
    every = rings.select(*keys, "total", "by", F.explode(F.sequence(F.lit(0), F.lit(sectors - 1))).alias("sector"))
    found = F.try_element_at("by", F.col("sector"))
    return every.select(
        *keys, "sector", (F.col("sector") * (360.0 / sectors)).alias("center_deg"), (F.coalesce(found["n"], F.lit(0)) / F.col("total")).alias("frequency"), F.coalesce(found["mean"], F.lit(0.0)).alias("mean_speed")
    )


def speed_class(speed: Column | str, top: Column, classes: int = 6) -> Column:
    """Number of the equal class of 0 .. top; the top belongs to the last class."""
    s = F.col(speed) if isinstance(speed, str) else speed
    return F.least(F.floor(F.try_divide(s, top / classes)), F.lit(classes - 1)).cast("int")


def speed_class_edges(speed: Column | str, edges: tuple[float, ...]) -> Column:
    """Number of the class [edge, next) of strictly increasing edges; the last edge belongs to the last class, outside is null."""
    if any(b <= a for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges increase strictly")
    s = F.col(speed) if isinstance(speed, str) else speed
    found = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        found = F.when((s >= edges[i]) & ((s < edges[i + 1]) | (F.lit(i == len(edges) - 2) & (s == edges[-1]))), i).otherwise(found)
    return found


def rose_table(wind: DataFrame, classes: int = 6, sectors: int = 16, speed: str = "ws_kmh", direction: str = "direction") -> DataFrame:
    """speed_bin, sector, n, percent, and the marginal of each sector over all classes (speed_bin null)."""
    pairs = wind.where(F.col(speed).isNotNull() & F.col(direction).isNotNull())
    top = pairs.agg(F.max(speed).alias("top"))
    binned = pairs.crossJoin(F.broadcast(top)).select(speed_class(speed, F.col("top"), classes).alias("speed_bin"), sector_of(direction, sectors).alias("sector"))
    out = binned.groupingSets([["sector", "speed_bin"], ["sector"]], "sector", "speed_bin").agg(F.count(F.lit(1)).alias("n"), F.grouping("speed_bin").alias("is_marginal"))
    whole = F.sum(F.when(F.col("is_marginal") == 1, F.col("n"))).over(Window.partitionBy())  # over sectors times classes
    return out.withColumn("percent", 100.0 * F.col("n") / whole)


def direction_edges(sectors: int = 16) -> list[float]:
    return [i * 360.0 / sectors for i in range(sectors + 1)]


def direction_label(number: Column | str, sectors: int = 16) -> Column:
    names = {16: COMPASS_16, 8: COMPASS_8}.get(sectors)
    n = F.col(number) if isinstance(number, str) else number
    if names:
        return F.element_at(F.array(*[F.lit(x) for x in names]), n + 1)
    return F.concat(F.format_string("%.0f", n * (360.0 / sectors)), F.lit("°"))


def calm_counts(wind: DataFrame, keys: tuple[str, ...] = (), speed: str = "ws_kmh") -> DataFrame:
    """keys, calm_count, sample_count: a speed of 0 or less, NaN and null are calm."""
    s = F.when(~F.isnan(speed), F.col(speed))
    return wind.groupBy(*keys).agg(F.count_if(F.coalesce(s, F.lit(0.0)) <= 0).alias("calm_count"), F.count(F.lit(1)).alias("sample_count"))
