"""Bringing inputs of varying shape to one shape: aliases, identifiers, directions, arrays, names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import in_land_sector, whole_direction, wrap360

# Column names accepted for each quantity, the first present one counts.
TRACE_DIRECTION_A = ("direction", "azimuth", "azimuth_deg")
TRACE_FETCH_A = ("fetch_m", "fetch_length_m", "distance_m")
TRACE_DIRECTION_B = ("direction", "azimuth_deg", "azimuth")
TRACE_FETCH_B = ("fetch_m", "fetch_length_m", "distance_m", "distance")
WIND_SPEED_A = ("wind_speed_10m_max", "wind_speed", "ws_kmh")
WIND_DIRECTION_A = ("wind_direction_10m_dominant", "wind_dir", "direction")
WIND_SPEED_B = ("ws_kmh", "wind_speed_10m_max", "windspeed10mmax")
WIND_DIRECTION_B = ("direction", "wind_direction_10m_dominant", "winddirection10mdominant", "wind_dir")
DATE_NAMES = ("date", "dates", "time")
WEATHER_ALIASES = {
    "dates": ("dates", "date", "time"),
    "wind_speed": ("wind_speed", "wind_speed_10m_max", "ws"),
    "wind_dir": ("wind_dir", "wind_direction_10m_dominant", "wd"),
}
CWEF_NAMES = ("CWEF_W_m", "CWEF_Wm", "cwef", "CWEF")
INDEX_DIRECTION_NAMES = ("direction", "wind_dir", "direction_deg")


def present(df: DataFrame, names: Iterable[str], required: bool = True) -> str | None:
    """The first of names that df has."""
    found = next((n for n in names if n in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of the columns {', '.join(names)} is there")
    return found


def number(c: Column | str) -> Column:
    """As a double; what is not a number, and NaN, is null."""
    d = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(d), d)


def normalise_trace(df: DataFrame, keys: Iterable[str] = (), variant: str = "a") -> DataFrame:
    """keys, direction (0 .. 359), fetch_m: the longest fetch of each whole direction; nulls count as 0."""
    directions, fetches = (TRACE_DIRECTION_A, TRACE_FETCH_A) if variant == "a" else (TRACE_DIRECTION_B, TRACE_FETCH_B)
    direction, fetch = present(df, directions), present(df, fetches)
    return (
        df.select(*keys, whole_direction(F.coalesce(number(direction), F.lit(0.0))).alias("direction"), F.coalesce(number(fetch), F.lit(0.0)).alias("fetch_m"))
        .groupBy(*keys, "direction")
        .agg(F.max("fetch_m").alias("fetch_m"))
    )


def normalise_wind(df: DataFrame, keys: Iterable[str] = (), variant: str = "a") -> DataFrame:
    """keys, date, ws_kmh (null: 0), direction (0 .. 359); rows without a direction go."""
    speeds, directions = (WIND_SPEED_A, WIND_DIRECTION_A) if variant == "a" else (WIND_SPEED_B, WIND_DIRECTION_B)
    speed, direction, date = present(df, speeds), present(df, directions), present(df, DATE_NAMES)
    return df.select(
        *keys, F.to_date(F.col(date)).alias("date"), F.coalesce(number(speed), F.lit(0.0)).alias("ws_kmh"), whole_direction(number(direction)).alias("direction")
    ).where("direction is not null")


def rename_index_columns(df: DataFrame) -> DataFrame:
    """The flux and direction columns, under any accepted name, become CWEF_W_m and direction."""
    for target, names in (("CWEF_W_m", CWEF_NAMES), ("direction", INDEX_DIRECTION_NAMES)):
        found = present(df, names, required=target == "CWEF_W_m")
        if found and found != target:
            df = df.withColumnRenamed(found, target)
    return df


def point_number(c: Column | str) -> Column:
    """point_00012 -> 12; otherwise the whole part of the number."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(text.startswith("point_"), F.substring(text, 7, 20).try_cast("bigint")).otherwise(F.floor(F.abs(text.try_cast("double"))) * F.signum(text.try_cast("double"))).cast("bigint")


def number_list(c: Column | str) -> Column:
    """JSON text of an array of numbers -> array<double>; null and broken text -> empty."""
    return F.coalesce(F.from_json(F.col(c) if isinstance(c, str) else c, "array<double>"), F.array().cast("array<double>"))


def first_present(*names: str) -> Column:
    return F.coalesce(*[F.col(n) for n in names])


def wide_to_long(df: DataFrame, keys: Iterable[str], arrays: dict[str, str]) -> DataFrame:
    """One row per element of parallel arrays; rows with an empty array or of unequal lengths go."""
    lists = list(arrays)
    equal = F.size(lists[0]) > 0
    for other in lists[1:]:
        equal = equal & (F.size(other) == F.size(lists[0]))
    zipped = F.explode(F.arrays_zip(*[F.col(n) for n in lists])).alias("at")
    return df.where(equal).select(*keys, zipped).select(*keys, *[F.col(f"at.{n}").alias(a) for n, a in arrays.items()])


def fetch_wide_to_long(df: DataFrame, order: str, threshold: float = 0.1) -> DataFrame:
    """point_id, direction, fetch_m of a wide fetch table; of rows with one point_id the last by `order` counts.

    Fetches of the threshold and less mark land and go.
    """
    last = df.groupBy("point_id").agg(F.max_by(F.struct("azimuths_deg", "fetch_lengths_m"), order).alias("last"))
    long = wide_to_long(last.select("point_id", "last.*"), ["point_id"], {"azimuths_deg": "azimuth", "fetch_lengths_m": "fetch_m"})
    return long.select("point_id", whole_direction("azimuth").alias("direction"), "fetch_m").where(F.col("fetch_m") > threshold)


def normalise_weather_grid(df: DataFrame) -> DataFrame:
    """Wide weather rows under the accepted names: dates as text, angles wrapped, NaN as null; unequal lengths go."""
    names = {target: present(df, aliases) for target, aliases in WEATHER_ALIASES.items()}
    others = [c for c in df.columns if c not in names.values()]
    clean = lambda x: F.when(~F.isnan(x), x)
    out = df.select(
        *others,
        F.transform(F.col(names["dates"]), lambda d: d.cast("date").cast("string")).alias("dates"),
        F.transform(F.col(names["wind_speed"]), lambda x: clean(x.cast("double"))).alias("wind_speed"),
        F.transform(F.col(names["wind_dir"]), lambda x: wrap360(clean(x.cast("double")))).alias("wind_dir"),
    )
    return out.where((F.size("dates") == F.size("wind_speed")) & (F.size("dates") == F.size("wind_dir")))


def drop_calm(df: DataFrame, speed: str = "ws_kmh", least: float = 0.1) -> DataFrame:
    return df.where(F.col(speed) >= least)


def valid_pairs(df: DataFrame, speed: str, direction: str) -> DataFrame:
    return df.where(F.col(speed).isNotNull() & F.col(direction).isNotNull())


def valid_depth(z: Column | str) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return z.isNotNull() & ~F.isnan(z) & (z > 0) & (z < float("inf"))


def between_chainages(df: DataFrame, low: float, high: float) -> DataFrame:
    """Both ends included."""
    return df.where(F.col("chainage_m").between(low, high))


def slug(c: Column | str) -> Column:
    """Letters, digits and -_. stay, all else becomes _, runs of _ one, outer _ go; empty: unknown."""
    text = F.regexp_replace(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^\p{L}\p{N}\-_.]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.btrim(text, F.lit("_")), F.lit("")), F.lit("unknown"))


def distinct_azimuths(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.col(c) if isinstance(c, str) else c, wrap360)))


def land_sector(df: DataFrame, edge: str = "half_open") -> DataFrame:
    return df.withColumn("is_land", in_land_sector("azimuth_deg", "normal_azimuth_deg", edge))


def carry_columns(summary: DataFrame, points: DataFrame, key: str = "point_id") -> DataFrame:
    """summary with all columns of points that it does not have."""
    more = [c for c in points.columns if c == key or c not in summary.columns]
    return summary.join(points.select(*more), key, "left")
