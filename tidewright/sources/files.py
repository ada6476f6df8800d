"""Readers and writers of vector layers, series and grids, and parsers of service payloads.

GeoJSON is read and written by Spark's JSON and text sources, so that any file system Spark knows will do. Formats that
need codecs outside this environment (shapefile, GeoPackage, PBF, GeoTIFF, NetCDF) raise UnsupportedFormat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "utf-8", "windows-1251", "iso-8859-1")
GEOJSON = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


class UnsupportedFormat(ValueError):
    pass


def _points(coordinates: Column) -> Column:
    return F.transform(F.from_json(coordinates, "array<array<double>>"), lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))


def flatten_geometry(kind: Column, coordinates: Column) -> Column:
    """Parts of a geometry as arrays of struct(x, y); rings of polygons are parts."""
    one = F.from_json(coordinates, "array<double>")
    nested = lambda c: F.transform(F.from_json(c, "array<array<array<double>>>"), lambda line: F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    deep = lambda c: F.flatten(F.transform(F.from_json(c, "array<array<array<array<double>>>>"), lambda poly: F.transform(poly, lambda line: F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))))
    return (
        F.when(kind == "Point", F.array(F.array(F.struct(one[0].alias("x"), one[1].alias("y")))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(_points(coordinates)))
        .when(kind.isin("MultiLineString", "Polygon"), nested(coordinates))
        .when(kind == "MultiPolygon", deep(coordinates))
    )


def read_geojson(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """feature_id, properties (map), geometry_type, parts; features without a geometry go."""
    raw = spark.read.schema(GEOJSON).option("multiLine", "true").option("encoding", encoding).json(path)
    rows = raw.select(F.posexplode("features").alias("feature_id", "f")).select("feature_id", "f.properties", F.col("f.geometry.type").alias("geometry_type"), flatten_geometry(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("parts"))
    return rows.where(F.col("parts").isNotNull() & (F.size("parts") > 0))


def read_geojson_any_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """The first encoding under which no replacement character shows up."""
    for encoding in encodings[:-1]:
        found = read_geojson(spark, path, encoding)
        text = F.array_join(F.map_values("properties"), "|", "")
        if found.where(F.contains(text, F.lit("�"))).isEmpty():
            return found
    return read_geojson(spark, path, encodings[-1])


def read_coastline(spark: SparkSession, main: str, other: str | None = None) -> DataFrame:
    """Main and other lines with coastline_role."""
    out = read_geojson(spark, main).withColumn("coastline_role", F.lit("main"))
    return out if other is None else out.unionByName(read_geojson(spark, other).withColumn("coastline_role", F.lit("other")))


def vertices_of(features: DataFrame) -> DataFrame:
    """line_id, pos, x, y of parts of two vertices and more."""
    parts = features.select("feature_id", F.posexplode("parts").alias("part", "c")).where(F.size("c") >= 2)
    rows = parts.select((F.col("feature_id") * 100000 + F.col("part")).cast("bigint").alias("line_id"), F.posexplode("c").alias("pos", "p"))
    return rows.select("line_id", F.col("pos").cast("long").alias("pos"), "p.x", "p.y")


def extract_box(features: DataFrame, west: float, south: float, east: float, north: float, coastline_only: bool = True) -> DataFrame:
    """Features with a vertex in the box; natural=coastline only, where that attribute is given at all."""
    hit = F.exists("parts", lambda c: F.exists(c, lambda p: p["x"].between(west, east) & p["y"].between(south, north)))
    out = features.where(hit)
    if coastline_only:
        natural = F.try_element_at("properties", F.lit("natural"))
        out = out.where(natural.isNull() | (natural == "coastline"))
    return out


def ways_to_lines(ways: DataFrame, nodes: DataFrame, whole_only: bool = False) -> DataFrame:
    """ways (way_id, node_ids) and nodes (node_id, lon, lat) -> way_id, coords; ways of under two nodes found go.

    whole_only: a way with a node that is not found goes altogether.
    """
    refs = ways.select("way_id", F.posexplode("node_ids").alias("pos", "node_id"), F.size("node_ids").alias("n"))
    found = refs.join(nodes, "node_id").groupBy("way_id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("c"))
    if whole_only:
        found = found.where(F.size("c") == F.col("n"))
    return found.where(F.size("c") >= 2).select("way_id", F.transform("c", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("coords"))


OVERPASS = "elements array<struct<type: string, id: bigint, lat: double, lon: double, nodes: array<bigint>, tags: map<string, string>>>"


def parse_overpass(payload: DataFrame) -> DataFrame:
    """payload (text) of an Overpass answer -> way_id, coords."""
    e = payload.select(F.explode(F.from_json("payload", OVERPASS)["elements"]).alias("e")).select("e.*")
    return ways_to_lines(e.where("type = 'way'").select(F.col("id").alias("way_id"), F.col("nodes").alias("node_ids")), e.where("type = 'node'").select(F.col("id").alias("node_id"), "lon", "lat"))


def overpass_query(south: float, west: float, north: float, east: float) -> str:
    return f'[out:json][timeout:180];way["natural"="coastline"]({south},{west},{north},{east});(._;>;);out body;'


ARCHIVE = "latitude double, longitude double, error boolean, reason string, daily struct<time: array<string>, wind_speed_10m_max: array<double>, wind_direction_10m_dominant: array<double>>"


def archive_parameters(points: DataFrame, start: str, end: str) -> DataFrame:
    """batch (of the points' own) -> request parameters: comma-joined coordinates of three decimals."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("point_id", c))), lambda p: F.format_string("%.3f", p[c])), ",")
    return points.groupBy("batch").agg(joined("lat").alias("latitude"), joined("lon").alias("longitude")).withColumns({"start_date": F.lit(start), "end_date": F.lit(end)})


def parse_archive(payload: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """point_id, payload -> point_id, date, ws, wd and the columns to keep; an error answer fails the query with its reason."""
    p = payload.select("point_id", *keep, F.from_json("payload", ARCHIVE).alias("p"))
    checked = p.withColumn("ok", F.when(F.coalesce("p.error", F.lit(False)), F.raise_error(F.coalesce("p.reason", F.lit("error")))).otherwise(F.lit(True)))
    z = F.arrays_zip(F.col("p.daily.time").alias("date"), F.col("p.daily.wind_speed_10m_max").alias("ws"), F.col("p.daily.wind_direction_10m_dominant").alias("wd"))
    return checked.where("ok").select("point_id", *keep, F.explode(z).alias("z")).select("point_id", F.col("z.date").cast("date").alias("date"), "z.ws", "z.wd", *keep)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def read_grid(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells of a long grid table (lat, lon, z) inside the box; the filter reaches the Parquet scan. Empty is an error."""
    out = spark.read.parquet(path).where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    if out.isEmpty():
        raise ValueError("no cell of the grid lies in the box")
    return out


def edge_axis(low: Column, high: Column, n: int) -> Column:
    """n values from low to high, both included: a raster's axis over its edges."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * (high - low) / (n - 1))


def raster_rows(lines: DataFrame, west: float, south: float, east: float, north: float, nodata: float = -9999.0) -> DataFrame:
    """Rows of an ASCII raster (row from the north, z as array) -> iy, ix, lat, lon, z from the south; nodata is null."""
    size = lines.agg(F.max("row").alias("top"), F.max(F.size("z")).alias("nx"))
    cells = lines.crossJoin(F.broadcast(size)).select((F.col("top") - F.col("row")).alias("iy"), "top", "nx", F.posexplode("z").alias("ix", "z"))
    return cells.select(
        "iy", "ix", (south + F.col("iy") * (north - south) / F.col("top")).alias("lat"), (west + F.col("ix") * (east - west) / (F.col("nx") - 1)).alias("lon"), F.when(F.col("z") != nodata, F.col("z")).alias("z")
    )


def feature_json(properties: list[str], geometry: Column) -> Column:
    """A GeoJSON feature as text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})


def point_geometry(x: str = "lon", y: str = "lat") -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates"))


def line_geometry(coords: str = "coords") -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.transform(coords, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))


def lines_of(vertices: DataFrame) -> DataFrame:
    held = vertices.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("c"))
    return held.select("line_id", F.transform("c", lambda p: F.struct(p["x"], p["y"])).alias("coords"))


def write_geojson_lines(df: DataFrame, path: str, properties: list[str], geometry: Column, by: str | None = None) -> None:
    """Newline-delimited GeoJSON features, a file per task (and per value of `by`)."""
    out = df.select(*([by] if by else []), feature_json(properties, geometry).alias("value"))
    writer = out.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.from_json("value", "properties map<string, string>, geometry struct<type: string, coordinates: string>").alias("f"))
    return rows.select("f.properties", F.col("f.geometry.type").alias("geometry_type"), flatten_geometry(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("parts"))


def save(df: DataFrame, path: str, properties: list[str], geometry: Column) -> None:
    """By suffix: .geojson and .json; .parquet and .csv keep the columns; others need codecs that are not here."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix in ("geojson", "json"):
        write_geojson_lines(df, path, properties, geometry)
    elif suffix == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif suffix == "csv":
        df.write.mode("overwrite").option("header", "true").csv(path)
    else:
        raise UnsupportedFormat(f"cannot write {suffix or 'a file without a suffix'}")


def manifest(df: DataFrame) -> DataFrame:
    """Files that a table was read from, with their numbers of rows."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n")).orderBy("file")


def profile_csv_rows(profile: DataFrame) -> DataFrame:
    six = lambda c: F.format_string("%.6f", F.col(c)).alias(c)
    return profile.select(six("distance_m"), six("z"), six("lat"), six("lon"))


def tolerance_label(t: Column | str) -> Column:
    """12.5 -> 12p5m, 3.0 -> 3m."""
    t = F.col(t) if isinstance(t, str) else t
    return F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.3f", t), r"\.?0+$", ""), r"\.", "p"), F.lit("m"))


def north_up(grid: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """row (from the north, of a grid that has every iy) and its values as an array, null as nodata."""
    rows = grid.groupBy("iy").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "z"))), lambda c: F.coalesce(c["z"], F.lit(nodata))).alias("z"))
    top = grid.agg(F.max("iy").alias("top"))  # one row
    return rows.crossJoin(F.broadcast(top)).select((F.col("top") - F.col("iy")).alias("row"), "z")
