"""Input files as DataFrames: site lists, GeoJSON, KML, truth tables and calibration files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helioframe.functions import text

# The headers by which a site list's columns go.
SITE_HEADERS = {
    "id": ["id", "site id", "property id", "building id", "name", "property name", "property", "site"],
    "address": ["address", "full address", "property address", "site address", "location"],
    "street": ["street", "address line 1", "address1", "street address"],
    "city": ["city"],
    "state": ["state", "st"],
    "zip": ["zip", "zip code", "zipcode", "postal code", "postcode"],
    "lat": ["lat", "latitude", "y"],
    "lon": ["lon", "lng", "long", "longitude", "x"],
    "occupancy": ["occupancy", "building type", "type", "property type", "housing type", "housingtype"],
    "units": ["units", "unit count", "number of units", "# units", "num units", "total units"],
    "group": ["group", "property group", "parent property", "main address", "complex"],
    "built": ["built", "year built", "yearbuilt", "built year", "year completed", "completed"],
}


def resolved(headers: list[str], known: dict[str, list[str]]) -> dict[str, str]:
    """Which header stands for each known column: the first alias that is there."""
    plain = {" ".join(h.strip().lower().replace("_", " ").split()): h for h in reversed(headers)}
    return {name: next(plain[a] for a in aliases if a in plain) for name, aliases in known.items() if any(a in plain for a in aliases)}


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites of a loose CSV: ordinal, id, address, lat, lon, occupancy, units, group, year_built.

    The address is put together from its parts where it is missing; coordinates that are no numbers fall
    back to the address; rows with neither are left out. Missing identifiers are site-<row>, repeated
    ones get ' (2)' and so on. Without any location column it raises ValueError.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    at = resolved(raw.columns, SITE_HEADERS)
    if not ({"address", "street"} & at.keys() or {"lat", "lon"} <= at.keys()):
        raise ValueError("no address or coordinate columns in " + path)

    def value(name: str) -> Column:
        return F.nullif(F.trim(F.col(f"`{at[name]}`")), F.lit("")) if name in at else F.lit(None).cast("string")

    def number(name: str) -> Column:
        return F.regexp_replace(value(name), ",", "").try_cast("double")

    # rows keep the order of the file: numbers grow within and across its splits
    rows = raw.select(F.monotonically_increasing_id().alias("ordinal"), *(value(n).alias(n) for n in SITE_HEADERS if n not in ("lat", "lon", "units", "built")), number("lat").alias("lat"), number("lon").alias("lon"),
                      F.nullif(F.regexp_replace(value("units"), "[^0-9]", ""), F.lit("")).try_cast("int").alias("units"), F.nullif(F.regexp_extract(value("built"), r"\b(1[89]\d\d|20\d\d)\b", 1), F.lit("")).try_cast("int").alias("year_built"))
    base = F.coalesce("address", "street")
    missing = lambda c: F.when(F.col(c).isNotNull() & ~F.lower(F.coalesce(base, F.lit(""))).contains(F.lower(F.col(c))), F.col(c))
    address = F.concat_ws(", ", base, missing("city"), F.nullif(F.concat_ws(" ", missing("state"), missing("zip")), F.lit("")))
    rows = rows.withColumn("address", F.nullif(address, F.lit("")))
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rows = rows.withColumn("lat", F.when(both, F.col("lat"))).withColumn("lon", F.when(both, F.col("lon"))).where("address is not null or lat is not null")
    named = rows.withColumn("id", F.coalesce("id", F.concat(F.lit("site-"), (F.col("ordinal") + 1).cast("string"))))
    k = F.row_number().over(Window.partitionBy("id").orderBy("ordinal"))
    return named.withColumn("id", F.when(k > 1, F.format_string("%s (%d)", F.col("id"), k)).otherwise(F.col("id"))).select("ordinal", "id", "address", "lat", "lon", text.occupancy_from_text(F.col("occupancy")).alias("occupancy"), "units", "group", "year_built")


FEATURES = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files: file, position, id, role, building_id, properties and the outer ring.

    Multi-polygons give their largest part. A role other than footprint, roof_plane or obstruction, or a
    child without its building, raises an error when the rows are read.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", FEATURES).alias("j"))
    f = files.select("file", F.posexplode("j.features").alias("position", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.from_json(raw, "array<array<array<double>>>")
    parts = F.when(kind == "MultiPolygon", F.from_json(raw, "array<array<array<array<double>>>>")).otherwise(F.array(one))
    rings = F.transform(parts, lambda p: F.transform(p[0], lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))))
    from helioframe.functions import geometry

    sized = F.transform(rings, lambda r: F.struct((-geometry.area(r)).alias("a"), r.alias("ring")))
    role = F.coalesce(F.col("f.properties")["role"], F.lit("footprint"))
    checked = F.when(role.isin("footprint", "roof_plane", "obstruction"), role).otherwise(F.raise_error(F.concat(F.lit("unknown role "), role)))
    rows = f.select("file", "position", F.coalesce("f.id", F.col("f.properties")["id"], F.col("position").cast("string")).alias("id"), checked.alias("role"), F.col("f.properties")["building_id"].alias("building_id"), F.col("f.properties").alias("properties"), F.array_min(sized)["ring"].alias("ring"))
    owners = rows.where("role = 'footprint'").select("file", F.col("id").alias("building_id"), F.lit(True).alias("known"))
    joined = rows.join(owners.distinct(), ["file", "building_id"], "left")
    sound = (F.col("role") == "footprint") | F.coalesce("known", F.lit(False))
    return joined.select("file", "position", F.when(sound, F.col("id")).otherwise(F.raise_error(F.lit("no building for a child feature"))).alias("id"), "role", "building_id", "properties", "ring")


KML_SCHEMA = "file string, position int, name string, context string, ring array<struct<x:double,y:double>>, holes int"


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of KML or KMZ files with their name and context (description and folder names)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(file, k, *shape) for file, data in zip(frame["path"], frame["content"]) for k, shape in enumerate(kml_shapes(data))]
            yield pd.DataFrame(rows, columns=["file", "position", "name", "context", "ring", "holes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, KML_SCHEMA)


def kml_shapes(data: bytes) -> Iterator[tuple[str, str, list[dict], int]]:
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [n for n in z.namelist() if n.lower().endswith(".kml")]
            data = z.read("doc.kml" if "doc.kml" in names else names[0])

    def plain(e: ElementTree.Element) -> str:
        return e.tag.rsplit("}", 1)[-1]

    def word(e: ElementTree.Element, tag: str) -> str:
        return next((c.text or "" for c in e if plain(c) == tag), "").strip()

    def ring(e: ElementTree.Element) -> list[dict]:
        found = next((c.text or "" for c in e.iter() if plain(c) == "coordinates"), "")
        return [{"x": float(p[0]), "y": float(p[1])} for t in found.split() if len(p := t.split(",")) >= 2]

    def walk(e: ElementTree.Element, folders: list[str]) -> Iterator[tuple[str, str, list[dict], int]]:
        for c in e:
            if plain(c) in ("Document", "Folder"):
                yield from walk(c, [*folders, word(c, "name")])
            elif plain(c) == "Placemark":
                for polygon in (p for p in c.iter() if plain(p) == "Polygon"):
                    outer = next((x for x in polygon if plain(x) == "outerBoundaryIs"), None)
                    if outer is not None and len(points := ring(outer)) >= 3:
                        yield word(c, "name"), " ".join([word(c, "name"), word(c, "description"), *folders]), points, sum(plain(x) == "innerBoundaryIs" for x in polygon)

    yield from walk(ElementTree.fromstring(data), [])


def kml_buildings(shapes: DataFrame) -> DataFrame:
    """Shapes with their role by name: plane, obstruction or roof; occupancy; pitch and azimuth."""
    plane, kind = text.plane_from_name(F.col("name")), text.obstruction_kind(F.col("name"))
    context = F.lower("context")
    occupancy = F.when(context.contains("commercial"), "commercial").when(context.rlike(r"\br-?3\b") | context.contains("townho"), "R-3").otherwise("R-2")
    role = F.when(plane.isNotNull(), "roof_plane").when(kind.isNotNull(), "obstruction").otherwise("footprint")
    return shapes.select("*", role.alias("role"), kind.alias("kind"), occupancy.alias("occupancy"), plane["pitch_deg"].alias("pitch_deg"), plane["azimuth_deg"].alias("azimuth_deg"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Known designs per site: name, address, lat, lon, kind and an array of (kw, module_w, source, racking)."""
    raw = spark.read.option("header", True).csv(path)
    at = resolved(raw.columns, {"name": ["name", "site", "property"], "address": ["address"], "lat": ["lat", "latitude"], "lon": ["lon", "longitude"], "kind": ["kind"], "kw": ["kw", "true kw"], "module_w": ["module w"], "source": ["source"], "racking": ["racking"]})
    value = lambda n: F.nullif(F.trim(F.col(f"`{at[n]}`")), F.lit("")) if n in at else F.lit(None).cast("string")
    rows = raw.select(F.monotonically_increasing_id().alias("o"), *(value(n).alias(n) for n in ("name", "address", "kind", "source", "racking")), *(value(n).try_cast("double").alias(n) for n in ("lat", "lon", "kw", "module_w"))).where("kw is not null")
    design = F.struct("o", "kw", "module_w", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("racking", F.lit("standard")).alias("racking"))
    first = lambda c: F.min_by(c, "o").alias(c)
    grouped = rows.groupBy("name").agg(first("address"), first("lat"), first("lon"), F.coalesce(F.min_by("kind", "o"), F.lit("maxfit")).alias("kind"), F.array_sort(F.collect_list(design)).alias("designs"))
    return grouped.withColumn("designs", F.transform("designs", lambda d: d.dropFields("o")))


CALIBRATION = "min_samples int, global_factor double, global_n long, factors map<string,struct<factor:double,n:long>>"


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """key, factor and n of a calibration file; the overall factor has the key null."""
    j = spark.read.schema(CALIBRATION).option("multiLine", True).json(path)
    parts = j.select(F.explode("factors").alias("key", "f")).select("key", "f.factor", "f.n")
    return parts.unionByName(j.select(F.lit(None).cast("string").alias("key"), F.col("global_factor").alias("factor"), F.col("global_n").alias("n")))


def footprints_in(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Footprints whose box meets a window: the bounds reach the Parquet scan and only used columns are read."""
    b = spark.read.parquet(path)
    return b.where((F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south))


def addresses_of(spark: SparkSession, path: str, zips: list[str]) -> DataFrame:
    """Address points of some ZIP codes: number, street, unit, lat, lon, postcode."""
    a = spark.read.parquet(path).where((F.col("country") == "US") & F.col("postcode").isin(zips))
    return a.select("postcode", F.upper("number").alias("number"), "street", "unit", F.col("bbox.ymin").alias("lat"), F.col("bbox.xmin").alias("lon"))


def newest_release(spark: SparkSession, path: str) -> str:
    """The greatest directory name below path; none raises ValueError."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [f.getPath().getName() for f in found if f.isDirectory() and re.match(r"\d", f.getPath().getName())]
    if not names:
        raise ValueError("no release in " + path)
    return max(names)
