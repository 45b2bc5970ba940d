"""Results as files: CSV, GeoJSON and KML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions import text


def blanks(df: DataFrame) -> DataFrame:
    """Nulls as empty strings, lists joined by ';', as the CSV files have them."""
    return df.select(*((F.array_join(c, ";") if kind.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c, kind in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    blanks(df).write.option("header", True).csv(path)


def write_calibration(factors: DataFrame, overall: float | None, n: int, min_samples: int, path: str) -> None:
    """One JSON document; segments are few (a factor each)."""
    pairs = F.map_from_entries(F.collect_list(F.struct(factors.columns[0], F.struct("factor", "n"))))
    factors.agg(pairs.alias("factors")).select(F.lit(min_samples).alias("min_samples"), F.lit(overall).alias("global_factor"), F.lit(n).alias("global_n"), "factors").coalesce(1).write.json(path)


def ring_json(ring: Column) -> Column:
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.array(F.transform(closed, lambda p: F.array(F.round(p["x"], 8), F.round(p["y"], 8))))


def layout_features(modules: DataFrame, building: str, method: str, ring: str) -> DataFrame:
    """One GeoJSON feature per placed module, as text lines (newline-delimited features)."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), ring_json(F.col(ring)).alias("coordinates")).alias("geometry"), F.struct(F.col(building).alias("building_id"), F.col(method).alias("method")).alias("properties"))
    return modules.select(F.to_json(feature).alias("value"))


def placemark(name: Column, ring: Column) -> Column:
    points = F.array_join(F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.format_string("%.8f,%.8f,0", p["x"], p["y"])), " ")
    return F.concat(F.lit("<Placemark><name>"), text.xml_escaped(name), F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), points, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))


def kml_folders(shapes: DataFrame, building: str, name: str, ring: str, kw: str, order: str) -> DataFrame:
    """A KML folder per site (the building id without ' #n'), its total in the name, as text rows.

    A folder holds one site's shapes, so its text is bounded by the site.
    """
    rows = shapes.withColumn("site", text.site_of(F.col(building)))
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), placemark(F.col(name), F.col(ring)).alias("p")))), lambda x: x["p"]), "")
    totals = rows.groupBy("site", building).agg(F.max(kw).alias("kw")).groupBy("site").agg(F.sum("kw").alias("total"))
    folders = rows.groupBy("site").agg(marks.alias("marks")).join(totals, "site")
    title = F.concat(text.xml_escaped(F.col("site")), F.format_string(" (%.1f kW)", F.col("total")))
    return folders.select("site", F.concat(F.lit("<Folder><name>"), title, F.lit("</name>"), F.col("marks"), F.lit("</Folder>")).alias("value"))
