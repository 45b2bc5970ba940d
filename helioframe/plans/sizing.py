"""The largest module layout of each roof that keeps to the fire rules: inset, keep-outs, planes, and packed rows.

buildings: bid, rings (outer ring, then holes; metres east and north of the roof), occupancy, lat, parapet_m, mapped
(whether its obstructions are known). planes: bid, plane, rings, pitch, azimuth. obstructions: bid, rings, kind,
height_m. A building without planes has one flat plane, its footprint. All is one overlay of four sides by plane, once
as seen from above, for areas and axes, and once in the frame of each layout, for the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions import geometry, solar
from helioframe.operators import overlay, packing
from helioframe.operators.stages import stored

SIDES = ["roof", "plane", "rim", "out"]
PLANE = ["bid", "plane"]


@dataclass(frozen=True)
class Design:
    """Module, racking and setbacks, all as the sizing command sets them by default."""

    length_m: float = 2.278
    width_m: float = 1.134
    watts: float = 550.0
    racking: str = "east_west"
    tilt: float = 10.0
    east_west_coverage: float = 0.90
    south_coverage: float | None = None
    flat_orientations: tuple[str, ...] = ("landscape",)
    pitched_orientations: tuple[str, ...] = ("portrait", "landscape")
    pitched_from: float = 9.46
    gap_m: float = 0.02
    edge_ft: float = 0.0
    parapet_ratio: float = 0.0
    shade_ratio: float = 0.0
    phases: int = 8
    least_modules: int = 6
    residential_ft: float = 3.0
    section_ft: float = 150.0
    aisle_ft: float = 4.0
    residential_for_pitched: bool = True

    def size(self, orientation: str) -> tuple[float, float]:
        """Along the row, and up the slope."""
        return (self.length_m, self.width_m) if orientation == "landscape" else (self.width_m, self.length_m)


def prepared(buildings: DataFrame, planes: DataFrame, design: Design) -> DataFrame:
    """A row per plane with its building's columns, the setbacks, and which of them holds."""
    measured = buildings.withColumn("short", packing.axes(F.col("rings")[0]).getField("short"))
    edge = F.greatest(solar.perimeter_m(F.col("short")), F.lit(design.edge_ft * solar.FT), design.parapet_ratio * F.coalesce("parapet_m", F.lit(0.0)))
    rows = measured.withColumn("perimeter", edge).join(planes.withColumnRenamed("rings", "plane_rings"), "bid", "left")
    rows = rows.withColumns({
        "planned": F.col("plane").isNotNull(), "plane_rings": F.coalesce("plane_rings", "rings"), "plane": F.coalesce("plane", F.lit(0).cast("long")),
        "pitch": F.coalesce("pitch", F.lit(0.0)), "azimuth": F.coalesce("azimuth", F.lit(180.0)),
    })
    pitched = F.col("pitch") >= design.pitched_from
    return rows.withColumn("pitched", pitched).withColumn("residential", pitched & solar.residential_rules(F.col("occupancy"), pitched, design.residential_for_pitched))


def shapes(rows: DataFrame, obstructions: DataFrame, design: Design) -> DataFrame:
    """bid, plane, side and rings of all that decides where modules may lie."""
    roof = rows.select(*PLANE, F.lit("roof").alias("side"), "rings")
    plane = rows.select(*PLANE, F.lit("plane").alias("side"), F.col("plane_rings").alias("rings"))
    # the setback runs along the plane's own edges by the residential rules, else along the footprint's
    strips = F.when(F.col("residential"), overlay.border(F.col("plane_rings"), F.lit(design.residential_ft * solar.FT))).otherwise(overlay.border(F.col("rings"), F.col("perimeter")))
    rim = rows.select(*PLANE, F.lit("rim").alias("side"), F.explode(strips).alias("s")).select(*PLANE, "side", F.array("s").alias("rings"))
    kept = obstructions
    if design.shade_ratio > 0:
        shift = F.when(F.col("lat") >= 0, 1.0).otherwise(-1.0) * design.shade_ratio * F.coalesce("height_m", F.lit(0.0))
        moved = F.transform(F.col("rings")[0], lambda p: overlay.point(p["x"], p["y"] + shift))
        hull = F.array(packing.hulls(F.concat(F.col("rings")[0], moved)))
        kept = kept.join(rows.select("bid", "lat").distinct(), "bid").withColumn("rings", F.when(shift != 0, hull).otherwise(F.col("rings"))).drop("lat")
    wide = F.concat(F.array("rings"), F.transform(overlay.border(F.col("rings"), -solar.clearance_m(F.col("kind"))), lambda s: F.array(s)))
    out = rows.select(*PLANE).join(kept.select("bid", F.explode(wide).alias("rings")), "bid").select(*PLANE, F.lit("out").alias("side"), "rings")
    return roof.unionByName(plane).unionByName(rim).unionByName(out)


def usable(found: DataFrame, key: list[str]) -> DataFrame:
    edges = overlay.edges(found, key, F.col("side"), F.col("rings"))
    return overlay.overlay(edges, key, SIDES, F.col("in_roof") & F.col("in_plane") & ~F.col("in_rim") & ~F.col("in_out"))


def specs(layouts: DataFrame, design: Design) -> DataFrame:
    """A row per layout and orientation: module, row pitch and sections."""

    def spec(kind: str, orientations: tuple[str, ...]) -> Column:
        made = []
        for at, name in enumerate(orientations):
            along, slant = design.size(name)
            if kind == "pitched":
                depth, pitch, most, aisle = F.lit(slant), F.lit(slant + design.gap_m), F.lit(None), F.lit(None)
            else:
                coverage = design.south_coverage if design.racking == "south_tilt" else design.east_west_coverage
                depth = F.lit(slant) if design.racking == "flush" else slant * F.cos(F.radians(F.lit(design.tilt)))
                pitch = solar.flat_row_pitch(F.lit(design.racking), F.lit(slant), F.lit(design.tilt), F.col("lat"), coverage, design.gap_m)
                most, aisle = F.lit(design.section_ft * solar.FT), F.lit(design.aisle_ft * solar.FT)
            values = {"orientation": F.lit(at), "along": F.lit(along), "depth": depth, "pitch": pitch, "gap": F.lit(design.gap_m), "most": most, "aisle": aisle}
            made.append(F.struct(*[v.cast("int" if c == "orientation" else "double").alias(c) for c, v in values.items()]))
        return F.array(*made)

    every = F.when(F.col("pitched"), spec("pitched", design.pitched_orientations)).otherwise(spec("flat", design.flat_orientations))
    return layouts.select(*PLANE, "layout", F.explode(every).alias("s")).select(*PLANE, "layout", "s.*").where(F.col("pitch").isNotNull())


def layouts(rows: DataFrame, seen: DataFrame, design: Design) -> DataFrame:
    """The frames in which a plane is packed: a turn in degrees and a stretch up the slope.

    Pitched planes lie with the downslope upwards; flat ones along either axis of what is usable of them, or for
    south-tilted rows along the one that is nearer to east-west.
    """
    corners = F.array(*[overlay.point(F.col(f"x{s}{e}"), F.col(f"y{e}")) for s in "lr" for e in (0, 1)])
    axis = seen.groupBy(*PLANE).agg(F.flatten(F.collect_list(corners)).alias("p")).select(*PLANE, packing.axes("p").getField("angle").alias("axis"))
    joined = rows.join(axis, PLANE)  # planes without anything usable have no layout
    both = F.array(F.col("axis"), F.pmod(F.col("axis") + 90, F.lit(180.0)))
    if design.racking == "south_tilt":
        off = lambda a: F.least(a, 180 - a)
        both = F.array(F.when(off(both[0]) <= off(both[1]), both[0]).otherwise(both[1]))
    turns = F.when(F.col("pitched"), F.array("azimuth")).otherwise(F.transform(both, lambda a: -a))
    stretch = F.when(F.col("pitched"), 1 / F.cos(F.radians("pitch"))).otherwise(F.lit(1.0))
    return joined.select(*PLANE, "pitched", "lat", stretch.alias("stretch"), F.posexplode(turns).alias("layout", "turn"))


def framed(found: DataFrame, frames: DataFrame) -> DataFrame:
    """Shapes turned and stretched into the frames of their plane's layouts."""
    turned = F.transform("rings", lambda r: F.transform(geometry.rotated(r, F.col("turn")), lambda p: overlay.point(p["x"], p["y"] * F.col("stretch"))))
    return found.join(frames.select(*PLANE, "layout", "turn", "stretch"), PLANE).select(*PLANE, "layout", "side", turned.alias("rings"))


def packed_planes(buildings: DataFrame, planes: DataFrame, obstructions: DataFrame, design: Design) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Planes with their usable area, the best layout of each (modules; none where nothing fits), and all runs."""
    rows = stored(prepared(buildings, planes, design))
    found = stored(shapes(rows, obstructions, design))
    seen = stored(usable(found, PLANE))
    frames = stored(layouts(rows, seen, design))
    regions = stored(usable(framed(found, frames), [*PLANE, "layout"]))
    layout = [*PLANE, "layout"], specs(frames, design)
    runs = packing.packed(regions, *layout, design.phases)
    best = packing.best_layouts(regions, *layout, PLANE, ["layout", "orientation"], design.phases)
    return rows.join(overlay.areas(seen, PLANE, "usable"), PLANE, "left"), best, runs


def estimate(buildings: DataFrame, planes: DataFrame, obstructions: DataFrame, design: Design = Design()) -> DataFrame:
    """A row per building: module_count, dc_kw, gross_m2, usable_m2, roof_type, perimeter_m and flags.

    Fewer than least_modules in all count as none, which a flag tells. Flags also tell of assumed flat roofs, unmapped
    obstructions and residential setbacks. Buildings without a footprint, or with nothing usable, get no modules.
    """
    rows, best, _ = packed_planes(buildings, planes, obstructions, design)
    joined = rows.join(best.select(*PLANE, "modules"), PLANE, "left")
    gross = F.aggregate(F.transform("rings", lambda r: geometry.area(r)), F.lit(0.0), lambda a, b: F.when(a == 0, b).otherwise(a - b))
    sums = joined.groupBy("bid").agg(
        F.coalesce(F.sum("modules"), F.lit(0)).cast("long").alias("found"), F.first(gross).alias("gross_m2"), F.coalesce(F.sum("usable"), F.lit(0.0)).alias("usable_m2"), F.first("perimeter").alias("perimeter_m"),
        F.bool_or("pitched").alias("p"), F.bool_and("pitched").alias("all_p"), F.bool_or("residential").alias("residential"), F.bool_and("planned").alias("planned"), F.first("mapped").alias("mapped"),
    )
    few = (F.col("found") > 0) & (F.col("found") < design.least_modules)
    count = F.when(few, F.lit(0).cast("long")).otherwise(F.col("found"))
    flags = F.array_compact(F.array(
        F.when(~F.col("planned"), "no_roof_planes_assumed_flat"), F.when(~F.coalesce("mapped", F.lit(False)), "obstructions_not_mapped_upper_bound"),
        F.when(F.col("residential"), "pitched_setbacks_approximated"), F.when(few, f"under_{design.least_modules}_modules_not_designed"),
    ))
    kind = F.when(F.col("all_p"), "pitched").when(F.col("p"), "mixed").otherwise("flat")
    return sums.select("bid", count.alias("module_count"), (count * design.watts / 1000).alias("dc_kw"), "gross_m2", "usable_m2", kind.alias("roof_type"), "perimeter_m", flags.alias("flags"))
