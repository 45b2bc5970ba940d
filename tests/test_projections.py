"""Columns and values of the result files' rows."""

import __spark_entry__
from helioframe.plans import projections

BUILDING = f"site_id int, ord int, counted boolean, structure string, occupancy string, overture_id string, mapped string, distance_m double, height_m double, {projections.ESTIMATE}, {projections.LEFT_OUT}"
SITE = (
    "site_id int, group string, address string, matched_address string, lat double, lon double, source string, precision string, parcel_id string, parcel_acres double, units int, listed_units int, parcel_units int, "
    "units_estimate_kw double, floor_m2_per_unit double, year_built int, solar_check string, reasons array<string>, manual_review array<string>"
)


def building(site, ord, kw, reasons=(), counted=None, structure="building", modules=100, left=None):
    layout = (modules, 500.04, 400.0, "flat", ["a", "b"]) if modules is not None else None
    return (site, ord, counted, structure, "R-2", f"o{ord}", None, 3.14, None, f"b{ord}", kw, kw * 1.1, "geometric", 0.97654, "segment", None, bool(reasons), list(reasons), layout, kw, None, left)


def site(i, units=0, reasons=None, review=None, few=None):
    return (i, "g", f"{i} Main St", None, 34.123456789, -118.5, "census", "rooftop", "p1", 0.0, units, None, None, few, None, 0, "", reasons, review)


def test_rows_of_sites(spark):
    left = (12.34, True, 1.26, 2.0, 10, "2024-01-01")
    buildings = [
        building(1, 2, 50.004, ["methods_disagree_ratio_0.5", "x", "far"], left=left), building(1, 1, 30.0, ["y", "methods_disagree_ratio_0.4"], counted=True, structure="carport_or_garage", left=left), building(1, 3, 7.0, ["x"], counted=False),
        building(2, 1, 10.0, ["methods_disagree_ratio_0.3"], modules=None),
    ]
    rows = projections.site_rows(spark.createDataFrame([site(1, 40, ["far"], ["pin", "old"]), site(2, few=12.345), site(3)], SITE), spark.createDataFrame(buildings, BUILDING))
    assert rows.columns == projections.SITE_COLUMNS and len(rows.columns) == 35
    one, two, three = rows.orderBy("site_id").collect()
    assert (one["dc_kw"], one["rooftop_kw"], one["carport_kw"], one["uncounted_buildings_kw"], one["kw_per_unit"], one["module_count"], one["buildings"]) == (80.0, 50.0, 30.0, 7.0, 2.0, 200, 3)
    assert (one["north_faces_kw_not_counted"], one["maxfit_raised_racking_kw"], one["equipment_clearance_kw_not_counted"], one["roof_area_m2"]) == (24.7, 88.0, 2.5, 1000.1)
    assert one["reasons"] == "far;y;x;methods_disagree_on_2_of_3_buildings" and one["manual_review_reason"] == "pin;old" and one["manual_review"] and one["lat"] == 34.1234568
    assert (two["reasons"], two["best_estimate_kw"], two["estimate_basis"], two["module_count"], two["maxfit_raised_racking_kw"]) == ("methods_disagree_ratio_0.3", 12.34, "units", 0, 10.0)
    assert (three["buildings"], three["dc_kw"], three["reasons"], three["needs_review"], three["kw_per_unit"], three["year_built"]) == (0, 0.0, "", False, None, None)


def test_rows_of_buildings(spark):
    rows = projections.site_building_rows(spark.createDataFrame([building(1, 1, 50.0, ["x", "y"]), building(1, 2, 5.0, modules=None)], BUILDING))
    assert rows.columns == projections.SITE_BUILDING_COLUMNS and len(projections.BUILDING_COLUMNS) == 17
    a, b = rows.orderBy("overture_id").collect()
    assert (a["segment"], a["reasons"], a["flags"], a["gross_roof_area_m2"], a["counted"], a["calibration_factor"], a["distance_from_address_m"]) == ("geometric|R-2|flat", "x;y", "a;b", 500.0, True, 0.9765, 3.1)
    assert (b["segment"], b["module_count"], b["roof_type"], b["flags"], b["height_m"]) == ("geometric|R-2|", 0, None, "", None)
    assert "f2_site_rows" in __spark_entry__.queries()
