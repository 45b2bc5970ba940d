"""Selections that depend on what was selected before: one group at a time, in a stated order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def budgeted(df: DataFrame, group: str, order: list[str], budget: int) -> DataFrame:
    """The first rows of each group that a budget of look-ups reaches."""
    return df.withColumn("spent", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("spent") <= budget)


def covering_points(points: DataFrame, group: str, x: str, y: str, radius: float, most: int) -> DataFrame:
    """Farthest-point sampling: points of a group picked until all are within radius of one, at most so many.

    The first point of the group (by `ord`) is picked first; of equally far ones the first. Each pick is an
    aggregate over the points joined to their group's picks so far, so no group is gathered, however large.
    """
    point = F.struct(*points.columns)
    far = F.array_min(F.transform("x_picks", lambda p: F.hypot(F.col(x) - p[x], F.col(y) - p[y])))
    picks = points.groupBy(group).agg(F.array(F.min_by(point, "ord")).alias("x_picks"))
    for _ in range(most - 1):
        joined = points.join(picks.withColumnRenamed(group, "x_group"), F.col(group).eqNullSafe(F.col("x_group"))).withColumn("x_far", far)
        farthest = joined.groupBy(group).agg(F.first("x_picks").alias("x_picks"), F.max("x_far").alias("x_most"), F.min_by(point, F.struct(-F.col("x_far"), F.col("ord"))).alias("x_next"))
        picks = farthest.select(group, F.when(F.col("x_most") > radius, F.concat("x_picks", F.array("x_next"))).otherwise(F.col("x_picks")).alias("x_picks"))
    return picks.select(F.posexplode("x_picks").alias("x_pos", "x_point")).select("x_point.*", (F.col("x_pos") + 1).alias("pick"))


def raster_components(cells: DataFrame, raster: str, row: str, col: str, least: int) -> DataFrame:
    """Four-neighbour components of a raster's cells with at least so many cells: label, cells, box.

    A label is the smallest (row, column) of its component, as row * 2^20 + column. A raster is one
    surface model of bounded size.
    """

    def label(cells: pd.DataFrame) -> pd.DataFrame:
        at = {(int(r), int(c)): k for k, (r, c) in enumerate(zip(cells[row], cells[col]))}
        parent = list(range(len(cells)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for (r, c), k in at.items():
            for near in ((r, c + 1), (r + 1, c)):
                if near in at:
                    parent[find(at[near])] = find(k)
        work = cells.assign(root=[find(k) for k in range(len(cells))], label=cells[row].astype(int) * 2**20 + cells[col].astype(int))
        out = work.groupby("root").agg(label=("label", "min"), cells=("label", "size"), r0=(row, "min"), r1=(row, "max"), c0=(col, "min"), c1=(col, "max")).reset_index(drop=True)
        return out[out["cells"] >= least].assign(**{raster: cells[raster].iloc[0]})[[raster, "label", "cells", "r0", "r1", "c0", "c1"]]

    return cells.groupBy(raster).applyInPandas(label, f"{raster} long, label long, cells long, r0 long, r1 long, c0 long, c1 long")


def equipment_screen(found: DataFrame, short: str, long: str, area: str, compactness: str, flat: str, pitched: str) -> DataFrame:
    """Detected objects that look like equipment, small ones marked."""
    odd = (F.col(short) < 0.6) | ((F.col(long) > 4) & (F.col(long) / F.greatest(F.col(short), F.lit(1e-9)) > 4)) | (F.col(area) > 40) | (F.col(compactness) < 0.3) | (F.col(pitched) > F.col(flat))
    return found.where(~odd).withColumn("kind", F.when(F.col(area) < 0.5, "small_equipment").otherwise("equipment"))
