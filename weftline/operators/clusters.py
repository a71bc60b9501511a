"""Clusters of a similarity graph and of points in the plane."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import connected_components
from weftline.shared import stored


def density_surface(points: DataFrame, grid: int = 60, bandwidth: float = 0.05) -> DataFrame:
    """ix, iy, density: Gaussian kernel density of weighted points (x, y in 0 to 1, weight) on a grid, cut at three
    bandwidths. Points are first summed in squares of a tenth of a bandwidth, so a crowd is a few rows."""
    reach, fine = 3 * bandwidth, bandwidth / 10
    snapped = points.groupBy(F.floor(F.col("x") / fine).alias("fx"), F.floor(F.col("y") / fine).alias("fy")).agg(F.sum(F.round(F.col("weight") * 1000).cast("long")).alias("w"))
    at = snapped.select(((F.col("fx") + 0.5) * fine).alias("x"), ((F.col("fy") + 0.5) * fine).alias("y"), "w")
    cells = lambda c: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - reach) * grid - 0.5).cast("int")), F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor((F.col(c) + reach) * grid - 0.5).cast("int"))))
    near = at.withColumn("ix", F.explode(cells("x"))).withColumn("iy", F.explode(cells("y")))
    dx, dy = (F.col("ix") + 0.5) / grid - F.col("x"), (F.col("iy") + 0.5) / grid - F.col("y")
    square = dx * dx + dy * dy
    mass = F.round(F.col("w") / 1000 * F.exp(-square / (2 * bandwidth**2)), 9).cast("decimal(28,9)")
    return near.where(square <= reach**2).groupBy("ix", "iy").agg(F.round(F.sum(mass).cast("double"), 4).alias("density"))


def density_peaks(surface: DataFrame, n: int = 10, share: float = 0.15, grid: int = 60) -> DataFrame:
    """ix, iy, density: inner cells that none of eight neighbours exceeds, with at least ``share`` of the maximum; the highest."""
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    around = surface.select("ix", "iy", "density", shifts.alias("s")).groupBy((F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy")).agg(F.max("density").alias("most"))
    top = surface.agg(F.max("density").alias("top"))
    inner = surface.where(F.col("ix").between(1, grid - 2) & F.col("iy").between(1, grid - 2))
    kept = inner.join(around, ["ix", "iy"], "left").crossJoin(F.broadcast(top)).where((F.col("density") >= F.coalesce("most", F.lit(0.0))) & (F.col("density") >= share * F.col("top")))
    return kept.orderBy(F.desc("density"), "ix", "iy").limit(n).select("ix", "iy", "density")


def density_clusters(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """id, cluster, is_core: density clusters of points (id string, x, y); noise has cluster null, border points the
    least cluster of the cores near them.

    Cells have a side of ``eps / sqrt(2)``, so points of one cell are all near each other: where a cell holds
    ``min_samples`` points all are cores and linked through the least, and no pairs are made inside it. Points of cells
    below that number are compared with the points near them. Cells of cores are linked where two boxes of their points lie within
    ``eps`` as a whole; only where no boxes decide, points of boxes at that distance are compared.
    """
    side = eps / 2**0.5
    placed = stored(points.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")), "cells")
    filled = placed.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    sized = stored(placed.join(filled, ["cx", "cy"]), "sized-cells")
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)]))
    asked = sized.where(F.col("n") < min_samples).select("id", "x", "y", shifts.alias("s"), "cx", "cy").select("id", "x", "y", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    other = placed.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy")
    near = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")) <= eps * eps
    met = asked.join(other, ["cx", "cy"]).where(near)
    sparse = met.groupBy("id").agg(F.count("*").alias("m")).where(F.col("m") >= min_samples).select("id")
    cores = stored(sized.where(F.col("n") >= min_samples).select("id").unionByName(sparse), "cores")
    core_points = stored(placed.join(cores, "id", "left_semi"), "core-points")
    # cells of cores are linked by one near pair of them
    hubs = core_points.groupBy("cx", "cy").agg(F.min("id").alias("hub"))
    # boxes of the points in an eighth of a cell's side decide most pairs of cells; points are compared in boxes that may or may not be near
    part = lambda c: F.floor(F.col(c) / (side / 8))
    fine = stored(core_points.select("x", "y", "cx", "cy", part("x").alias("fx"), part("y").alias("fy")).distinct(), "core-parts")
    boxes = fine.groupBy("cx", "cy", "fx", "fy").agg(*[f(c).alias(n) for n, f, c in (("lx", F.min, "x"), ("ux", F.max, "x"), ("ly", F.min, "y"), ("uy", F.max, "y"))])
    here = boxes.select(*[F.col(c).alias(f"h{c}") for c in boxes.columns], shifts.alias("s")).select("*", (F.col("hcx") + F.col("s.i")).alias("cx"), (F.col("hcy") + F.col("s.j")).alias("cy")).where((F.col("cx") > F.col("hcx")) | ((F.col("cx") == F.col("hcx")) & (F.col("cy") > F.col("hcy"))))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"l{c}") - F.col(f"hu{c}"), F.col(f"hl{c}") - F.col(f"u{c}"))
    span = lambda c: F.greatest(F.col(f"u{c}") - F.col(f"hl{c}"), F.col(f"hu{c}") - F.col(f"l{c}"))
    apart, across = gap("x") * gap("x") + gap("y") * gap("y"), span("x") * span("x") + span("y") * span("y")
    met_boxes = stored(here.join(boxes, ["cx", "cy"]).where(apart <= eps * eps).select("hcx", "hcy", "hfx", "hfy", "cx", "cy", "fx", "fy", (across <= eps * eps).alias("sure")), "core-boxes")
    ends = ["hcx", "hcy", "cx", "cy"]
    sure = met_boxes.where("sure").select(*ends).distinct()
    asked = met_boxes.where("not sure").join(sure, ends, "left_anti").join(fine.select("x", "y", *[F.col(c).alias(f"h{c}") for c in ("cx", "cy", "fx", "fy")]), ["hcx", "hcy", "hfx", "hfy"])
    close = asked.join(fine.select(F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy", "fx", "fy"), ["cx", "cy", "fx", "fy"]).where(near).select(*ends).distinct()
    cells = sure.unionByName(close).select(F.col("hcx").alias("hx"), F.col("hcy").alias("hy"), "cx", "cy")
    named = cells.join(hubs, ["cx", "cy"]).withColumnRenamed("hub", "dst").drop("cx", "cy").join(hubs.select(F.col("cx").alias("hx"), F.col("cy").alias("hy"), F.col("hub").alias("src")), ["hx", "hy"])
    of_hub = connected_components(hubs.select(F.col("hub").alias("node")), named.select("src", "dst"))
    labelled = stored(core_points.join(hubs, ["cx", "cy"]).join(of_hub.select(F.col("node").alias("hub"), F.col("component").alias("cluster")), "hub").select("id", "x", "y", "cx", "cy", "cluster"), "core-labels")
    rest = placed.join(cores, "id", "left_anti").select("id", "x", "y", "cx", "cy", shifts.alias("s")).select("id", "x", "y", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    border = rest.join(labelled.select(F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy", "cluster"), ["cx", "cy"]).where(near).groupBy("id").agg(F.min("cluster").alias("cluster"))
    found = labelled.select("id", "cluster", F.lit(True).alias("is_core")).unionByName(border.select("id", "cluster", F.lit(False).alias("is_core")))
    return points.select("id").join(found, "id", "left").select("id", "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core"))
