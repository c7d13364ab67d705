"""Voxels (x, y, z, sv): nearest lookups and relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, connected_components


def nearest(points: DataFrame, voxels: DataFrame, radius: int) -> DataFrame:
    """(point, sv, d2): each point's nearest voxel within ``radius``; ties go to the least sv, points with none are absent.

    Space is cut into cells of side ``radius``; a place is sent to its 27 cells, so the join is an equi-join and a cell
    holds at most radius^3 voxels. Points of one place are looked up once. Neither side is broadcast: the optimizer takes a place's
    27 rows for one."""
    cell = lambda c, by=0: F.floor(F.col(c) / radius) + by
    p = points.select("x", "y", "z").distinct()
    for c in "xyz":
        p = p.withColumn(f"c{c}", F.explode(F.array(*(cell(c, k) for k in (-1, 0, 1)))))
    p = p.withColumnsRenamed({c: f"p{c}" for c in "xyz"})
    v = voxels.select("x", "y", "z", "sv", *(cell(c).alias(f"c{c}") for c in "xyz"))
    d2 = sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xyz")
    j = p.hint("merge").join(v, ["cx", "cy", "cz"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    found = j.groupBy(*(F.col(f"p{c}").alias(c) for c in "xyz")).agg(F.min_by("sv", F.struct("d2", "sv")).alias("sv"), F.min("d2").alias("d2"))
    return points.join(found, ["x", "y", "z"]).select("point", "sv", "d2")


def relabelled(voxels: DataFrame, mapping: DataFrame) -> DataFrame:
    """(x, y, z, label): voxels named by a mapping (sv, node); 0 where the mapping has none."""
    return voxels.join(mapping.select("sv", "node"), "sv", "left").select("x", "y", "z", F.coalesce("node", F.lit(0).cast("long")).alias("label"))


def chunk_volume(voxels: DataFrame, start: tuple[int, int, int], size: tuple[int, int, int], bounds: tuple[int, int, int], overlap: int = 1) -> DataFrame:
    """Voxels of a chunk with some overlap in the positive directions, clamped to the volume."""
    keep = F.lit(True)
    for c, a, n, top in zip("xyz", start, size, bounds, strict=True):
        keep = keep & (F.col(c) >= a) & (F.col(c) < min(a + n + overlap, top))
    return voxels.filter(keep)


def merged_vertices(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments' vertices (fragment, i, x, y, z): the distinct points (vertex, x, y, z) and (fragment, i, vertex).

    A point's id is the least (fragment, i) at it, so nothing has to be sorted as a whole."""
    points = vertices.groupBy("x", "y", "z").agg(F.min(F.struct("fragment", "i")).alias("vertex"))
    return points, vertices.join(points, ["x", "y", "z"]).select("fragment", "i", "vertex")


def clusters(points: DataFrame, radius: float) -> DataFrame:
    """(point, cluster): points (point, x, y, z) chained by distances under ``radius``; a cluster's id is its least point.

    Points of one place are one, named by the least of them; places are compared, points are not. Cells of side ``radius``: a
    place meets the places of its 27 cells only, by an equi-join that is never a broadcast."""
    cell = lambda c: F.floor(F.col(c) / radius)
    places = checkpointed(points.groupBy("x", "y", "z").agg(F.min("point").alias("point")))
    left = places.select("point", *(F.col(c).alias(f"p{c}") for c in "xyz"), *(cell(c).alias(f"c{c}") for c in "xyz"))
    right = places.select(F.col("point").alias("other"), *(F.col(c).alias(f"q{c}") for c in "xyz"), *(cell(c).alias(f"d{c}") for c in "xyz"))
    for c in "xyz":
        left = left.withColumn(f"d{c}", F.explode(F.array(*(F.col(f"c{c}") + k for k in (-1, 0, 1)))))
    d2 = sum((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "xyz")
    near = left.hint("merge").join(right, ["dx", "dy", "dz"]).filter((F.col("point") < F.col("other")) & (d2 < radius * radius)).select(F.col("point").alias("a"), F.col("other").alias("b"))
    every = places.select(F.col("point").alias("a"), F.col("point").alias("b"))
    of = connected_components(near.unionAll(every)).select(F.col("node").alias("place"), F.col("root").alias("cluster"))
    member = points.join(places.withColumnRenamed("point", "place"), ["x", "y", "z"]).select("point", "place")
    return member.join(of, "place").select("point", "cluster")
