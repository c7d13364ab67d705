"""Geometry of the chunk grid as small generated tables and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import LAYER_SHIFT, Codec


def _axis(lo: int, hi: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long"))).alias(name)


def grid(s: SparkSession, side: int | tuple[int, int, int], start: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """(x, y, z): all coordinates of a box, generated by three explodes."""
    sides = (side,) * 3 if isinstance(side, int) else side
    df = s.range(1)
    for name, lo, n in zip("xyz", start, sides, strict=True):
        df = df.select(*(c for c in df.columns if c != "id"), *(["id"] if "id" in df.columns else []), _axis(lo, lo + n, name))
    return df.select("x", "y", "z")


def children(chunks: DataFrame, codec: Codec, layer: int) -> DataFrame:
    """(x, y, z, cx, cy, cz): the chunks of the layer below, clipped to its bounds."""
    for name, bound in zip("xyz", codec.layer_bounds(layer - 1), strict=True):
        chunks = chunks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(codec.fanout - 1)))).withColumn(f"c{name}", F.col(name) * codec.fanout + F.col("i")).drop("i").filter(F.col(f"c{name}") < bound)
    return chunks


def parents(chunks: DataFrame, codec: Codec, layer: int) -> DataFrame:
    """Adds layer, px, py, pz for the chunk's own and every higher layer; the two lowest layers share a grid."""
    up = chunks.withColumn("layer", F.explode(F.sequence(F.lit(layer), F.lit(codec.layers))))
    step = F.pow(F.lit(float(codec.fanout)), F.greatest(F.col("layer") - 2, F.lit(0)))
    for c in "xyz":
        up = up.withColumn(f"p{c}", F.floor(F.col(c) / step))
    return up.drop("x", "y", "z")


def _inside(s: SparkSession, codec: Codec, layer: int, at: tuple[int, int, int], below: int) -> tuple[DataFrame, int]:
    width = codec.fanout ** (layer - max(below, 2))
    bounds = codec.layer_bounds(below)
    start = tuple(a * width for a in at)
    return grid(s, tuple(min(width, b - o) for b, o in zip(bounds, start, strict=True)), start), width


def bounding(s: SparkSession, codec: Codec, layer: int, at: tuple[int, int, int], below: int) -> DataFrame:
    """Chunks of layer ``below`` on the six faces of a chunk."""
    cells, width = _inside(s, codec, layer, at, below)
    edge = F.lit(False)
    for c, a in zip("xyz", at, strict=True):
        edge = edge | F.col(c).isin(a * width, (a + 1) * width - 1)
    return cells.filter(edge)


def touching(s: SparkSession, codec: Codec, layer: int, at: tuple[int, int, int]) -> DataFrame:
    """Finest chunks on both sides of the middle planes, where a chunk's children meet."""
    cells, width = _inside(s, codec, layer, at, 2)
    middle = F.lit(False)
    for c, a in zip("xyz", at, strict=True):
        middle = middle | F.col(c).isin(a * width + width // 2 - 1, a * width + width // 2)
    return cells.filter(middle)


def in_box(codec: Codec, node: Column, box) -> Column:
    """Interval overlap of a node's chunk with a box given in finest chunks."""
    scale = F.pow(F.lit(float(codec.fanout)), F.greatest(codec.layer(node) - 2, F.lit(0)))
    out = F.lit(True)
    for i, (lo, hi) in enumerate(box):
        c = codec.coordinate(node, i)
        out = out & (c < F.lit(hi) / scale) & (c + 1 > F.lit(lo) / scale)
    return out


def stop_layers(chunks: DataFrame, codec: Codec) -> DataFrame:
    """(x, y, z, stop_layer): the lowest layer at which a chunk and its neighbours in the positive directions share one chunk."""
    up = chunks.withColumn("layer", F.explode(F.sequence(F.lit(2), F.lit(codec.layers))))
    step = F.pow(F.lit(float(codec.fanout)), F.col("layer") - 2)
    same = F.lit(True)
    for c in "xyz":
        same = same & (F.floor(F.col(c) / step) == F.floor((F.col(c) + 1) / step))
    return up.filter(same).groupBy("x", "y", "z").agg(F.min("layer").alias("stop_layer"))


def _place(codec: Codec, node: Column, axis: int, at: int) -> Column:
    """A coordinate of a node whose layer is known: constant shifts, so that expressions over it stay small."""
    b = codec.bits[at]
    return F.shiftrightunsigned(node, LAYER_SHIFT - (axis + 1) * b).bitwiseAND(F.lit(2**b - 1).cast("long"))


def ancestor(codec: Codec, node: Column, layer: int) -> Column:
    """First node of the chunk of ``layer`` that holds the chunk of a node of layer 1 or 2 (which share a grid)."""
    step, b = codec.fanout ** max(0, layer - 2), codec.bits[layer]
    return sum((F.floor(_place(codec, node, i, 2) / F.lit(step)) * F.lit(2 ** (LAYER_SHIFT - (i + 1) * b)) for i in range(3)), F.lit(layer * 2**LAYER_SHIFT + 1))


def on_boundary(codec: Codec, node: Column, layer: int) -> Column:
    """Whether the chunk of a node of layer 1 or 2 lies on a face of its chunk of ``layer``."""
    width = codec.fanout ** max(0, layer - 2)
    out = F.lit(False)
    for i in range(3):
        out = out | (_place(codec, node, i, 2) % width).isin(0, width - 1)
    return out


def bounding_below(chunks: DataFrame, codec: Codec, layer: int) -> DataFrame:
    """(x, y, z, below, cx, cy, cz): for chunks of ``layer`` their boundary chunks of every layer from 2 to the one below."""
    out = chunks.withColumn("below", F.explode(F.sequence(F.lit(2), F.lit(layer - 1))))
    out = out.withColumn("w", F.pow(F.lit(float(codec.fanout)), F.lit(layer) - F.col("below")).cast("long"))
    edge = F.lit(False)
    for c in "xyz":
        out = out.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1))).withColumn(f"c{c}", F.col(c) * F.col("w") + F.col("i")).drop("i")
        edge = edge | (F.col(f"c{c}") % F.col("w") == 0) | (F.col(f"c{c}") % F.col("w") == F.col("w") - 1)
    return out.filter(edge).drop("w")


def container_chunks(faces: DataFrame, bounds: tuple[int, int, int]) -> DataFrame:
    """(x, y, z, axis, cx, cy, cz) of faces (x, y, z, axis) between a chunk and the next one along an axis (0 to 2): the chunks whose
    files hold the face's data, those one step below the upper chunk along the axis and at most one along the others."""
    out = faces
    for i, (c, bound) in enumerate(zip("xyz", bounds, strict=True)):
        upper = F.col(c) + (F.col("axis") == i).cast("int")
        out = out.withColumn("d", F.explode(F.array(F.lit(0), F.lit(-1)))).filter((F.col("axis") != i) | (F.col("d") == -1))
        out = out.withColumn(f"c{c}", upper + F.col("d")).filter((F.col(f"c{c}") >= 0) & (F.col(f"c{c}") < bound)).drop("d")
    return out
