"""Quantisation of mesh vertices: integer grids on which the chunks of a layer snap alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps after which any range of 64 bits is wide enough.
_STEPS = 64


def quantization(least_range: Column, most_bin: float) -> Column:
    """struct<bits, bin, range>: the fewest bits whose bins, of whole size and at most ``most_bin`` wide, span the range and one bin more.

    A size that fits is tried one larger where it leaves no spare bin; where it may not grow, one more bit is taken."""
    start = F.ceil(F.log2(least_range / F.lit(most_bin) + 1)).cast("int")

    def step(i: Column) -> Column:
        bits = start + i
        bins = F.pow(F.lit(2.0), bits) - 1
        size = F.ceil(least_range / bins).cast("double")
        short = size * bins < least_range + size
        wide = F.when(short, size + 1).otherwise(size)
        return F.struct(bits.alias("bits"), wide.alias("bin"), (wide * bins).alias("range"), (short & (size == most_bin)).alias("again"))

    fits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(_STEPS - 1)), step), lambda x: ~x["again"])[0]
    return F.struct(fits["bits"].alias("bits"), fits["bin"].alias("bin"), fits["range"].alias("range"))


def quantization_origin(offset: Column, size: Column) -> Column:
    """The grid point at or below a chunk's offset."""
    return offset - offset % size
