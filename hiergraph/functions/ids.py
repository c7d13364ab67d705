"""64-bit node ids as column expressions: layer in the top bits, chunk x, y, z, then the segment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYER_SHIFT = 56


def bits_per_axis(layers: int, spatial_bits: int = 10) -> dict[int, int]:
    """Bits of each chunk coordinate by layer; layer 1 shares the grid of layer 2."""
    if spatial_bits < layers - 2:
        raise ValueError("spatial_bits cannot hold the finest grid")
    bits = {layer: max(1, layers - layer) for layer in range(3, layers + 1)}
    bits[1] = bits[2] = spatial_bits
    return bits


def _power(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


@dataclass(frozen=True)
class Codec:
    layers: int = 5
    spatial_bits: int = 10
    fanout: int = 2
    bounds: tuple[int, int, int] = (8, 8, 8)

    @property
    def bits(self) -> dict[int, int]:
        return bits_per_axis(self.layers, self.spatial_bits)

    def _bits(self, layer: Column) -> Column:
        """Bits per axis of a layer (null outside 1..layers), by an array lookup: small generated code however often it is used."""
        return F.get(F.array(*(F.lit(self.bits[k]) for k in range(1, self.layers + 1))), layer - 1)

    def layer(self, node: Column) -> Column:
        return F.shiftrightunsigned(node, LAYER_SHIFT).cast("int")

    def coordinate(self, node: Column, axis: int) -> Column:
        b = self._bits(self.layer(node))
        return F.call_function("shiftrightunsigned", node, LAYER_SHIFT - (axis + 1) * b).bitwiseAND(_power(b) - 1)

    def segment_limit(self, layer: Column) -> Column:
        return _power(LAYER_SHIFT - 3 * self._bits(layer)) - 1

    def segment(self, node: Column) -> Column:
        return node.bitwiseAND(self.segment_limit(self.layer(node)))

    def chunk(self, node: Column) -> Column:
        return node - self.segment(node)

    def pack(self, layer: Column, x: Column, y: Column, z: Column, segment: Column | None = None) -> Column:
        b = self._bits(layer)
        top = _power(b)
        ok = (F.least(x, y, z) >= 0) & (F.greatest(x, y, z) < top)
        place = sum((c.cast("long") * _power(LAYER_SHIFT - (i + 1) * b) for i, c in enumerate((x, y, z))), layer.cast("long") * 2**LAYER_SHIFT)
        return F.when(ok, place + (F.lit(0) if segment is None else segment)).otherwise(F.raise_error(F.lit("coordinate out of range")).cast("long"))

    def layer_bounds(self, layer: int) -> tuple[int, ...]:
        return tuple(-(-b // 2 ** max(0, layer - 2)) for b in self.bounds)

    def cross_layer(self, a: Column, b: Column) -> Column:
        """Layer at which an edge first leaves a chunk: 1 + how many grids, fine to coarse, tell its ends apart."""
        pairs = [(self.coordinate(a, i), self.coordinate(b, i)) for i in range(3)]
        if self.fanout & (self.fanout - 1) == 0:
            # A grid tells two coordinates apart if they differ in a bit that it keeps, so the highest bit in which any axis differs says how many do.
            x, y, z = (p.bitwiseXOR(q) for p, q in pairs)
            bits = F.floor(F.log2(F.coalesce(x.bitwiseOR(y).bitwiseOR(z), F.lit(0)) + F.lit(0.5))) + 1
            return F.least(F.ceil(bits / F.lit(self.fanout.bit_length() - 1)).cast("int"), F.lit(self.layers - 2)) + 1
        gaps = F.array(*(F.struct(p.alias("p"), q.alias("q")) for p, q in pairs))

        def apart(k: Column) -> Column:
            step = F.pow(F.lit(float(self.fanout)), k)
            return F.exists(gaps, lambda g: F.floor(g["p"] / step) != F.floor(g["q"] / step))

        return F.size(F.filter(F.sequence(F.lit(0), F.lit(self.layers - 3)), apart)) + 1


def padded(node: Column) -> Column:
    """Text form whose byte order is the numeric order."""
    return F.lpad(node.cast("string"), 20, "0")


def floor_ms(ts: Column) -> Column:
    return F.date_trunc("MILLISECOND", ts)


def log_n(value: Column, base: float) -> Column:
    """Logarithm to any base."""
    return F.ln(value) / F.ln(F.lit(float(base)))
