"""Edge tables (a, b, aff, area): membership, direction, crossing layers, ingest of chunks into layer-2 nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import Codec
from .graph import connected_components


def directed(edges: DataFrame, inside: Column) -> DataFrame:
    """Swap ends so that ``inside`` (of column a) holds for a wherever it holds for one end."""
    flip = ~inside & F.expr("TRUE")
    return edges.withColumn("x", F.when(flip, F.col("b")).otherwise(F.col("a"))).withColumn("y", F.when(flip, F.col("a")).otherwise(F.col("b"))).drop("a", "b").withColumnsRenamed({"x": "a", "y": "b"})


def categorized(edges: DataFrame, members: DataFrame, layer: Column) -> DataFrame:
    """Adds kind: in (both ends are members), out (only a, same chunk), cross (a is, the edge leaves the chunk); others go."""
    a, b = members.select(F.col("node").alias("a")), members.select(F.col("node").alias("b"), F.lit(True).alias("has_b"))
    j = edges.join(a.distinct(), "a", "left_semi").join(b.distinct(), "b", "left")
    return j.withColumn("kind", F.when(layer > 1, "cross").when(F.col("has_b"), "in").otherwise("out")).drop("has_b")


def least_crossing(cross: DataFrame) -> DataFrame:
    """Of (node, layer, ...) the rows of each node's first layer that has any."""
    w = Window.partitionBy("node")
    return cross.withColumn("first", F.min("layer").over(w)).filter("layer = first").drop("first")


def newest_attempt(nodes: DataFrame) -> DataFrame:
    """Of (node, segment, max_child) the highest segment for each max_child: what failed attempts wrote goes."""
    return nodes.groupBy("max_child").agg(F.max_by("node", "segment").alias("node"), F.max("segment").alias("segment"))


def _chunked(edges: DataFrame, codec: Codec) -> DataFrame:
    """Edges with the chunks (ca, cb) of their ends, read from the ids where they do not bring them."""
    return edges if "ca" in edges.columns else edges.withColumns({"ca": codec.chunk(F.col("a")), "cb": codec.chunk(F.col("b"))})


def layer_two(nodes: DataFrame, edges: DataFrame, codec: Codec) -> DataFrame:
    """(node, l2): one layer-2 node for each component inside a chunk; ids count up by least member within the chunk."""
    if "chunk" not in nodes.columns:
        nodes = nodes.withColumn("chunk", codec.chunk(F.col("node")))
    inner = _chunked(edges, codec).filter("ca = cb").select("a", "b").unionAll(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    comp = connected_components(inner).join(nodes.select("node", "chunk"), "node")
    firsts = comp.select("chunk", "root").distinct().withColumn("i", F.row_number().over(Window.partitionBy("chunk").orderBy("root")))
    # Layers 1 and 2 share a grid, so a chunk's layer-2 id is one layer up.
    return comp.join(firsts, ["chunk", "root"]).select("node", (F.col("chunk") + 2**56 + F.col("i")).alias("l2"))


def chunk_summary(l2: DataFrame, edges: DataFrame, codec: Codec) -> DataFrame:
    """(chunk, components, n_in, n_out) of layer-2 nodes (node, l2): edges are counted where their first end lies."""
    inner = codec.cross_layer(F.col("ca"), F.col("cb")) == 1
    kinds = _chunked(edges, codec).groupBy(F.col("ca").alias("chunk")).agg(F.count_if(inner).alias("n_in"), F.count_if(~inner).alias("n_out"))
    parts = l2.groupBy((codec.chunk(F.col("l2")) - 2**56).alias("chunk")).agg(F.count_distinct("l2").alias("components"))
    return parts.join(kinds, "chunk", "left").na.fill(0, ["n_in", "n_out"])


def node_cross_edges(l2: DataFrame, edges: DataFrame, codec: Codec) -> DataFrame:
    """(l2, layer, a, b): the edges that leave their chunk, from both sides, with the layer-2 node of their first end."""
    edges = _chunked(edges, codec)
    both = edges.select("a", "b", "ca", "cb").unionAll(edges.select("b", "a", "cb", "ca"))
    crossing = both.withColumn("layer", codec.cross_layer(F.col("ca"), F.col("cb"))).filter("layer > 1")
    return crossing.join(l2.select(F.col("node").alias("a"), "l2"), "a").select("l2", "layer", "a", "b")


def component_cross_edges(components: DataFrame, cross: DataFrame) -> DataFrame:
    """(root, layer, a, b): crossing edges (a, b, layer) whose first end lies in a component (node, root)."""
    return cross.join(components.select(F.col("node").alias("a"), "root"), "a").select("root", "layer", "a", "b")


def active_edges(edges: DataFrame, mapping: DataFrame, cross: Column) -> DataFrame:
    """(a, b, active, isolated) by a mapping (node, l2): crossing edges are active, others iff both ends are mapped to one
    component; isolated edges have an unmapped end."""
    named = lambda c, p: mapping.select(F.col("node").alias(c), F.col("l2").alias(p))
    j = edges.join(named("a", "p"), "a", "left").join(named("b", "q"), "b", "left")
    return j.select("a", "b", (cross | F.coalesce(F.col("p") == F.col("q"), F.lit(False))).alias("active"), (F.col("p").isNull() | F.col("q").isNull()).alias("isolated"))


def fake_edges_at(stored: DataFrame, chunks: DataFrame, at: str) -> DataFrame:
    """(chunk, a, b): all versions up to ``at`` of the fake edges (chunk, ts, a, b) of some chunks (chunk)."""
    return stored.filter(F.col("ts") <= F.lit(at).cast("timestamp_ntz")).join(chunks.select("chunk"), "chunk", "left_semi").select("chunk", "a", "b")


def merges_apart(components: DataFrame, asked: DataFrame) -> DataFrame:
    """(operation_id, source, sink, lo, hi): merges asked (operation_id, source, sink) whose ends lie in two components (node, root), lo < hi."""
    named = lambda c, r: components.select(F.col("node").alias(c), F.col("root").alias(r))
    ends = asked.join(named("source", "rs"), "source").join(named("sink", "rt"), "sink").filter("rs <> rt")
    return ends.select("operation_id", "source", "sink", F.least("rs", "rt").alias("lo"), F.greatest("rs", "rt").alias("hi"))


def inactive_between(edges: DataFrame, components: DataFrame, asked: DataFrame, active: str) -> DataFrame:
    """(operation_id, a, b): for merges asked (operation_id, source, sink), or those ``merges_apart`` found, the inactive edges between the two
    components (node, root) their ends lie in: what the merge turns active."""
    named = lambda c, r: components.select(F.col("node").alias(c), F.col("root").alias(r))
    j = edges.filter(f"NOT ({active})").join(named("a", "ra"), "a").join(named("b", "rb"), "b").filter("ra <> rb")
    keyed = j.select("a", "b", F.least("ra", "rb").alias("lo"), F.greatest("ra", "rb").alias("hi"))
    ends = asked if "lo" in asked.columns else merges_apart(components, asked)
    return ends.select("operation_id", "lo", "hi").join(keyed, ["lo", "hi"]).select("operation_id", "a", "b").distinct()


def layer_above(l2: DataFrame, edges: DataFrame, codec: Codec, layer: int) -> DataFrame:
    """(child, parent_root): components of layer-2 nodes over edges that stay within one chunk of ``layer``; parent_root is the least member."""
    named = lambda c: l2.select(F.col("node").alias(c), F.col("l2").alias(f"l{c}"))
    up = _chunked(edges, codec).filter(codec.cross_layer(F.col("ca"), F.col("cb")) < layer).join(named("a"), "a").join(named("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    every = l2.select(F.col("l2").alias("a"), F.col("l2").alias("b")).distinct()
    return connected_components(up.unionAll(every)).select(F.col("node").alias("child"), F.col("root").alias("parent_root"))


def lockable(locks: DataFrame, at: str, expiry_minutes: int = 3) -> DataFrame:
    """(root, free): free iff no indefinite lock, no superseding mark and no unexpired lock stands at ``at``, of (root, ts, kind)."""
    t = F.lit(at).cast("timestamp_ntz")
    seen = locks.filter(F.col("ts") <= t)
    held = (F.col("kind").isin("indefinite", "superseded")) | (F.col("ts") > t - F.expr(f"INTERVAL {expiry_minutes} MINUTES"))
    return seen.groupBy("root").agg((~F.bool_or(held)).alias("free"))


def lock_winners(wanted: DataFrame) -> DataFrame:
    """(operation_id, gets) of (operation_id, root): an operation gets its locks iff it comes first at each root it wants."""
    first = wanted.groupBy("root").agg(F.min("operation_id").alias("first"))
    return wanted.join(first, "root").groupBy("operation_id").agg(F.bool_and(F.col("operation_id") == F.col("first")).alias("gets"))


def new_ids(wanted: DataFrame, highest: DataFrame) -> DataFrame:
    """(chunk, item, segment): fresh segment numbers above each chunk's highest, of (chunk, item) and (chunk, top)."""
    w = Window.partitionBy("chunk").orderBy("item")
    return wanted.join(highest, "chunk", "left").select("chunk", "item", (F.coalesce("top", F.lit(0)) + F.row_number().over(w)).alias("segment"))
