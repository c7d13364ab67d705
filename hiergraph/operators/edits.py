"""Edits of a hierarchy: merges and splits as one set-based rebuild of the trees they touch.

A graph is ``parents`` (child_id, parent_id, ts) over layers 1 to codec.layers and ``edges`` (a, b) between
supervoxels, the active ones. An edit adds and removes edges, of any number of operations at once; ids are never
reused, and nodes whose children stay the same keep their id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import Codec
from .graph import checkpointed, connected_components
from .hierarchy import descend, layer_of, parents_at, roots, tops


@dataclass(frozen=True)
class Edited:
    #: (child_id, parent_id, ts): rows to append
    parents: DataFrame
    #: (a, b): the active edges after the edit
    edges: DataFrame
    #: makes the lineage when it is asked for
    _lineage: Callable[[], DataFrame]

    @cached_property
    def lineage(self) -> DataFrame:
        """(old_root, new_root, ts)"""
        return self._lineage()


def checked_merges(asked: DataFrame, parents: DataFrame, codec: Codec, allow_same_root: bool = False) -> DataFrame:
    """Adds ``error`` (null: none) to merges (operation_id, a, b): self loops, ends that are no supervoxels, ends of one root."""
    found = _with_roots(asked, parents, codec)
    same = F.lit(False) if allow_same_root else F.col("root_a") == F.col("root_b")
    return found.withColumn("error", F.when(F.col("a") == F.col("b"), "self loop").when((codec.layer(F.col("a")) != 1) | (codec.layer(F.col("b")) != 1), "not a supervoxel").when(F.col("root_a").isNull() | F.col("root_b").isNull(), "unknown node").when(same, "one root"))


def checked_splits(asked: DataFrame, parents: DataFrame, codec: Codec) -> DataFrame:
    """Adds ``error`` to splits (operation_id, a, b), a source and a sink or the ends of an edge: they must lie in one root."""
    found = _with_roots(asked, parents, codec)
    return found.withColumn("error", F.when(F.col("a") == F.col("b"), "source is sink").when((codec.layer(F.col("a")) != 1) | (codec.layer(F.col("b")) != 1), "not a supervoxel").when(F.col("root_a").isNull() | F.col("root_b").isNull(), "unknown node").when(F.col("root_a") != F.col("root_b"), "several roots"))


def _with_roots(asked: DataFrame, parents: DataFrame, codec: Codec) -> DataFrame:
    ends = asked.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    known = ends.join(parents.select(F.col("child_id").alias("id")).distinct(), "id", "left_semi")
    of = checkpointed(roots(known, parents, codec.layers))
    return asked.join(of.select(F.col("id").alias("a"), F.col("root").alias("root_a")), "a", "left").join(of.select(F.col("id").alias("b"), F.col("root").alias("root_b")), "b", "left")


def fake_edges(merges: DataFrame, inactive: DataFrame) -> DataFrame:
    """(operation_id, a, b, fake) for merges (operation_id, a, b): the inactive edges (operation_id, a, b) found between
    the two roots, or, where there are none, the asked pair itself as an edge that the segmentation does not have."""
    bare = merges.join(inactive.select("operation_id").distinct(), "operation_id", "left_anti")
    return inactive.select("operation_id", "a", "b", F.lit(False).alias("fake")).unionAll(bare.select("operation_id", "a", "b", F.lit(True).alias("fake")))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _chunk_at(codec: Codec, node: Column, layer: int) -> Column:
    """The chunk of ``layer`` that a node of a lower layer lies in."""
    shrink = F.pow(F.lit(float(codec.fanout)), layer - F.greatest(codec.layer(node), F.lit(2)))
    return codec.pack(F.lit(layer), *(F.floor(codec.coordinate(node, i) / shrink) for i in range(3)))


def _numbered(groups: DataFrame, top: DataFrame | None, codec: Codec, each: int = 100_000) -> DataFrame:
    """(chunk, key, id): new ids for groups (chunk, key), above each chunk's highest segment ``top`` (chunk, top).

    The uppermost chunk holds the whole graph's groups, so more than ``each`` are dealt out by hash and every part counts in steps of the
    parts' number: no task sorts a whole chunk, and few numbers are left out."""
    parts = max(1, groups.count() // each)
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    n = (F.row_number().over(Window.partitionBy("chunk", "part").orderBy("key")) - 1) * F.lit(parts) + F.col("part") + 1
    counted = groups.withColumn("part", part).select("chunk", "key", n.alias("n"))
    if top is None:
        return counted.select("chunk", "key", (F.col("chunk") + F.col("n")).alias("id"))
    return counted.join(top, "chunk", "left").select("chunk", "key", (F.col("chunk") + F.coalesce("top", F.lit(0)) + F.col("n")).alias("id"))


def rebuilt(l2: DataFrame, cross: DataFrame, old: DataFrame | None, top: DataFrame | None, codec: Codec) -> DataFrame:
    """(child_id, parent_id) of the layers above layer-2 nodes (node), joined by ``cross`` (a, b, layer), layer being that at
    which an edge still crosses chunks.

    A node whose lowest crossing edge lies at its own layer shares a parent one layer up with all that such edges reach;
    if it lies higher, the node's only parent is at that layer; a node without any hangs below a root of its own.
    A parent with the same children as one in ``old`` (child_id, parent_id) is that one. Edges climb along with the nodes, so a layer
    reads its own nodes and the edges that are left, no longer those of layer 2."""
    size = None if old is None else checkpointed(old.groupBy("parent_id").agg(F.count("*").alias("n_old")))
    nodes, out = l2.select("node").distinct(), None
    for p in range(3, codec.layers + 1):
        least = cross.select(F.explode(F.array("a", "b")).alias("node"), "layer").groupBy("node").agg(F.min("layer").alias("layer"))
        due = F.lit(p == codec.layers) | F.coalesce(F.col("layer").isin(p - 1, p), F.lit(False))
        nodes = checkpointed(nodes.join(least, "node", "left").select("node", due.alias("due")))
        alone = nodes.filter("due").select(F.col("node").alias("a"), F.col("node").alias("b"))
        comp = checkpointed(connected_components(cross.filter(F.col("layer") == p - 1).select("a", "b").unionAll(alone)))
        if old is None:
            named, lone = None, comp.filter("node = root").select("root")
        else:
            kin = comp.join(old, comp["node"] == old["child_id"], "left").groupBy("root").agg(F.count("*").alias("n"), F.min("parent_id").alias("lo"), F.max("parent_id").alias("hi"), F.count("parent_id").alias("had"))
            kin = kin.join(size, kin["lo"] == size["parent_id"], "left").drop("parent_id")
            same = (F.col("lo") == F.col("hi")) & (F.col("had") == F.col("n")) & (F.col("n") == F.col("n_old")) & (layer_of(F.col("lo")) == p)
            kin = checkpointed(kin.select("root", F.when(same, F.col("lo")).alias("kept")))
            named, lone = kin.filter("kept IS NOT NULL").select("root", F.col("kept").alias("parent_id")), kin.filter("kept IS NULL").select("root")
        fresh = _numbered(lone.select(_chunk_at(codec, F.col("root"), p).alias("chunk"), F.col("root").alias("key")), top, codec).select(F.col("key").alias("root"), F.col("id").alias("parent_id"))
        put = checkpointed(comp.join(fresh if named is None else named.unionAll(fresh), "root").select(F.col("node").alias("child_id"), "parent_id"))
        out = put if out is None else out.unionAll(put)
        if p < codec.layers:
            up = lambda c, put=put: put.select(F.col("child_id").alias(c), F.col("parent_id").alias(f"p{c}"))
            left = cross.filter(F.col("layer") >= p).join(up("a"), "a", "left").join(up("b"), "b", "left")
            cross = checkpointed(left.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"), "layer").distinct())
            nodes = nodes.filter("NOT due").select("node").unionAll(put.select(F.col("parent_id").alias("node")).distinct())
    return out


def _crossing(active: DataFrame, sv: DataFrame, codec: Codec) -> DataFrame:
    """(a, b, layer) between the layer-2 nodes of supervoxels (sv, l2): the edges that leave their chunks."""
    leaving = active.withColumn("layer", codec.cross_layer(F.col("a"), F.col("b"))).filter("layer > 1")
    named = lambda c: sv.select(F.col("sv").alias(c), F.col("l2").alias(f"l{c}"))
    return checkpointed(leaving.join(named("a"), "a").join(named("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"), "layer").distinct())


def _layer_two(loose: DataFrame, active: DataFrame, top: DataFrame | None, codec: Codec) -> DataFrame:
    """(sv, l2): new layer-2 nodes of loose supervoxels (sv), one for each component of the active edges inside a chunk."""
    inside = active.filter(codec.chunk(F.col("a")) == codec.chunk(F.col("b"))).join(loose.withColumnRenamed("sv", "a"), "a", "left_semi").select("a", "b")
    comp = checkpointed(connected_components(inside.unionAll(loose.select(F.col("sv").alias("a"), F.col("sv").alias("b")))))
    # Layers 1 and 2 share a grid, so a chunk's layer-2 id is one layer up.
    firsts = comp.filter("node = root").select((codec.chunk(F.col("root")) + 2**56).alias("chunk"), F.col("root").alias("key"))
    fresh = _numbered(firsts, top, codec).select(F.col("key").alias("root"), F.col("id").alias("l2"))
    return checkpointed(comp.join(fresh, "root").select(F.col("node").alias("sv"), "l2"))


def apply_edits(parents: DataFrame, edges: DataFrame, codec: Codec, ts: str, added: DataFrame | None = None, removed: DataFrame | None = None, nodes: DataFrame | None = None) -> Edited:
    """Add and remove edges (a, b) at ``ts``; ``nodes`` (node) are supervoxels that have no parent yet, as at ingest.

    Every layer-2 node that an edge's end lies in is made anew from the components of its supervoxels, then the roots
    above are rebuilt. Nothing but those roots is read."""
    none = edges.select("a", "b").limit(0)
    added, removed = _ordered(none if added is None else added), _ordered(none if removed is None else removed)
    active = checkpointed(_ordered(edges).unionAll(added).distinct().join(removed, ["a", "b"], "left_anti"))
    up = checkpointed(parents_at(parents))
    # Of all versions: an id that is no longer anyone's parent is not given again.
    ids = parents.select(F.explode(F.array("child_id", "parent_id")).alias("id"))
    top = checkpointed(ids.groupBy(codec.chunk(F.col("id")).alias("chunk")).agg(F.max(codec.segment(F.col("id"))).alias("top")))
    both = added.unionAll(removed)
    touched = both.select(F.explode(F.array("a", "b")).alias("child_id")).distinct()
    stale = checkpointed(touched.join(up, "child_id").select(F.col("parent_id").alias("l2")).distinct())
    gone = tops(stale.select(F.col("l2").alias("id")), up, codec.layers - 1).select(F.col("root").alias("seed")).distinct()
    under = checkpointed(descend(checkpointed(gone), up, codec.layers, 1).select("seed", "layer", "node"))
    inner = up.join(under.filter("layer > 1").select(F.col("node").alias("parent_id")), "parent_id", "left_semi")
    inner = checkpointed(inner.select("child_id", "parent_id"))
    old_sv = inner.filter(layer_of(F.col("child_id")) == 1).select(F.col("child_id").alias("sv"), F.col("parent_id").alias("l2"))
    loose = old_sv.join(stale, "l2", "left_semi").select("sv")
    if nodes is not None:
        loose = loose.unionAll(nodes.select(F.col("node").alias("sv"))).distinct()
    made = _layer_two(checkpointed(loose), active, top, codec)
    sv = checkpointed(made.unionAll(old_sv.join(stale, "l2", "left_anti").select("sv", "l2")))
    above = inner.filter(layer_of(F.col("child_id")) > 1)
    tree = rebuilt(sv.select(F.col("l2").alias("node")), _crossing(active, sv, codec), above, top, codec)
    stamp = F.lit(ts).cast("timestamp_ntz").alias("ts")
    new = made.select(F.col("sv").alias("child_id"), F.col("l2").alias("parent_id")).unionAll(tree.join(above, ["child_id", "parent_id"], "left_anti"))
    new = checkpointed(new.select("child_id", "parent_id", stamp))

    def lineage() -> DataFrame:
        before = under.filter("layer = 1").select(F.col("node").alias("sv"), F.col("seed").alias("old_root"))
        after = tops(sv.select(F.col("l2").alias("id")), tree, codec.layers - 1).select(F.col("id").alias("l2"), F.col("root").alias("new_root"))
        return checkpointed(before.join(sv, "sv").join(after, "l2").filter("old_root <> new_root").select("old_root", "new_root", stamp).distinct())

    return Edited(new, active, lineage)


def build(nodes: DataFrame, edges: DataFrame, codec: Codec, ts: str) -> Edited:
    """A whole hierarchy of supervoxels (node) and active edges (a, b): the edit of an empty graph, without looking for what it replaces."""
    active = checkpointed(_ordered(edges))
    made = _layer_two(nodes.select(F.col("node").alias("sv")).distinct(), active, None, codec)
    tree = rebuilt(made.select(F.col("l2").alias("node")), _crossing(active, made, codec), None, None, codec)
    stamp = F.lit(ts).cast("timestamp_ntz").alias("ts")
    new = made.select(F.col("sv").alias("child_id"), F.col("l2").alias("parent_id")).unionAll(tree).select("child_id", "parent_id", stamp)
    return Edited(new, active, lambda: new.select(F.col("child_id").alias("old_root"), F.col("parent_id").alias("new_root"), "ts").limit(0))


def undone(operation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) that take back an operation (a, b, added): its added edges go, its removed edges come back."""
    return operation.filter("NOT added").select("a", "b"), operation.filter("added").select("a", "b")


def transactions(ops: DataFrame, read_only: bool = False) -> DataFrame:
    """(operation_id, step, status) of ops (operation_id, locked, valid, raised): what each operation writes to its log, in order.

    An operation that does not get its locks writes nothing. The others are created; one that breaks a pre- or postcondition
    (valid is false) stays so, one that fails unexpectedly (raised) logs an exception. Before the rows themselves are written
    the start is logged, after them the success; a read-only graph stops before the write."""
    done = F.array(F.lit("created")) if read_only else F.array(F.lit("created"), F.lit("write_started"), F.lit("success"))
    said = F.when(F.col("raised"), F.array(F.lit("created"), F.lit("exception"))).when(~F.col("valid"), F.array(F.lit("created"))).otherwise(done)
    return ops.filter("locked").select("operation_id", F.posexplode(said).alias("step", "status"))


def repairable(log: DataFrame) -> DataFrame:
    """(operation_id, status): operations (operation_id, step, status) that started to write and did not succeed: to be run
    again on the hierarchy as it was when they were created."""
    last = log.groupBy("operation_id").agg(F.max_by("status", "step").alias("status"))
    return last.filter("status = 'write_started'")


def as_of(parents: DataFrame, ts: str) -> DataFrame:
    """The rows of a hierarchy before a time: the state an operation of that time is replayed on."""
    return parents.filter(F.col("ts") < F.lit(ts).cast("timestamp_ntz"))


def repaired(parents: DataFrame, edges: DataFrame, codec: Codec, ts: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> Edited:
    """Replay a failed edit on the state just before ``ts``; what it wrote then, if anything, is left out of that state."""
    return apply_edits(as_of(parents, ts), edges, codec, ts, added, removed)
