"""Graph algorithms on edge DataFrames; bounded per-group kernels run in applyInPandas."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; one below the warehouse only where none is named."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: lineage is cut, and columns are compressed, which a checkpoint's rows are not."""
    at = scratch(df.sparkSession, f"table-{uuid.uuid4()}")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of few edges (u, v) in one task: trees hang below their least neighbouring tree until no edge is left between two."""
    parts = [(b["u"].to_numpy(np.int64), b["v"].to_numpy(np.int64)) for b in batches if len(b)]
    both = np.concatenate([x for i in (0, 1) for x in (p[i] for p in parts)]) if parts else np.empty(0, np.int64)
    ids, code = np.unique(both, return_inverse=True)
    a, b = code[: len(code) // 2], code[len(code) // 2 :]
    root = np.arange(len(ids))
    while len(a):
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    for i in range(0, len(ids), 500_000):
        yield pd.DataFrame({"node": ids[i : i + 500_000], "root": ids[root[i : i + 500_000]]})


def _united_near(batches: Iterator[pd.DataFrame], most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """(node, root) of edges (u, v) as they come, about ``most`` at a time: each lot hangs its nodes below the least they hang together with in it."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= most:
            yield from _united(iter(held))
            held, n = [], 0
    yield from _united(iter(held))


def _tops(up: DataFrame) -> DataFrame:
    """(u, root) of a forest (u, m) whose parents are less than their children, by doubling; nodes that know their root rest."""
    active, done = up.withColumn("ends", F.lit(False)), None
    while True:
        known = active if done is None else active.unionAll(done)
        above = known.select(F.col("u").alias("m"), F.col("m").alias("next"), F.col("ends").alias("next_ends"))
        told = checkpointed(active.join(above, "m", "left").select("u", F.coalesce("next", "m").alias("m"), (F.col("next").isNull() | F.col("next_ends")).alias("ends")))
        ended = told.filter("ends")
        done, active = ended if done is None else done.unionAll(ended), told.filter("NOT ends")
        if active.isEmpty():
            return done.select("u", F.col("m").alias("root"))


def near_components(edges: DataFrame, small: int = 1_000_000) -> DataFrame:
    """``connected_components`` of edges (a, b) that mostly hang together within a partition, as those of one order do. The same edge may come often.

    Every task first hangs what it reads below least nodes of its own, which moves nothing; a node then takes the least of its own roots, and the others
    are linked to that one. Only these links, one for each node and further root, go through levels."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = F.min("root").over(Window.partitionBy("node"))
    told = checkpointed(e.mapInPandas(_united_near, "node long, root long").repartition("node").distinct().withColumn("m", least))
    links = connected_components(told.filter("m < root").select(F.col("root").alias("a"), F.col("m").alias("b")), small)
    higher = links.select(F.col("node").alias("m"), F.col("root").alias("higher"))
    return told.filter("m = root").select("node", "m").join(higher, "m", "left").select("node", F.coalesce("higher", "m").alias("root"))


def connected_components(edges: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(node, root) of edges (a, b): the least node of each component. Self edges make their node known.

    Each node hangs below its least neighbour, if that is less than itself, and the forest's roots are found by doubling. The
    edges this leaves over, a node's others to lesser neighbours, are carried over to the roots and are the next level's
    graph, whose nodes had no lesser neighbour, so two levels leave half of the nodes at most. A level of at most ``small`` edges is
    done in one task. All levels but the first hold what cycles and forks are left, most often little."""
    e, levels, lone, lones = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), [], None, None
    while True:
        # One shuffle by u serves the distinct and the window.
        least = F.min(F.when(F.col("v") < F.col("u"), F.col("v"))).over(Window.partitionBy("u"))
        e = checkpointed(e.repartition("u").distinct().withColumn("m", least))
        lone = e.filter("u = v") if lone is None else lone
        # Self edges move nothing, so they do not count.
        links, alone = e.agg(F.count_if(F.expr("v < u")), F.count_if(F.expr("u = v"))).first()
        lones = alone if lones is None else lones
        if links <= small:
            found = checkpointed(e.filter("v < u").select("u", "v").coalesce(1).mapInPandas(_united, "node long, root long"))
            break
        up = _tops(e.filter("v = m").select("u", "m"))
        levels.append(up)
        rest = e.filter("m < v AND v < u").select("v", "m")
        ends = rest.select(F.explode(F.array("v", "m")).alias("u")).distinct()
        tops = checkpointed(up.join(ends, "u", "left_semi"))
        named = lambda c: tops.select(F.col("u").alias(c), F.col("root").alias(f"r{c}"))
        p, q = F.coalesce("rv", "v"), F.coalesce("rm", "m")
        e = rest.join(named("v"), "v", "left").join(named("m"), "m", "left").select(F.greatest(p, q).alias("u"), F.least(p, q).alias("v")).filter("u <> v")
    for up in reversed(levels):
        tops = up.select(F.col("root").alias("node")).unionAll(found.select("node")).distinct()
        higher = found.select(F.col("node").alias("top"), F.col("root").alias("higher"))
        every = up.select(F.col("u").alias("node"), F.col("root").alias("top")).unionAll(tops.select("node", F.col("node").alias("top")))
        found = every.join(higher, "top", "left").select("node", F.coalesce("higher", "top").alias("root"))
    if not lones:
        return found
    return found.unionAll(lone.select(F.col("u").alias("node")).join(found, "node", "left_anti").select("node", F.col("node").alias("root")))


def reachable(components: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``reachable`` to pairs (u, v): whether both lie in one of the components (node, root)."""
    cc = checkpointed(components)
    named = lambda c, r: cc.select(F.col("node").alias(c), F.col("root").alias(r))
    return pairs.join(named("u", "__p"), "u", "left").join(named("v", "__q"), "v", "left").withColumn("reachable", F.coalesce(F.col("__p") == F.col("__q"), F.lit(False))).drop("__p", "__q")


def densified(edges: DataFrame) -> DataFrame:
    """(node, dense): 0-based ranks of the node ids, made with a range partitioning rather than one sorted task."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().orderBy("node")
    placed = checkpointed(nodes.withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1).cast("long"))))
    sizes = placed.groupBy("part").agg((F.max("i") + 1).alias("n"))
    # A running sum over one row per partition.
    before = sizes.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("node", (F.col("before") + F.col("i")).alias("dense"))  # one row per partition


def shortest_paths(edges: DataFrame, sources: DataFrame, within: int | None = None, apart: bool = False) -> DataFrame:
    """(source, node, hops, path) by undirected hops from sources (source), to ``within`` hops or as far as they reach.

    Frontier joins, each frontier a table of its own; a neighbour of a frontier lies in it, in the one before or in the next, so only
    those two are looked up. Of several shortest paths the one whose last node but one is least counts. Where no two sources
    hang together (``apart``), a node is reached once, and the edges that leave a frontier are dropped behind it."""
    both = checkpointed(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    front = checkpointed(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops"), F.array("source").alias("path")).distinct())
    before, levels = front.limit(0), [front]
    while within is None or len(levels) <= within:
        reached = front.join(both, front["node"] == both["a"]).groupBy("source", "b").agg(F.min_by("path", "a").alias("path"))
        new = reached.select("source", F.col("b").alias("node"), F.lit(len(levels)).alias("hops"), F.concat("path", F.array("b")).alias("path"))
        seen = before.select("source", "node").unionAll(front.select("source", "node"))
        if apart:
            both = checkpointed(both.join(front.select(F.col("node").alias("a")), "a", "left_anti"))
        before, front = front, checkpointed(new.join(seen, ["source", "node"], "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
    return reduce(DataFrame.unionAll, levels)


def _paths_of(g: pd.DataFrame) -> pd.DataFrame:
    """(source, node, hops, path) in whole components (root, a, b), from each root; levels go on for all components at once."""
    ids, code = np.unique(np.concatenate([g["a"], g["b"]]).astype(np.int64), return_inverse=True)
    u, v = code, np.concatenate([code[len(g) :], code[: len(g)]])
    order = np.argsort(u, kind="stable")
    v, start = v[order], np.searchsorted(u[order], np.arange(len(ids) + 1))
    source, hops, path = np.empty(len(ids), np.int64), np.full(len(ids), -1, np.int32), np.empty(len(ids), object)
    text = ids.astype(str).astype(object)
    front = np.searchsorted(ids, np.unique(g["root"].to_numpy(np.int64)))
    source[front], hops[front], path[front] = ids[front], 0, text[front]
    while len(front):
        n = start[front + 1] - start[front]
        a = np.repeat(front, n)
        b = v[np.arange(len(a)) + np.repeat(start[front] - np.cumsum(n) + n, n)]
        new = hops[b] < 0
        a, b = a[new], b[new]
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        first = np.ones(len(b), bool)
        first[1:] = b[1:] != b[:-1]
        a, front = a[first], b[first]
        source[front], hops[front], path[front] = source[a], hops[a] + 1, path[a] + "," + text[front]
    return pd.DataFrame({"source": source, "node": ids, "hops": hops, "path": path})


def _paths_near(batches: Iterator[pd.DataFrame], most: int = 20_000) -> Iterator[pd.DataFrame]:
    """``_paths_of`` edges (root, a, b) in order of root, about ``most`` edges at a time; a component is never cut."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= most:
            g = pd.concat(held)
            last = g["root"] == g["root"].iloc[-1]
            if not last.all():
                yield _paths_of(g[~last])
            held, n = [g[last]], int(last.sum())
    if n:
        yield _paths_of(pd.concat(held))


def component_paths(edges: DataFrame, components: DataFrame, most: int = 2000) -> DataFrame:
    """(source, node, hops, path) from each component's root to all its nodes, as ``shortest_paths`` finds them; path is comma-joined.

    edges (a, b), one or more of each; components (node, root) of the same edges. Components of at most ``most`` edges are walked in one task each,
    larger ones by frontier joins: a task's paths stay bounded, no component is left out."""
    e = checkpointed(edges.join(components.select(F.col("node").alias("a"), "root"), "a").select("root", "a", "b"))
    large = checkpointed(e.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("root"))
    some = not large.isEmpty()
    few = e.join(large, "root", "left_anti") if some else e
    found = few.repartition("root").sortWithinPartitions("root").mapInPandas(_paths_near, "source long, node long, hops int, path string")
    if not some:
        return found
    far = shortest_paths(e.join(large, "root", "left_semi"), large.select(F.col("root").alias("source")), apart=True)
    return found.unionAll(far.select("source", "node", "hops", F.array_join("path", ",")))


def shortest_path(edges: DataFrame, source: int, target: int) -> DataFrame:
    """(hops, path) between two nodes; no row where they do not hang together."""
    start = edges.sparkSession.createDataFrame([(source,)], "source long")
    return shortest_paths(edges, start).filter(F.col("node") == target).select("hops", "path")


def contracted(edges: DataFrame, uncuttable: str = "aff = double('Infinity')") -> tuple[DataFrame, DataFrame]:
    """Merge the ends of uncuttable edges into their least id: (edges between merged nodes, mapping)."""
    merged = connected_components(edges.filter(uncuttable).select("a", "b"))
    return replaced(edges.filter(f"NOT ({uncuttable})"), merged), merged


def replaced(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """(a, b, aff): edges between merged nodes, by a mapping (node, root)."""
    named = lambda c: merged.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    left = edges.join(named("a"), "a", "left").join(named("b"), "b", "left")
    return left.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "aff").filter("a <> b")


def _min_cut(nodes: int, a: np.ndarray, b: np.ndarray, capacity: np.ndarray, s: int, t: int) -> tuple[float, np.ndarray]:
    """Dinic on an undirected graph: value, and which nodes lie on the source's side."""
    to, cap, adj = [], [], [[] for _ in range(nodes)]
    for x, y, c in zip(a.tolist(), b.tolist(), capacity.tolist(), strict=True):
        for p, q in ((x, y), (y, x)):
            adj[p].append(len(to))
            to.append(q)
            cap.append(c)
    flow = 0.0
    while True:
        level = [-1] * nodes
        level[s], queue = 0, [s]
        for u in queue:
            for e in adj[u]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return flow, np.array([x >= 0 for x in level])
        at = [0] * nodes
        while True:
            path, u = [], s
            while u != t:
                while at[u] < len(adj[u]):
                    e = adj[u][at[u]]
                    if cap[e] > 0 and level[to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(adj[u]):
                    path.append(adj[u][at[u]])
                    u = to[path[-1]]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break
            if u != t:
                break
            push = min(cap[e] for e in path)
            flow += push
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push


def min_cuts(edges: DataFrame) -> DataFrame:
    """(op_id, a, b, aff, value): the cut edges of each group's minimum cut, of (op_id, a, b, aff, source, sink); an edit's local graph is bounded by its box."""

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        ids, code = np.unique(np.concatenate([g["a"], g["b"]]), return_inverse=True)
        a, b = code[: len(g)], code[len(g) :]
        where = {x: i for i, x in enumerate(ids.tolist())}
        s, t = where.get(g["source"].iloc[0]), where.get(g["sink"].iloc[0])
        if s is None or t is None or s == t:
            return g.iloc[:0].assign(value=0.0)[["op_id", "a", "b", "aff", "value"]]
        value, side = _min_cut(len(ids), a, b, g["aff"].to_numpy(float), s, t)
        return g[side[a] != side[b]].assign(value=value)[["op_id", "a", "b", "aff", "value"]]

    return edges.groupBy("op_id").applyInPandas(cut, "op_id long, a long, b long, aff double, value double")
