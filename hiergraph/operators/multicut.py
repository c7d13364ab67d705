"""Cuts between two teams of supervoxels, one local graph per operation.

An operation's graph is what its box holds, so it is bounded and is cut by one call of a kernel; operations are
spread over the cluster. A cut that cannot be made is a row with an ``error``, never a failed job."""

from __future__ import annotations

import heapq
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _min_cut

_EPS = np.finfo(np.float64).eps


class CutError(Exception):
    """The labels, the graph or the cut itself rule the operation out."""


class Graph(NamedTuple):
    """Undirected, nodes 0..n-1, with the adjacency as lists of (neighbour, edge number)."""

    n: int
    a: np.ndarray
    b: np.ndarray
    aff: np.ndarray
    near: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, n: int, a: np.ndarray, b: np.ndarray, aff: np.ndarray) -> Graph:
        near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            near[x].append((y, i))
            near[y].append((x, i))
        return cls(n, a, b, aff, near)

    def components(self, gone: set[int] = frozenset()) -> np.ndarray:
        """A component number for each node, without the edges that are gone."""
        out, k = np.full(self.n, -1), 0
        for s in range(self.n):
            if out[s] < 0:
                out[s], todo = k, [s]
                for u in todo:
                    for v, e in self.near[u]:
                        if out[v] < 0 and e not in gone:
                            out[v] = k
                            todo.append(v)
                k += 1
        return out


class Path(NamedTuple):
    nodes: list[int]
    edges: list[int]
    cost: float


def cheapest_path(g: Graph, source: int, target: int, omit: set[int]) -> Path | None:
    """The path of least summed 1 / affinity that avoids some nodes."""
    if source in omit or target in omit:
        return None
    cost, back, heap, done = {source: 0.0}, {}, [(0.0, source)], set()
    while heap:
        c, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == target:
            break
        for v, e in g.near[u]:
            d = c + 1 / (g.aff[e] + _EPS)
            if v not in omit and d < cost.get(v, np.inf):
                cost[v], back[v] = d, (u, e)
                heapq.heappush(heap, (d, v))
    if target not in done:
        return None
    nodes, edges, u = [target], [], target
    while u != source:
        u, e = back[u]
        nodes.append(u)
        edges.append(e)
    return Path(nodes[::-1], edges[::-1], cost[target])


def team_paths(g: Graph, team: list[int], omit: set[int]) -> list[Path]:
    """Cheapest paths between all pairs of a team; an unreachable pair is an error."""
    found = [cheapest_path(g, x, y, omit) for x, y in combinations(team, 2)]
    if any(p is None or not p.edges for p in found):
        raise CutError("a team is not connected around the other team")
    return found


def _nodes(paths: list[Path]) -> set[int]:
    return {v for p in paths for v in p.nodes}


def _whole(g: Graph, nodes: set[int], edges: set[int]) -> bool:
    """Whether the edges hold the nodes together."""
    root = {v: v for v in nodes}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for e in edges:
        root[find(int(g.a[e]))] = find(int(g.b[e]))
    return len({find(v) for v in nodes}) <= 1


def _mean_cost(paths: list[Path]) -> float:
    return float(np.exp(np.mean([np.log(p.cost) for p in paths]))) if paths else 0.0


def augmenting_edges(g: Graph, sources: list[int], sinks: list[int]) -> tuple[set[int], set[int]]:
    """Edges that hold each team together, of its paths around the other team.

    Where the teams' paths meet, edges at shared nodes are left out; if that breaks a team, the team with the cheaper
    paths keeps them and the other one looks for paths around them, and failing that the other way round."""
    s, t = team_paths(g, sources, set(sinks)), team_paths(g, sinks, set(sources))
    es, et = {e for p in s for e in p.edges}, {e for p in t for e in p.edges}
    shared = _nodes(s) & _nodes(t)
    if not shared:
        return es, et
    free = lambda edges: {e for e in edges if int(g.a[e]) not in shared and int(g.b[e]) not in shared}
    if _whole(g, _nodes(s), free(es)) and _whole(g, _nodes(t), free(et)):
        return free(es), free(et)
    first = _mean_cost(s) < _mean_cost(t)
    for source_keeps in (first, not first):
        try:
            if source_keeps:
                return es, {e for p in team_paths(g, sinks, _nodes(s)) for e in p.edges}
            return {e for p in team_paths(g, sources, _nodes(t)) for e in p.edges}, et
        except CutError:
            continue
    raise CutError("the teams' paths overlap")


class Cut(NamedTuple):
    #: numbers of the cut edges, the cut's value, whether the teams are cleanly apart, a component for each node
    edges: list[int]
    value: float
    clean: bool
    component: np.ndarray


def cut_teams(g: Graph, sources: list[int], sinks: list[int], path_augment: bool = True, isolating: bool = False, preview: bool = False) -> Cut:
    """The least cut that parts two teams; ``isolating`` allows a side that is nothing but labelled points and their paths."""
    if not sources or not sinks:
        raise CutError("a team is empty")
    if set(sources) & set(sinks):
        raise CutError("uncuttable edges join the teams")
    if not len(g.a):
        raise CutError("nothing can be cut")
    whole = g.components()
    if len({int(whole[v]) for v in (*sources, *sinks)}) > 1:
        raise CutError("the teams are not in one component")
    cap = g.aff.astype(float).copy()
    most = 2 * cap.sum() + 1
    a, b = g.a, g.b
    held = [set(sources), set(sinks)]
    if path_augment:
        es, et = augmenting_edges(g, sources, sinks)
        cap[sorted(es | et)] = most
        for team, edges in zip(held, (es, et), strict=True):
            team |= {int(x) for e in edges for x in (g.a[e], g.b[e])}
    else:
        # Edges that cannot be cut between the first of a team and the others.
        extra = [(t[0], v) for t in (sources, sinks) for v in t[1:]]
        a, b = np.append(a, [x for x, _ in extra]).astype(int), np.append(b, [y for _, y in extra]).astype(int)
        cap = np.append(cap, np.full(len(extra), most))
    value, side = _min_cut(g.n, a, b, cap, sources[0], sinks[0])
    cut = [int(e) for e in np.flatnonzero(side[g.a] != side[g.b])]
    left = g.components(set(cut))
    clean = len({int(left[v]) for v in sources}) == 1 and len({int(left[v]) for v in sinks}) == 1 and left[sources[0]] != left[sinks[0]] and value < most
    if not clean and not preview:
        raise CutError("no cut parts the teams cleanly")
    if not isolating:
        labelled = set(sources) | set(sinks)
        for team in held:
            mine = {int(v) for v in np.flatnonzero(left == left[next(iter(team))])}
            if mine == team and not all(u in labelled for v in mine for u, _ in g.near[v]):
                if not preview:
                    raise CutError("the cut would isolate labelled points")
                clean = False
    return Cut(cut, float(g.aff[cut].sum()), clean, left)


def _local(g: pd.DataFrame, teams: pd.DataFrame) -> tuple[Graph, np.ndarray, np.ndarray, list[int], list[int]]:
    """Graph with nodes joined by uncuttable (infinite) edges merged; (graph, its edges' rows, ids' nodes, sources, sinks)."""
    ids, code = np.unique(np.concatenate([g["a"].to_numpy(), g["b"].to_numpy(), teams["node"].to_numpy()]), return_inverse=True)
    a, b, aff = code[: len(g)], code[len(g) : 2 * len(g)], g["aff"].to_numpy(float)
    fixed = np.isinf(aff)
    merged = Graph.of(len(ids), a[fixed], b[fixed], aff[fixed]).components()
    x, y = merged[a], merged[b]
    rows = np.flatnonzero(~fixed & (x != y))
    graph = Graph.of(int(merged.max(initial=-1)) + 1, x[rows], y[rows], aff[rows])
    of = dict(zip(ids.tolist(), merged.tolist(), strict=True))
    team = lambda k: list(dict.fromkeys(of[v] for v in sorted(teams.loc[teams["team"] == k, "node"].tolist())))
    return graph, rows, merged, team("source"), team("sink")


def multicuts(edges: DataFrame, teams: DataFrame, path_augment: bool = True, isolating: bool = False) -> DataFrame:
    """(op_id, a, b, aff, value, error): the cut edges of each operation, or one row with the reason why there is no cut.

    edges (op_id, a, b, aff), infinite where uncuttable; teams (op_id, node, team), team being source or sink."""

    def cut(g: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        op = (t if len(t) else g)["op_id"].iloc[0]
        try:
            graph, rows, _, sources, sinks = _local(g, t)
            c = cut_teams(graph, sources, sinks, path_augment, isolating)
            if not c.edges:
                raise CutError("no edge was cut")
            out = g.iloc[rows[c.edges]][["op_id", "a", "b", "aff"]]
            return out.assign(value=c.value, error=None)
        except CutError as e:
            return pd.DataFrame({"op_id": [op], "a": [None], "b": [None], "aff": [None], "value": [None], "error": [str(e)]}).astype({"a": "Int64", "b": "Int64", "aff": float, "value": float})

    return edges.select("op_id", "a", "b", "aff").groupBy("op_id").cogroup(teams.select("op_id", "node", "team").groupBy("op_id")).applyInPandas(cut, "op_id long, a long, b long, aff double, value double, error string")


def split_previews(edges: DataFrame, teams: DataFrame, path_augment: bool = True, isolating: bool = False) -> DataFrame:
    """(op_id, part, node, illegal, error): components of each local graph after its cut. Part 0 holds the most sources, part 1 the
    most sinks, others follow by least node; a cut that would be refused is only marked illegal."""

    def show(g: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        op = (t if len(t) else g)["op_id"].iloc[0]
        try:
            graph, _, merged, sources, sinks = _local(g, t)
            c = cut_teams(graph, sources, sinks, path_augment, isolating, preview=True)
        except CutError as e:
            return pd.DataFrame({"op_id": [op], "part": [None], "node": [None], "illegal": [None], "error": [str(e)]}).astype({"part": "Int32", "node": "Int64", "illegal": "boolean"})
        ids = np.unique(np.concatenate([g["a"].to_numpy(), g["b"].to_numpy(), t["node"].to_numpy()]))
        of = c.component[merged]
        score = lambda team: np.bincount(c.component[team], minlength=of.max() + 1)
        first, second = int(score(sources).argmax()), int(score(sinks).argmax())
        rest = [k for k in dict.fromkeys(of.tolist()) if k not in (first, second)]
        order = {k: i for i, k in enumerate(dict.fromkeys([first, second, *rest]))}
        return pd.DataFrame({"op_id": op, "part": [order[k] for k in of.tolist()], "node": ids, "illegal": not c.clean, "error": None})

    return edges.select("op_id", "a", "b", "aff").groupBy("op_id").cogroup(teams.select("op_id", "node", "team").groupBy("op_id")).applyInPandas(show, "op_id long, part int, node long, illegal boolean, error string")


def checked_cuts(edges: DataFrame, teams: DataFrame, cuts: DataFrame) -> DataFrame:
    """(op_id, failed, adds_up, parted): for each operation whether it has an error, whether the cut's value is the sum of its
    edges, and whether without them each team is in one component and the two are in different ones."""
    from .graph import checkpointed, connected_components

    rows = checkpointed(cuts)
    gone = rows.filter("error IS NULL").select("op_id", "a", "b", F.lit(True).alias("gone"))
    # Operations may share supervoxels, so a node of the check is one of an operation.
    name = lambda c: F.struct("op_id", F.col(c).alias("node"))
    left = edges.join(gone, ["op_id", "a", "b"], "left").filter("gone IS NULL").select(F.xxhash64(name("a")).alias("a"), F.xxhash64(name("b")).alias("b"))
    every = teams.select(F.xxhash64(F.struct("op_id", "node")).alias("a")).select("a", F.col("a").alias("b"))
    cc = connected_components(left.unionAll(every))
    placed = teams.select("op_id", "team", F.xxhash64(F.struct("op_id", "node")).alias("node")).join(cc, "node")
    sides = placed.groupBy("op_id").agg(F.count_distinct(F.when(F.col("team") == "source", F.col("root"))).alias("s"), F.count_distinct(F.when(F.col("team") == "sink", F.col("root"))).alias("t"), F.count_distinct("root").alias("n"))
    sums = rows.groupBy("op_id").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"), (F.abs(F.sum("aff") - F.max("value")) < 1e-6).alias("adds_up"))
    return sums.join(sides, "op_id").select("op_id", "failed", F.coalesce("adds_up", F.lit(False)).alias("adds_up"), ((F.col("s") == 1) & (F.col("t") == 1) & (F.col("n") == 2)).alias("parted"))
