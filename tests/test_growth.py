"""What a step moves, counted by Spark, and graphs that take every level of it."""

import random

import pytest
from hiergraph.operators.graph import component_paths, connected_components, near_components, shortest_paths


@pytest.fixture
def moved(spark):
    """Bytes shuffled and rows shuffled by all stages that a call runs."""
    jsc = spark.sparkContext._jsc.sc()

    def stages():
        jvm = spark.sparkContext._jvm
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        seq = jsc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
        return [seq.apply(i) for i in range(seq.size())]

    def count(call):
        jsc.listenerBus().waitUntilEmpty()
        seen = {(x.stageId(), x.attemptId()) for x in stages()}
        call()
        jsc.listenerBus().waitUntilEmpty()
        new = [x for x in stages() if (x.stageId(), x.attemptId()) not in seen]
        return sum(x.shuffleWriteBytes() for x in new), sum(x.shuffleWriteRecords() for x in new)

    return count


def united(pairs):
    above = {x: x for p in pairs for x in p}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        above[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in above}


@pytest.mark.parametrize("seed", range(1))
def test_components_by_levels(spark, seed):
    """Without the last level's single task: paths that rise, stars around their greatest node, forks, self edges."""
    r = random.Random(seed)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(300, x) for x in range(200, 230)] + [(r.randrange(400, 460), r.randrange(400, 460)) for _ in range(50)] + [(7, 7), (110, 110)]
    pairs += [(900 + i, 1000 + (i + d) % 20) for i in range(20) for d in (0, 1)]
    got = [(x.node, x.root) for x in connected_components(spark.createDataFrame(pairs, "a long, b long"), small=0).collect()]
    assert len(got) == len(set(got)) and set(got) == united(pairs)


def test_components_move_few_rows(spark, moved):
    """Many short rising paths, as orders make: not every edge in every round."""
    n = 20_000
    e = spark.range(n).selectExpr("id + id div 5 AS a", "id + id div 5 + 1 AS b")
    assert moved(lambda: connected_components(e, small=1000).count())[1] < 14 * n


@pytest.mark.parametrize("seed", range(2))
def test_near_components(spark, seed):
    """Edges in any order and often given, self edges, nodes of several partitions, levels behind the links."""
    r = random.Random(seed)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(400, 460), r.randrange(400, 460)) for _ in range(60)] + [(7, 7), (110, 110)]
    pairs += [(900 + i, 1000 + (i + d) % 20) for i in range(20) for d in (0, 1, 1)]
    r.shuffle(pairs)
    got = [(x.node, x.root) for x in near_components(spark.createDataFrame(pairs, "a long, b long"), small=0).collect()]
    assert len(got) == len(set(got)) and set(got) == united(pairs)


@pytest.mark.parametrize("name, times", [("g02_connected_components", 3), ("e10_edges_status", 5), ("g04_shortest_paths", 5), ("g10_direct_cuts", 4), ("i03_fake_edges", 7)])
def test_queries_move_few_rows(spark, moved, tmp_path, name, times):
    """Orders that share few supervoxels, as at scale: a query moves a row a few times, not once in every round."""
    from conftest import TABLES
    from hiergraph import plans

    import duckdb

    for t in TABLES:
        if t != "lineitem":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    duckdb.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_orderkey % 10 = 0) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    assert moved(lambda: plans.QUERIES[name](spark, str(tmp_path)).count())[1] < times * 60_000


@pytest.mark.parametrize("most", [0, 3, 2000])
def test_component_paths(spark, most):
    """Components of all sizes, by tasks and by joins: the paths are the same."""
    r = random.Random(5)
    pairs = [(r.randrange(k, k + 9), r.randrange(k, k + 9)) for k in (10, 30, 50) for _ in range(8)] + [(70, 71), (71, 72), (72, 71), (80, 80), (90 + 1, 90)]
    e = spark.createDataFrame(pairs, "a long, b long")
    cc = connected_components(e)
    want = sorted((x.source, x.node, x.hops, ",".join(map(str, x.path))) for x in shortest_paths(e, cc.selectExpr("root AS source").distinct()).collect())
    assert sorted(map(tuple, component_paths(e, cc, most).collect())) == want


def test_paths_of_components_over_batches():
    import pandas as pd
    from hiergraph.operators.graph import _paths_near

    g = pd.DataFrame([(10 * k, 10 * k + i, 10 * k + i + 1) for k in range(7) for i in range(k + 1)], columns=["root", "a", "b"])
    got = pd.concat(_paths_near((g.iloc[i : i + 2] for i in range(0, len(g), 2)), most=5))
    assert len(got) == sum(k + 2 for k in range(7)) and (got["path"] == [",".join(str(x) for x in range(s, n + 1)) for s, n in zip(got["source"], got["node"], strict=True)]).all()


def test_shortest_paths_of_sources_apart(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (10, 11), (11, 12)], "a long, b long")
    s = spark.createDataFrame([(1,), (10,)], "source long")
    rows = lambda df: sorted((r.source, r.node, r.hops, tuple(r.path)) for r in df.collect())
    assert rows(shortest_paths(e, s, apart=True)) == rows(shortest_paths(e, s)) and len(rows(shortest_paths(e, s))) == 8


def test_nearest_looks_up_a_place_once_and_broadcasts_no_points(spark, moved):
    from hiergraph.operators.space import nearest

    v = spark.range(100).selectExpr("id % 10 AS x", "id div 10 AS y", "0L AS z", "id AS sv")
    p = spark.range(20_000).selectExpr("id AS point", "id % 10 AS x", "id % 7 AS y", "1L AS z")
    found = nearest(p, v, 2)
    assert sorted({(r.sv, r.d2) for r in found.collect() if r.point % 70 == 13}) == [(63, 1)] and found.count() == 20_000
    assert moved(found.count)[1] < 40_000


def test_clusters_of_many_points_at_few_places(spark):
    """Pairs of points would be 50 million."""
    from hiergraph.operators.space import clusters

    p = spark.range(10_000).selectExpr("id AS point", "(id % 2) * 5.0 AS x", "0.0 AS y", "0.0 AS z")
    assert {(r.point % 2, r.cluster) for r in clusters(p, 3).collect()} == {(0, 0), (1, 1)}
    assert {r.cluster for r in clusters(p, 6).collect()} == {0}


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(1, 9)] + [(3, 20), (5, 21)], [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 5)], [(1, 2), (2, 3), (3, 1), (3, 4)], []])
def test_closure_by_doubling(spark, pairs):
    """Chains with forks, diamonds of unequal length, cycles, no lineage."""
    from hiergraph.operators.history import closure

    every = sorted({x for p in pairs for x in p}) or [1]
    for forward in (True, False):
        near = {x: {b if forward else a for a, b in pairs if (a if forward else b) == x} for x in every}
        want = set()
        for x in every:
            seen, todo = {x}, [x]
            for u in todo:
                todo += [y for y in near[u] if y not in seen]
                seen |= near[u]
            want |= {(x, y) for y in seen - {x}}
        lin = spark.createDataFrame(pairs, "old_root long, new_root long")
        got = [tuple(r) for r in closure(lin, spark.createDataFrame([(x,) for x in every], "start long"), forward).collect()]
        assert len(got) == len(set(got)) and set(got) == want
