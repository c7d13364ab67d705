import random

from hiergraph.operators import graph as G
from hiergraph.operators import hierarchy as H
from hiergraph.operators import history as K
from hiergraph.sources import files as S


def lineage(spark, edges):
    return spark.createDataFrame([(a, b, op, None) for a, b, op in edges], "old_root long, new_root long, operation_id long, ts timestamp_ntz")


def test_id_mappings(spark):
    # 1 and 2 merge into 3; 4 splits into 5 and 6; 7 is handed on to 8; 9 was never edited.
    lin = lineage(spark, [(1, 3, 10), (2, 3, 10), (4, 5, 11), (4, 6, 11), (7, 8, 12)])
    starts = spark.createDataFrame([(i,) for i in (3, 5, 8, 9)], "start long")
    got = {(r.start, r.past_id): r.future_id for r in K.id_mappings(lin, starts).collect()}
    assert got == {(3, 1): 3, (3, 2): 3, (5, 4): None, (8, 7): None, (9, 9): 9}


def test_lineage_graph_within_times(spark):
    rows = [(1, 2, 10, "2024-01-01 00:00:00"), (2, 3, 11, "2024-01-02 00:00:00"), (3, 4, 12, "2024-01-03 00:00:00"), (4, 5, 13, "2024-01-04 00:00:00")]
    lin = spark.createDataFrame(rows, "old_root long, new_root long, operation_id long, t string").selectExpr("old_root", "new_root", "operation_id", "cast(t as timestamp_ntz) ts")
    made = lin.selectExpr("new_root root", "ts").unionAll(spark.sql("SELECT 1L root, timestamp_ntz'2023-12-31 00:00:00' ts"))
    start = spark.createDataFrame([(3,)], "start long")
    got = {(r.old_root, r.new_root) for r in K.lineage_graph(lin, start, made, "2024-01-02 00:00:00", "2024-01-02 12:00:00").collect()}
    assert got == {(2, 3), (3, 4)}
    assert K.node_link(K.lineage_graph(lin, start)).first().graph == '{"nodes":[1,2,3,4,5],"links":[[1,2],[2,3],[3,4],[4,5]]}'


def test_long_chains_end(spark):
    """Paths far beyond the number of rounds that were allowed once."""
    n = 300
    path = spark.range(n).selectExpr("id a", "id + 1 b")
    assert {r.root for r in G.connected_components(path).collect()} == {0}
    assert K.closure(path.selectExpr("a old_root", "b new_root").filter("a < 40"), spark.sql("SELECT 0L start")).count() == 40
    log = spark.range(1, 200).selectExpr("id operation_id", "case when id > 1 then id - 1 end undo_of", "cast(null as long) redo_of")
    got = K.resolved(log).filter("operation_id = 199").first()
    assert (got.target, got.undone) == (1, False)


def test_shortest_paths(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)}
    near = {v: set() for v in range(60)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want, front = {0: 0}, [0]
    for u in front:
        for v in sorted(near[u]):
            if v not in want:
                want[v] = want[u] + 1
                front.append(v)
    df = spark.createDataFrame(list(edges), "a long, b long")
    got = G.shortest_paths(df, spark.createDataFrame([(0,)], "source long")).collect()
    assert {r.node: r.hops for r in got} == want
    assert all(len(r.path) == r.hops + 1 and all(y in near[x] for x, y in zip(r.path, r.path[1:], strict=False)) for r in got)
    far = max(want, key=want.get)
    assert G.shortest_path(df, 0, far).first().hops == want[far]


def test_roots_of_skipping_trees(spark):
    n = 2**56
    rows = [(n + 1, 2 * n + 1), (n + 2, 2 * n + 1), (2 * n + 1, 4 * n + 1), (n + 3, 2 * n + 3), (2 * n + 3, 3 * n + 1), (3 * n + 1, 4 * n + 1), (4 * n + 1, 5 * n + 1)]
    p = spark.createDataFrame(rows, "child_id long, parent_id long").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' ts")
    ids = spark.createDataFrame([(n + 1,), (n + 3,), (n + 3,), (5 * n + 1,), (n + 9,)], "id long")
    find = lambda **how: {r.id: r.root for r in H.roots(ids, p, 5, **how).collect()}
    assert find() == {n + 1: 5 * n + 1, n + 3: 5 * n + 1, 5 * n + 1: 5 * n + 1, n + 9: n + 9}
    assert find(stop_layer=3)[n + 1] == 4 * n + 1 and find(stop_layer=3)[n + 3] == 3 * n + 1
    assert find(stop_layer=3, ceil=False)[n + 1] == 2 * n + 1 and find(stop_layer=3, ceil=False)[5 * n + 1] is None
    pairs = spark.createDataFrame([(n + 1, n + 2), (n + 1, n + 3), (n + 1, n + 9)], "a long, b long")
    assert {r.b: r.shared for r in H.lowest_common(pairs, p, 5).collect()} == {n + 2: 2 * n + 1, n + 3: 4 * n + 1, n + 9: None}


def test_components_round_trip(spark):
    rows = [(1, 5, 9), (1, 5, 3), (1, 7, 4), (2, 1, 8)]
    got = S.get_components(S.put_components(spark.createDataFrame(rows, "chunk long, component int, sv long"))).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 3), (1, 0, 9), (1, 1, 4), (2, 0, 8)]


def test_graph_meta(spark, tmp_path):
    m = S.GraphMeta(spark, str(tmp_path / "graph"))
    m.create({"layers": 5})
    m.set_version("1")
    m.update({"layers": 6})
    assert m.read() == {"meta": {"layers": 6}, "version": "1"}
    for refused in (lambda: m.create({}), lambda: m.set_version("2")):
        try:
            refused()
        except ValueError:
            continue
        raise AssertionError
