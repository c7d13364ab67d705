import random
from itertools import product

import numpy as np
import pytest
from hiergraph.operators import multicut as M


def graph(edges):
    n = 1 + max(max(e[:2]) for e in edges)
    a, b, w = (np.array(x) for x in zip(*edges, strict=True))
    return M.Graph.of(n, a, b, w.astype(float))


def best(edges, n, sources, sinks):
    """Least value over all partitions that keep the teams apart."""
    free = [v for v in range(n) if v not in sources and v not in sinks]
    out = np.inf
    for bits in product([0, 1], repeat=len(free)):
        side = dict(zip(free, bits, strict=True)) | dict.fromkeys(sources, 0) | dict.fromkeys(sinks, 1)
        out = min(out, sum(w for x, y, w in edges if side[x] != side[y]))
    return out


def test_direct_cut_is_least():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(4, 9)
        edges = [(i, rng.randrange(i), rng.randrange(1, 9)) for i in range(1, n)] + [(*rng.sample(range(n), 2), rng.randrange(1, 9)) for _ in range(n)]
        teams = rng.sample(range(n), 4)
        try:
            c = M.cut_teams(graph(edges), teams[:2], teams[2:], path_augment=False, isolating=True)
        except M.CutError as e:
            assert "cleanly" in str(e)
            continue
        assert c.value == best(edges, n, teams[:2], teams[2:])


def test_augmented_cut_holds_teams_together():
    rng = random.Random(2)
    done = 0
    for _ in range(80):
        n = rng.randrange(6, 12)
        edges = [(i, rng.randrange(i), rng.randrange(1, 9)) for i in range(1, n)] + [(*rng.sample(range(n), 2), rng.randrange(1, 9)) for _ in range(2 * n)]
        teams = rng.sample(range(n), 4)
        g = graph(edges)
        try:
            c = M.cut_teams(g, teams[:2], teams[2:], isolating=True)
        except M.CutError:
            continue
        done += 1
        left = g.components(set(c.edges))
        assert left[teams[0]] == left[teams[1]] != left[teams[2]] == left[teams[3]]
        assert c.value >= best(edges, n, teams[:2], teams[2:])
    assert done > 30


def test_cut_that_ignores_a_source_is_refused():
    edges = [(0, 2, 2.0), (1, 2, 3.0), (2, 3, 10.0)]
    for augment in (False, True):
        with pytest.raises(M.CutError):
            M.cut_teams(graph(edges), [0, 1], [3], path_augment=augment)


def test_paths_avoid_the_other_team_and_resolve_overlaps():
    # Both teams' cheapest paths run over the middle, node 4; the cheaper team keeps it.
    edges = [(0, 4, 9.0), (4, 1, 9.0), (2, 4, 5.0), (4, 3, 5.0), (2, 5, 1.0), (5, 3, 1.0), (0, 5, 1.0)]
    s, t = M.augmenting_edges(graph(edges), [0, 1], [2, 3])
    assert (s, t) == ({0, 1}, {4, 5})
    assert M.cheapest_path(graph(edges), 0, 1, {4}) is None
    assert M.cheapest_path(graph(edges), 2, 3, {4}).nodes == [2, 5, 3]


def test_isolating_cuts():
    edges = [(0, 1, 1.0), (1, 2, 5.0), (2, 3, 5.0)]
    with pytest.raises(M.CutError, match="isolate"):
        M.cut_teams(graph(edges), [0], [3])
    assert M.cut_teams(graph(edges), [0], [3], isolating=True).edges == [0]
    assert not M.cut_teams(graph(edges), [0], [3], preview=True).clean


def test_multicuts_and_previews(spark):
    inf = float("inf")
    rows = [(1, 10, 11, inf), (1, 11, 12, 0.5), (1, 12, 13, 2.0), (1, 13, 14, inf), (1, 14, 15, 3.0), (2, 20, 21, inf), (3, 30, 31, 1.0)]
    edges = spark.createDataFrame(rows, "op_id long, a long, b long, aff double")
    teams = spark.createDataFrame([(1, 10, "source"), (1, 15, "sink"), (2, 20, "source"), (2, 21, "sink"), (3, 30, "source"), (3, 39, "sink"), (4, 40, "source")], "op_id long, node long, team string")
    cuts = M.multicuts(edges, teams, isolating=True)
    got = {}
    for r in cuts.collect():
        got.setdefault(r.op_id, []).append((r.a, r.b, r.value, r.error))
    assert got == {1: [(11, 12, 0.5, None)], 2: [(None, None, None, "uncuttable edges join the teams")], 3: [(None, None, None, "the teams are not in one component")], 4: [(None, None, None, "a team is empty")]}
    checks = {r.op_id: (r.failed, r.adds_up, r.parted) for r in M.checked_cuts(edges, teams, cuts).collect()}
    assert checks[1] == (False, True, True) and checks[2] == (True, False, False)
    parts = {}
    for r in M.split_previews(edges, teams, isolating=True).filter("error IS NULL").collect():
        parts.setdefault((r.op_id, r.part), set()).add(r.node)
    assert parts == {(1, 0): {10, 11}, (1, 1): {12, 13, 14, 15}}
