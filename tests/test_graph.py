import itertools
import random

import numpy as np
import pytest
from hiergraph.functions.ids import Codec, bits_per_axis
from hiergraph.operators.graph import _min_cut, connected_components, contracted, min_cuts
from hiergraph.sources.files import get_chunk_edges, get_components, put_chunk_edges, put_components
from pyspark.sql import functions as F


def test_components_against_union_find(spark):
    rng = random.Random(1)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)] + [(2000, 2000)]
    parent = {x: x for p in e for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_min_cut_is_least():
    rng = np.random.default_rng(3)
    for _ in range(20):
        pairs = [p for p in itertools.combinations(range(6), 2) if rng.random() < 0.6]
        a, b, c = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), rng.integers(1, 9, len(pairs)).astype(float)
        value, side = _min_cut(6, a, b, c, 0, 5)
        best = min(c[s[a] != s[b]].sum() for bits in itertools.product([0, 1], repeat=4) for s in [np.array([1, *bits, 0])])
        assert value == best == c[side[a] != side[b]].sum()


def test_min_cuts_by_group(spark):
    e = spark.createDataFrame([(1, 1, 2, 5.0, 1, 3), (1, 2, 3, 2.0, 1, 3), (2, 7, 8, 1.0, 7, 9)], "op_id long, a long, b long, aff double, source long, sink long")
    assert [(r.op_id, r.a, r.b, r.value) for r in min_cuts(e).collect()] == [(1, 2, 3, 2.0)]


def test_contracted(spark):
    inf = float("inf")
    e, m = contracted(spark.createDataFrame([(1, 2, inf), (2, 3, 0.5), (1, 3, 0.25)], "a long, b long, aff double"))
    assert sorted((r.a, r.b, r.aff) for r in e.collect()) == [(1, 3, 0.25), (1, 3, 0.5)]
    assert {(r.node, r.root) for r in m.collect()} == {(1, 1), (2, 1)}


def test_codec_round_trip(spark):
    assert bits_per_axis(5) == {1: 10, 2: 10, 3: 2, 4: 1, 5: 1}
    with pytest.raises(ValueError):
        bits_per_axis(13)
    c = Codec()
    df = spark.createDataFrame([(3, 1, 2, 3, 9), (2, 7, 0, 5, 1), (5, 0, 0, 0, 4)], "layer int, x long, y long, z long, seg long")
    n = df.withColumn("n", c.pack(F.col("layer"), F.col("x"), F.col("y"), F.col("z"), F.col("seg")))
    back = n.select("*", c.layer(F.col("n")).alias("l"), *(c.coordinate(F.col("n"), i).alias(f"c{i}") for i in range(3)), c.segment(F.col("n")).alias("s"))
    assert all((r.layer, r.x, r.y, r.z, r.seg) == (r.l, r.c0, r.c1, r.c2, r.s) for r in back.collect())
    with pytest.raises(Exception, match="out of range"):
        df.select(c.pack(F.lit(4), F.lit(2), F.lit(0), F.lit(0))).collect()


def test_chunk_files(spark, tmp_path):
    e = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 3, 4)], "cx int, cy int, cz int, a long, b long")
    put_chunk_edges(e, f"{tmp_path}/e")
    assert [(r.a, r.b) for r in get_chunk_edges(spark, f"{tmp_path}/e", [(0, 1, 0), (5, 5, 5)]).collect()] == [(3, 4)]


def test_component_lists(spark):
    c = spark.createDataFrame([(1, 0, 5), (1, 0, 6), (1, 1, 7), (2, 0, 9)], "chunk long, component int, sv long")
    assert sorted(map(tuple, get_components(put_components(c)).collect())) == [(1, 0, 5), (1, 0, 6), (1, 1, 7), (2, 0, 9)]
