from hiergraph.operators.space import chunk_volume, merged_vertices, nearest, relabelled

VOXELS = [(0, 0, 0, 5), (3, 0, 0, 6), (0, 3, 0, 4), (9, 9, 9, 7)]


def voxels(spark, data=VOXELS):
    return spark.createDataFrame(data, "x long, y long, z long, sv long")


def test_nearest_takes_the_least_of_ties_and_leaves_out_the_far(spark):
    p = spark.createDataFrame([(1, 0, 0, 1), (2, 2, 2, 0), (3, 50, 0, 0)], "point long, x long, y long, z long")
    assert sorted(map(tuple, nearest(p, voxels(spark), 3).collect())) == [(1, 5, 1), (2, 4, 5)]
    assert nearest(p, voxels(spark, []), 3).count() == 0


def test_chunk_volume_is_clamped(spark):
    got = chunk_volume(voxels(spark), (0, 0, 0), (3, 3, 3), (4, 3, 10))
    assert sorted(r.sv for r in got.collect()) == [5, 6]


def test_relabelled(spark):
    m = spark.createDataFrame([(5, 50), (7, 70)], "sv long, node long")
    assert sorted((r.x, r.y, r.z, r.label) for r in relabelled(voxels(spark), m).collect()) == [(0, 0, 0, 50), (0, 3, 0, 0), (3, 0, 0, 0), (9, 9, 9, 70)]


def test_merged_vertices(spark):
    v = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 1, 0, 0), (2, 0, 1, 0, 0)], "fragment long, i long, x long, y long, z long")
    points, named = merged_vertices(v)
    assert points.count() == 2
    assert sorted((r.fragment, r.i, tuple(r.vertex)) for r in named.collect()) == [(1, 0, (1, 0)), (1, 1, (1, 1)), (2, 0, (1, 1))]
