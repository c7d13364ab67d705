"""Supplier keys from 16384 on: segment numbers that take more than an id's 26 bits."""

import os

import pytest
from conftest import TABLES, rows
from hiergraph import plans
from hiergraph.plans.fixtures import GRID_SQL


@pytest.fixture(scope="module")
def many(tmp_path_factory, small):
    import duckdb

    at, c = tmp_path_factory.mktemp("many"), duckdb.connect()
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{small}/{t}.parquet", f"{at}/{t}.parquet")
    c.execute(f"COPY (SELECT * REPLACE (l_suppkey + l_suppkey % 4 * 16384 AS l_suppkey) FROM '{small}/lineitem.parquet' WHERE l_orderkey % 3 = 0) TO '{at}/lineitem.parquet' (FORMAT parquet)")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return str(at), c


@pytest.mark.parametrize("name", ["a06_range_read_chunk", "a07_chunk_edges", "b01_codec", "c08_mask_by_box", "d08_subgraph_edges", "d12_bounding_l2_children", "e03_merge_edge_dicts", "e05_categorize_by_parent", "e06_cross_layer", "g05_l2_edge_list", "h03_node_rows", "i05_remove_edges"])
def test_chunks_of_wide_segments(spark, many, name):
    at, c = many
    df, r = plans.QUERIES[name](spark, at), c.execute(plans.ORACLES[name])
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows([x[0] for x in r.description], r.fetchall())


@pytest.fixture(scope="module")
def shared(tmp_path_factory, small):
    """Few parts of suppliers that lie 16384 apart, so that supervoxels share node ids."""
    import duckdb

    at, c = tmp_path_factory.mktemp("shared"), duckdb.connect()
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{small}/{t}.parquet", f"{at}/{t}.parquet")
    c.execute(f"COPY (SELECT * REPLACE (l_suppkey % 4 * 16384 AS l_suppkey, l_partkey * 7 % 500 AS l_partkey) FROM '{small}/lineitem.parquet' WHERE l_orderkey % 3 = 0) TO '{at}/lineitem.parquet' (FORMAT parquet)")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return str(at), c


@pytest.mark.parametrize("name", ["d08_subgraph_edges", "d08_subgraph_edges_in_box"])
def test_supervoxels_of_one_id(spark, shared, name):
    at, c = shared
    svs, ids = c.execute(f"WITH {GRID_SQL} SELECT count(*), count(DISTINCT node) FROM grid").fetchone()
    assert ids < svs
    df, r = plans.QUERIES[name](spark, at), c.execute(plans.ORACLES[name])
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows([x[0] for x in r.description], r.fetchall())


def test_box_is_not_worked_out_for_every_edge(spark, small):
    """Catalyst hands the chunks' condition down to the edges where it can, written out for each use of their ends."""
    plan = plans.QUERIES["g05_l2_edge_list"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 30_000 and plan.count("l_suppkey") < 100


@pytest.mark.parametrize("fanout, layers", [(2, 5), (4, 4), (8, 4), (3, 5)])
def test_cross_layer_counts_grids(spark, fanout, layers):
    from hiergraph.functions.ids import Codec
    from pyspark.sql import functions as F

    codec = Codec(layers=layers, fanout=fanout)
    at = [(x * 7 % 64, x * 5 % 64, x % 3) for x in range(64)]
    pairs = [(*p, *q) for p in at for q in at]
    df = spark.createDataFrame(pairs, "ax long, ay long, az long, bx long, by long, bz long")
    ends = [codec.pack(F.lit(2), *(F.col(f"{e}{c}") for c in "xyz")) for e in "ab"]
    got = df.select("*", codec.cross_layer(*ends).alias("layer")).collect()
    assert all(r.layer == 1 + sum(any(p // fanout**k != q // fanout**k for p, q in zip(r[:3], r[3:6], strict=True)) for k in range(layers - 2)) for r in got)
    assert dict(df.select(codec.cross_layer(*ends).alias("layer"), codec.cross_layer(F.lit(None).cast("long"), ends[1]).alias("none")).dtypes) == {"layer": "int", "none": "int"}
