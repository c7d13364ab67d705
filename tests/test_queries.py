import pytest
from hiergraph import plans

#: Queries that may well have no rows on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(name, same):
    same(plans.QUERIES[name], plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_has_rows(name, spark, small):
    assert plans.QUERIES[name](spark, small).count() > 0 or name in MAY_BE_EMPTY


def test_min_cuts_are_least(spark, small):
    """On trees the least cut between two ends is the weakest edge of the path between them."""
    from hiergraph.plans.graphs import cut_input

    edges = cut_input(spark, small).collect()
    cuts = plans.QUERIES["g09_min_cut"](spark, small).collect()
    by = {}
    for e in edges:
        by.setdefault(e.op_id, []).append(e)
    for op, rows in by.items():
        value = sum(r.aff for r in cuts if r.op_id == op)
        source, sink = rows[0].source, rows[0].sink
        near = {}
        for r in rows:
            near.setdefault(r.a, []).append((r.b, r.aff))
            near.setdefault(r.b, []).append((r.a, r.aff))
        if len(rows) != len(near) - 1:
            continue
        todo, weakest = [(source, float("inf"))], {source: float("inf")}
        for u, w in todo:
            for v, aff in near[u]:
                if v not in weakest:
                    weakest[v] = min(w, aff)
                    todo.append((v, weakest[v]))
        assert value == weakest[sink]
