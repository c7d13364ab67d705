import random
import re

from hiergraph.functions.ids import Codec
from hiergraph.operators import edits
from hiergraph.operators.edits import apply_edits, build, checked_merges, checked_splits, fake_edges, undone
from hiergraph.operators.hierarchy import roots

C = Codec(4, 10, 2, (4, 4, 4))


def sv(x, y, z, segment):
    return (1 << 56) + (x << 46) + (y << 36) + (z << 26) + segment


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def classes(spark, nodes, parents, layers):
    ids = spark.createDataFrame([(n,) for n in nodes], "id long")
    groups = {}
    for r in roots(ids, parents, layers).collect():
        assert r.root >> 56 == layers
        groups.setdefault(r.root, set()).add(r.id)
    return sorted(map(sorted, groups.values())), groups


def united(nodes, pairs):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        at[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n)
    return sorted(map(sorted, groups.values()))


def test_ingest_merge_split_undo(spark):
    rng = random.Random(4)
    codec = Codec(3, 10, 2, (2, 2, 2))
    nodes = [sv(x, y, 0, s) for x in range(2) for y in range(2) for s in range(1, 8)]
    pairs = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(16)})
    more = [p for p in {tuple(sorted(rng.sample(nodes, 2))) for _ in range(4)} if p not in pairs]
    svs = spark.createDataFrame([(n,) for n in nodes], "node long")
    one = build(svs, frame(spark, pairs), codec, "2024-01-01 00:00:00")
    was, old = classes(spark, nodes, one.parents, 3)
    assert was == united(nodes, pairs)
    two = apply_edits(one.parents, one.edges, codec, "2024-01-02 00:00:00", added=frame(spark, more))
    merged, new = classes(spark, nodes, one.parents.unionAll(two.parents), 3)
    assert merged == united(nodes, pairs + more)
    # A root is new iff an end of an added edge lies in it, and lineage joins it to the roots it came from.
    touched = {n for p in more for n in p}
    assert {r for r, g in new.items() if r not in old} == {r for r, g in new.items() if g & touched}
    assert {(r.old_root, r.new_root) for r in two.lineage.collect()} == {(o, n) for o in old for n in new if o != n and old[o] & new[n]}
    # What stood before is still answered at the time before.
    ids = spark.createDataFrame([(n,) for n in nodes], "id long")
    then = {r.id: r.root for r in roots(ids, one.parents.unionAll(two.parents), 3, "2024-01-01 12:00:00").collect()}
    assert then == {n: r for r, g in old.items() for n in g}
    add, remove = undone(spark.createDataFrame([(a, b, True) for a, b in more], "a long, b long, added boolean"))
    three = apply_edits(one.parents.unionAll(two.parents), two.edges, codec, "2024-01-03 00:00:00", add, remove)
    assert classes(spark, nodes, one.parents.unionAll(two.parents).unionAll(three.parents), 3)[0] == was


def test_skip_to_root_and_shared_parents(spark):
    a, b0, b1, c0 = sv(0, 0, 0, 0), sv(1, 0, 0, 0), sv(1, 0, 0, 1), sv(2, 0, 0, 0)
    got = build(spark.createDataFrame([(n,) for n in (a, b0, b1, c0)], "node long"), frame(spark, [(b0, b1), (b0, c0)]), C, "2024-01-01 00:00:00").parents.collect()
    up = {r.child_id: r.parent_id for r in got}
    path = lambda n: [n >> 56, *path(up[n])] if n in up else [n >> 56]
    assert path(a) == [1, 2, 4]
    assert path(b0) == path(c0) == [1, 2, 3, 4] and up[b0] == up[b1]
    assert up[up[up[b0]]] == up[up[up[c0]]] and up[up[b0]] != up[up[c0]]


def test_validators(spark):
    a, b, c = sv(0, 0, 0, 1), sv(0, 0, 0, 2), sv(3, 0, 0, 1)
    p = build(spark.createDataFrame([(a,), (b,), (c,)], "node long"), frame(spark, [(a, b)]), C, "2024-01-01 00:00:00").parents
    asked = spark.createDataFrame([(1, a, a), (2, a, b), (3, a, c), (4, 2**57, a), (5, a, c + 9)], "operation_id long, a long, b long")
    say = lambda df: {r.operation_id: r.error for r in df.collect()}
    assert say(checked_merges(asked, p, C)) == {1: "self loop", 2: "one root", 3: None, 4: "not a supervoxel", 5: "unknown node"}
    assert say(checked_splits(asked, p, C)) == {1: "source is sink", 2: None, 3: "several roots", 4: "not a supervoxel", 5: "unknown node"}
    inactive = spark.createDataFrame([(3, 7, 8)], "operation_id long, a long, b long")
    assert sorted(map(tuple, fake_edges(asked.filter("operation_id IN (2, 3)"), inactive).collect())) == [(2, a, b, True), (3, 7, 8, False)]


def test_ids_of_a_large_chunk_are_not_sorted_in_one_task(spark):
    """Many groups of one chunk, as the uppermost has: distinct ids above what is known, dealt out, and hardly a number left out."""
    groups = spark.range(3000).selectExpr(f"{4 << 56}L AS chunk", "id AS key")
    top = spark.createDataFrame([(4 << 56, 7)], "chunk long, top long")
    got = edits._numbered(groups, top, C, each=100)
    ids = {r.id - (4 << 56) for r in got.collect()}
    assert len(ids) == 3000 and min(ids) > 7 and max(ids) < 2 * 3000
    assert re.search(r"hashpartitioning\([^)]*part#", got._jdf.queryExecution().toString())


def test_retired_ids_are_not_given_again(spark):
    a, b = sv(0, 0, 0, 1), sv(0, 0, 0, 2)
    one = build(spark.createDataFrame([(a,), (b,)], "node long"), frame(spark, []), C, "2024-01-01 00:00:00")
    two = apply_edits(one.parents, one.edges, C, "2024-01-02 00:00:00", added=frame(spark, [(a, b)]))
    three = apply_edits(one.parents.unionAll(two.parents), two.edges, C, "2024-01-03 00:00:00", removed=frame(spark, [(a, b)]))
    four = apply_edits(one.parents.unionAll(two.parents).unionAll(three.parents), three.edges, C, "2024-01-04 00:00:00", added=frame(spark, [(a, b)]))
    made = [{r.parent_id for r in x.parents.collect()} for x in (one, two, three, four)]
    assert sum(map(len, made)) == len(set.union(*made))


def test_ingest_takes_few_jobs(spark):
    """Nothing that an ingest cannot replace is looked up, and self edges do not start rounds of components."""
    nodes = [sv(x, y, 0, s) for x in range(4) for y in range(4) for s in range(1, 4)]
    svs = spark.createDataFrame([(n,) for n in nodes], "node long")
    jobs = lambda: spark.sparkContext._jsc.sc().statusStore().jobsList(spark.sparkContext._jvm.java.util.ArrayList())
    ids = lambda: {jobs().apply(i).jobId() for i in range(jobs().size())}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = max(ids(), default=-1)
    got = build(svs, frame(spark, list(zip(nodes, nodes[5:], strict=False))), C, "2024-01-01 00:00:00")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert max(ids()) - before < 100 and got.lineage.isEmpty()
