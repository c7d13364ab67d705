"""Lineage of roots (old_root, new_root, operation_id, ts) and the operation log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

#: Hops after which a closure is checkpointed and tested for its end.
_STRIDE = 4


def closure(lineage: DataFrame, starts: DataFrame, forward: bool = True) -> DataFrame:
    """(start, root): all roots that follow (or precede) starts (start), themselves excluded; runs until no new root is found.

    By doubling: what lies within k hops is joined to the pairs k hops apart. Where ids rise along the lineage and forks occur on one
    side only, no pair is found twice, so nothing is compared with what was found before; otherwise each round's pairs are made
    distinct, until none is new."""
    step = checkpointed(lineage.select(F.col("old_root" if forward else "new_root").alias("x"), F.col("new_root" if forward else "old_root").alias("y")).distinct())
    most = lambda c: step.groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    rising = step.filter("x >= y" if forward else "x <= y").isEmpty()
    once = rising and (most("y") <= 1 or most("x") <= 1)
    found = checkpointed(starts.select("start", F.col("start").alias("root")).distinct())
    n = found.count()
    while not step.isEmpty():
        reached = found.join(step, found["root"] == step["x"]).select("start", F.col("y").alias("root"))
        if once:
            found = found.unionAll(checkpointed(reached))
        else:
            found, before = checkpointed(found.unionAll(reached).distinct()), n
            n = found.count()
            if n == before:
                break
        further = step.select(F.col("x").alias("y"), F.col("y").alias("z"))
        step = checkpointed(step.join(further, "y").select("x", F.col("z").alias("y")).distinct())
    return found.filter("start <> root")


def latest(roots: DataFrame, lineage: DataFrame, at: str) -> DataFrame:
    """(root) of roots (root, ts) that exist before ``at`` and were not superseded before it."""
    t = F.lit(at).cast("timestamp_ntz")
    gone = lineage.filter(F.col("ts") < t).select(F.col("old_root").alias("root"))
    return roots.filter(F.col("ts") < t).select("root").distinct().join(gone, "root", "left_anti")


def kind_of(log: DataFrame) -> DataFrame:
    """Adds op: undo, redo, merge or split, in this precedence."""
    return log.withColumn("op", F.when(F.col("undo_of").isNotNull(), "undo").when(F.col("redo_of").isNotNull(), "redo").when(F.col("n_added") > 0, "merge").when(F.col("n_removed") > 0, "split").otherwise("error"))


def resolved(log: DataFrame) -> DataFrame:
    """(operation_id, target, undone): follow undo/redo pointers to the edit they are about; each undo flips the direction.

    Pointers go back in time, so chains end; one that does not (a damaged log) is taken for none."""
    back = F.coalesce("undo_of", "redo_of")
    table = checkpointed(log.select(F.col("operation_id").alias("o"), F.when(back < F.col("operation_id"), back).alias("next"), F.col("undo_of").isNotNull().alias("flips")))
    at = table.filter("next IS NOT NULL").select(F.col("o").alias("operation_id"), F.col("next").alias("target"), F.col("flips").alias("undone"))
    done, i = [], 0
    while True:
        j = at.join(table, at["target"] == table["o"], "left")
        done.append(j.filter("next IS NULL").select("operation_id", "target", "undone"))
        at = j.filter("next IS NOT NULL").select("operation_id", F.col("next").alias("target"), (F.col("undone") != F.col("flips")).alias("undone"))
        i += 1
        if i % _STRIDE == 0:
            at = checkpointed(at)
            if at.isEmpty():
                return reduce(DataFrame.unionAll, done)


def standing(log: DataFrame) -> DataFrame:
    """Merges and splits that the last successful (status 0) undo or redo naming them does not leave undone."""
    r = log.filter("status = 0 AND coalesce(undo_of, redo_of) IS NOT NULL").groupBy(F.coalesce("undo_of", "redo_of").alias("target")).agg(F.max_by(F.col("undo_of").isNotNull(), "operation_id").alias("undone"))
    edits = kind_of(log).filter("op IN ('merge', 'split')")
    return edits.join(r, edits["operation_id"] == r["target"], "left").filter("undone IS NULL OR NOT undone").drop("target", "undone")


def summary(log: DataFrame) -> DataFrame:
    return kind_of(log).groupBy("user").agg(F.count("*").alias("n"), F.sum((F.col("op") == "merge").cast("long")).alias("merges"), F.sum((F.col("op") == "split").cast("long")).alias("splits"), F.min("operation_id").alias("first_op"), F.max("operation_id").alias("last_op"))


def with_previous(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("user").orderBy("operation_id")
    return log.select("operation_id", "user", F.lag("operation_id").over(w).alias("previous_op"))


def _with_starts(found: DataFrame, starts: DataFrame) -> DataFrame:
    return found.unionAll(starts.select("start", F.col("start").alias("root")).distinct())


def lineage_graph(lineage: DataFrame, starts: DataFrame, made: DataFrame | None = None, past: str | None = None, future: str | None = None) -> DataFrame:
    """(start, old_root, new_root, operation_id): the edges before and after each start (start).

    With ``made`` (root, ts), roots older than ``past`` are not followed back and roots newer than ``future`` not forward; the
    edges that lead to them are kept."""
    back = forth = lineage
    if made is not None and past is not None:
        back = lineage.join(made.filter(F.col("ts") >= F.lit(past).cast("timestamp_ntz")).select(F.col("root").alias("new_root")), "new_root", "left_semi")
    if made is not None and future is not None:
        forth = lineage.join(made.filter(F.col("ts") <= F.lit(future).cast("timestamp_ntz")).select(F.col("root").alias("old_root")), "old_root", "left_semi")
    edge = ("old_root", "new_root", "operation_id")
    before, after = (checkpointed(_with_starts(closure(x, starts, fwd), starts)) for x, fwd in ((back, False), (forth, True)))
    up = before.join(back.select(*edge), F.col("root") == F.col("new_root")).select("start", *edge)
    down = after.join(forth.select(*edge), F.col("root") == F.col("old_root")).select("start", *edge)
    return up.unionAll(down).distinct()


def node_link(graph: DataFrame) -> DataFrame:
    """(start, graph): each start's lineage graph (start, old_root, new_root, ...) as node-link JSON, ids in order."""
    lists = graph.groupBy("start").agg(
        F.array_sort(F.array_union(F.collect_set("old_root"), F.collect_set("new_root"))).alias("nodes"),
        F.array_sort(F.collect_set(F.array("old_root", "new_root"))).alias("links"),
    )
    return lists.select("start", F.to_json(F.struct("nodes", "links")).alias("graph"))


def id_mappings(lineage: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, past_id, future_id): the first ancestors of each start, itself where it has none, and what each became.

    A past id has a future id only where that is beyond doubt: one descendant without successors, none with two, and no
    descendant handed on whole (one successor, which has no other predecessor)."""
    n_in = lineage.groupBy(F.col("new_root").alias("root")).agg(F.count("*").alias("n_in"))
    n_out = lineage.groupBy(F.col("old_root").alias("root")).agg(F.count("*").alias("n_out"), F.min("new_root").alias("next"))
    before = _with_starts(closure(lineage, starts, False), starts)
    firsts = checkpointed(before.join(n_in, "root", "left_anti").select("start", F.col("root").alias("past_id")))
    past = firsts.select(F.col("past_id").alias("start")).distinct()
    # Looked up for each root with successors, not for each of its starts: the many rows without one would share a null key.
    n_next = n_out.join(n_in.select(F.col("root").alias("next"), F.col("n_in").alias("next_in")), "next", "left").select("root", "n_out", "next_in")
    handed = _with_starts(closure(lineage, past), past).join(n_next, "root", "left")
    out = F.coalesce("n_out", F.lit(0))
    told = handed.groupBy(F.col("start").alias("past_id")).agg(
        F.bool_or(out == 2).alias("two"), F.count_if(out == 0).alias("ends"), F.bool_or((out == 1) & (F.col("next_in") == 1)).alias("whole"), F.min(F.when(out == 0, F.col("root"))).alias("end")
    )
    future = told.filter("NOT two AND ends = 1 AND NOT whole").select("past_id", F.col("end").alias("future_id"))
    return firsts.join(future, "past_id", "left").select("start", "past_id", "future_id")


def past_operations(lineage: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, operation_id): the operations that led to each start."""
    every = _with_starts(closure(lineage, starts, False), starts)
    return every.join(lineage.select(F.col("new_root").alias("root"), "operation_id"), "root").select("start", "operation_id").distinct()


def changelog(past: DataFrame, log: DataFrame, ends: DataFrame, now: DataFrame, first: DataFrame, lineage: DataFrame) -> DataFrame:
    """(root, operation_id, ts, user, is_merge, before, after, in_neuron, is_relevant): one row for each root and operation behind it.

    past (start, operation_id); log (operation_id, ts, user, is_merge); ends (operation_id, sv): ends of its edges; now (root, sv,
    now_root): roots at the asked root's own time; first (sv, first_root): at the earliest time. A merge is in the neuron if all its
    ends are now in the root and relevant if they had several roots at first; a split is in it if any end is, and relevant if
    its ends have several roots now. ``after`` are the successors of the least root before."""
    j = past.select(F.col("start").alias("root"), "operation_id").join(ends, "operation_id").join(now, ["root", "sv"], "left").join(first, "sv", "left")
    per = j.groupBy("root", "operation_id").agg(
        F.bool_and(F.col("now_root").eqNullSafe(F.col("root"))).alias("all_in"), F.bool_or(F.col("now_root").eqNullSafe(F.col("root"))).alias("any_in"),
        F.count_distinct("now_root").alias("n_now"), F.count_distinct("first_root").alias("n_first"),
    )
    before = lineage.groupBy("operation_id").agg(F.array_sort(F.collect_set("old_root")).alias("before"))
    after = lineage.groupBy(F.col("old_root").alias("lead")).agg(F.array_sort(F.collect_set("new_root")).alias("after"))
    told = before.withColumn("lead", F.col("before")[0]).join(after, "lead")
    rows = per.join(log.select("operation_id", "ts", "user", "is_merge"), "operation_id").join(told, "operation_id")
    merge = F.col("is_merge")
    return rows.select(
        "root", "operation_id", "ts", "user", "is_merge", "before", "after",
        F.when(merge, F.col("all_in")).otherwise(F.col("any_in")).alias("in_neuron"),
        F.when(merge, F.col("n_first") != 1).otherwise(F.col("n_now") != 1).alias("is_relevant"),
    )
