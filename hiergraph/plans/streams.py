"""Queries that run a stream to its end and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import scratch
from ..streaming.edits import apply_batches, consume, edit_stream, publish, window_counts
from . import fixtures as X


def s01_edit_counts(s, d):
    at = scratch(s, f"stream-{uuid.uuid4()}")
    apply_batches(edit_stream(s, d), f"{at}/out", f"{at}/state")
    return s.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


def s02_window_counts(s, d):
    """The newest count of each window."""
    at = scratch(s, f"stream-{uuid.uuid4()}")
    window_counts(edit_stream(s, d), f"{at}/out", f"{at}/state")
    last = s.read.parquet(f"{at}/out").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def s03_published_edits(s, d):
    """Edits are published twice; the consumer takes each once."""
    at = scratch(s, f"stream-{uuid.uuid4()}")
    log = X.log(s, d).filter("n_added > 0").select("operation_id", "user", "n_roots")
    for _ in range(2):
        publish(log, f"{at}/topic")
    consume(s, f"{at}/topic", "operation_id long, user long, n_roots int", f"{at}/out", f"{at}/state")
    return s.read.parquet(f"{at}/out")


Q = {"s01_edit_counts": s01_edit_counts, "s02_window_counts": s02_window_counts, "s03_published_edits": s03_published_edits}
S = {
    "s01_edit_counts": "SELECT event_type, count(*)::BIGINT AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1",
    "s02_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2",
    "s03_published_edits": f"WITH {X.LOG_SQL} SELECT operation_id, \"user\", n_roots FROM log WHERE n_added > 0",
}
