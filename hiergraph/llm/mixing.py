"""Operator 9, mixing sources to target weights by Poisson replication.

A source of n rows with target share w of a mixture of m rows has the mean
repetition rate w * m / n. Each row draws its count by inverting the Poisson
distribution of that mean at a uniform number made from a hash of seed, id and
text; it is exploded that often, and all copies are dealt out and sorted by another
hash, which is unique to the copy, so no key is hot.

Sources are counted, rated and given their distribution tables where they lie; nothing about them
reaches the driver. The tables are written in the shared folder, so Catalyst knows their size: it
broadcasts them below the session's threshold (spark.sql.autoBroadcastJoinThreshold) and shuffles by
source beyond it, where adaptive execution splits a hot source.

Defined edge cases: a null source is a source of its own ('' in the targets); a
source that targets leave out keeps no rows; targets of absent sources are
spread over the present ones (shares are renormalised); equal rows draw alike; a
null text or id takes part as ''; an empty table gives an empty result; further
columns are carried along, and where one of them has the name of a new column the new one
is named with "mix_" before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions_for, scratch

SEED = 9
_SPACE = 16**13


def uniform(salt: str, *columns: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5: the same in any engine."""
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / float(_SPACE)


def poisson_table(mean: float) -> tuple[int, np.ndarray]:
    """(k, P(X <= k), P(X <= k + 1), ...): all that a 52-bit number can tell, by ratios from the most likely count outwards."""
    if mean <= 0:
        return 0, np.ones(1)
    reach = 12 * np.sqrt(mean) + 20
    low, high = max(0, int(mean - reach)), int(np.ceil(mean + reach))
    log = np.append(0.0, np.cumsum(np.log(mean) - np.log(np.arange(low + 1, high + 1))))
    p = np.cumsum(np.exp(log - log.max()))
    return low, p / p[-1]


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = [poisson_table(r) for r in b["rate"]]
        yield b.assign(low=[m[0] for m in made], cdf=[m[1] for m in made])


def inverted(u: Column, low: Column, cdf: Column) -> Column:
    """Least k with P(X <= k) >= u. The one-element array makes u be computed once, not once per entry of the table."""
    return low + F.transform(F.array(u), lambda v: F.size(F.filter(cdf, lambda c: c < v)))[0].cast("long")


def mix_sources(df: DataFrame, targets: dict[str, float] | None = None, size: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """All columns of ``df`` and replica (from 0), replicas, rate, globally shuffled by shuffle_key.

    Without targets all sources get equal shares; without size the mixture has as many rows as the table (in the mean)."""
    spark, source = df.sparkSession, F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    counts = df.groupBy(source.alias("source")).agg(F.count("*").alias("n"))
    if targets is None:
        wanted = counts.withColumn("w", F.lit(1.0))
    else:
        wanted = counts.join(spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, w double"), "source").filter("w > 0")
    whole = wanted.agg(F.sum("w").alias("whole"))
    total = counts.agg(F.sum("n").cast("double").alias("total")) if size is None else spark.range(1).select(F.lit(float(size)).alias("total"))
    rated = wanted.crossJoin(whole).crossJoin(total).select("source", (F.col("w") / F.col("whole") * F.col("total") / F.col("n")).alias("rate"))  # two single rows
    path = scratch(spark, f"rates-{uuid4()}")
    rated.mapInPandas(_tables, "source string, rate double, low long, cdf array<double>").write.parquet(path)
    table = spark.read.parquet(path)
    # The row travels as one value, so no name in it can clash.
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), source.alias("source"), F.col(f"`{id_col}`").cast("string").alias("id"), F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")).alias("digest"))
    ids = (F.col("id"), F.col("digest"))
    drawn = rows.join(table, "source").withColumn("replicas", inverted(uniform(f"{seed}-draw", *ids), F.col("low"), F.col("cdf"))).filter("replicas > 0")
    copies = drawn.select("row", "id", "digest", "rate", "replicas", F.explode(F.sequence(F.lit(0).cast("long"), F.col("replicas") - 1)).alias("replica"))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), *[F.coalesce(c.cast("string"), F.lit("")) for c in (*ids, F.col("replica"))]).cast("binary"))
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        return name if name not in taken else free(f"mix_{name}")

    new = [F.col(c).alias(free(c)) for c in ("rate", "replicas", "replica")] + [key.alias(free("shuffle_key"))]
    keyed = copies.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns), *new)
    # The key is uniform, so dealing by it and sorting the parts is a global shuffle that needs no sampling pass over the texts.
    return keyed.repartition(partitions_for(df), free("shuffle_key")).sortWithinPartitions(free("shuffle_key"), free("replica"))


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "source", "replica", "replicas", "shuffle_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "text")


QUERIES = {"op9_poisson_mixing": op9_poisson_mixing}
ORACLES = {
    "op9_poisson_mixing": """
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*)::DOUBLE AS c FROM documents GROUP BY 1),
r AS (SELECT s, (1.0::DOUBLE / (SELECT count(*) FROM n)) * (SELECT sum(c) FROM n) / c AS rate FROM n),
q AS (
  SELECT s, rate, 0::BIGINT AS k, exp(-rate) AS p, exp(-rate) AS cum, -1e0::DOUBLE AS below FROM r
  UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1), cum FROM q WHERE k < rate + 12 * sqrt(rate) + 20),
d AS (
  SELECT *, md5(coalesce(text, '')) AS text_md5,
         (('0x' || substr(md5('9-draw|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
x AS (SELECT d.*, q.k AS replicas FROM d JOIN q ON q.s = coalesce(d.source, '') AND d.u > q.below AND d.u <= q.cum)
SELECT doc_id, source, replica, replicas, md5('9-order|' || coalesce(doc_id::VARCHAR, '') || '|' || text_md5 || '|' || replica::VARCHAR) AS shuffle_key, text_md5, text
FROM (SELECT *, unnest(range(replicas)) AS replica FROM x WHERE replicas > 0)""",
}
