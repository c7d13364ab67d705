"""Chunked edge files: partitioned Parquet, and run-length component lists."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_chunk_edges(edges: DataFrame, path: str) -> None:
    """Edges (cx, cy, cz, a, b, aff, area, ...) by chunk, zstd; a rewritten chunk replaces itself."""
    edges.write.mode("overwrite").partitionBy("cx", "cy", "cz").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").parquet(path)


def get_chunk_edges(spark: SparkSession, path: str, chunks: list[tuple[int, int, int]]) -> DataFrame:
    """The edges of some chunks by partition pruning; missing chunks yield nothing."""
    wanted = F.lit(False)
    for x, y, z in chunks:
        wanted = wanted | ((F.col("cx") == x) & (F.col("cy") == y) & (F.col("cz") == z))
    return spark.read.parquet(path).filter(wanted)


def put_components(components: DataFrame) -> DataFrame:
    """(chunk, runs) of (chunk, component, sv): each component's size, then its supervoxels, end to end."""
    each = components.groupBy("chunk", "component").agg(F.array_sort(F.collect_list("sv")).alias("svs"))
    runs = each.select("chunk", "component", F.concat(F.array(F.size("svs").cast("long")), F.col("svs")).alias("run"))
    return runs.groupBy("chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("component", "run"))), lambda r: r["run"])).alias("runs"))


def get_components(stored: DataFrame) -> DataFrame:
    """(chunk, component, sv) of (chunk, runs); components are numbered from 0 within a chunk. One step for each component."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, runs in zip(b["chunk"], b["runs"], strict=True):
                heads, at = [], 0
                while at < len(runs):
                    heads.append(at)
                    at += int(runs[at]) + 1
                sizes = np.asarray(runs, np.int64)[heads]
                yield pd.DataFrame({"chunk": chunk, "component": np.repeat(np.arange(len(heads), dtype=np.int32), sizes), "sv": np.delete(np.asarray(runs, np.int64), heads)})

    return stored.select(F.col("chunk").cast("long"), "runs").mapInPandas(each, "chunk long, component int, sv long")


def write_cells(cells: DataFrame, path: str, keys: tuple[str, ...] = ("row", "col")) -> None:
    """Append cells (row, col, order, value) in one write; of cells with one row and column the last by ``order`` counts."""
    last = cells.groupBy(*keys).agg(F.max_by(F.struct("order", "value"), F.struct("order", "value")).alias("c"))
    last.select(*keys, "c.order", "c.value").write.mode("append").parquet(path)


def read_cells(spark: SparkSession, path: str, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """The newest cell of each row and column over all writes."""
    newest = spark.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct("order", "value"), F.struct("order", "value")).alias("c"))
    return newest.select(*keys, "c.value")


def put_fragments(fragments: DataFrame, path: str) -> None:
    """Mesh fragments (fragment, data) as binary Parquet, sorted by id within files so that lookups prune row groups."""
    fragments.select("fragment", "data").repartitionByRange("fragment").sortWithinPartitions("fragment").write.mode("append").parquet(path)


def manifest(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, fragment, found) of wanted (id, fragment): which fragments of a mesh are stored."""
    have = stored.select("fragment", F.lit(True).alias("found")).distinct()
    return wanted.join(have, "fragment", "left").select("id", "fragment", F.coalesce("found", F.lit(False)).alias("found"))


class GraphMeta:
    """A graph's meta data and version as a JSON file beside its tables: created once, updated whole, the version set once."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm.org.apache.hadoop
        self._file = jvm.fs.Path(path.rstrip("/") + "/meta.json")
        self._fs = self._file.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._file)

    def read(self) -> dict:
        stream = self._fs.open(self._file)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, meta: dict, replace: bool) -> None:
        # Without replace the file system itself refuses a second creation.
        stream = self._fs.create(self._file, replace)
        try:
            stream.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
        finally:
            stream.close()

    def create(self, meta: dict) -> None:
        if self.exists():
            raise ValueError("the graph exists")
        self._write({"meta": meta}, False)

    def update(self, meta: dict) -> None:
        self._write(self.read() | {"meta": meta}, True)

    def set_version(self, version: str) -> None:
        now = self.read()
        if "version" in now:
            raise ValueError("the version is set")
        self._write(now | {"version": version}, True)
