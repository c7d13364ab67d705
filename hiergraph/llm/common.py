"""Shared kernels of the training-data operators: table access, word spans over
Arrow buffers, and the partition-wise exchange used by the dedup operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpointed, ensure_checkpoint_dir, scratch

#: Bytes of text that one numpy kernel call works on (a longer text is one call of its own).
BLOCK_BYTES = 1 << 20

_U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: 0-9, a-z (after lower-casing A-Z) and every byte of a non-ASCII character.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan: file sizes for a scan, no job is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions_for(df: DataFrame, bytes_each: int = 12 << 20) -> int:
    """Partitions so that each holds about ``bytes_each`` of (compressed) input, never fewer than the session's shuffle partitions.

    Where Catalyst knows no size (an RDD, or the product of a join), the plan's own number of partitions serves."""
    floor, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return max(floor, -(-size // bytes_each) if size < 2**50 else min(200_000, df.rdd.getNumPartitions()))


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, end to end, and the offsets of each (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = pc.fill_null(column.cast(kind), pa.scalar(b"", kind))
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[offs[0] : offs[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def blocks(data: np.ndarray, offs: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: (first row, end row, bytes, offsets)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, _U64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=_U64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h ^= h >> _U64(33)
    h *= _U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U64(33))


class Words(NamedTuple):
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: words before the first of each text, one more entry than texts
    first: np.ndarray
    low: np.ndarray


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Word spans (bytes) of texts laid end to end; equal words have equal 64-bit hashes everywhere."""
    low, n = LOWER[data], len(data)
    w = IS_WORD[low]
    begins = np.zeros(n + 1, bool)
    begins[offs[:-1]] = True
    first, last = w.copy(), w.copy()
    if n:
        first[1:] &= ~w[:-1] | begins[1:n]
        last[:-1] &= ~w[1:] | begins[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, _U64)
    np.cumsum(BYTE_CODE[low] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    row = np.searchsorted(offs, start, "right") - 1
    return Words(row, start, end, h, np.searchsorted(start, offs), low)


def prefixes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the first n characters of each word that is longer than that."""
    starts = np.append(np.flatnonzero((w.low & 0xC0) != 0x80), len(w.low))
    char = np.searchsorted(starts, w.start)
    end = starts[np.minimum(char + n, len(starts) - 1)]
    at = np.flatnonzero(end < w.end)
    up, down = powers(len(w.low))
    total = np.zeros(len(w.low) + 1, _U64)
    np.cumsum(BYTE_CODE[w.low] * up[: len(w.low)], out=total[1:])
    return w.row[at], mix((total[end[at]] - total[w.start[at]]) * down[w.start[at]] + _U64(n))


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)])).hash[0])


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of k words (runs across texts included: mask them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _U64(0x9FB21C651E98DF25) + h[j : j + n]
    return mix(out)


def run_heads(*keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys (sorted together) begins."""
    n = len(keys[0])
    head = np.ones(n, bool)
    if n:
        head[1:] = False
        for k in keys:
            head[1:] |= k[1:] != k[:-1]
    return head


def dealt(df: DataFrame, id_col: str, text_col: str, n: int, extra: Iterable[str] = ()) -> DataFrame:
    """(pid, doc_id, text) dealt by pid into ``n`` partitions. What is found out about a part elsewhere is sent back under its pid,
    so a frequent line or passage is one row for each part that holds it, not one for each document."""
    ids, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    return df.select(F.pmod(F.xxhash64(ids, text), F.lit(n)).cast("int").alias("pid"), ids.alias("doc_id"), text.alias("text"), *extra).repartition(n, "pid")
