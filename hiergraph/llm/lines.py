"""Operator 6, line dedup with sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z lower-cased, kept
as a 128-bit digest. Shards by key hold a cuckoo filter (four 16-bit fingerprints
a bucket, one fingerprint for each key; supports deletion) in front of an exact
table of (key, holder, count). References are inserted block by block: the filter is
asked first, and a key that it does not know is new and goes to the table's newest run without
a search; one that it knows is looked up, as it may be a false positive, which gets a
fingerprint of its own. Deletion skips what the filter does not know; a key whose count
falls to zero leaves the table and takes its fingerprint with it, so documents can be taken out again
and lines come back exactly as they were. ``LineIndex`` keeps filters and tables as Parquet.

Keys of at least MIN_CHARS code points that MIN_DOCS documents hold lose all
their lines except in the largest doc_id that holds them. Parts of the documents
count their own keys first; a shard gets one row for each key and part and sends
one row back, so a line in a third of all documents costs as many rows as there
are parts.

Defined edge cases: null or empty text is one empty line; every row is a document
(repeated rows count as often as they stand there, and all rows with the largest
doc_id keep the line: a tie keeps all); a null doc_id is smaller than any other;
a text of one key many times counts once; an empty table gives an empty result;
other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import dealt, documents, mix, partitions_for, run_heads

MIN_CHARS, MIN_DOCS = 20, 3
_NULL_ID = -(2**63)
_LOWER = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))
_SPACE = b" \t\n\x0b\x0c\r"
_U64 = np.uint64


class CuckooFilter:
    """Approximate set of 64-bit hashes with deletion; all calls take arrays of distinct hashes."""

    SLOTS, ROUNDS = 4, 200

    def __init__(self, capacity: int):
        size = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.8)))))
        self.table = np.zeros((size, self.SLOTS), np.uint16)
        self.mask = _U64(size - 1)

    @classmethod
    def stored(cls, data: bytes) -> "CuckooFilter":
        """The filter whose table's bytes these are."""
        f = cls(1)
        f.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        f.mask = _U64(len(f.table) - 1)
        return f

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(h.astype(np.uint64))
        fp = (h >> _U64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        a = h & self.mask
        return fp, a.astype(np.int64), self._other(fp, a)

    def _other(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return ((bucket.astype(np.uint64) ^ mix(fp.astype(np.uint64))) & self.mask).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(h)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def _settle(self, fp: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put what finds a free slot; True where it did."""
        order = np.argsort(bucket, kind="stable")
        heads = np.flatnonzero(run_heads(bucket[order]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        free = self.table[bucket] == 0
        ok = rank < free.sum(1)
        slot = (np.cumsum(free, 1) == rank[:, None] + 1).argmax(1)
        self.table[bucket[ok], slot[ok]] = fp[ok]
        return ok

    def insert(self, h: np.ndarray) -> bool:
        """False if the filter is too full: build a larger one from the exact table."""
        fp, bucket, other = self._places(h)
        left = ~self._settle(fp, bucket)
        fp, bucket = fp[left], other[left]
        rng = np.random.default_rng(6)
        for _ in range(self.ROUNDS):
            if not len(fp):
                return True
            left = ~self._settle(fp, bucket)
            fp, bucket = fp[left], bucket[left]
            _, one = np.unique(bucket, return_index=True)
            slot = rng.integers(0, self.SLOTS, len(one))
            out = self.table[bucket[one], slot].copy()
            self.table[bucket[one], slot] = fp[one]
            fp[one], bucket[one] = out, self._other(out, bucket[one])
        return not len(fp)

    def delete(self, h: np.ndarray) -> None:
        """Take one fingerprint out for each hash; only for hashes that were inserted."""
        fp, a, b = self._places(h)
        for i in np.flatnonzero(self.contains(h)):
            for bucket in (a[i], b[i]):
                at = np.flatnonzero(self.table[bucket] == fp[i])
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break


class Shard:
    """One shard: the filter and the exact table, rows (key hi, key lo, holder, count, top doc_id) in sorted runs; a run is
    merged with the one before once it is half as long, so there are few."""

    COLUMNS = ("hi", "lo", "holder", "n", "top")
    #: Rows that are inserted at a time.
    BLOCK = 1 << 14

    def __init__(self, rows: np.ndarray | None = None, known: CuckooFilter | None = None, capacity: int = 0):
        self.runs = [] if rows is None or not len(rows) else [self._summed(rows)]
        #: keys that were searched for in the table, of all that came in
        self.searched = self.asked = 0
        self.filter = known
        if known is None:
            self._fill(capacity)

    @staticmethod
    def _hashes(keys: np.ndarray) -> np.ndarray:
        return keys[:, 0].astype(np.uint64) ^ mix(keys[:, 1].astype(np.uint64))

    @staticmethod
    def _summed(rows: np.ndarray) -> np.ndarray:
        """Rows by key and holder, one for each."""
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        heads = np.flatnonzero(run_heads(rows[:, 0], rows[:, 1], rows[:, 2]))
        if len(heads) < len(rows):
            n, top = np.add.reduceat(rows[:, 3], heads), np.maximum.reduceat(rows[:, 4], heads)
            rows = rows[heads]
            rows[:, 3], rows[:, 4] = n, top
        return rows

    @staticmethod
    def _keys(rows: np.ndarray) -> np.ndarray:
        return rows[run_heads(rows[:, 0], rows[:, 1]), :2]

    def _fill(self, capacity: int = 0) -> None:
        """A new filter with a fingerprint for each key of the table."""
        keys = self._keys(self.table())
        capacity = max(capacity, len(keys) + 16)
        self.filter = CuckooFilter(capacity)
        while not self.filter.insert(self._hashes(keys)):
            capacity *= 2
            self.filter = CuckooFilter(capacity)

    def table(self) -> np.ndarray:
        """All rows, sorted by key and holder."""
        if len(self.runs) > 1:
            self.runs = [self._summed(np.concatenate(self.runs))]
        return self.runs[0] if self.runs else np.zeros((0, 5), np.int64)

    def _holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether the table holds these keys (hi, lo), by binary search in each run."""
        out = np.zeros(len(keys), bool)
        self.searched += len(keys)
        for run in self.runs:
            left = np.flatnonzero(~out)
            at = np.searchsorted(run[:, 0], keys[left, 0])
            while len(left):
                inside = at < len(run)
                left, at = left[inside], at[inside]
                here = run[at, 0] == keys[left, 0]
                left, at = left[here], at[here]
                out[left[run[at, 1] == keys[left, 1]]] = True
                go = run[at, 1] < keys[left, 1]
                left, at = left[go], at[go] + 1
        return out

    def insert(self, rows: np.ndarray) -> None:
        """Add references; a key and holder that are there already add up."""
        for i in range(0, len(rows), self.BLOCK):
            block = self._summed(rows[i : i + self.BLOCK])
            keys = self._keys(block)
            h = self._hashes(keys)
            self.asked += len(h)
            known = self.filter.contains(h)
            known[known] = self._holds(keys[known])
            full = not self.filter.insert(h[~known])
            self.runs.append(block)
            while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
                self.runs[-2:] = [self._summed(np.concatenate(self.runs[-2:]))]
            if full:
                self._fill(8 * len(self.filter.table))

    def delete(self, rows: np.ndarray) -> None:
        """Take references out again; what the filter does not know is skipped unseen, what the table does not hold is left alone."""
        rows = rows[self.filter.contains(self._hashes(rows))] if len(rows) else rows
        table = self.table()
        if not len(rows) or not len(table):
            return
        minus = self._summed(rows)
        minus[:, 3] *= -1
        minus[:, 4] = _NULL_ID
        both = np.concatenate([table, minus])
        order = np.lexsort((both[:, 2], both[:, 1], both[:, 0]))
        both, old = both[order], order < len(table)
        heads = np.flatnonzero(run_heads(both[:, 0], both[:, 1], both[:, 2]))
        n, top = np.add.reduceat(both[:, 3], heads), np.maximum.reduceat(both[:, 4], heads)
        stays = np.logical_or.reduceat(old, heads) & (n > 0)
        left = both[heads][stays]
        left[:, 3], left[:, 4] = n[stays], top[stays]
        self.runs = [left] if len(left) else []
        before, after = self._keys(table), self._keys(left) if len(left) else np.zeros((0, 2), np.int64)
        every = np.concatenate([before, after])
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        heads = np.flatnonzero(run_heads(every[:, 0], every[:, 1]))
        gone = every[heads][np.diff(np.append(heads, len(every))) == 1]
        self.filter.delete(self._hashes(gone))

    def repeated(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the table, of keys with ``least`` references at least; number of references; largest doc_id) for each such row."""
        rows = self.table()
        if not len(rows):
            z = np.zeros(0, np.int64)
            return z, z, z
        heads = np.flatnonzero(run_heads(rows[:, 0], rows[:, 1]))
        size = np.diff(np.append(heads, len(rows)))
        total, top = np.repeat(np.add.reduceat(rows[:, 3], heads), size), np.repeat(np.maximum.reduceat(rows[:, 4], heads), size)
        at = np.flatnonzero(total >= least)
        return at, total[at], top[at]


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes]:
    """The key's digest of each line, b'' where the key is too short to count."""
    out = []
    for k in text.translate(_LOWER).split(b"\n"):
        k = k.strip(_SPACE)
        long_enough = len(k) >= min_chars and (k.isascii() or len(k.decode("utf-8", "replace")) >= min_chars)
        out.append(hashlib.blake2b(k, digest_size=16).digest() if long_enough else b"")
    return out


_KEYS = pa.schema([("shard", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("holder", pa.int64()), ("n", pa.int64()), ("top", pa.int64())])


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def key_rows(parts: DataFrame, shards: int, min_chars: int = MIN_CHARS, by_document: bool = False) -> DataFrame:
    """(shard, hi, lo, holder, n, top) of (pid, doc_id, text): references summed by part (or by document) before they are dealt out."""

    def each(batches):
        for b in batches:
            found: dict[tuple[bytes, int], list[int]] = {}
            ids = b.column(1).to_pylist()
            for pid, doc, text in zip(b.column(0).to_pylist(), ids, _texts(b.column(2)), strict=True):
                doc = _NULL_ID if doc is None else doc
                for k in set(line_keys(text, min_chars)) - {b""}:
                    x = found.setdefault((k, doc if by_document else pid), [0, _NULL_ID])
                    x[0] += 1
                    x[1] = max(x[1], doc)
            keys = np.frombuffer(b"".join(k for k, _ in found), np.int64).reshape(-1, 2)
            shard = (mix(keys[:, 1].astype(np.uint64)) % _U64(shards)).astype(np.int32)
            columns = [shard, keys[:, 0], keys[:, 1], np.array([h for _, h in found], np.int64), *(np.array([v[i] for v in found.values()], np.int64) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_KEYS)

    return parts.mapInArrow(each, "shard int, hi long, lo long, holder long, n long, top long")


def _matrix(t: pa.Table) -> np.ndarray:
    return np.stack([t[c].to_numpy() for c in Shard.COLUMNS], 1) if t.num_rows else np.zeros((0, 5), np.int64)


_SAID = "pid int, hi long, lo long, top long"


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digest: bool = False, extra: str | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) or, as a digest, kept_sha256 in place of the text; one row per input row."""
    n = partitions_for(df)
    parts = dealt(df, id_col, text_col, n, [extra] if extra else [])

    def count(t: pa.Table) -> pa.Table:
        shard = Shard(capacity=t.num_rows)
        shard.insert(_matrix(t))
        at, _, top = shard.repeated(min_docs)
        r = shard.table()[at]
        return pa.table({"pid": pa.array(r[:, 2].astype(np.int32)), "hi": r[:, 0], "lo": r[:, 1], "top": top})

    # Dealt out in full: shards that are put together by their size on the wire would be one large task.
    said = key_rows(parts.select("pid", "doc_id", "text"), n, min_chars).repartition(n, "shard").groupBy("shard").applyInArrow(count, _SAID)
    return _cut(parts, said, df, min_chars, digest, extra)


def _cut(parts: DataFrame, said: DataFrame, df: DataFrame, min_chars: int, digest: bool = False, extra: str | None = None) -> DataFrame:
    """Parts (pid, doc_id, text) without the lines that ``said`` (pid, hi, lo, top) gives to another document."""

    def drop(docs: pa.Table, said: pa.Table) -> pa.Table:
        keys = np.stack([said["hi"].to_numpy(), said["lo"].to_numpy()], 1) if said.num_rows else np.zeros((0, 2), np.int64)
        flat = keys.tobytes()
        keep = {flat[16 * i : 16 * i + 16]: top for i, top in enumerate(said["top"].to_pylist())}
        lines, dropped, out = [], [], []
        for doc, text in zip(docs["doc_id"].to_pylist(), _texts(docs["text"].combine_chunks()), strict=True):
            at, own = line_keys(text, min_chars), _NULL_ID if doc is None else doc
            whole = text.split(b"\n")
            kept = [x for k, x in zip(at, whole, strict=True) if keep.get(k, own) == own]
            lines.append(len(whole))
            dropped.append(len(whole) - len(kept))
            text = b"\n".join(kept)
            out.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        return pa.table({"doc_id": docs["doc_id"], "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256" if digest else "text": pa.array(out, pa.string()), **({extra: docs[extra]} if extra else {})})

    schema = StructType.fromDDL(f"doc_id long, n_lines long, n_dropped long, {'kept_sha256' if digest else 'text'} string")
    return parts.groupBy("pid").cogroup(said.groupBy("pid")).applyInArrow(drop, schema.add(df.schema[extra]) if extra else schema)


def with_lines_dropped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows with all their columns and the text without its dropped lines; other columns travel beside the text."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    packed = df.withColumn("__rest", F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("struct<x:int>"))
    kept = dedup_lines(packed, id_col, text_col, extra="__rest", **limits)
    back = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return kept.select(*((back[c] if c in back else F.col(f"__rest.`{c}`")).cast(df.schema[c].dataType).alias(c) for c in df.columns))


class LineIndex:
    """Incremental, reversible form: exact tables and filters are Parquet at ``path``; documents go in and out, and
    ``dropped`` answers for any text against what is there now. Each call writes the next version beside the old one, which
    counts only once it is whole, so an attempt that dies leaves the old state; an index opened again goes on from the last
    whole version (with the shards it was made with). The last two versions stay."""

    _STATE = "shard int, hi long, lo long, holder long, n long, top long, filter binary"

    def __init__(self, spark: SparkSession, path: str, shards: int = 16):
        self.spark, self.path, self.shards, self.version = spark, path, shards, 0
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for version, of in self._versions():
            if version > self.version:
                self.version, self.shards = version, of
        self.state = spark.read.schema(self._STATE).parquet(self._at(self.version)) if self.version else spark.createDataFrame([], self._STATE)

    def _at(self, version: int) -> str:
        return f"{self.path}/v{version}_of_{self.shards}"

    def _versions(self) -> list[tuple[int, int]]:
        if not self._files.exists(self._folder):
            return []
        whole = [x.getPath() for x in self._files.listStatus(self._folder) if self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        found = [re.fullmatch(r"v([0-9]+)_of_([0-9]+)", p.getName()) for p in whole]
        return [(int(m[1]), int(m[2])) for m in found if m]

    def _apply(self, docs: DataFrame, method: str) -> None:
        new = key_rows(dealt(docs, "doc_id", "text", self.shards), self.shards, by_document=True)

        def change(old: pa.Table, new: pa.Table) -> pa.Table:
            filters = old.filter(old["filter"].is_valid())
            shard = Shard(_matrix(old.filter(old["filter"].is_null())), CuckooFilter.stored(filters["filter"][0].as_py()) if filters.num_rows else None)
            if new.num_rows:
                getattr(shard, method)(_matrix(new))
            number, rows = (new if new.num_rows else old)["shard"][0].as_py(), shard.table()
            rows = np.concatenate([rows, np.zeros((1, 5), np.int64)])
            return pa.table({"shard": pa.array(np.full(len(rows), number, np.int32)), **{c: rows[:, i] for i, c in enumerate(Shard.COLUMNS)}, "filter": pa.array([None] * (len(rows) - 1) + [shard.filter.table.tobytes()], pa.binary())})

        self.version += 1
        self.state.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(change, self._STATE).write.parquet(self._at(self.version), mode="overwrite")
        self.state = self.spark.read.schema(self._STATE).parquet(self._at(self.version))
        self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._at(self.version - 2)), True)

    def insert(self, docs: DataFrame) -> None:
        self._apply(docs, "insert")

    def delete(self, docs: DataFrame) -> None:
        """Take documents (same doc_id and text as inserted) out again."""
        self._apply(docs, "delete")

    def counts(self) -> DataFrame:
        """(hi, lo, n, top): the exact references of every key."""
        return self.state.filter("filter IS NULL").groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def dropped(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, n_lines, n_dropped, text) of any texts: lines go that ``min_docs`` documents of the index hold, except in the
        largest of them. The shard's filter is asked before its table."""
        parts = dealt(df, id_col, text_col, self.shards)

        def tell(old: pa.Table, asked: pa.Table) -> pa.Table:
            want, filters = _matrix(asked), old.filter(old["filter"].is_valid())
            if filters.num_rows and len(want):
                want = want[CuckooFilter.stored(filters["filter"][0].as_py()).contains(Shard._hashes(want))]
            shard = Shard(_matrix(old.filter(old["filter"].is_null())), CuckooFilter(1))
            at, _, top = shard.repeated(min_docs)
            tops = {(hi, lo): t for hi, lo, t in zip(*shard.table()[at, :2].T.tolist(), top.tolist(), strict=True)} if len(at) else {}
            rows = [(pid, hi, lo, tops[hi, lo]) for hi, lo, pid in want[:, :3].tolist() if (hi, lo) in tops]
            return pa.table({c: pa.array([r[i] for r in rows], pa.int32() if c == "pid" else pa.int64()) for i, c in enumerate(("pid", "hi", "lo", "top"))})

        asked = key_rows(parts, self.shards, min_chars)
        said = self.state.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(tell, _SAID)
        return _cut(parts, said, df, min_chars)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir), digest=True)


ORACLES = {
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
often AS (SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE top <> doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE top IS NULL OR top = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN often USING (k) GROUP BY doc_id""",
}
QUERIES = {"op6_line_dedup": op6_line_dedup}
