"""Operator 3, MinHash near-dedup with DartMinHash signatures.

A document is a weighted set of word 5-gram hashes. Darts rain on the plane of
(weight, rank) above each element: the plane is cut into dyadic cells, a hash of
element and cell gives each cell its Poisson number of darts and their places.
A document keeps the darts below its weights and below rank T / total weight
(about T = k ln k + 2k of them, so few elements are ever looked at more than
once), deals them over k coordinates by hash and keeps the earliest in each.
Two documents agree in a coordinate with the probability of their (weighted)
Jaccard similarity. BANDS bands of ROWS coordinates are joined.

1. Equal sets become one class, by hash, before anything is joined.
2. In each bucket every class is paired with the bucket's leader (the least by a
   hash of band and class, so a class meets another leader in each of the bands
   it shares): as many pairs as rows, also in a bucket that holds a third of all.
3. Pairs are verified exactly on their sets; components by alternating
   large-star and small-star rounds, checkpointed, nothing at the driver.
4. In buckets that still hold several components each class is tried with the next
   of another component in bucket order, a few times: most links of large groups
   are found so, which spares pairs in 5 but decides nothing.
5. The classes of buckets that still hold several components are joined exactly:
   every pair of different components that is similar shares one of the rarest
   shingles of both (prefix filter, with lengths and positions), so after this no
   two classes that share a bucket are left undecided.

Defined edge cases: a text of fewer than five words is one shingle; texts without
words (null too) are near nothing and are their own class; equal rows with one
doc_id are one document; rows with one doc_id and several texts are linked; a
null doc_id is never linked and has a null class; an empty table gives an empty
result; other columns are never looked at. A class's id is its least doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components as components
from .common import blocks, checkpointed, documents, kgrams, mix, raw, run_heads, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
_U64 = np.uint64
#: The lowest rank cell is [0, 2^_LOW); cell j above it is [2^(j-1), 2^j).
_LOW = -4
_tables: dict[float, np.ndarray] = {}


def _poisson_table(mean: float) -> np.ndarray:
    """Distribution function of a Poisson variable."""
    if mean not in _tables:
        top = int(mean + 12 * np.sqrt(mean) + 20)
        k = np.arange(1, top + 1)
        _tables[mean] = np.cumsum(np.exp(-mean + np.append(0, np.cumsum(np.log(mean) - np.log(k)))))
    return _tables[mean]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U64(11)).astype(np.float64) * 2.0**-53


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int = COORDINATES) -> np.ndarray:
    """(rows, k) ranks of the earliest dart per coordinate; inf for rows without elements. Equal ranks mean the same dart."""
    out = np.full((rows, k), np.inf)
    total = np.bincount(row, weight, rows)
    limit = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    todo = total > 0
    while todo.any():
        mine = todo[row]
        r, e, w = row[mine], element[mine], weight[mine]
        top = limit[r]
        cells, high = [(0.0, 2.0**_LOW, _LOW)], top.max(initial=0)
        j = _LOW + 1
        while 2.0 ** (j - 1) < high:
            cells.append((2.0 ** (j - 1), 2.0**j, j))
            j += 1
        columns, heavy = [(0.0, 1.0, 0)], w.max(initial=0)
        v = 1
        while 2.0 ** (v - 1) < heavy:
            columns.append((2.0 ** (v - 1), 2.0**v, v))
            v += 1
        for lo, hi, cell in cells:
            for left, right, column in columns:
                at = np.flatnonzero((top > lo) & (w > left))
                salt = _U64((cell + 64) * 0x9E3779B97F4A7C15 + column * 0xC2B2AE3D27D4EB4F & (2**64 - 1))
                base = mix(e[at] ^ salt)
                n = np.searchsorted(_poisson_table((hi - lo) * (right - left)), _unit(base))
                some = np.flatnonzero(n)
                n, base, at = n[some], base[some], at[some]
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                dart = mix(np.repeat(base, n) + (number.astype(np.uint64) + _U64(1)) * _U64(0xD6E8FEB86659FD93))
                owner = np.repeat(at, n)
                rank = lo + (hi - lo) * _unit(dart)
                keep = rank < top[owner]
                if heavy > 1 or left:
                    keep &= left + (right - left) * _unit(mix(dart + _U64(1))) < w[owner]
                dart, owner, rank = dart[keep], owner[keep], rank[keep]
                place = (mix(dart ^ _U64(0xA0761D6478BD642F)) % _U64(k)).astype(np.int64)
                np.minimum.at(out.reshape(-1), r[owner] * k + place, rank)
        todo &= np.isinf(out).any(1)
        limit[todo] *= 2
    return out


def shingles(data: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct word shingles of each text, sorted by row and hash; a shorter text is one shingle."""
    w = words(data, offs)
    g = kgrams(w.hash, size)
    at = np.flatnonzero(w.row[: len(g)] == w.row[size - 1 : size - 1 + len(g)])
    row, h = w.row[at], g[at]
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.array([mix(np.array([np.bitwise_xor.reduce(mix(w.hash[w.first[i] : w.first[i + 1]] + np.arange(1, n[i] + 1).astype(np.uint64)))], np.uint64))[0] for i in short], np.uint64)
        row, h = np.append(row, short), np.append(h, extra)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    heads = np.flatnonzero(run_heads(row, h))
    return row[heads], h[heads], np.diff(np.append(heads, len(row)))


_SIGNED = "doc_id long, hi long, lo long, n_shingles long, bands array<long>"


def signed(docs: DataFrame, weighted: bool = False, bands: int = BANDS, rows_: int = ROWS) -> DataFrame:
    """(doc_id, hi, lo, n_shingles, bands) of (doc_id, text): the set's 128-bit identity and band hashes (empty without words)."""

    def each(batches):
        for b in batches:
            for start, stop, data, offs in blocks(*raw(b.column(1))):
                m = stop - start
                row, h, n = shingles(data, offs)
                sig = signatures(row, h, n.astype(float) if weighted else np.ones(len(h)), m, bands * rows_)
                bits = sig.view(np.uint64).reshape(m, bands, rows_)
                key = np.zeros((m, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15)
                for j in range(rows_):
                    key = mix(key * _U64(31) + bits[:, :, j])
                item = h + n.astype(np.uint64) * _U64(0x632BE59BD9B4E019) if weighted else h
                heads = np.searchsorted(row, np.arange(m))
                has = np.diff(np.append(heads, len(row)))
                ident = []
                for salt in (1, 2):
                    x = np.zeros(m, np.uint64)
                    if len(h):
                        x[has > 0] = np.add.reduceat(mix(item ^ _U64(salt * 0xD6E8FEB86659FD93 & (2**64 - 1))), heads[has > 0])
                    ident.append(x.view(np.int64))
                lists = [key[i].view(np.int64) if has[i] else np.zeros(0, np.int64) for i in range(m)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, m), pa.array(ident[0]), pa.array(ident[1]), pa.array(has.astype(np.int64)), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "hi", "lo", "n_shingles", "bands"])

    return docs.mapInArrow(each, _SIGNED)


def sets(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """(doc_id, items): sorted distinct 32-bit shingle hashes, packed; for verification of pairs.

    Weighted, each occurrence of a shingle is an item of its own, so the Jaccard similarity of the items is that of the weights."""

    def each(batches):
        for b in batches:
            for start, stop, data, offs in blocks(*raw(b.column(1))):
                row, h, n = shingles(data, offs)
                if weighted:
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, h = np.repeat(row, n), mix(np.repeat(h, n) + nth.astype(np.uint64) * _U64(0xD6E8FEB86659FD93))
                low = (h >> _U64(32)).astype(np.uint32)
                cut = np.searchsorted(row, np.arange(stop - start + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), pa.array([np.unique(low[a:z]).tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["doc_id", "items"])

    return docs.mapInArrow(each, "doc_id long, items binary")


def verified(pairs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): the pairs whose sets have that Jaccard similarity at least. The leader's set is joined last, so it is not shuffled once per pair."""
    left = items.select(F.col("doc_id").alias("b"), F.col("items").alias("ib"))
    right = items.select(F.col("doc_id").alias("a"), F.col("items").alias("ia"))
    # Sets whose sizes differ too much cannot be similar.
    both = pairs.join(left, "b").join(right, "a").filter(F.least(F.length("ia"), F.length("ib")) >= similarity * F.greatest(F.length("ia"), F.length("ib")))

    def each(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(common >= similarity * (len(p) + len(q) - common) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "ia", "ib").mapInArrow(each, "a long, b long")


def crowded(crowd: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of different roots of crowd (doc_id, root), among them all whose sets have that Jaccard similarity.

    Sets are ordered by (frequency, hash) of their shingles. Two similar sets share a shingle among the first
    n - ceil(similarity n) + 1 of each, and the first one shared leaves room for the overlap they need. A shingle
    of one set only comes before all others and is never shuffled again."""
    mine = items.join(crowd, "doc_id")

    def each(batches):
        for b in batches:
            lists = [np.frombuffer(x, np.uint32).astype(np.int64) for x in b.column(1).to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            of = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(2).take(of), pa.array(np.repeat(n, n)), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))], names=["doc_id", "root", "n", "t"])

    shown = mine.select("doc_id", "items", "root").mapInArrow(each, "doc_id long, root long, n long, t long")
    shared = shown.groupBy("t").agg(F.count("*").alias("f")).filter("f > 1")
    # What only one root has makes no pair, but keeps its place in the order.
    common = shown.join(shared, "t").groupBy("doc_id", "root", "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("s"))
    alone = F.col("n") - F.size("s")
    prefix = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-6) + 1 - alone).cast("int")
    posted = checkpointed(common.withColumn("alone", alone).withColumn("s", F.slice("s", F.lit(1), F.greatest(prefix, F.lit(0)))).select("doc_id", "root", "n", "alone", F.posexplode("s")).select("doc_id", "root", "n", (F.col("n") - F.col("alone") - F.col("pos")).alias("left"), F.col("col.t").alias("t")))
    x = posted.select("t", *(F.col(c).alias(f"x{c}") for c in ("doc_id", "root", "n", "left")))
    y = posted.select("t", *(F.col(c).alias(f"y{c}") for c in ("doc_id", "root", "n", "left")))
    need = similarity / (1 + similarity) * (F.col("xn") + F.col("yn")) - 1e-6
    met = x.join(y, "t").filter((F.col("xdoc_id") < F.col("ydoc_id")) & (F.col("xroot") != F.col("yroot")) & (F.least("xleft", "yleft") >= need))
    return met.select(F.col("xdoc_id").alias("a"), F.col("ydoc_id").alias("b")).distinct()


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, weighted: bool = False, rounds: int = 3) -> DataFrame:
    """(doc_id, class_id, n_shingles), one row per input row."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    s = checkpointed(signed(docs, weighted))
    usable = s.filter("doc_id IS NOT NULL AND n_shingles > 0")
    reps = checkpointed(usable.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    same_doc = usable.groupBy("hi", "lo").agg(F.min("doc_id").alias("a")).join(usable.select("hi", "lo", "doc_id").distinct(), ["hi", "lo"]).select("a", F.col("doc_id").alias("b"))
    order: Column = F.xxhash64("band", "rep")
    buckets = reps.select("rep", F.explode("bands").alias("band")).withColumn("o", order)
    lead = buckets.groupBy("band").agg(F.min_by("rep", F.struct("o", "rep")).alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = checkpointed(buckets.join(lead, "band").select("band", "o", "a", F.col("rep").alias("b")))
    pairs = checkpointed(members.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = members.select(F.col("b").alias("doc_id")).distinct()
    items = checkpointed(sets(docs.join(wanted, "doc_id", "left_semi"), weighted).groupBy("doc_id").agg(F.max("items").alias("items")))
    links = verified(pairs, items, similarity).unionAll(same_doc)
    tried, comp = pairs, checkpointed(components(links, 200_000))
    for i in range(rounds + 1):
        placed = members.join(comp, members["b"] == comp["node"], "left").select("band", "o", F.col("b"), F.coalesce("root", "b").alias("root"))
        mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
        crowd = placed.join(mixed, "band")
        if i == rounds:
            break
        w = Window.partitionBy("band").orderBy("o", "b")
        near = crowd.withColumn("p", F.lag("b").over(w)).withColumn("pr", F.lag("root").over(w)).filter("p IS NOT NULL AND pr <> root")
        more = checkpointed(near.select(F.least("b", "p").alias("a"), F.greatest("b", "p").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
        found = checkpointed(verified(more, items, similarity))
        if found.isEmpty():
            break
        # What is known already stands for the links behind it.
        known = comp.select(F.col("node").alias("a"), F.col("root").alias("b"))
        comp, tried = checkpointed(components(known.unionAll(found), 200_000)), tried.unionAll(more)
    crowd = checkpointed(crowd.select(F.col("b").alias("doc_id"), "root").distinct())
    if not crowd.isEmpty():
        found = checkpointed(verified(checkpointed(crowded(crowd, items, similarity)), items, similarity))
        if not found.isEmpty():
            comp = checkpointed(components(comp.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found), 200_000))
    return s.join(comp, s["doc_id"] == comp["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), "n_shingles")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows, all columns, of each class's least doc_id; of repeated rows of one doc_id one stays, null ids all stay."""
    found = checkpointed(near_classes(df, id_col, text_col, **how))
    drop = found.filter("class_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = df.join(drop, id_col, "left_anti")
    if found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    null = F.col(id_col).isNull()
    return kept.filter(~null).dropDuplicates([id_col]).unionAll(kept.filter(null))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLES: dict[str, str] = {}
