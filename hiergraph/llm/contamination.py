"""Operator 8 [native], benchmark decontamination by a positional inverted index.

The index is stored once, as Parquet in the shared checkpoint folder: a posting is (th, check, did, pos), th and check two
64-bit hashes that stand for the term, did a number of the document; each file holds the postings of a range of documents.
So no posting list is ever gathered in one place, and building the index needs neither a shuffle nor a sort. A mark, the
posting at position 0, carries a document's id, text hash and number of words.

Test windows are looked up list by list, rarest term first (by counts over the whole index):

1. postings of each window's rarest term give places where it could start;
2. the list of its second rarest term, offset-adjusted, is intersected with those;
3. the lists of all its terms are, for the few places left, with both hashes of each term.

Lookups are broadcast joins in blocks: at most WINDOWS_EACH windows, then at most DOCUMENTS_EACH document numbers at a
time; a block of documents is limited to its range of numbers, which Parquet's statistics prune by. Any
number of windows takes this one path, and only postings that a block wants are shuffled. Everything is DataFrame
functions; there is no Python.

Defined edge cases: null texts have no words; an item without words has no
windows; an item of fewer than WINDOW words is one window; the same window in
several items counts for each; a null item_id counts as ''; a null doc_id is
kept; equal rows are documents of their own; an empty benchmark
hits nothing; an empty table gives an empty result; only the named columns are
looked at.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, remove, scratch

WINDOW = 10
#: What a block of a lookup holds at most: the bound of each broadcast.
WINDOWS_EACH, DOCUMENTS_EACH = 100_000, 1_000_000
ROW_GROUP = 16 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands once before each text's words, so that every document has one posting.
_MARK = "\x00"


def lowered(text: Column) -> Column:
    """A-Z lower-cased; the faster general function where a text is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def tokens(text: Column) -> Column:
    """Words of a text (null: none) as an array; JVM only."""
    return F.coalesce(F.array_remove(F.split(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, at, words): all runs of ``size`` words, or the whole of a shorter item."""
    w = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), tokens(F.col(f"`{text_col}`").cast("string")).alias("w")).filter(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("at")
    return w.select("item", "w", at).select("item", "at", F.slice("w", F.col("at") + 1, F.lit(size)).alias("words"))


def term_hashes(term: str) -> tuple[Column, Column]:
    """The 128 bits by which the index knows a term."""
    return F.xxhash64(term).alias("th"), F.xxhash64(F.lit(8), F.col(term)).alias("check")


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the postings of all texts to ``path`` and read them back; position 0 is a mark, words follow from 1."""
    text = F.col(f"`{text_col}`").cast("string")
    w = docs.select(F.monotonically_increasing_id().alias("did"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key"), F.concat(F.array(F.lit(_MARK)), tokens(text)).alias("w"))
    flat = w.select("did", F.struct("id", "key", (F.size("w") - 1).cast("long").alias("n_words")).alias("doc"), F.posexplode("w").alias("pos", "term"))
    # Small row groups: they are what a writing task holds, and what a range of documents is pruned by.
    flat.select(*term_hashes("term"), "did", "pos", F.when(F.col("pos") == 0, F.col("doc")).alias("doc")).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _blocks(keyed: DataFrame, most: int) -> list[DataFrame]:
    """Rows (th, wid, ...) in blocks of about ``most``: by ranges of th, and where one range holds too many by a hash of wid."""
    ranges = -(-keyed.count() // most)
    if ranges <= 1:
        return [keyed] * ranges
    # The upper half of the hash, from 0, times the number of ranges: its own upper half is the range.
    of = F.shiftright((F.shiftright("th", 32) + 2**31) * ranges, 32)
    out = []
    for k, n in sorted(tuple(r) for r in keyed.groupBy(of).count().collect()):
        parts = -(-n // most)
        out += [keyed.filter((of == k) & (F.pmod(F.xxhash64("wid"), F.lit(parts)) == i)) for i in range(parts)]
    return out


def _within(index: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The postings in the range of a bounded set of values; the two ends are one row."""
    lo, hi = wanted.agg(F.min(column), F.max(column)).first()
    return index.filter(F.col(column).between(F.lit(lo), F.lit(hi))) if lo is not None else index.filter("false")


def _of_documents(index: DataFrame, wanted: DataFrame, most: int) -> list[tuple[DataFrame, DataFrame]]:
    """(wanted, postings): blocks of wanted rows (did, ...) by ranges of did, each with all postings of its documents."""
    number = -(-wanted.count() // most)
    if not number:
        return []
    cuts = wanted.agg(F.percentile_approx("did", [i / number for i in range(1, number)], 10_000)).first()[0] if number > 1 else []
    ends = sorted({-1, *cuts, 2**63 - 1})
    out = []
    for lo, hi in zip(ends, ends[1:], strict=False):
        mine = wanted.filter((F.col("did") > lo) & (F.col("did") <= hi))
        out.append((mine, _within(index, "did", mine).join(F.broadcast(mine.select("did").distinct()), "did", "left_semi")))  # at most about ``most`` numbers
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def phrase_matches(index: DataFrame, test: DataFrame, windows_each: int = WINDOWS_EACH, documents_each: int = DOCUMENTS_EACH) -> DataFrame:
    """(did, items, start, size): places of test windows (item, at, words); items holds all items of the window."""
    words = checkpointed(test.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("wid", F.monotonically_increasing_id()))
    counts = index.filter("pos > 0").groupBy("th").agg(F.count("*").alias("n"))
    lists = words.select("wid", F.posexplode("words").alias("o", "term")).withColumn("th", F.xxhash64("term")).join(counts, "th", "left")
    ranked = lists.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "o", "th"))).alias("r"))
    # A term that is in no document rules its window out at once. A window of one term has it as its second rarest, too.
    second = F.get("r", F.least(F.lit(1), F.size("r") - 1))
    keyed = checkpointed(ranked.filter(F.col("r")[0]["n"] > 0).select("wid", F.col("r")[0]["th"].alias("th"), F.col("r")[0]["o"].alias("o"), second["th"].alias("th2"), second["o"].alias("o2")))
    found = []
    for mine in _blocks(keyed, windows_each):
        heads = F.broadcast(mine.groupBy("th").agg(F.collect_list(F.struct("wid", "o", "th2", "o2")).alias("t")))  # at most about windows_each entries
        first = _within(index.filter("pos > 0"), "th", mine).join(heads, "th").select("did", "pos", F.explode("t").alias("t"))
        first = first.select("did", (F.col("pos") - F.col("t.o")).alias("start"), "t.wid", F.col("t.th2").alias("th"), (F.col("pos") - F.col("t.o") + F.col("t.o2")).alias("pos")).filter("start >= 1")
        seconds = index.filter("pos > 0").join(F.broadcast(mine.select(F.col("th2").alias("th")).distinct()), "th", "left_semi")  # as bounded
        left = checkpointed(first.join(seconds.select("did", "pos", "th"), ["did", "pos", "th"]).select("did", "start", "wid"))
        text = F.broadcast(words.join(F.broadcast(mine.select("wid")), "wid", "left_semi").select("wid", "items", "words"))  # as bounded
        for some, all_of in _of_documents(index, left, documents_each):
            asked = some.join(text, "wid").select("did", "start", "items", F.size("words").alias("size"), "wid", F.posexplode("words").alias("o", "term"))
            asked = asked.select("did", "start", "items", "size", "wid", (F.col("start") + F.col("o")).alias("pos"), *term_hashes("term"))
            met = asked.join(all_of.select("did", "pos", "th", "check"), ["did", "pos", "th", "check"]).groupBy("did", "start", "wid").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("items").alias("items"))
            found.append(checkpointed(met.filter("n = size").select("did", "items", (F.col("start") - 1).alias("start"), "size")))
    return _union(found) if found else index.sparkSession.createDataFrame([], "did long, items array<string>, start int, size int")


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int = 8, pairs_each: int = WINDOWS_EACH) -> DataFrame:
    """(did, a, b, pos_a, pos_b): for each place of a word a the nearest place of b at most ``within`` words off (the earlier of two
    as near), of word pairs (a, b). The lists meet in cells of ``within`` words, so nothing longer than a cell is compared."""
    (ta, ca), (tb, cb) = term_hashes("a"), term_hashes("b")
    pairs = checkpointed(pairs.select("a", "b", ta, ca, tb.alias("tb"), cb.alias("cb")).distinct().withColumn("wid", F.xxhash64("a", "b")))
    found = []
    for mine in _blocks(pairs, pairs_each):
        cell = F.floor(F.col("pos") / within)
        words = index.filter("pos > 0").select("did", "pos", "th", "check")
        left = words.join(F.broadcast(mine.select("th", "check", "a", "b")), ["th", "check"]).select("did", "a", "b", F.col("pos").alias("pa"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
        others = mine.select(F.col("tb").alias("th"), F.col("cb").alias("check"), "b").distinct()
        right = words.join(F.broadcast(others), ["th", "check"]).select("did", "b", F.col("pos").alias("pb"), cell.alias("cell"))
        near = left.join(right, ["did", "b", "cell"]).filter((F.abs(F.col("pa") - F.col("pb")) <= within) & (F.col("pa") != F.col("pb")))
        best = near.groupBy("did", "a", "b", "pa").agg(F.min(F.struct(F.abs(F.col("pb") - F.col("pa")).alias("d"), "pb"))["pb"].alias("pb"))
        found.append(best.select("did", "a", "b", (F.col("pa") - 1).alias("pos_a"), (F.col("pb") - 1).alias("pos_b")))
    return _union(found) if found else index.sparkSession.createDataFrame([], "did long, a string, b string, pos_a int, pos_b int")


def described(index: DataFrame) -> DataFrame:
    """(did, id, key, n_words): the documents of an index."""
    return index.filter(F.col("th") == F.xxhash64(F.lit(_MARK))).filter("pos = 0").select("did", "doc.id", "doc.key", "doc.n_words")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items, contaminated): one row for each input row. The index is removed once the
    result stands in the checkpoint folder."""
    path = scratch(docs.sparkSession, f"postings-{uuid4()}")
    index = build_index(docs, path, id_col, text_col)
    m = phrase_matches(index, windows(items), **limits)
    by = m.groupBy("did").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    j = described(index).join(by, "did", "left")
    none = F.array().cast("array<string>")
    # Length of the union of runs sorted by start.
    hit = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["end"]))).alias("n"), F.greatest(a["end"], r["end"]).alias("end")))["n"]
    hit = F.coalesce(hit, F.lit(0)).cast("long")
    out = checkpointed(j.select(F.col("id").alias("doc_id"), "key", "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items")).withColumn("contaminated", F.col("n_hit") > 0))
    remove(docs.sparkSession, path)
    return out


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = 0.0) -> DataFrame:
    """The rows, all columns, of which at most the share ``most`` of words is hit."""
    bad = contamination(docs, items, id_col, text_col).filter((F.col("n_hit") > 0) & (F.col("n_hit") > most * F.col("n_words"))).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    mine = docs.withColumn("__h", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    return mine.join(bad, mine[id_col].eqNullSafe(bad["__id"]) & (mine["__h"] == bad["__key"]), "left_anti").drop("__h")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLES = {
    "op8_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, w[i : i + least(10, len(w)) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM v),
p AS (SELECT doc_id, n, i, w[i : i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM p JOIN v USING (g)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
}
