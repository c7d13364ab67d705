"""Operator 5, language identification by word-first backoff.

A known word adds its log frequency in each language; an unseen word falls back
to its character n-grams, from MAX_N down to 1 byte-safe characters: the longest
length at which any of its n-grams is known decides. Counts are made by Spark
over the training texts; every word and n-gram of the sample (about SAMPLE_ROWS
labelled rows at most, chosen by a hash of the id, the documented limit of the
fit) is an entry of the tables, so what is sent to the executors is bounded by the sample alone.

Defined edge cases: null text, or text without a letter: `und`, score 0; texts
whose letters give no evidence: the most frequent language; a null id is kept
and counts as the id ''; ties go to the alphabetically first language; rows
without lang are never learned from; with nothing to learn from all is `und`;
repeated rows are answered alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_mod, documents, kgrams, mix, raw, run_heads, words

#: Bound of the fit: labelled rows looked at.
SAMPLE_ROWS, MAX_N = 8_000, 5
_LETTER = regex.compile(r"\p{L}")


class Model:
    """Sorted hashes of known words (table 0) and n-grams (table n), with a row of log frequencies by language for each."""

    def __init__(self, langs: list[str], keys: list[np.ndarray], logs: list[np.ndarray]):
        self.langs, self.keys, self.logs = langs, keys, logs

    def find(self, kind: int, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where unknown."""
        table = self.keys[kind]
        if not len(table):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return np.where(table[at] == h, at, -1)

    def backoff(self, spelled: list[bytes]) -> np.ndarray:
        """Evidence of unseen words: the mean over the known n-grams of the greatest length that has any."""
        out = np.zeros((len(spelled), len(self.langs)))
        left = np.arange(len(spelled))
        for n in range(MAX_N, 0, -1):
            if not len(left):
                break
            h, word = grams([spelled[i] for i in left], n)
            at = self.find(n, h)
            word, at = word[at >= 0], at[at >= 0]
            n_known = np.bincount(word, minlength=len(left))
            hit = n_known > 0
            for k in range(len(self.langs)):
                total = np.bincount(word, self.logs[n][at, k], len(left))
                out[left[hit], k] = total[hit] / n_known[hit]
            left = left[~hit]
        return out

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Summed evidence per text and language."""
        w = words(data, offs)
        out = np.zeros((len(offs) - 1, len(self.langs)))
        if not len(w.hash) or not self.langs:
            return out
        kinds, place, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        at = self.find(0, kinds)
        value = np.zeros((len(kinds), len(self.langs)))
        value[at >= 0] = self.logs[0][at[at >= 0]]
        low, unseen = w.low.tobytes(), np.flatnonzero(at < 0)
        value[unseen] = self.backoff([low[a:z] for a, z in zip(w.start[place[unseen]].tolist(), w.end[place[unseen]].tolist(), strict=True)])
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(w.row, value[inverse, k], len(out))
        return out


def grams(spelled: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of code points of the words, a blank standing at both ends (not for n = 1), and whose each is."""
    text = (b" " + b" ".join(spelled) + b" ").decode("utf-8", "replace").lower()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    blank = codes == 32
    h = kgrams(mix(codes), n)
    size = len(h)
    ok = np.ones(size, bool) if n > 1 else ~blank[:size]
    for j in range(1, n - 1):
        ok &= ~blank[j : j + size]
    if n == 2:
        ok &= ~(blank[:size] & blank[1 : size + 1])
    at = np.flatnonzero(ok)
    word = np.cumsum(blank)[at] - 1
    keep = word < len(spelled)
    return h[at[keep]], word[keep]


def _summed(h: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((code, h))
    h, code, n = h[order], code[order], n[order]
    heads = np.flatnonzero(run_heads(h, code))
    return h[heads], code[heads], np.add.reduceat(n, heads) if len(heads) else n[:0], order[heads]


def counts(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(kind, hash, lang, n): kind 0 whole words, 1..MAX_N n-grams of the words' spelling; summed in each block before the shuffle."""

    def each(batches):
        for b in batches:
            names, code = np.unique(np.array(b.column(1).to_pylist(), str), return_inverse=True)
            for lo, _, data, offs in blocks(*raw(b.column(0)), most=4 << 20):
                w = words(data, offs)
                if not len(w.hash):
                    continue
                h, c, n, at = _summed(w.hash, code[lo + w.row], np.ones(len(w.hash), np.int64))
                low = w.low.tobytes()
                spelled = [low[a:z] for a, z in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
                parts = [(0, h, c, n)]
                for size in range(1, MAX_N + 1):
                    g, word = grams(spelled, size)
                    parts.append((size, *_summed(g, c[word], n[word])[:3]))
                for kind, h, c, n in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(names[c].astype(object), pa.string()), pa.array(n)], names=["kind", "hash", "lang", "n"])

    parts = train.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).mapInArrow(each, "kind int, hash long, lang string, n long")
    return parts.groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))


def sample(train: DataFrame, id_col: str, most: int, seed: int = 5) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the id: the same rows in any run and on any partitioning."""
    n = train.count()
    if n <= most:
        return train
    bits = 2**30
    return train.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(bits)) < F.lit(int(bits * most / n)))


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_ROWS) -> Model:
    train = train.select(id_col, text_col, lang_col).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = sample(train, id_col, most)
    langs = sorted(r[0] for r in rows.select(F.col(lang_col).cast("string")).distinct().collect())
    per = counts(rows, text_col, lang_col).groupBy("kind", "hash").agg(*(F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).cast("int").alias(f"n{i}") for i, k in enumerate(langs))) if langs else None
    parts = []
    table = per.toArrow() if langs else pa.table({"kind": pa.array([], pa.int32()), "hash": pa.array([], pa.int64())})
    kinds = table["kind"].to_numpy()
    for kind in range(MAX_N + 1):
        t = table.filter(pa.array(kinds == kind))
        h = t["hash"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        n = np.stack([t[f"n{i}"].to_numpy() for i in range(len(langs))], 1).astype(np.float32)[order] if langs else np.zeros((len(h), 0))
        parts.append((h[order], np.log((n + 0.5) / (n.sum(0) + 0.5 * (len(h) + 1))).astype(np.float32)))
    return Model(langs, [p[0] for p in parts], [p[1] for p in parts])


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the share of the best language among all, by evidence per word)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        m = sent.value
        for b in batches:
            texts = b.column(2)
            lettered = np.array([bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            e = [m.scores(data, offs) for _, _, data, offs in blocks(*raw(texts))]
            e = np.concatenate(e) if e else np.zeros((0, len(m.langs)))
            if not m.langs:
                pred, share = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            else:
                best = e.argmax(1) if len(e) else np.zeros(0, int)
                share = 1 / np.exp(np.maximum(e - e.max(1, keepdims=True), -60)).sum(1) if len(e) else np.zeros(0)
                pred = np.array(m.langs, object)[best]
            pred = np.where(lettered, pred, "und")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(np.where(lettered, share, 0.0))], schema=_OUT)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(id_col, modulus) == rest).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs.filter(crc_mod("doc_id", 4) != 2)))


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
