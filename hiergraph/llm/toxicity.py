"""Operator 7, toxicity by a counterfactually regularised classifier.

A logistic model over the presence of words and of beginnings of words. Labelled texts that
name a group are swapped: the term is taken out and every other term of its class put in (in the
sample or not), the features of the swapped text are scored, and training adds a penalty on the
squared change of the score (as logit, which does not fade where scores are near 0 or 1), so that naming one group rather than another does not move it. A term
that names a group is one feature, without its beginnings, so a swap of that feature is the swap of the word.

All features of the sample take part: an L1 penalty of PENALTY standard errors of the feature decides
which ones stay (solved over all features by growing the active set until none outside it would
move), and those that stay are fitted again with a small ridge only.

The fit sees about SAMPLE_ROWS labelled rows at most, chosen by a hash of the id (the documented
bound of the sample), and runs in one task of an executor, so the driver gets only the weights that are not zero;
scoring covers whole texts of all rows.

Defined edge cases: null, empty or word-less texts get the model's base rate
(predicted 0); a null id counts as the id '' and is not learned from; rows with null labels are not
learned from; repeated label or document rows count as often as they stand there; with no
labels at all the score is 0; repeated rows are answered alike; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_mod, documents, prefixes, raw, run_heads, word_hash, words
from .language import sample

#: Bound of the fit: labelled rows looked at.
SAMPLE_ROWS = 8_000
PREFIXES = (3, 4, 5, 6, 7)
PENALTY, FAIRNESS, RIDGE, ROUNDS = 2.0, 1.0, 1e-4, 300

#: Terms that name groups, by class; within a class each may stand for any other.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "musulman", "chrétien", "juif", "muslimisch", "christlich", "jüdisch", "cristiano", "judío"],
    ["black", "white", "asian", "latino", "african", "european", "noir", "blanc", "schwarz", "weiß", "negro", "blanco"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual", "homosexual"],
    ["immigrants", "foreigners", "refugees", "natives", "étrangers", "ausländer", "extranjeros"],
    ["old", "young", "disabled", "blind", "deaf"],
]


@cache
def group_names() -> np.ndarray:
    return np.unique(np.concatenate(swaps()))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash): the words of each text and the beginnings (PREFIXES characters) of longer ones that do not name a group."""
    w, names = words(data, offs), group_names()
    rest = names[np.minimum(np.searchsorted(names, w.hash), len(names) - 1)] != w.hash
    other = w._replace(row=w.row[rest], start=w.start[rest], end=w.end[rest], hash=w.hash[rest])
    parts = [(w.row, w.hash), *(prefixes(other, n) for n in PREFIXES)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = np.full(len(offs) - 1, self.bias)
        row, h = features(data, offs)
        if len(self.keys) and len(h):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            once = np.unique(row[hit] * len(self.keys) + at[hit])
            z += np.bincount(once // len(self.keys), self.weights[once % len(self.keys)], len(z))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def presence(rows: DataFrame) -> DataFrame:
    """(label, words: the distinct features of a text) of (label, text)."""

    def each(batches):
        for b in batches:
            lists = []
            for _, _, data, offs in blocks(*raw(b.column(1))):
                row, h = features(data, offs)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                one = run_heads(row, h)
                row, h = row[one], h[one].view(np.int64)
                lists += np.split(h, np.searchsorted(row, np.arange(1, len(offs) - 1))) if len(offs) > 1 else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["label", "words"])

    return rows.mapInArrow(each, "label int, words array<long>")


def swaps(terms: list[list[str]] = IDENTITY_TERMS) -> list[np.ndarray]:
    return [np.array(sorted({word_hash(t) for t in group}), np.uint64) for group in terms]


def _swapped(keys: np.ndarray, row: np.ndarray, col: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Counterfactual texts: (feature taken out, feature put in, 0 where the row holds that one already)."""
    pair_row, out, into = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for group in groups:
        mine = np.flatnonzero(np.isin(keys, group))
        for i in mine:
            at = row[col == i]
            for j in mine[mine != i]:
                pair_row.append(at)
                out.append(np.full(len(at), i))
                into.append(np.full(len(at), j))
    r, o, i = (np.concatenate(x) for x in (pair_row, out, into))
    return o, i, (~np.isin(r * len(keys) + i, row * len(keys) + col)).astype(float)


def _descend(label: np.ndarray, row: np.ndarray, col: np.ndarray, theta: np.ndarray, bias: float, pairs: tuple[np.ndarray, ...], fairness: float, l1: np.ndarray | None) -> tuple[np.ndarray, float]:
    """Full-batch proximal Adam with a step that falls to 0, from (theta, bias)."""
    out, into, new = pairs
    n, k = len(label), len(theta)
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, ROUNDS + 1):
        z = bias + np.bincount(row, theta[col], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        gz = (p - label) / n
        g = RIDGE * theta
        if len(out):
            # The score of the text less that of the swapped one, as logits: all other features are the same in both.
            d = fairness * (theta[out] - new * theta[into]) / len(out)
            g += np.bincount(out, d, k) - np.bincount(into, new * d, k)
        g = np.append(g + np.bincount(col, gz[row], k), gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 * (1 - (t - 1) / ROUNDS) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        step = rate * m / (1 - 0.9**t)
        theta, bias = theta - step[:-1], bias - step[-1]
        if l1 is not None:
            theta = np.sign(theta) * np.maximum(np.abs(theta) - rate[:-1] * l1, 0)
    return theta, float(bias)


def fit_arrays(label: np.ndarray, lists: list[np.ndarray], fairness: float = FAIRNESS, terms: list[list[str]] = IDENTITY_TERMS, penalty: float = PENALTY) -> Model:
    """Train on presence features; ``fairness`` weighs the counterfactual penalty, ``penalty`` the L1 one (terms that name groups are free of it)."""
    if not len(label):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    rate = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    h = np.concatenate(lists).astype(np.uint64)
    groups = swaps(terms)
    # Terms that no row holds are features too: others are swapped for them.
    keys, code = np.unique(np.concatenate([h, *groups]), return_inverse=True)
    code = code[: len(h)]
    n = np.bincount(code, minlength=len(keys))
    named = np.isin(keys, np.concatenate(groups))
    bound = np.where(named, 0, penalty * np.sqrt(n * rate * (1 - rate)))
    theta, bias = np.zeros(len(keys)), float(np.log(rate / (1 - rate)))

    def solved(active: np.ndarray, theta: np.ndarray, bias: float, l1: bool) -> tuple[np.ndarray, float]:
        ids = np.flatnonzero(active)
        place = np.full(len(keys), -1)
        place[ids] = np.arange(len(ids))
        mine = place[code] >= 0
        r, c = row[mine], place[code[mine]]
        out = np.zeros(len(keys))
        out[ids], bias = _descend(label, r, c, theta[ids], bias, _swapped(keys[ids], r, c, groups), fairness, bound[ids] / len(label) if l1 else None)
        return out, bias

    active = named | (np.abs(np.bincount(code, label[row], len(keys)) - n * rate) > bound)
    while True:
        theta, bias = solved(active, theta, bias, True)
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, theta[code], len(label)), -40, 40)))
        late = ~active & (np.abs(np.bincount(code, (p - label)[row], len(keys))) > 1.02 * bound)
        if not late.any():
            break
        active |= late
    active = named | (theta != 0)
    theta, bias = solved(active, theta, bias, False)
    kept = np.flatnonzero(theta)
    return Model(keys[kept], theta[kept], bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows whose crc32(id) mod 5 is not 0; features are made where the texts lie, the fit is one task."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("id").isNotNull() & (crc_mod("id", 5) != 0))
    # The sample is bounded, so it may be broadcast; texts are never shuffled.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample(known, "id", most, 7)), "id")

    def each(batches):
        label, lists = [], []
        for b in batches:
            label.append(b.column(0).to_numpy())
            lists += [x.values.to_numpy().view(np.uint64) for x in b.column(1)]
        # An order that no partitioning changes, so that sums round alike.
        label = np.concatenate(label).astype(float) if label else np.zeros(0)
        order = np.lexsort(([int(x[0]) if len(x) else 0 for x in lists], [int(x.sum()) for x in lists], label)) if lists else []
        m = fit_arrays(label[order] if lists else label, [lists[i] for i in order])
        yield pa.RecordBatch.from_arrays([pa.array([m.keys.tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias])], names=["keys", "weights", "bias"])

    r = presence(rows.select("label", "text")).repartition(1).mapInArrow(each, "keys binary, weights binary, bias double").first()
    return Model(np.frombuffer(r.keys, np.uint64), np.frombuffer(r.weights), r.bias) if r else fit_arrays(np.zeros(0), [])


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for b in batches:
            parts = [sent.value.scores(data, offs) for _, _, data, offs in blocks(*raw(b.column(2)))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=_OUT)

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (crc_mod(id_col, 5) == 0).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns; decided row by row where the row lies."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def each(batches):
        for b in batches:
            parts = [sent.value.scores(data, offs) for _, _, data, offs in blocks(*raw(b.column(at).cast(pa.string())))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield b.filter(pa.array(s < 0.5))

    return df.mapInArrow(each, df.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
