import hashlib
import os
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from hiergraph import llm
from hiergraph.llm import contamination, language, licenses, lines, media, mixing, near, pii, suffixes, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(1, None), (2, ""), (3, "one"), (4, "a b c d e f g h i j k l " * 400), (4, "a b c d e f g h i j k l " * 400), (5, "é" * 70), (None, "mit license " * 9), (6, "\n\n"), (7, "x" * 200000)]
SCHEMA = "doc_id long, text string, hash string, pid string, id string, key string, term string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *"abcde") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_equals_sql(name, same):
    same(llm.QUERIES[name], llm.ORACLES[name])


APPLY = {
    "media": lambda s, d: media.read_media(media.store_texts(d)),
    "licenses": lambda s, d: licenses.scan(d),
    "near": lambda s, d: near.near_classes(d),
    "suffixes": lambda s, d: suffixes.cut_repeats(d, digest=True),
    "language": lambda s, d: language.predict(d, language.Model([], [np.zeros(0, np.uint64)] * 6, [np.zeros((0, 0))] * 6)),
    "lines": lambda s, d: lines.dedup_lines(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.fit_arrays(np.zeros(0), [])),
    "contamination": lambda s, d: contamination.digest(contamination.contamination(d, s.createDataFrame([(1, "a b c"), (2, None), (3, "")], "item_id long, text string"))),
    "pii": lambda s, d: pii.digest(pii.all_spans(d)),
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_odd_rows(name, spark, odd, nothing):
    assert sorted(str(r.doc_id) for r in APPLY[name](spark, odd).collect()) == sorted(str(i) for i, _ in ODD)
    assert APPLY[name](spark, nothing).count() == 0


def test_media_round_trip_and_damage():
    rng = random.Random(2)
    for n in (64, 4096, 8192, 65024, 300032):
        data = rng.randbytes(n)
        m = media.encode(data)
        assert media.decode(m)[0] == data
        bad = bytearray(m)
        bad[len(m) // 2] ^= 1
        assert media.read_container(bytes(bad)).bad_pages >= 1
        with pytest.raises(ValueError, match="damaged"):
            media.decode(bytes(bad))
    assert media.read_container(b"noise" + m).pages == media.read_container(m).pages


def test_media_errors_are_rows(spark):
    good = media.encode(bytes(range(64)))
    d = spark.createDataFrame([(1, 64, bytearray(good)), (2, 0, None), (3, 0, bytearray(b"OggS" * 5000)), (4, 0, bytearray(good[:-9])), (None, 0, bytearray(b""))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.read_media(d).collect()}
    assert got[1].error is None and got[1].payload_bytes == 64 and got[1].feature.startswith("streams=2;pages=3;packets=3")
    assert all(got[i].error and got[i].payload_sha256 is None for i in (2, 3, 4, None)) and got[2].media_bytes is None


def test_media_crc_by_bits():
    def crc(data):
        r = 0
        for x in data:
            r ^= x << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        return r

    assert media.page_crc(b"any bytes") == crc(b"any bytes")


def test_media_digests(spark, small, docs):
    for r in media.op1_media_columns(spark, small).collect():
        b = dict(docs)[r.doc_id].encode()
        p = b + bytes(-len(b) % 64 or (0 if b else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        m = media.encode(p)
        blocks = [len(p[i : i + media.PACKET]) for i in range(0, len(p), media.PACKET)]
        ms = [round(1000 * sum(blocks[t :: media.TRACKS]) / media.RATE) for t in range(media.TRACKS)]
        assert (r.media_bytes, r.media_sha256, r.error) == (len(m), hashlib.sha256(m).hexdigest(), None)
        assert f"packets={len(blocks) + media.TRACKS};ms={ms[0]},{ms[1]};mean={np.frombuffer(p, np.uint8).mean():.4f}" in r.feature


def test_licenses(spark, small, docs):
    for r in licenses.op2_license_scan(spark, small).collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), dict(docs)[r.doc_id]))
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
    t = licenses.TEMPLATES["bsd"][0].split()
    df = spark.createDataFrame([(1, "x y " + " ".join([*t[:9], "inserted", "words", *t[9:]]) + " z"), (2, "redistribution and use of bicycles")], "doc_id long, text string")
    assert [(r.doc_id, r.labels) for r in licenses.scan(df).orderBy("doc_id").collect()] == [(1, "bsd"), (2, "")]
    kin = [(k, licenses.TEMPLATES[label][0]) for k, label in enumerate(("gpl", "lgpl", "cc-by", "cc-by-sa"))]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(kin, "doc_id long, text string")).collect()}
    assert got == {0: "gpl", 1: "lgpl", 2: "cc-by", 3: "cc-by-sa"}


def test_license_votes_against_brute_force(spark, small, docs):
    """Diagonals, merging, cover and the best of overlapping spans by plain loops over all texts and some made ones."""
    rng, low = random.Random(2), lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    parts = [low(t) for texts in licenses.TEMPLATES.values() for t in texts]
    made = []
    for i in range(60):
        w = [f"x{rng.randrange(50)}" for _ in range(10)]
        for _ in range(rng.randrange(1, 4)):
            t = list(rng.choice(parts))
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t)) : rng.randrange(len(t) + 1)] = ["z"] * rng.randrange(4)
            w += t + ["y"] * rng.randrange(9)
        made.append((10**6 + i, " ".join(w)))
    k, gap, want = licenses.K, licenses.GAP, {}
    for i, t in docs + made:
        w, spans = low(t), []
        for label, texts in licenses.TEMPLATES.items():
            for v in map(low, texts):
                at = {}
                for p in range(len(v) - k + 1):
                    at.setdefault(tuple(v[p : p + k]), []).append(p)
                hits = sorted((q - p, q, p) for q in range(len(w) - k + 1) for p in at.get(tuple(w[q : q + k]), []))
                for n, (d, q, p) in enumerate(hits):
                    if not n or d - hits[n - 1][0] > gap:
                        spans.append([label, q, q, set(), len(v)])
                    s = spans[-1]
                    s[1], s[2] = min(s[1], q), max(s[2], q)
                    s[3] |= set(range(p, p + k))
        spans = [(s[0], s[1], s[2] + k, (len(s[3]), len(s[3]) / s[4])) for s in spans if len(s[3]) >= licenses.MIN_COVER * s[4] or len(s[3]) >= 4 * k]
        beaten = lambda x, y: x[0] != y[0] and y[3] > x[3] and 2 * (min(x[2], y[2]) - max(x[1], y[1])) >= min(x[2] - x[1], y[2] - y[1])
        want[i] = sorted(x[:3] for x in spans if not any(beaten(x, y) for y in spans))
    df = spark.createDataFrame(docs + made, "id long, text string").selectExpr("id", "xxhash64(text) key", "text")
    got = {i: [] for i in want}
    for r in licenses.license_spans(df).collect():
        got[r.id].append((r.label, r.start, r.end))
    assert {i: sorted(x) for i, x in got.items()} == want and sum(map(len, want.values())) > 60


def test_near_against_brute_force(spark, small, docs):
    sets = {}
    for i, t in docs:
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id: r.class_id for r in near.op3_near_dedup(spark, small).collect()} == {i: find(i) for i in ids}


def test_near_decides_crowded_buckets(spark, monkeypatch):
    """One bucket holds all: every similar pair in it is found, wherever its two texts stand."""
    rng, signed = random.Random(3), near.signed
    monkeypatch.setattr(near, "signed", lambda *a, **k: signed(*a, **k).withColumn("bands", near.F.expr("array(1L)")))
    frame = [f"frame{i}" for i in range(60)]
    texts = []
    for i in range(60):
        own = [f"own{i}x{j}" for j in range(40)]
        texts += [frame + own] if i % 3 else [frame + own, frame + own[:-1] + ["other"]]
    rng.shuffle(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    want = {i: min(j for j in range(len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(sets))}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near.near_classes(df).collect()}
    assert got == want and sum(want[i] != i for i in want) == 20


def test_weighted_near_against_brute_force(spark):
    """Repeated shingles weigh by their number, in signatures and in verification."""
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        parts = [[f"w{rng.randrange(9)}" for _ in range(7)] for _ in range(3)]
        base = [w for p in parts for w in p * rng.randrange(1, 9)]
        more = base + parts[0] * rng.randrange(4)
        texts += [base, more, base[: len(base) - rng.randrange(6)]]
    bags = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in texts]
    root = list(range(len(bags)))
    for i in range(len(bags)):
        for j in range(i):
            if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near.near_classes(df, weighted=True).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(root) - 10


def test_dart_signatures_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    row = np.repeat([0, 1], 300)
    s = near.signatures(row, np.r_[a, a], np.r_[np.full(300, 3.0), np.full(300, 1.5)], 2, 2000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05


def brute_cut(docs):
    least = {}
    for i, t in docs:
        b, i = (t or "").encode(), -(2**63) if i is None else i
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(least.get(b[k : k + 50], i), i)
    out = Counter()
    for i, t in docs:
        b, n = (t or "").encode(), -(2**63) if i is None else i
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < n:
                gone[k : k + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffixes_against_brute_force(spark, small, docs):
    assert Counter(map(tuple, suffixes.op4_suffix_dedup(spark, small).collect())) == brute_cut(docs)
    tricky = [(1, "a" * 300), (2, "a" * 60 + "b" * 49), (3, ""), (None, "b" * 60), (5, "ab" * 100), (6, "ba" * 40), (7, "b" * 49), (8, "b" * 50), (9, "c" + "b" * 50 + "é" * 40), (10, "é" * 40), (2, "a" * 60 + "b" * 49)]
    got = suffixes.cut_repeats(spark.createDataFrame(tricky, "doc_id long, text string"), digest=True).collect()
    assert Counter(map(tuple, got)) == brute_cut(tricky)


def test_suffix_array_and_shard_merge():
    rng = np.random.default_rng(1)
    for trial in range(60):
        a = rng.integers(1, 3 if trial % 2 else 200, int(rng.integers(0, 60))).astype(np.uint8)
        b = a.tobytes()
        order = suffixes.suffix_array(a)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp = suffixes.common_prefixes(a, order, 10)
        assert all(len(os.path.commonprefix([b[order[k - 1] :], b[order[k] :]])[:10]) == lcp[k] for k in range(1, len(b)))
    texts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(8, 30, 40)]
    offs, doc = np.cumsum([0] + [len(t) for t in texts]), rng.integers(0, 20, 40)
    data = np.frombuffer(b"".join(texts), np.uint8)
    assert (suffixes.least_documents(data, offs, doc, 8, 100) == suffixes.least_documents(data, offs, doc, 8, 1 << 20)).all()


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in language.op5_language_id(spark, d).collect() if r.held_out and r.lang_pred != "und"]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.97


def test_lines_are_reversible(spark, tmp_path):
    a = spark.createDataFrame([(i, "A shared line of some length\nown line number %d of this text" % i) for i in range(5)], "doc_id long, text string")
    b = spark.createDataFrame([(9, "A shared line of some length\nanother")], "doc_id long, text string")
    index = lines.LineIndex(spark, str(tmp_path / "index"), 4)
    index.insert(a)
    before, kept = sorted(map(tuple, index.counts().collect())), sorted(map(tuple, index.dropped(a).collect()))
    assert kept == sorted(map(tuple, lines.dedup_lines(a).collect()))
    index.insert(b)
    assert sorted(map(tuple, index.counts().collect())) != before and sorted(map(tuple, index.dropped(a).collect())) != kept
    again = lines.LineIndex(spark, str(tmp_path / "index"), 8)
    assert (again.version, again.shards) == (2, 4)
    again.delete(b)
    again.delete(spark.createDataFrame([(77, "never seen before in this index")], "doc_id long, text string"))
    assert sorted(map(tuple, again.counts().collect())) == before and sorted(map(tuple, again.dropped(a).collect())) == kept
    again.delete(a)
    assert again.counts().count() == 0
    assert all(not any(r.filter) for r in again.state.filter("filter IS NOT NULL").collect())


def test_shard_spares_searches_and_ends_empty():
    """Keys that share fingerprints and buckets: every one gets a fingerprint, and all leave again."""
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**62, (6000, 2)), axis=0)
    rows = np.column_stack([keys, np.zeros((len(keys), 1), np.int64), np.ones((len(keys), 2), np.int64)])
    shard = lines.Shard()
    shard.BLOCK = 500
    shard.insert(rows)
    assert shard.asked == len(keys) and shard.searched < 0.02 * len(keys)
    fp, a, b = shard.filter._places(shard._hashes(keys))
    twins = {}
    for i, k in enumerate(zip(fp.tolist(), np.minimum(a, b).tolist(), strict=True)):
        twins.setdefault(k, []).append(i)
    # Plant collisions: keys whose hash differs but whose fingerprint and buckets are those of a key that is there.
    h, planted = shard._hashes(keys), []
    while len(planted) < 20:
        x = rng.integers(0, 2**62, (400000, 2))
        pf, pa_, pb = shard.filter._places(shard._hashes(x))
        hit = [i for i, k in enumerate(zip(pf.tolist(), np.minimum(pa_, pb).tolist(), strict=True)) if k in twins]
        planted += [x[i] for i in hit]
    extra = np.array(planted)
    more = np.column_stack([extra, np.zeros((len(extra), 1), np.int64), np.ones((len(extra), 2), np.int64)])
    assert shard.filter.contains(shard._hashes(extra)).all()
    shard.insert(more)
    assert len(shard.table()) == len(rows) + len(more) and (shard.filter.table > 0).sum() == len(rows) + len(more)
    shard.delete(rows)
    assert shard.filter.contains(shard._hashes(extra)).all() and len(shard.table()) == len(more)
    shard.delete(more)
    assert not len(shard.table()) and not shard.filter.table.any()


def test_cuckoo_filter():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    f = lines.CuckooFilter(len(h))
    assert f.insert(h) and f.contains(h).all()
    assert f.contains(rng.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.01
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.01


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in toxicity.op7_toxicity(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.97


def said(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def fitted(texts, label, **how):
    row, h = toxicity.features(*said(texts))
    return toxicity.fit_arrays(np.array(label, float), [np.unique(h[row == i]) for i in range(len(texts))], **how)


def test_counterfactual_penalty_on_sentences():
    """Whole sentences through features(): no beginning of a term keeps what the penalty takes from the term."""
    for one, other, rest in (("immigrants", "natives", "refugees"), ("muslim", "christian", "jewish")):
        texts = [f"these {one} are vile"] * 40 + [f"these {other} are fine"] * 40 + ["they are vile"] * 10 + ["they are fine"] * 10
        label = ["vile" in t for t in texts]
        asked = said([f"some {t} came home" for t in (one, other, rest)])
        assert np.ptp(fitted(texts, label).scores(*asked)) < 0.05 < np.ptp(fitted(texts, label, fairness=0.0).scores(*asked))
        assert ((fitted(texts, label).scores(*said(texts)) >= 0.5) == label).all()
    assert set(toxicity.features(*said(["muslim"]))[1].tolist()) == {toxicity.word_hash("muslim")}


def test_toxicity_odd_rows_with_a_model(spark, odd, nothing):
    """Nulls in ids, texts and labels, repeated rows, other columns of any name; the fit runs on executors."""
    labels = spark.createDataFrame([(i % 7, int(i % 7 == 3), "x") for i in range(14)] + [(None, 1, "x"), (2, None, "x")], "doc_id long, toxic int, text string")
    m = toxicity.fit(odd, labels)
    got = toxicity.score(odd, m).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.keep_clean(odd, m).columns == odd.columns and toxicity.score(nothing, m).count() == 0
    assert toxicity.fit(nothing, labels).bias == -40.0 == toxicity.fit(odd, labels.limit(0)).bias


def test_language_odd_rows_with_a_model(spark, odd, nothing):
    train = spark.createDataFrame([(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, None, "en"), (4, "x", None), (None, "der hund", "de")], "doc_id long, text string, lang string")
    m = language.fit(train)
    got = {r.doc_id: r for r in language.predict(odd, m).collect()}
    assert m.langs == ["de", "en", "fr"] and got[1].lang_pred == "und" and got[2].score == 0.0 and got[3].lang_pred in m.langs
    assert language.predict(nothing, m).count() == 0 and language.fit(train.limit(0)).langs == []


def test_language_against_brute_force(spark):
    """Word log frequencies, then the longest known n-grams, by plain dictionaries."""
    train = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, "a cat and a dog", "en"), (4, "une table noire", "fr")]
    m = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    langs = ["en", "fr"]

    def grams(w, n):
        w = w if n == 1 else f" {w} "
        return [w[i : i + n] for i in range(len(w) - n + 1)]

    tables = [Counter() for _ in range(6)]
    for _, t, lang in train:
        for w in t.split():
            tables[0][w, lang] += 1
            for n in range(1, 6):
                for g in grams(w, n):
                    tables[n][g, lang] += 1

    def logs(n, x, lang):
        size, total = len({k for k, _ in tables[n]}), sum(v for (_, k), v in tables[n].items() if k == lang)
        return np.log((tables[n][x, lang] + 0.5) / (total + 0.5 * (size + 1)))

    def evidence(w):
        known = [{k for k, _ in t} for t in tables]
        if w in known[0]:
            return [logs(0, w, x) for x in langs]
        for n in range(5, 0, -1):
            hit = [g for g in grams(w, n) if g in known[n]]
            if hit:
                return [np.mean([logs(n, g, x) for g in hit]) for x in langs]
        return [0.0, 0.0]

    for text in ("the chat", "catalogue", "noir zebra table", "qqq"):
        want = np.sum([evidence(w) for w in text.split()], 0)
        assert np.allclose(m.scores(*said([text]))[0], want, atol=1e-4), text


def test_proximity(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("red blue a b c d e f g h".split()) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = contamination.build_index(d, str(tmp_path / "index"))
    names = {r.did: r.id for r in contamination.described(index).collect()}
    asked = [("red", "blue"), ("a", "b"), ("a", "a"), ("red", "none")]
    for each in (1, 100):
        got = Counter((names[r.did], r.a, r.b, r.pos_a, r.pos_b) for r in contamination.proximity_matches(index, spark.createDataFrame(asked, "a string, b string"), 4, each).collect())
        want = Counter()
        for i, t in enumerate(texts):
            w = (t or "").split()
            for a, b in asked:
                for p in (k for k, x in enumerate(w) if x == a):
                    near = [(abs(q - p), q) for q, x in enumerate(w) if x == b and q != p and abs(q - p) <= 4]
                    if near:
                        want[i, a, b, p, min(near)[1]] += 1
        assert got == want


def test_decontamination_in_blocks(spark, small, docs):
    """Small blocks of windows and documents give the rows of one block; repeated rows, short items and ties included."""
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(1, "a b a b a"), (1, "a b a b a"), (None, "a"), (5, None)], "doc_id long, text string"))
    items = spark.read.parquet(f"{small}/benchmark.parquet").selectExpr("cast(item_id as string) item_id", "text").unionAll(spark.createDataFrame([("x", "a b a"), ("y", "a"), (None, "a b a"), ("z", ""), ("u", "zebra not there")], "item_id string, text string"))
    say = lambda f: Counter(str(r) for r in contamination.digest(f).collect())
    one = say(contamination.contamination(d, items))
    assert one == say(contamination.contamination(d, items, windows_each=3000, documents_each=20))
    got = [r for r in contamination.contamination(d, items).collect() if r.n_words == 5 and r.n_hit]
    assert [(r.n_hit, r["items"]) for r in got] == [(5, ["", "x", "y"])] * 2


def test_mixing_rates(spark):
    d = spark.createDataFrame([(i, f"t{i}", "a" if i % 10 else "b") for i in range(4000)], "doc_id long, text string, source string")
    n = Counter(r.source for r in mixing.mix_sources(d, {"a": 1.0, "b": 3.0, "absent": 5.0}).collect())
    assert abs(n["b"] / (n["a"] + n["b"]) - 0.75) < 0.04


def test_mixing_large_means(spark):
    """A rare source at a mean of 2000: Poisson draws, not the length of the table for each row."""
    d = spark.createDataFrame([(i, f"t{i}", "a" if i < 40 else "b") for i in range(160000)], "doc_id long, text string, source string")
    n = [r.replicas for r in mixing.mix_sources(d).filter("source = 'a' AND replica = 0").collect()]
    assert len(n) == 40 and abs(np.mean(n) - 2000) < 5 * (2000 / 40) ** 0.5 and 20 < np.std(n) < 70
    for mean in (0.3, 5.0, 90.0):
        p = np.cumsum([np.exp(-mean) * np.prod(mean / np.arange(1, k + 1)) for k in range(260)])
        low, got = mixing.poisson_table(mean)
        assert abs(got - p[low : low + len(got)]).max() < 1e-12 and got[-1] == 1.0
    for mean in (800.0, 5000.0, 1e8):
        low, got = mixing.poisson_table(mean)
        k, p = np.arange(low, low + len(got)), np.diff(np.append(0, got))
        assert abs((k * p).sum() / mean - 1) < 1e-6 and abs((k * k * p).sum() - (k * p).sum() ** 2 - mean) < 0.01 * mean


def test_mixing_odd_rows(spark, odd, nothing):
    """Null ids, texts and sources, repeated rows, names of new columns in the input, an empty table."""
    d = odd.select("doc_id", "text", odd["hash"].alias("source"), odd["pid"].alias("rate"), odd["id"].alias("replica"), odd["key"].alias("Shuffle_key"), odd["term"].alias("replicas"))
    got = mixing.mix_sources(d, size=900.0)
    assert got.columns == [*d.columns, "mix_rate", "mix_replicas", "mix_replica", "mix_shuffle_key"]
    rows = got.collect()
    assert 700 < len(rows) < 1100 and {r.doc_id for r in rows} == {i for i, _ in ODD} and {r.rate for r in rows} == {"b"}
    n = Counter((r.doc_id, r.text) for r in rows)
    assert all(n[r.doc_id, r.text] == r.mix_replicas * ODD.count((r.doc_id, r.text)) for r in rows)
    empty = nothing.withColumn("source", nothing["hash"])
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_sources(d, {"absent": 1.0}).count() == 0
    assert mixing.mix_sources(d.withColumn("source", mixing.F.lit(None)), {"": 1.0}, 90.0).count() > 0


def luhn(x):
    return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(x)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, n: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, n: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, n: 13 <= len(n) <= 19 and luhn(n)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, n: 9 <= len(n) <= 15),
]


def test_pii_base(spark, docs):
    extra = ["a@b.com_c@d.org", "..a@b.c.", "x@y 1.2.3.4.5.6.7.8 999.1.1.1.1 01.002.3.0255", "+1 (415) 555-0199 + +123456789012345678", "4111 1111 1111 1111 4111-1111-1111-1111 5", "4111111111111111-", "é@a.b ü +33 1 23 45 67 89.", "1.2.3.4@5.6.7.8", "4111111111111111"]
    every = docs + [(10**6 + i, t) for i, t in enumerate(extra)]
    got = {r.doc_id: r for r in pii.digest(pii.all_spans(spark.createDataFrame(every, "doc_id long, text string"))).collect()}
    for i, t in every:
        spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in PATTERNS for m in re.finditer(p, t) if ok(m.group(), re.sub("[^0-9]", "", m.group())))
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), t[:80]


def brute_terms(rows, alpha=0.8, prior=1.0):
    """{(id, text): sorted term spans} by plain sets; rows (id, text)."""
    docs = {(i, t or "") for i, t in rows}
    ents = {d: {f"{k}:{m.group().lower()}" for k, p, ok in PATTERNS for m in re.finditer(p, d[1]) if ok(m.group(), re.sub("[^0-9]", "", m.group()))} for d in docs}
    base = {d: [m.span() for k, p, ok in PATTERNS for m in re.finditer(p, d[1]) if ok(m.group(), re.sub("[^0-9]", "", m.group()))] for d in docs}
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    words = {d: set(WORD.findall(low(d[1]))) for d in docs}
    n, n_t, n_c = len(docs), Counter(w for d in docs for w in words[d]), Counter(c for d in docs for c in ents[d])
    n_tc = Counter((t, c) for d in docs if ents[d] for t in words[d] for c in ents[d])
    told = {(t, c) for (t, c), x in n_tc.items() if (pmi := np.log((x + prior * n_c[c] / n) / (n_t[t] + prior) * n / n_c[c])) > 0 and pmi >= alpha * np.log(n / n_c[c])}
    out = {}
    for d in docs:
        terms = {t for t, c in told if c in ents[d] and t in words[d]}
        spans = [m.span() for m in WORD.finditer(low(d[1])) if m.group() in terms]
        out[d] = [x for x in spans if not any(y[0] < x[1] and x[0] < y[1] for y in base[d])]
    return out


@pytest.mark.parametrize("frequent", [1000, 10**9])
def test_pii_terms_against_brute_force(spark, docs, frequent, monkeypatch):
    """Repeated rows, an entity and terms in many documents, places far from the entity; hot keys by either way."""
    monkeypatch.setattr(pii, "FREQUENT", frequent)
    rng = random.Random(10)
    rows = docs + [(10**6 + i, f"Zorblax {'far ' * 40} away, write to jo{i % 30}@x.org or +33 1 23 45 67 {i % 7}0, zorblax{i % 9}") for i in range(120)]
    rows += [(2 * 10**6 + i, " ".join(rng.choice(["write", "to", "away", "plain", f"w{i}", "zorblax1"]) for _ in range(12))) for i in range(150)] + [rows[3], rows[-1], (None, "só é a@b.org aqui"), (None, "só é a@b.org aqui"), (9, None)]
    want = brute_terms(rows)
    got = pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(map(len, want.values())) > 100
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(want[i, t or ""])
    seen = {}
    for r in got:
        seen.setdefault(r.id, []).append([(t.start, t.end) for t in r.terms])
    assert {i: sorted(x) for i, x in seen.items()} == {i: sorted(x) for i, x in by.items()}


def test_pii_terms_and_text(spark):
    t = [(i, "write to zorblax, who is at jo@x.org now; Zorblax") if i < 4 else (i, f"plain words now to write {i} who is at") for i in range(40)]
    df = spark.createDataFrame(t, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert got[0] == "write to [term], who is at [email] now; [term]" and got[9] == t[9][1]


def brute_pipeline(spark, d):
    """{(doc_id, text, n_chars, replica): copies}: the model's decisions, then each stage by plain loops."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    bad = {(r.doc_id) for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect() if r.doc_id not in bad]
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t)
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t, _ in rows:
        for k in {key(x) for x in t.split("\n")}:
            held.setdefault(k, set()).add(i)
    gone = lambda i, x: len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i
    rows = [(i, "\n".join(x for x in t.split("\n") if not gone(i, x)), s) for i, t, s in rows]
    words = {i: WORD.findall(low(t)) for i, t, _ in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = [r for r in rows if find(r[0]) == r[0]]
    windows = set()
    for r in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        w = WORD.findall(low(r.text or ""))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    rows = [r for r in rows if not any(tuple(words[r[0]][k : k + n]) in windows for n in sizes for k in range(len(words[r[0]]) - n + 1))]
    count = Counter(s or "" for _, _, s in rows)
    tables = {s: mixing.poisson_table(len(rows) / len(count) / n) for s, n in count.items()}
    out = Counter()
    for i, t, s in rows:
        u = (int(hashlib.md5(f"9-draw|{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        first, cdf = tables[s or ""]
        out.update((i, t, len(t), k) for k in range(first + int(np.searchsorted(cdf, u))))
    return out


def test_pipeline_against_brute_force(spark, small):
    got = corpus_pipeline.run(spark, small)
    want = brute_pipeline(spark, small)
    assert Counter((r.doc_id, r.text, r.n_chars, r.replica) for r in got.collect()) == want and len(want) > 50
    assert set(corpus_pipeline.COLUMNS) | {"replica", "replicas", "rate", "shuffle_key"} == set(got.columns)


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, columns named like those of the stages, and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, rate string, row string, id long, terms string"
    rows = [(i, t, None, "s" if i and i % 2 else None, 3, "r", "w", 7, None) for i, t in ODD]
    for name, data in (("full", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 0, None), (None, 1, 1), (2, None, None)] if data else [], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "never there")] if data else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = corpus_pipeline.run(spark, d)
        assert {"rate", "mix_rate", "row", "id", "terms", "replica"} <= set(got.columns)
        assert (got.count() > 0) == bool(data)
