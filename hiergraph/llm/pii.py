r"""Operator 10 [native], information-theoretic sanitisation of personal data.

Base spans (email, ip, card, phone) come from patterns and checks. They are the
protected entities. Every word of a document that holds an entity is a candidate; over the whole corpus,
with N documents, n(x) of which hold x and n(t, c) both, a term t discloses an entity c when

    PMI(t; c) = log(p(c | t) N / n(c)) >= ALPHA * IC(c),  IC(c) = log(N / n(c)),
    p(c | t) = (n(t, c) + PRIOR n(c) / N) / (n(t) + PRIOR),

the share of the term's documents that hold the entity, drawn towards its share of the corpus, so that few
documents are weak evidence. All places of a disclosing term in the entity's documents become spans of kind `term`;
sanitising replaces base spans by their kind and generalises terms (a number to [number], other words to
[term]). Everything is DataFrame functions; there is no Python.

As n(t, c) is at most n(c), a term in more than n(c)^ALPHA N^(1-ALPHA) (1 + PRIOR / N) documents cannot disclose c: rare
terms alone are joined to rare entities. Keys that more than a FREQUENT-th of all documents hold (at most FREQUENT times
what a document holds in the mean) are joined by broadcast, so no hot key is shuffled.

Matching is leftmost and non-overlapping per kind; a match that fails its check
is dropped without a retry. Positions are code points, ends exclusive.

Defined edge cases: null text is the empty text and has no spans; a null id is
kept; equal rows (id and text) are answered as often as they stand there and
count as one document everywhere; term spans that touch a base span are dropped; an empty
table gives an empty result; only the named columns are looked at.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, scratch
from .contamination import lowered, tokens

ALPHA, PRIOR, FREQUENT = 0.8, 1.0, 1000
KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, with anchors that stop a run of characters from being tried at each of its characters; a run
# that fails at its first character fails at any other. \G: the end of the match before, where a run may go on.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
# Maximal runs are what the plain pattern matches; only those of 13 to 19 digits can pass.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    r = F.reverse(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), add) % 10 == 0


def _check(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _passing(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda x: _check(kind, x["m"]))


def placed(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of all matches of a pattern: the pieces between them give the positions."""
    pieces = F.split(text, pattern)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out"))

    def go(a: Column, i: Column) -> Column:
        start = a["at"] + F.length(F.get(pieces, i))
        end = start + F.length(F.get(matches, i))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.get(matches, i).alias("m")))).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, go)["out"]).otherwise(zero["out"])


def _document(id_col: str, text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\x00")).alias("who"), F.xxhash64(text).alias("key")


def base_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, who, key, text, email, ip, card, phone): spans by kind, array<struct<start, end, m>>; (who, key) tells documents apart."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), *_document(id_col, text_col), text.alias("text"))
    t, none = F.col("text"), F.array().cast("array<string>")
    found = rows.select(
        "*",
        F.when(F.contains(t, F.lit("@")), F.regexp_extract_all(t, F.lit(_EMAIL), F.lit(0))).otherwise(none).alias("m_email"),
        F.regexp_extract_all(t, F.lit(_IP), F.lit(0)).alias("m_ip"),
        F.regexp_extract_all(t, F.lit(_CARD), F.lit(0)).alias("m_card"),
        F.when(F.contains(t, F.lit("+")), F.regexp_extract_all(t, F.lit(_PHONE), F.lit(0))).otherwise(none).alias("m_phone"),
    )
    patterns = dict(zip(KINDS, (_EMAIL, _IP, _CARD, _PHONE), strict=True))
    return found.select("id", "who", "key", "text", *(_passing(k, placed(t, F.col(f"m_{k}"), p)).alias(k) for k, p in patterns.items()))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _entities() -> Column:
    """Distinct kind:text of all base spans of a row."""

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x["m"])))

    return F.array_distinct(F.concat(*map(named, KINDS)))


def _counted(rows: DataFrame, counts: DataFrame, key: list[str], n: str, frequent: float, most: float | None = None) -> DataFrame:
    """``rows`` with their counts (key, n, ...), those above ``most`` left out; frequent keys are few and broadcast."""
    hot = counts.filter(F.col(n) > frequent)
    rest, often = counts.filter(F.col(n) <= frequent), hot
    if most is not None:
        rest, often = rest.filter(F.col(n) <= most), hot.filter(F.col(n) <= most)
    return rows.join(F.broadcast(often), key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(rest, key))


def term_counts(df: DataFrame, stored: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n_t): documents that hold each word. Counted by rows, less what repeated rows add, so only those are told apart by id."""
    text = F.col(f"`{text_col}`").cast("string")
    each = F.explode(F.array_distinct(tokens(text))).alias("term")
    path = scratch(df.sparkSession, f"repeated-{uuid4()}")
    # Written, so that Catalyst knows how small it is.
    stored.groupBy("who", "key").agg((F.count("*") - 1).alias("more")).filter("more > 0").write.parquet(path)
    again = df.sparkSession.read.parquet(path)
    twice = df.select(*_document(id_col, text_col), text.alias("__text")).join(again, ["who", "key"]).dropDuplicates(["who", "key"])
    less = twice.select(F.explode(F.array_distinct(tokens(F.col("__text")))).alias("term"), (-F.col("more")).alias("n"))
    counted = df.select(each).groupBy("term").agg(F.count("*").alias("n")).unionByName(less.groupBy("term").agg(F.sum("n").alias("n")))
    return counted.groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(df: DataFrame, stored: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, prior: float = PRIOR) -> DataFrame:
    """(who, key, entity, term, pmi): terms that disclose an entity of their document, of ``stored`` base spans with the texts of documents that have any."""
    holders = stored.filter(F.size(_entities()) > 0).dropDuplicates(["who", "key"])
    n, = stored.agg(F.count_distinct("who", "key")).first()
    held = holders.select("who", "key", F.explode(_entities()).alias("entity"))
    n_c = checkpointed(held.groupBy("entity").agg(F.count("*").alias("n_c")))
    top = n_c.agg(F.max("n_c")).first()[0] or 0
    frequent = max(100.0, n / FREQUENT)
    limit = lambda c: c**alpha * max(n, 1) ** (1 - alpha) * (1 + prior / max(n, 1)) - prior + 1e-6
    n_t = checkpointed(term_counts(df, stored, id_col, text_col).filter((F.col("n_t") <= limit(top)) | (F.col("n_t") > frequent)))
    # Words that are in too many documents for any entity never leave the document.
    words = holders.select("who", "key", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    words = _counted(words, n_t, ["term"], "n_t", frequent, limit(top))
    able = F.col("n_t") <= F.pow(F.col("n_c").cast("double"), F.lit(alpha)) * max(n, 1) ** (1 - alpha) * (1 + prior / max(n, 1)) - prior + 1e-6
    pairs = checkpointed(words.join(_counted(held, n_c, ["entity"], "n_c", frequent), ["who", "key"]).filter(able))
    share = (F.col("n_tc") + prior * F.col("n_c") / n) / (F.col("n_t") + prior) if n else F.lit(0.0)
    told = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_tc"), F.first("n_t").alias("n_t"), F.first("n_c").alias("n_c")).withColumn("pmi", F.log(share * n / F.col("n_c")))
    told = checkpointed(told.filter((F.col("pmi") > 0) & (F.col("pmi") >= alpha * F.log(n / F.col("n_c")))).select("entity", "term", "pmi", "n_tc"))
    return _counted(pairs.select("who", "key", "entity", "term"), told, ["entity", "term"], "n_tc", frequent).drop("n_tc")


def term_places(stored: DataFrame, told: DataFrame) -> DataFrame:
    """(who, key, start, end, term): all places of the terms (who, key, term) in their documents."""
    wanted = told.select("who", "key", "term").distinct()
    t = lowered(F.col("text"))
    texts = stored.filter(F.size(_entities()) > 0).dropDuplicates(["who", "key"]).join(wanted.select("who", "key").distinct(), ["who", "key"], "left_semi")
    each = texts.select("who", "key", F.posexplode(F.arrays_zip(F.split(t, _WORD).alias("gap"), F.regexp_extract_all(t, F.lit(_WORD), F.lit(0)).alias("term"))).alias("i", "x"))
    each = each.select("who", "key", "i", F.length("x.gap").alias("gap"), "x.term", F.coalesce(F.length("x.term"), F.lit(0)).alias("size"))
    # Running sums give the positions, whatever the length of a text.
    w = Window.partitionBy("who", "key").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(w).cast("int")
    return each.select("who", "key", "term", (end - F.col("size")).alias("start"), end.alias("end")).join(wanted, ["who", "key", "term"])


def all_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **limits) -> DataFrame:
    """(id, key, [text,] email, ip, card, phone, terms): terms are array<struct<start, end, m>> sorted by start."""
    base = base_spans(df, id_col, text_col)
    # Only documents with entities are looked into again; the text of others is not kept.
    stored = checkpointed(base if keep_text else base.withColumn("text", F.when(F.size(F.concat(*KINDS)) > 0, F.col("text"))))
    places = term_places(stored, checkpointed(disclosing(df, stored, id_col, text_col, **limits)))
    terms = places.groupBy("who", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("term").alias("m")))).alias("terms"))
    j = (stored if keep_text else stored.drop("text")).join(terms, ["who", "key"], "left").drop("who")
    base_all = F.concat(*KINDS)
    apart = F.filter(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,m:string>>")), lambda t: ~F.exists(base_all, lambda x: (x["start"] < t["end"]) & (t["start"] < x["end"])))
    return j.withColumn("terms", apart)


def _said(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def digest(spans: DataFrame) -> DataFrame:
    base = F.concat(*(_said(k, F.col(k)) for k in KINDS))
    return spans.select(
        F.col("id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _said("term", F.col("terms"))), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, text): base spans replaced by [kind], terms generalised; of overlapping spans the first, then the longest, counts."""
    s = all_spans(df, id_col, text_col, keep_text=True, **limits)

    def tag(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), F.lit(f"[{kind}]").alias("by")))

    tagged = [tag(k) for k in KINDS]
    tagged.append(F.transform("terms", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), F.when(x["m"].rlike("^[0-9]+$"), "[number]").otherwise("[term]").alias("by"))))

    def put(a: Column, x: Column) -> Column:
        go = x["start"] >= a["at"]
        return F.struct(F.when(go, -x["end"]).otherwise(a["at"]).alias("at"), F.when(go, F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"]), x["by"])).otherwise(a["out"]).alias("out"))

    done = F.aggregate(F.array_sort(F.concat(*tagged)), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put)
    return s.withColumn("d", done).select(F.col("id").alias("doc_id"), F.concat("d.out", F.substring("text", F.col("d.at") + 1, F.length("text"))).alias("text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(all_spans(documents(spark, sf_dir)))


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
