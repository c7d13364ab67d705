"""Operator 2, license scans by diagonal voting.

Every rolling K-word hash of every text is joined (Spark broadcast join; the
template table is fixed in this module, a few hundred rows) to the positions
that hash has in license templates. A hit votes for its diagonal, text position
minus template position; votes are counted by (text, template, diagonal) before
anything is gathered, diagonals at most GAP apart are merged (an insertion or
deletion of up to GAP words), and a merged span is verified by the words that align along its diagonals:
they must be the share MIN_COVER of the template's words, or 4 K words of a long template. Where spans of
two labels overlap by half of the shorter one, the one with more aligned words stays, of equally many the one
with the shorter template (equal ones both), so the words that tell a license from its kin decide.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.

Defined edge cases: a null or empty text has no words, labels '' and score 0;
a null id is kept; repeated rows are answered row by row with equal values; an
empty table gives an empty result; other columns are never looked at. Labels
are sets, so ties between templates need no order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, documents, kgrams, raw, run_heads, word_hash, words

K, GAP, MIN_COVER = 4, 6, 0.4

#: Phrases whose presence is a base label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices of public licenses (the wording that identifies each).
TEMPLATES = {
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "licensed under the Apache License"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "released under the GNU General Public License"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
}


def template_grams(templates: dict[str, list[str]], k: int = K) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    """(hash, template, position) of all k-grams, and (template, label, words)."""
    grams, about = [], []
    for label, texts in templates.items():
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            w = words(data, np.array([0, len(data)]))
            about.append((len(about), label, len(w.hash)))
            grams += [(int(h), len(about) - 1, p) for p, h in enumerate(kgrams(w.hash, k).view(np.int64))]
    return grams, about


_GRAMS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("pos", pa.int32()), ("gram", pa.int64())])


def text_grams(keyed: DataFrame, k: int = K) -> DataFrame:
    """(id, key, pos, gram): all rolling k-word hashes of id, key, text."""

    def each(batches):
        for b in batches:
            ids, keys = b.column(0), b.column(1)
            for lo, _, data, offs in blocks(*raw(b.column(2))):
                w = words(data, offs)
                g = kgrams(w.hash, k)
                at = np.flatnonzero(w.row[: len(g)] == w.row[k - 1 : k - 1 + len(g)])
                row = w.row[at]
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([pc.take(ids, take), pc.take(keys, take), pa.array((at - w.first[row]).astype(np.int32)), pa.array(g[at].view(np.int64))], schema=_GRAMS)

    return keyed.mapInArrow(each, "id long, key long, pos int, gram long")


def license_spans(keyed: DataFrame, templates: dict[str, list[str]] | None = None, k: int = K, gap: int = GAP, min_cover: float = MIN_COVER) -> DataFrame:
    """(id, key, label, start, end, cover): verified spans, in words, of texts (id, key, text); equal (id, key) count once."""
    grams, about = template_grams(templates or TEMPLATES, k)
    spark = keyed.sparkSession
    table = spark.createDataFrame(grams, "gram long, template int, tpos int")
    sizes = spark.createDataFrame(about, "template int, label string, n_template int")
    votes = (
        text_grams(keyed, k)
        .join(F.broadcast(table), "gram")
        .withColumn("diagonal", F.col("pos") - F.col("tpos"))
        .groupBy("id", "key", "template", "diagonal")
        .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("hits"))
    )
    # A diagonal holds a template at most once, so its set of template positions is bounded by the template.
    w = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    marked = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal", 1).over(w) > gap).cast("int")).withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(w))
    merged = marked.groupBy("id", "key", "template", "span").agg(F.min("lo").alias("start"), (F.max("hi") + k).alias("end"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda t: F.sequence(t, t + (k - 1))))))
    spans = (
        merged.join(F.broadcast(sizes), "template")
        .withColumn("covered", covered)
        .withColumn("cover", F.least(F.lit(1.0), F.col("covered") / F.col("n_template")))
        .filter((F.col("cover") >= min_cover) | (F.col("covered") >= 4 * k))
        .groupBy("id", "key")
        .agg(F.collect_list(F.struct("label", "start", "end", "cover", "covered")).alias("s"))
    )

    def beaten(x, y):
        common = F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"])
        return (x["label"] != y["label"]) & ((y["covered"] > x["covered"]) | (y["covered"] == x["covered"]) & (y["cover"] > x["cover"])) & (2 * common >= F.least(x["end"] - x["start"], y["end"] - y["start"]))

    best = F.filter("s", lambda x: ~F.exists("s", lambda y: beaten(x, y)))
    return spans.select("id", "key", F.explode(best).alias("x")).select("id", "key", "x.label", "x.start", "x.end", "x.cover")


_BASE = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string()))])


def base_phrases(keyed: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Word count and the places of fixed phrases, per row of (id, key, text)."""
    wanted = [(np.array([word_hash(x) for x in p.split()], np.uint64), p.encode().split(), label) for p, label in phrases.items()]

    def each(batches):
        for b in batches:
            n = b.num_rows
            count, places, first, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            labels: list[set[str]] = [set() for _ in range(n)]
            for lo, hi, data, offs in blocks(*raw(b.column(2))):
                w = words(data, offs)
                count[lo:hi] = np.diff(w.first)
                low = w.low.tobytes()
                for hashes, spelled, label in wanted:
                    at = np.flatnonzero(w.hash == hashes[0])
                    at = at[at + len(hashes) <= len(w.hash)]
                    for j in range(1, len(hashes)):
                        at = at[(w.hash[at + j] == hashes[j]) & (w.row[at + j] == w.row[at])]
                    for i in at.tolist():
                        if all(low[w.start[i + j] : w.end[i + j]] == s for j, s in enumerate(spelled)):
                            r = int(w.row[i])
                            p = i - int(w.first[r])
                            r += lo
                            places[r] += 1
                            first[r] = p if first[r] < 0 else min(first[r], p)
                            last[r] = max(last[r], p)
                            labels[r].add(label)
            none = places == 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count), pa.array(places), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string()))], schema=_BASE)

    return keyed.mapInArrow(each, "id long, key long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans, one row per input row.

    ``score`` is the best cover of a verified span; base phrases alone give 0.5, both combine as independent evidence."""
    t = F.col(f"`{text_col}`").cast("string")
    keyed = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("key"), t.alias("text"))
    found = license_spans(keyed).groupBy("id", "key").agg(F.collect_set("label").alias("found"), F.max("cover").alias("cover"), F.count_distinct("label", "start").alias("n_spans"))
    found = found.select(F.col("id").alias("fid"), F.col("key").alias("fkey"), "found", "cover", "n_spans")
    base = base_phrases(keyed)
    joined = base.join(found, base.id.eqNullSafe(found.fid) & (base.key == found.fkey), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        (1 - (1 - F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)) * (1 - F.coalesce("cover", F.lit(0.0)))).alias("score"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
