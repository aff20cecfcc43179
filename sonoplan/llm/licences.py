"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory; DataFrame operations only.

Texts become sparse vectors of terms, weighted by count and by the inverse frequency of the term among the
TEMPLATES (a term of no template weighs most, so it only lengthens the vector). A header is a line with one of
the ANCHORS; its licence is the template of the greatest cosine, if that is HEADER_COSINE or more. A
licence file is a whole text whose cosine to a template is FILE_COSINE or more; it is its directory's licence
(the greatest cosine of the directory's files, ties to the first name). A file without a licence of its own gets that
of the nearest directory above it which has one, found by joins of the distinct directories' ancestors.

What these notices do not tell is looked for further. An SPDX line names its licence (the first of an expression, without
"-only" and "-or-later"). Windows of 2 to MOST_LINES neighbouring lines, and lines, are held against the notices and the usual
headers (HEADERS) together, with HEADER_COSINE: that is for wrapped headers. Whole texts are held against the
full licence texts (the files of licence_texts, by licence) over pairs of neighbouring terms, with FILE_COSINE: pairs, as single words of
long texts are mostly those of any prose. A full text comes before headers, a line's notice before a window's;
"all rights reserved" comes last, as it stands in other licences' headers. Texts that no word of MARKS has are passed over:
MARKS are drawn from the templates so that what has none of them cannot reach the cosine. Of the full texts only pairs with such a
word count in the product (all pairs count in a text's own length), so a full text's cosine to itself is about 0.8.

Each text is looked at once, and only those with an anchor or a mark are kept. What is shuffled are the terms of their lines and texts, by
line, and sums by directory that each task forms first; a directory that holds a large part of all files is met from a broadcast
table of bounded size. The templates are a fixed list and go along as literals, or as a small table.

Defined results: null and empty texts, and such without an anchor or a mark, have no licence of their own; equal cosines
go to the first name in the alphabet; rows that repeat are each judged; null parts of a document's path are "none", a null path
inherits nothing; other columns stay, and where one has the name of a new column, the new one has "_found" behind its name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, meet_hot, stash, table

HEADER_COSINE = 0.75
FILE_COSINE = 0.5
#: Short notices of licences, as their texts recommend them.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all-rights-reserved": ["All rights reserved."],
}
ANCHORS = r"(?i)licen[cs]|rights reserved|permission|redistribution|public domain"
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
_FREE = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
#: The headers that licences recommend for source files.
HEADERS = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "GPL-2.0": [_FREE.format("program", ";", "", ";", 2), "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "GPL-3.0": [_FREE.format("program", ":", "", ",", 3)],
    "LGPL-3.0": [_FREE.format("program", ":", "Lesser ", ",", 3), _FREE.format("library", ";", "Lesser ", ";", 3)],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
#: Most lines of a window.
MOST_LINES = 5
_SPDX = r"SPDX-License-Identifier:\s*\(?\s*([A-Za-z0-9.\-]+)"

_NOTICES = [(name, Counter(re.findall(TERM, text.lower()))) for name, texts in TEMPLATES.items() for text in texts]
_IDF = {t: math.log((1 + len(_NOTICES)) / (1 + sum(t in n for _, n in _NOTICES))) + 1 for _, own in _NOTICES for t in own}
#: Weight of a term that no template has.
UNSEEN = math.log(1 + len(_NOTICES)) + 1


def template_weights() -> list[tuple[str, dict[str, float]]]:
    """Unit vectors of the notices."""
    out = []
    for name, own in _NOTICES:
        weights = {t: n * _IDF[t] for t, n in own.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out.append((name, {t: w / norm for t, w in weights.items()}))
    return out


def _lookup(values: dict[str, float], term: Column, otherwise: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv)), term), F.lit(otherwise))


def best_templates(texts: DataFrame) -> DataFrame:
    """_id, licence, cosine (the greatest) of each row of texts (_id, _text) with a term."""
    terms = texts.select("_id", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(f"({TERM})"), 1)).alias("_t")).groupBy("_id", "_t").agg(F.count(F.lit(1)).alias("_n"))
    weighed = terms.withColumn("_w", F.col("_n") * _lookup(_IDF, F.col("_t"), UNSEEN))
    templates = template_weights()
    sums = weighed.groupBy("_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"), *(F.sum(F.col("_w") * _lookup(own, F.col("_t"), 0.0)).alias(f"_d{k}") for k, (_, own) in enumerate(templates)))
    cosine = lambda k: F.round(F.col(f"_d{k}") / F.col("_norm"), 6)
    names = sorted({n for n, _ in templates})
    of_name = {n: [cosine(k) for k, (m, _) in enumerate(templates) if m == n] for n in names}
    greatest = {n: reduce(lambda a, b: F.greatest(a, b), cs) for n, cs in of_name.items()}
    ranked = F.array_max(F.array(*(F.struct(greatest[n].alias("cosine"), F.lit(-k).alias("place"), F.lit(n).alias("licence")) for k, n in enumerate(names))))
    return sums.select("_id", ranked.alias("_r")).select("_id", "_r.licence", "_r.cosine")


class Space:
    """Unit vectors of templates over terms, or over pairs of neighbouring terms; single terms count by the root of their number, as headers repeat common words."""

    def __init__(self, templates: list[tuple[str, str]], pairs: bool):
        self.pairs, self.power = pairs, 1.0 if pairs else 0.5
        own = [(name, Counter(self._terms(text))) for name, text in templates]
        self.names = [name for name, _ in own]
        self.idf = {t: math.log((1 + len(own)) / (1 + sum(t in n for _, n in own))) + 1 for _, n in own for t in n}
        self.unseen = math.log(1 + len(own)) + 1
        self.vectors = []
        for _, n in own:
            weights = {t: k ** self.power * self.idf[t] for t, k in n.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors.append({t: w / norm for t, w in weights.items()})

    def _terms(self, text: str) -> list[str]:
        words = re.findall(TERM, text.lower())
        return [f"{a} {b}" for a, b in zip(words, words[1:])] if self.pairs else words

    def terms(self, text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)
        if not self.pairs:
            return words
        paired = F.transform(F.array(words), lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))
        return F.filter(F.element_at(paired, 1), lambda x: x.isNotNull())

    def table(self, spark: SparkSession) -> DataFrame:
        """_t, _idf, _ws: each term's weight and its weights in the templates (0 where it is left out)."""
        rows = [(t, idf, [v.get(t, 0.0) for v in self.vectors]) for t, idf in sorted(self.idf.items())]
        return spark.createDataFrame(rows, "_t string, _idf double, _ws array<double>")

    def marks(self, share: float) -> set[str]:
        """Words such that the template terms that have one make up more than share of each template's squared length: the likeliest first."""
        out: set[str] = set()
        for vector in self.vectors:
            rest = {t: (x * x, t.split(" ")) for t, x in vector.items()}
            while sum(x for x, ws in rest.values() if out.isdisjoint(ws)) >= 1 - share - 1e-6:
                gain: Counter = Counter()
                for x, ws in rest.values():
                    if out.isdisjoint(ws):
                        for w in set(ws):
                            gain[w] += x
                out.add(min(gain, key=lambda w: (w in _COMMON or len(w) < 3 or not w.isalpha(), -gain[w], w)))
        return out

    def only(self, words: set[str]) -> None:
        """Leave of the templates the terms that have one of words, as unit vectors."""
        for k, v in enumerate(self.vectors):
            left = {t: x for t, x in v.items() if not words.isdisjoint(t.split(" "))}
            norm = math.sqrt(sum(x * x for x in left.values()))
            self.vectors[k] = {t: x / norm for t, x in left.items()}

    def best(self, texts: DataFrame, least: float) -> DataFrame:
        """_id, licence, cosine (the greatest) of each row of texts (_id, _text) with least or more."""
        terms = texts.select("_id", F.explode(self.terms(F.col("_text"))).alias("_t")).groupBy("_id", "_t").agg(F.count(F.lit(1)).alias("_n"))
        # The table's size is fixed by the templates.
        met = terms.join(F.broadcast(self.table(texts.sparkSession)), "_t", "left").withColumn("_w", F.pow("_n", F.lit(self.power)) * F.coalesce("_idf", F.lit(self.unseen)))
        part = lambda k: F.sum(F.col("_w") * F.coalesce(F.col("_ws")[k], F.lit(0.0)))
        sums = met.groupBy("_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"), *(part(k).alias(f"_d{k}") for k in range(len(self.names))))
        order = sorted(set(self.names))
        ranked = F.array_max(F.array(*(F.struct(F.round(F.col(f"_d{k}") / F.col("_norm"), 6).alias("cosine"), F.lit(-order.index(n)).alias("place"), F.lit(n).alias("licence")) for k, n in enumerate(self.names))))
        return sums.select("_id", ranked.alias("_r")).select("_id", "_r.licence", "_r.cosine").where(F.col("cosine") >= least)


#: Words of any English prose: drawn as marks only where nothing else suffices.
_COMMON = set("a all an and any are as at be but by can for from have if in is it its may not of on one or such that the these this to under use version was which with you your mit has his does own make must other those used within part either means mean list further been".split())
_LINES = Space([(n, t) for source in (TEMPLATES, HEADERS) for n, texts in source.items() for t in texts], False)
_TEXTS = Space([(p.stem, p.read_text()) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))], True)
#: Words of the full texts' pairs that count: a text without any of them has cosine 0, and a full text itself more than sqrt(TEXT_SHARE).
TEXT_SHARE = 0.6
_TEXT_WORDS = _TEXTS.marks(TEXT_SHARE)
_TEXTS.only(_TEXT_WORDS)
#: Words of which a text has one at least if a line, a window or the whole of it can be accepted. By Cauchy and Schwarz a cosine is at
#: most the length of that part of the template that the text shares; what these words leave of a template is shorter than HEADER_COSINE.
WORDS = sorted(_LINES.marks(1 - HEADER_COSINE**2) | _TEXT_WORDS | {"spdx"})
MARKS = r"(?<![a-z0-9.])(?:" + "|".join(f"{c}(?:{'|'.join(re.escape(w[1:]) for w in WORDS if w[0] == c)})" for c in sorted({w[0] for w in WORDS})) + ")(?![a-z0-9])"


def windows(some: DataFrame) -> DataFrame:
    """_id (of the text, of the window), _text: each 1 to MOST_LINES neighbouring lines that have a mark."""
    from_each = F.transform(F.array(F.split("text", "\n")), lambda ls: F.transform(F.sequence(F.lit(1), F.size(ls)), lambda i: F.slice(ls, i, MOST_LINES)))
    rows = some.select("_id", F.explode(F.element_at(from_each, 1)).alias("_ls"))
    rows = rows.select("_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("_ls")), lambda n: F.array_join(F.slice("_ls", 1, n), "\n"))).alias("_text"))
    return rows.where(F.lower("_text").rlike(MARKS)).select(F.struct("_id", F.monotonically_increasing_id().alias("line")).alias("_id"), "_text")


def scan(files: DataFrame) -> DataFrame:
    """The rows of files (path, text and others) with licence, cosine, origin (header, file, inherited) and licence_dir."""
    names = [c for c in files.columns if c != "text"]
    # What has neither an anchor nor a mark is passed over.
    looked_at = F.coalesce(F.col("text").rlike(ANCHORS) | F.lower("text").rlike(MARKS), F.lit(False))
    marked = files.select(F.struct(*names).alias("_row"), F.col("path").alias("_path"), F.when(looked_at, F.col("text")).alias("text"), F.monotonically_increasing_id().alias("_id"))
    marked = stash(marked, "licence-files")
    some = marked.where("text is not null")
    lines = some.select("_id", F.explode(F.split("text", "\n")).alias("_text")).where(F.col("_text").rlike(ANCHORS)).select(F.struct("_id", F.monotonically_increasing_id().alias("line")).alias("_id"), "_text")
    rank = F.struct(F.col("cosine"), (-F.array_position(F.array(*map(F.lit, sorted(TEMPLATES))), F.col("licence"))).alias("place"), F.col("licence").alias("licence"))
    headers = best_templates(lines).where(F.col("cosine") >= HEADER_COSINE).groupBy(F.col("_id._id").alias("_h")).agg(F.max(rank).alias("_header"))
    wrapped = _LINES.best(windows(some), HEADER_COSINE).groupBy(F.col("_id._id").alias("_v")).agg(F.max(rank).alias("_wrapped"))
    full = _TEXTS.best(some.select("_id", F.col("text").alias("_text")), FILE_COSINE).select(F.col("_id").alias("_g"), rank.alias("_full"))
    named = F.regexp_replace(F.regexp_extract("text", _SPDX, 1), "-(?:only|or-later)$", "")
    spdx = F.when(named.isin(*TEMPLATES), F.struct(F.lit(1.0).alias("cosine"), F.lit(0).alias("place"), named.alias("licence")))
    whole = best_templates(some.where(F.col("text").rlike(ANCHORS)).select("_id", F.col("text").alias("_text"))).where(F.col("cosine") >= FILE_COSINE).select(F.col("_id").alias("_f"), rank.alias("_file"))
    own = some.withColumn("_spdx", spdx).drop("text").join(headers, F.col("_id") == F.col("_h"), "left").join(whole, F.col("_id") == F.col("_f"), "left")
    own = own.join(wrapped, F.col("_id") == F.col("_v"), "left").join(full, F.col("_id") == F.col("_g"), "left")
    reserved = lambda c: F.col(f"{c}.licence") == "all-rights-reserved"
    said = [F.col("_spdx"), *(F.when(~reserved(c), F.col(c)) for c in ("_header", "_wrapped")), F.col("_header"), F.col("_wrapped")]
    own = own.select("_row", "_path", "_id", F.when(F.col("_full").isNull(), F.coalesce(*said)).alias("_header"), F.coalesce("_full", "_file").alias("_file"))
    own = stash(own.where("_header is not null or _file is not null"), "licences")

    parent = F.regexp_extract("_path", "^(.*)/[^/]*$", 1)
    of_dir = own.where("_file is not null").groupBy(parent.alias("_dir")).agg(F.max("_file").alias("_best"))
    judged = own.select("_row", F.coalesce("_header", "_file").alias("_r"), F.when(F.col("_header").isNotNull(), "header").otherwise("file").alias("origin"))
    judged = judged.select("_row", F.col("_r.licence").alias("licence"), F.col("_r.cosine").alias("cosine"), "origin", F.lit(None).cast("string").alias("licence_dir"))

    # Rows without a licence of their own: those whose text is passed over, and those looked at that no template fits.
    unmarked = marked.where("text is null").select("_row", "_path", "_id")
    anchored = some.select("_row", "_path", "_id").join(own.select(F.col("_id").alias("_own")), F.col("_id") == F.col("_own"), "left_anti")
    rest = unmarked.unionByName(anchored).withColumn("_parent", parent)
    dirs = stash(rest.groupBy("_parent").agg(F.count(F.lit(1)).alias("_n")), "directories")
    total = dirs.agg(F.sum("_n")).first()[0] or 0
    parts = F.split(F.col("_parent"), "/")
    above = dirs.select("_parent", "_n", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_depth")).withColumn("_dir", F.array_join(F.slice(parts, 1, F.col("_depth")), "/"))
    nearest = above.join(of_dir, "_dir").groupBy(F.col("_parent").alias("_key")).agg(F.max(F.struct("_depth", "_dir", "_best")).alias("_value"), F.first("_n").alias("_n"))
    inherited = meet_hot(rest, F.col("_parent"), F.xxhash64("_id"), stash(nearest, "nearest"), total).select(
        "_row", F.col("_value._best.licence").alias("licence"), F.col("_value._best.cosine").alias("cosine"),
        F.when(F.col("_value").isNotNull(), "inherited").alias("origin"), F.col("_value._dir").alias("licence_dir"),
    )
    return judged.unionByName(inherited).select("_row.*", *(F.col(c).alias(fresh(c, files.columns)) for c in ("licence", "cosine", "origin", "licence_dir")))


def document_path() -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id"))


def licence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, licence, cosine, origin, licence_dir of every document; its path is /source/lang/doc_id."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    rows = ", ".join(f"('{name}', {k}, '{t}', {w!r}e0)" for k, (name, own) in enumerate(template_weights()) for t, w in sorted(own.items()))
    idf = ", ".join(f"('{t}', {w!r}e0)" for t, w in sorted(_IDF.items()))
    anchors = "regexp_matches({0}, '" + ANCHORS.removeprefix("(?i)") + "', 'i')"

    def best(source: str, ids: str) -> str:
        return f"""(SELECT {ids}, licence, cosine FROM (SELECT {ids}, name AS licence, max(round(coalesce(dot, 0) / norm, 6)) AS cosine,
            row_number() OVER (PARTITION BY {ids} ORDER BY max(round(coalesce(dot, 0) / norm, 6)) DESC, name) AS r
          FROM (SELECT {ids}, sqrt(sum(w * w)) AS norm FROM w_{source} GROUP BY {ids}) JOIN (SELECT DISTINCT name, k FROM weights) ON true
          LEFT JOIN (SELECT {ids}, k, sum(x.w * t.w) AS dot FROM w_{source} x JOIN weights t ON x.term = t.term GROUP BY {ids}, k) USING ({ids}, k)
          GROUP BY {ids}, name) WHERE r = 1)"""

    def weigh(source: str, ids: str, text: str) -> str:
        return f"""w_{source} AS (SELECT {ids}, term, n * coalesce(idf, {UNSEEN!r}e0) AS w FROM (SELECT {ids}, term, count(*) AS n
          FROM (SELECT {ids}, unnest(regexp_extract_all(lower({text}), '{TERM}')) AS term FROM {source}) GROUP BY ALL) LEFT JOIN idf USING (term))"""

    return f"""
WITH weights(name, k, term, w) AS (VALUES {rows}), idf(term, idf) AS (VALUES {idf}),
files AS (SELECT doc_id, '/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'none') AS path, text FROM documents),
marked AS (SELECT * FROM files WHERE {anchors.format("text")}),
lines AS (SELECT doc_id, n, line FROM (SELECT doc_id, string_split(text, chr(10))[n] AS line, n FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM marked)) WHERE {anchors.format("line")}),
{weigh("lines", "doc_id, n", "line")}, {weigh("marked", "doc_id", "text")},
headers AS (SELECT doc_id, licence, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, licence) AS r FROM {best("lines", "doc_id, n")} WHERE cosine >= {HEADER_COSINE}) WHERE r = 1),
whole AS (SELECT * FROM {best("marked", "doc_id")} WHERE cosine >= {FILE_COSINE}),
dirs AS (SELECT dir, licence, cosine FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, w.licence, w.cosine, row_number() OVER (PARTITION BY dir ORDER BY w.cosine DESC, w.licence) AS r FROM whole w JOIN files USING (doc_id)) WHERE r = 1),
above AS (SELECT doc_id, dir, depth FROM (SELECT doc_id, unnest(range(1, 4)) AS depth, array_to_string(string_split(path, '/')[1:depth], '/') AS dir FROM files)),
near AS (SELECT doc_id, dir, licence, cosine FROM (SELECT a.doc_id, a.dir, d.licence, d.cosine, row_number() OVER (PARTITION BY doc_id ORDER BY depth DESC) AS r FROM above a JOIN dirs d USING (dir)) WHERE r = 1)
SELECT f.doc_id, f.path, coalesce(h.licence, w.licence, n.licence) AS licence, CASE WHEN h.licence IS NOT NULL THEN h.cosine WHEN w.licence IS NOT NULL THEN w.cosine ELSE n.cosine END AS cosine,
  CASE WHEN h.licence IS NOT NULL THEN 'header' WHEN w.licence IS NOT NULL THEN 'file' WHEN n.licence IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN h.licence IS NULL AND w.licence IS NULL THEN n.dir END AS licence_dir
FROM files f LEFT JOIN headers h USING (doc_id) LEFT JOIN whole w USING (doc_id) LEFT JOIN near n USING (doc_id)
"""
