"""Licence scan: sparse TF-IDF cosine of licence notices to templates, then inheritance from the nearest ancestor directory; DataFrame functions only.

A file's notice is made of the lines of its whole text that hold a cue (licence, copyright, SPDX...). Its
words are weighted by term frequency and inverse document frequency, the latter counted over the
notices of all files, and compared by cosine with each template under the same weights. The best
template of at least ``MIN_COSINE`` is the file's own licence. Where the notice as a whole resembles none, an
SPDX line decides, then the best window of the whole text: at each word that a longer template (headers and
licence texts) or a short notice has as its first cue, as many words as the template holds and a few more are compared with it. There
weights are counted over the templates and words that no template holds (names, years) are left out of the norm. A file without one takes that of the nearest
directory above it (its own directory first) that holds a licence file; where a directory holds several, the
first by path decides. Directories are resolved once each, so that a directory with a third of all
files costs one row in the path join.

The templates travel with the tasks: there are a few dozen, whatever the corpus.

Null and empty texts have no notice and may inherit. A null path has no directory and inherits nothing.
Ties of cosine go to the first template by name. Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_COSINE = 0.6
MIN_WINDOW_COSINE = 0.8
#: Words of years and holders that may stand inside the short proprietary notice.
NAME_WORDS = 12
CUE = r"(?i)licen[cs]e|copyright|spdx|all rights reserved|public domain"
_WORD = "[a-z0-9.+-]*[a-z0-9]"
#: The same words, found in one step each: a run of these signs holds one word, which begins with it.
_WORD_AT_ONCE = "(?<![a-z0-9.+-])(?:[.+-]*+[a-z0-9]++)++"

#: Short notices by licence, as commonly written.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)


#: Headers, titles and opening passages of licence texts, as published.
PASSAGES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
_PLAIN_WORD = "[a-z0-9]++(?:[.+-][a-z0-9]++)*+"
_ANCHOR = "^(?:licen[cs]e[ds]?|copyright|domain)$"
_SPDX = r"(?i)spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+(?:[ \t]+(?:and|or|with)[ \t]+[a-z0-9.+-]+)*)"


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "template string, text string")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD_AT_ONCE), F.lit(0))


def notice(text: Column) -> Column:
    """The lines that hold a cue, or null; the cheap test comes first."""
    lines = F.filter(F.split(text, r"[\n\r]"), lambda x: x.rlike(CUE))
    return F.when(text.rlike(CUE), F.array_join(lines, "\n"))


def own_licenses(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``path``, ``own_license``, ``cosine`` of the distinct files whose notice resembles a template."""
    notes = files.select("path", notice(F.col("text")).alias("note")).where("path is not null and note is not null").groupBy("path").agg(F.max("note").alias("note"))
    tf = notes.select("path", F.explode(words(F.col("note"))).alias("term")).groupBy("path", "term").agg(F.count("*").alias("tf"))
    ttf = listing.select("template", F.explode(words(F.col("text"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("ttf"))
    total = notes.agg(F.count("*").alias("files"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # Terms of the templates alone have df 0; their weight is that of a term never seen.
    idf = ttf.select("term").distinct().join(df, "term", "full").select("term", (F.log((F.lit(1.0) + total.scalar()) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1.0).alias("idf"))
    tw = ttf.join(idf, "term").select("template", "term", (F.col("ttf") * F.col("idf")).alias("tw"))
    tnorm = tw.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    w = tf.join(idf, "term").select("path", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy("path").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = w.join(F.broadcast(tw), "term").groupBy("path", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(F.broadcast(tnorm), "template").join(norm, "path").select("path", "template", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("cosine"))
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "template")).alias("b"))
    return best.select("path", F.col("b.template").alias("own_license"), (-F.col("b.minus")).alias("cosine")).where(F.col("cosine") >= MIN_COSINE)


def plain_words(text: Column) -> Column:
    """Words without the marks of comments around them; *licence* reads *license*."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "licence", "license"), F.lit(_PLAIN_WORD), F.lit(0))


def spdx(text: Column) -> Column:
    """The licence an SPDX line names, under the template's name where it is one; null without such a line."""
    found = F.regexp_extract(text, _SPDX, 1)
    base = F.regexp_replace(F.lower(found), r"(?:-only|-or-later|\+)$", "")
    known = sorted({t for t, _ in (*TEMPLATES, *PASSAGES)})
    names = F.coalesce(*[F.when(base == k.lower(), F.lit(k)) for k in known], found)
    return F.when(found != "", names)


def passages(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """``t``, ``template``, ``anchor`` (first cue), ``before`` it and ``tsize`` words, ``terms``; short notices included."""
    texts = listing.select("template", "text").unionByName(spark.createDataFrame(list(PASSAGES), "template string, text string"))
    at = texts.select("template", "text", plain_words(F.col("text")).alias("ws"))
    first = F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x.w.rlike(_ANCHOR))[0]
    return at.select(F.xxhash64("template", "text").alias("t"), "template", first.w.alias("anchor"), first.i.alias("before"), F.size("ws").alias("tsize"), F.array_distinct("ws").alias("terms")).where("anchor is not null")


def window_licenses(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``path``, ``own_license``, ``cosine`` by SPDX line or best window of the whole text."""
    noted = files.where("path is not null").where(F.col("text").rlike(CUE)).select("path", "text")
    by_line = noted.select("path", spdx(F.col("text")).alias("template")).where("template is not null").select("path", "template", F.lit(2).alias("kind"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("cosine"))
    ps = passages(files.sparkSession, listing)
    idf2 = ps.select("t", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", F.pow(F.log((F.lit(1.0) + ps.agg(F.count("*").alias("n")).scalar()) / (F.lit(1.0) + F.col("df"))) + 1.0, F.lit(2)).alias("w2"))
    size = ps.select("t", "template", F.explode("terms").alias("term")).join(idf2, "term").groupBy("t").agg(F.sum("w2").alias("t2"))
    at = noted.select("path", F.xxhash64("text").alias("h"), plain_words(F.col("text")).alias("ws"))
    at = at.select("path", "h", "ws", F.explode(F.filter(F.transform("ws", lambda w, i: F.struct(i.alias("i"), w.alias("anchor"))), lambda x: x.anchor.rlike(_ANCHOR))).alias("a"))
    slack = F.shiftright("tsize", 3) + 2
    names = F.when(F.col("template") == "Proprietary", F.lit(NAME_WORDS)).otherwise(F.lit(0))
    start = F.col("a.i") - F.col("before") - slack
    window = F.array_distinct(F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("tsize") + slack * 2 + names + F.least(start, F.lit(0))))
    near = at.join(F.broadcast(ps), F.col("a.anchor") == F.col("anchor")).select("path", "h", F.col("a.i").alias("i"), "t", "template", "terms", window.alias("ws"))
    near = near.where(F.size(F.array_intersect("ws", "terms")) * 2 >= F.size("terms"))
    each = near.select("path", "h", "i", "t", "template", "terms", F.explode("ws").alias("term")).join(F.broadcast(idf2), "term")
    sums = each.groupBy("path", "h", "i", "t", "template").agg(F.sum("w2").alias("w2"), F.sum(F.when(F.array_contains(F.col("terms"), F.col("term")), F.col("w2"))).alias("dot"))
    scored = sums.join(F.broadcast(size), "t").select("path", "template", (F.col("template") != "Proprietary").cast("int").alias("kind"), F.col("dot").alias("weight"), F.round(F.col("dot") / F.sqrt(F.col("w2") * F.col("t2")), 6).alias("cosine"))
    fit = scored.where(F.col("cosine") >= MIN_WINDOW_COSINE).unionByName(by_line)
    order = F.struct((-F.col("kind")).alias("k"), F.round(-F.col("cosine") * F.sqrt("weight"), 6).alias("s"), "template", "cosine")
    return fit.groupBy("path").agg(F.min(order).alias("b")).select("path", F.col("b.template").alias("own_license"), F.col("b.cosine").alias("cosine"))


def all_licenses(files: DataFrame, listing: DataFrame) -> DataFrame:
    """The licence of a file's notice where it resembles a template, else that of its SPDX line or best window."""
    more = window_licenses(files, listing).select("path", F.col("own_license").alias("l2"), F.col("cosine").alias("c2"))
    return own_licenses(files, listing).join(more, "path", "full").select("path", F.coalesce("own_license", "l2").alias("own_license"), F.coalesce("cosine", "c2").alias("cosine"))


def directory(path: Column) -> Column:
    """The path without its last part; "" for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(at: Column) -> Column:
    """The directory itself and all above it, as struct(depth, dir); the root is "" at depth 0."""
    parts = F.filter(F.split(at, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))


def scan(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``files`` rows (``doc_id``, ``path``) with ``own_license``, ``cosine``, ``license`` and ``inherited_from`` (path of the licence file, null for own licences)."""
    own = all_licenses(files, listing)
    at_dir = own.groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct("path", "own_license")).alias("first"))
    dirs = files.where("path is not null").select(directory(F.col("path")).alias("own_dir")).distinct()
    up = dirs.select("own_dir", F.explode(ancestors(F.col("own_dir"))).alias("a")).select("own_dir", "a.depth", "a.dir")
    nearest = up.join(at_dir, "dir").groupBy("own_dir").agg(F.max_by("first", "depth").alias("near"))
    rows = files.select("doc_id", "path").withColumn("own_dir", directory(F.col("path")))
    out = rows.join(own, "path", "left").join(nearest, "own_dir", "left")
    mine = F.col("own_license").isNotNull()
    return out.select("doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "near.own_license").alias("license"), F.when(~mine, F.col("near.path")).alias("inherited_from"))


def paths_of(docs: DataFrame) -> DataFrame:
    """A file tree for ``documents``, which has none: source / language / hundred / identifier. Null parts read ``unknown``."""
    part = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    return docs.select("doc_id", F.concat_ws("/", part("source"), part("lang"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string")).alias("path"), "text")


def sql() -> str:
    rows = ", ".join(f"('{n}', '{t}')" for n, t in TEMPLATES)
    return f"""
with templates(template, text) as (values {rows}),
files as (select doc_id, concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'), cast(doc_id // 100 as varchar), cast(doc_id as varchar)) as path, text from documents),
lines as (select path, unnest(regexp_split_to_array(text, '[\\n\\r]')) as line from files where regexp_matches(text, '{CUE}')),
tf as (select path, term, count(*) as tf from (select path, unnest(regexp_extract_all(lower(line), '{_WORD}')) as term from lines where regexp_matches(line, '{CUE}')) group by all),
ttf as (select template, term, count(*) as ttf from (select template, unnest(regexp_extract_all(lower(text), '{_WORD}')) as term from templates) group by all),
total as (select count(distinct path) as files from lines where regexp_matches(line, '{CUE}')),
df as (select term, count(*) as df from tf group by term),
idf as (select term, ln((1.0::double + files) / (1.0::double + coalesce(df, 0))) + 1.0::double as idf from (select distinct term from ttf) full join df using (term) cross join total),
tw as (select template, term, ttf * idf as tw from ttf join idf using (term)),
tn as (select template, sqrt(sum(tw * tw)) as tnorm from tw group by template),
w as (select path, term, tf * idf as w from tf join idf using (term)),
wn as (select path, sqrt(sum(w * w)) as norm from w group by path),
scored as (select path, template, round(sum(w * tw) / (any_value(norm) * any_value(tnorm)), 6) as cosine from w join tw using (term) join tn using (template) join wn using (path) group by path, template),
own as (select path, arg_min(template, (-cosine, template)) as own_license, max(cosine) as cosine from scored group by path having max(cosine) >= {MIN_COSINE}),
at_dir as (select regexp_replace(path, '/?[^/]*$', '') as dir, arg_min(own_license, path) as lic, min(path) as lic_path from own group by 1),
dirs as (select distinct regexp_replace(path, '/?[^/]*$', '') as own_dir from files),
up as (select own_dir, dir, length(dir) as depth, lic, lic_path from dirs join at_dir on dir = '' or own_dir = dir or starts_with(own_dir, dir || '/')),
near as (select own_dir, arg_max(lic, depth) as lic, arg_max(lic_path, depth) as lic_path from up group by own_dir)
select f.doc_id, f.path, o.own_license, o.cosine, coalesce(o.own_license, n.lic) as license, case when o.own_license is null then n.lic_path end as inherited_from
from files f left join own o using (path) left join near n on n.own_dir = regexp_replace(f.path, '/?[^/]*$', '')"""
