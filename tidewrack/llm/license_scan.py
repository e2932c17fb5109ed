"""License scans by MinHash bands over overlapping windows, in DataFrame functions only.

Templates are cut into classes by their number of five-word shingles, [4^c,
4^(c+1)). For each class a text is read in windows of 2 * 4^(c+1) shingles that
start every 4^(c+1), so a whole template always lies in one window. Only
shingles that some template of the class has count, since no other can collide
or be contained; they are found by a broadcast of the templates' shingles.

Every window gets BANDS MinHash values (bands of one row). A window that holds
0.75 of a template has a similarity of at least 0.75 / 8.25 to it after that
restriction, so that at least one band collides with a probability above
0.997, and above 1 - 1e-10 where the window holds nothing else. Candidates are
then verified by exact containment.

Texts are read once: what remains of their windows is a table of the few
shingles that templates have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.session import materialize

#: Bands of one MinHash value each.
BANDS = 64
LEAST_CONTAINMENT = 0.75
#: Up to so many shingles of templates are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 200_000

#: Notices by which public licenses ask to be named, and bodies of short licenses. A table of (license, text) can replace them.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
        NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
        AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
        NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
        OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
)


def notices(spark: SparkSession) -> DataFrame:
    """The notices as a table of (license, text)."""
    return spark.createDataFrame(list(NOTICES), "license string, text string")


def _words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingles(rows: DataFrame, *kept: str) -> DataFrame:
    """pos, shingle of every five-word shingle of ``words``; each word is hashed once, and each shingle from five such numbers."""
    hashed = rows.select(*kept, F.transform("words", lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") >= 5)
    placed = hashed.select(*kept, "h", F.posexplode("h").alias("pos", "_word")).where(F.col("pos") < F.size("h") - 4)
    return placed.select(*kept, "pos", F.xxhash64(*[F.get(F.col("h"), F.col("pos") + k) for k in range(5)]).alias("shingle"))


def template_table(templates: DataFrame) -> DataFrame:
    """template, license, n, cls, shingle: a row per distinct shingle. Templates of fewer than five words are refused by an error."""
    words = templates.where(F.col("text").isNotNull()).select("license", F.xxhash64("license", "text").alias("template"), _words(F.col("text")).alias("words"))
    short = [r.license for r in words.where(F.size("words") < 5).select("license").limit(10).collect()]
    if short:
        raise ValueError(f"templates of fewer than five words: {short}")
    rows = _shingles(words, "license", "template").select("license", "template", "shingle").distinct()
    sizes = rows.groupBy("template").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return rows.join(sizes, "template").select("template", "license", "n", F.floor(F.log(4.0, F.col("n") + 0.5)).cast("int").alias("cls"), "shingle")


def _signature(n: int) -> list[Column]:
    return [F.min(F.xxhash64(F.lit(i), "shingle")).alias(f"m{i}") for i in range(n)]


def _bands(n: int) -> Column:
    return F.posexplode(F.array(*[F.col(f"m{i}") for i in range(n)])).alias("band", "value")


def matches(docs: DataFrame, templates: DataFrame, bands: int = BANDS, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """doc_id, text_hash, license, containment, word (first word of the window): the best window of every text and license."""
    table = materialize(template_table(templates), "license-templates")
    small = table.count() <= MAX_BROADCAST

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if small else rows  # at most ``bands`` times the checked number of rows

    known = sent(table.select("cls", "shingle").distinct())
    words = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), _words(F.col("text")).alias("words"))
    hits = _shingles(words, "doc_id", "text_hash").join(known, "shingle")
    step = F.pow(F.lit(4), F.col("cls") + 1).cast("int")
    at = F.floor(F.col("pos") / step).cast("int")
    windowed = hits.withColumn("window", F.explode_outer(F.array(at, at - 1))).select("doc_id", "text_hash", "cls", "window", "shingle").distinct()
    windowed = materialize(windowed, "license-windows")
    key = ["doc_id", "text_hash", "cls", "window"]
    signed = windowed.groupBy(*key).agg(*_signature(bands)).select(*key, _bands(bands))
    wanted = table.groupBy("cls", "template").agg(*_signature(bands)).select("cls", "template", _bands(bands))
    near = signed.join(sent(wanted), ["cls", "band", "value"]).select(*key, "template").distinct()
    inside = near.join(windowed, [windowed[k].eqNullSafe(near[k]) for k in key]).select(*[near[k] for k in key], "template", "shingle")
    common = inside.join(sent(table.select("template", "license", "n", "shingle")), ["template", "shingle"])
    share = common.groupBy(*key, "template", "license", "n").agg((F.count(F.lit(1)) / F.col("n")).alias("containment"))
    first = F.greatest(F.col("window"), F.lit(0)) * F.pow(F.lit(4), F.col("cls") + 1).cast("int")
    good = share.where(F.col("containment") >= least).withColumn("word", first)
    best = good.groupBy("doc_id", "text_hash", "license").agg(F.max(F.struct("containment", (-F.col("word")).alias("back"))).alias("b"))
    return best.select("doc_id", "text_hash", "license", F.col("b.containment").alias("containment"), (-F.col("b.back")).cast("int").alias("word"))


def scan(docs: DataFrame, templates: DataFrame | None = None, **options) -> DataFrame:
    """doc_id, n_licenses, licenses (name, containment, word of the window's start): one row per row of ``docs``.

    Null, empty and wordless texts have no licenses. Repeated rows get the same
    result; a null doc_id takes part. Extra columns play no part. An empty table
    gives an empty result.
    """
    found = matches(docs, notices(docs.sparkSession) if templates is None else templates, **options)
    lists = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("license", "containment", "word"))).alias("licenses"))
    lists = lists.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "licenses")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    empty = F.array().cast("array<struct<license:string,containment:double,word:int>>")
    return joined.select("doc_id", F.greatest(F.size("licenses"), F.lit(0)).alias("n_licenses"), F.coalesce("licenses", empty).alias("licenses"))
