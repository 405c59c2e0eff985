"""Finding licence notices in texts, with DataFrame functions only.

Templates and documents become lower-case words and shingles of five words (shorter templates are one shingle). A
template is compared with overlapping windows of a document that are twice its size, rounded up to a power of
two, and step by half of a window, so that some window holds the whole notice. Windows and templates are hashed to
``BANDS`` bands of one minimum each: a window that holds 80 % of a template has a Jaccard similarity of at
least 0.16, so a band collides with that chance and all of them miss with less than 0.4 %; a full notice alone in
the smallest window that fits is missed with less than 1 in 10 000. Retrieved templates are verified: the share of their distinct
shingles that the document holds must reach the threshold.

Windows without a shingle of any template cannot reach it and are left out before hashing; that drops no match.
The templates are a bounded table (at most ``MOST_SHINGLES`` shingles, else an error), which is why they may be broadcast.

A licence may have several templates, and licences that differ in their version are a family: a document reports the template with
the largest containment of each licence, and of a family only the licences that reach its largest containment, so the notice
of one version is not reported as another that shares most of its words.

Documents without a match give no row. Rows with equal ids, and rows without an id, are one document with the best template of all
their texts. Null and empty texts match nothing; so do templates without words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import id_and_text

WORDS, THRESHOLD, BANDS, MOST_SHINGLES = 5, 0.8, 32, 20_000
#: windows are at most so many shingles; longer templates are retrieved by pieces of half of that
LARGEST = 128

# fixed values: usual short notices, headers and tags of licences
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files, to deal in the Software without restriction"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
     "the License, or (at your option) any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
     "the License, or (at your option) any later version"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("reserved", "All rights reserved."),
]


def family(license_id: Column) -> Column:
    """The licence without its version."""
    return F.regexp_replace(license_id, r"-[0-9.]+$", "")


def templates(spark: SparkSession, notices: list | None = None) -> DataFrame:
    return spark.createDataFrame(notices or NOTICES, "license_id string, notice string")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, size: Column | int) -> Column:
    """Hashes of the runs of ``size`` words, in order; none where there are fewer words."""
    n = F.lit(size)
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1),
                                                  lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def _minima(shingles: Column) -> Column:
    def least(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(seed))))

    return F.array(*[least(s) for s in range(BANDS)])


def _spans(size: int, width: int, wanted: Column) -> Column:
    """The overlapping windows of a width that hold a wanted shingle."""
    s = F.col(f"s{size}")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s)), F.lit(max(1, width // 2)))
    cut = F.filter(F.transform(starts, lambda i: F.slice(s, i, width)), lambda x: F.arrays_overlap(x, wanted))
    return F.transform(cut, lambda x: F.struct(F.lit(size).alias("size"), F.lit(width).alias("width"), x.alias("span")))


def license_matches(docs: DataFrame, notices: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, n_shared, n_shingles, containment) for every notice that a document holds."""
    spark = docs.sparkSession
    known = notices.select("license_id", words_of(F.col("notice")).alias("w")).where("size(w) > 0").withColumn(
        "size", F.least(F.lit(WORDS), F.size("w")))
    known = known.select("license_id", "size", shingles_of(F.col("w"), F.col("size")).alias("all"))
    # the templates are the parameter of the scan: at most MOST_SHINGLES shingles come to the driver
    rows = known.orderBy("license_id").limit(MOST_SHINGLES + 1).collect()
    every = sorted({h for r in rows for h in r["all"]})
    if len(every) > MOST_SHINGLES or len(rows) > MOST_SHINGLES:
        raise ValueError(f"more than {MOST_SHINGLES} template shingles")
    source = id_and_text(docs, id_col, text_col)
    if not rows:
        return source.limit(0).select("doc_id", F.lit("").alias("license_id"), F.lit(0).alias("n_shared"), F.lit(0).alias("n_shingles"), F.lit(0.0).alias("containment"))
    pieces, windows = [], {}
    for r in rows:
        step = LARGEST // 2
        for at in range(0, len(r["all"]), step):
            piece = r["all"][at:at + step]
            width = 2 << (len(piece) - 1).bit_length()
            windows.setdefault(r["size"], set()).add(width)
            pieces.append((r.license_id, r["size"], width, piece, sorted(set(r["all"]))))
    table = spark.createDataFrame(pieces, "license_id string, size int, width int, piece array<bigint>, shingles array<bigint>")
    table = table.select("license_id", "size", "width", "shingles", F.posexplode(_minima(F.col("piece"))).alias("band", "minimum"))
    sizes = sorted(windows)
    wanted = {k: F.array(*[F.lit(h) for h in sorted({h for r in rows if r["size"] == k for h in r["all"]})]) for k in sizes}
    # one-row generators: words and shingles are computed once, not again wherever a later expression names them
    found = source.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.array(words_of(F.col("text")))).alias("w"))
    found = found.select("doc_id", F.inline(F.array(F.struct(*[shingles_of(F.col("w"), k).alias(f"s{k}") for k in sizes]))))
    hit = F.lit(False)
    for k in sizes:
        hit = hit | F.arrays_overlap(f"s{k}", wanted[k])
    found = found.where(hit).withColumn("held", F.array_distinct(F.concat(*[F.array_intersect(f"s{k}", wanted[k]) for k in sizes])))
    spans = [_spans(k, width, wanted[k]) for k in sizes for width in sorted(windows[k])]
    spans = found.select("doc_id", "held", F.explode(F.concat(*spans)).alias("x")).select("doc_id", "held", "x.size", "x.width", F.col("x.span"))
    bands = spans.select("doc_id", "held", "size", "width", F.posexplode(_minima(F.col("span"))).alias("band", "minimum"))
    shared = F.size(F.array_intersect("held", "shingles"))
    pairs = bands.join(F.broadcast(table), ["size", "width", "band", "minimum"]).select(
        "doc_id", "license_id", shared.alias("n_shared"), F.size("shingles").alias("n_shingles"))
    match = F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shared", "n_shingles")
    best = (pairs.where(F.col("n_shared") >= threshold * F.col("n_shingles")).groupBy("doc_id", "license_id")
            .agg(F.max(match).alias("x")).select("doc_id", "license_id", "x.n_shared", "x.n_shingles", "x.containment"))
    top = F.max("containment").over(Window.partitionBy("doc_id", family(F.col("license_id"))))
    return best.withColumn("top", top).where("containment = top").drop("top")


def sql(notices: list | None = None) -> str:
    """The same matches without retrieval: every shingle of every template looked up in every document."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(notices or NOTICES))
    words = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH notices(no, license_id, notice) AS (VALUES {rows}),
t AS (SELECT no, license_id, {words.format('notice')} AS w FROM notices),
ts AS (SELECT no, license_id, least({WORDS}, len(w)) AS size, w FROM t),
tsh AS (SELECT DISTINCT no, license_id, size, array_to_string(w[i:i + size - 1], ' ') AS sh
  FROM (SELECT *, unnest(generate_series(1, len(w) - size + 1)) AS i FROM ts)),
d AS (SELECT doc_id, {words.format('text')} AS w FROM documents WHERE text IS NOT NULL),
dsh AS (SELECT DISTINCT doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS sh FROM (
  SELECT doc_id, size, w, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM tsh))),
n AS (SELECT no, count(*) AS n_shingles FROM tsh GROUP BY no),
m AS (SELECT doc_id, no, license_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment
  FROM dsh JOIN tsh USING (size, sh) JOIN n USING (no) GROUP BY doc_id, no, license_id
  HAVING count(*) >= {THRESHOLD} * any_value(n_shingles)),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, license_id ORDER BY containment DESC, n_shared DESC) = 1)
SELECT doc_id, license_id, n_shared, n_shingles, containment FROM best
QUALIFY containment = max(containment) OVER (PARTITION BY doc_id, regexp_replace(license_id, '-[0-9.]+$', ''))"""
