"""License notices by MinHash bands over text windows, in DataFrame functions only.

1. A text is lower-cased and cut into words at every ASCII character that is no letter or digit; shingles
   are five words, hashed from their words' hashes.  Every third place starts a window of ``WINDOW`` = 9
   shingles, so any run of up to seven shingles lies whole in some window.
2. Templates are cut into pieces of up to seven shingles.  Band k of a window or a piece is the least of its
   shingle hashes under the k-th bit flip.  A run of s shingles of a piece shares a band with its window
   with probability 1 - (1 - s/9)^8 at least: 0.998 for five, 0.9998 for six, 0.99999 for seven, and a
   longer template has that chance with each of its pieces.  Templates of up to four shingles must be held
   whole to pass, so they are looked up by one shingle at every place, which never misses; templates of
   fewer than five words are one shingle of all their words and are looked up likewise.
3. A template that any band retrieves for a document is verified exactly: the share of its shingles (as
   words, not hashes) that the document holds must be ``CONTAINED`` or more.

The bands are computed row by row after one explode, inside generated code (the shingle hashes, then the
bands, each stand behind a one-element explode: else the optimizer would copy the hashes into every band, and
the generated method would be too long to be compiled); nothing but the few retrieved rows is ever shuffled.  Templates are a library of bounded size (``MOST_PIECES`` pieces, else an error), so
their bands are literals of the query.

A null text is an empty one.  A document has one row for each license it holds; rows that repeat an id and a
text give one set of rows, null ids give rows of their own.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW, STEP, PIECE = 9, 3, 7
BANDS = 8
CONTAINED = 0.8
SMALL = 4
MOST_PIECES = 20_000
#: ASCII other than lower-case letters and digits.
SEPARATORS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
#: Odd multiples of the golden ratio's 64 bits: one bit flip for each band.
FLIPS = [((2 * k + 1) * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(BANDS)]

#: The wording of public license notices.
NOTICES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "rights-reserved": "All rights reserved.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied."
    ),
    "gpl-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def notices(spark: SparkSession) -> DataFrame:
    """license, text: the templates above."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in NOTICES.items()])
    return spark.range(1).select(F.inline(rows))


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS), "")


def shingles(of: Column, size: Column) -> Column:
    """All runs of ``size`` words, space-joined; none if there are fewer words."""
    starts = F.when(F.size(of) >= size, F.sequence(F.lit(1), F.size(of) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(of, i, size), " "))


def _hash(at: Column, length: int = SHINGLE) -> Column:
    """The hash of the shingle of ``length`` words from place ``at`` of the column ``hashes``."""
    return F.xxhash64(*[F.get("hashes", at + i) for i in range(length)])


def _bands(hashes: list[Column]) -> list[Column]:
    flip = lambda k: [h.bitwiseXOR(F.lit(FLIPS[k])) for h in hashes]
    return [F.least(*flip(k)) if len(hashes) > 1 else flip(k)[0] for k in range(BANDS)]


def _library(templates: DataFrame) -> DataFrame:
    """license, shingles, size, n: the templates with at least a word, their distinct shingles."""
    cut = templates.select("license", words().alias("words")).filter(F.size("words") > 0)
    cut = cut.withColumn("size", F.least(F.size("words"), F.lit(SHINGLE)))
    return cut.select("license", "words", "size", F.array_distinct(shingles(F.col("words"), F.col("size"))).alias("shingles"))


def _keys(library: DataFrame) -> DataFrame:
    """license, band, key: what a window must show to retrieve a template.  Bands 0 and above are MinHash
    bands, -1 the lookup of one five-word shingle, -2 to -5 that of short templates of 1 to 4 words."""
    hashed = library.select("license", "size", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    n = F.size("hashes") - F.lit(SHINGLE - 1)
    places = hashed.filter(n > SMALL).select("license", "hashes", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(PIECE))).alias("first"))
    # the last piece of a template is as long as the others
    first = F.when(F.col("n") <= PIECE, 0).otherwise(F.least(F.col("first"), F.col("n") - PIECE))
    runs = places.select("license", "hashes", "n", first.alias("first"))
    pieces = runs.select("license", F.transform(F.sequence(F.col("first"), F.least(F.col("first") + PIECE, F.col("n")) - 1), lambda i: _hash(i)).alias("piece"))
    least = lambda flip: F.array_min(F.transform("piece", lambda h: h.bitwiseXOR(F.lit(flip))))
    bands = F.array(*[F.struct(F.lit(k).alias("band"), least(flip).alias("key")) for k, flip in enumerate(FLIPS)])
    keys = pieces.select("license", F.inline(bands))
    small = hashed.filter((n > 0) & (n <= SMALL)).select("license", F.lit(-1).alias("band"), _hash(F.lit(0)).alias("key"))
    for length in range(1, SHINGLE):
        short = hashed.filter(F.size("hashes") == length).select("license", F.lit(-1 - length).alias("band"), _hash(F.lit(0), length).alias("key"))
        small = small.union(short)
    return keys.union(small).distinct()


def scan(docs: DataFrame, templates: DataFrame | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, n_found (shingles of the template in the document), containment."""
    library = _library(notices(docs.sparkSession) if templates is None else templates)
    keys = _keys(library)
    rows = keys.select("band", "key").distinct().limit(MOST_PIECES * (BANDS + 1) + 1).collect()
    if len(rows) > MOST_PIECES * (BANDS + 1):
        raise ValueError(f"the templates have more than {MOST_PIECES} pieces")
    known: dict[int, list[int]] = {}
    for band, key in rows:
        known.setdefault(band, []).append(key)

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words().alias("words"))
    hashed = chosen.filter(F.size("words") > 0).select("doc_id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    places = hashed.select("doc_id", "words", "hashes", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.lit(STEP))).alias("at"))
    at = F.col("at")
    held = {f"h{i}": _hash(at + i) for i in range(WINDOW)}
    lookups = {-1: [f"h{i}" for i in range(STEP)]}
    for band in sorted(b for b in known if b < -1):
        lookups[band] = [f"r{-band}_{i}" for i in range(STEP)]
        held |= {name: _hash(at + i, -1 - band) for i, name in enumerate(lookups[band])}
    hashes = places.select("doc_id", "words", F.inline(F.array(F.struct(*[h.alias(name) for name, h in held.items()]))))
    least = {f"b{k}": band for k, band in enumerate(_bands([F.col(f"h{i}") for i in range(WINDOW)]))}
    names = [name for band in lookups for name in lookups[band]]
    hashes = hashes.select("doc_id", "words", *names, F.inline(F.array(F.struct(*[b.alias(name) for name, b in least.items()]))))
    views = [(k, F.col(f"b{k}")) for k in range(BANDS) if k in known]
    views += [(band, F.col(name)) for band, names in lookups.items() if band in known for name in names]
    hit = F.lit(False)
    for band, value in views:
        hit = hit | value.isin(known[band])
    shown = F.array(F.struct(F.lit(-9).alias("band"), F.lit(0).cast("long").alias("key")), *[F.struct(F.lit(band).alias("band"), value.alias("key")) for band, value in views])
    met = hashes.filter(hit).select("doc_id", "words", F.inline(shown)).join(keys, ["band", "key"]).select("doc_id", "words", "license").distinct()
    library = library.select("license", "size", "shingles")
    judged = met.join(library, "license").withColumn(
        "n_found", F.size(F.array_intersect("shingles", shingles(F.col("words"), F.col("size"))))
    )
    share = F.col("n_found") / F.size("shingles")
    return judged.select("doc_id", "license", "n_found", share.alias("containment")).filter(F.col("containment") >= contained)


def oracle() -> str:
    """The same rows in SQL: every template against every document."""
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in NOTICES.items())
    cut = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+'), lambda x: x <> '')"
    return f"""WITH t AS (SELECT license, w, least(len(w), {SHINGLE}) AS size FROM (SELECT license, {cut} AS w FROM (VALUES {values}) v(license, text)) a),
ts AS (SELECT license, size, s, count(*) OVER (PARTITION BY license) AS n FROM (SELECT DISTINCT license, size, array_to_string(w[i:i + size - 1], ' ') AS s
FROM (SELECT license, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM t) b) c),
d AS (SELECT DISTINCT doc_id, {cut} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, w, size, array_to_string(w[i:i + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM t) z) e)
SELECT doc_id, license, CAST(count(*) AS INTEGER) AS n_found, count(*) / CAST(any_value(n) AS DOUBLE) AS containment
FROM ds JOIN ts USING (size, s) GROUP BY doc_id, w, license HAVING count(*) >= {CONTAINED} * any_value(n)"""
