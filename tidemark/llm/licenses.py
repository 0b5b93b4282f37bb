"""License scans by diagonal voting (operator 2): built-in functions only.

All rolling 2-word grams of a text are hashed and joined with the grams of the templates.  A hit
at word ``pos`` of gram ``tpos`` votes for the diagonal ``pos - tpos``.  Votes are gathered by
diagonal; neighbouring diagonals merge, so that an inserted or missing word does not split a
passage; the spans found are then verified: short phrases need all grams on one diagonal,
longer templates a share of their grams within a span of about their own length.

The set of grams hit is kept as longs of ``BITS`` grams each, so its union is a bit-or and a template
may be a whole license text.  The template table is sent to all workers if it has at most
``SENT_GRAMS`` grams; larger ones are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Base phrases and their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
    "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons "
    "to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code "
    "must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list "
    "of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following "
    "restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
    "acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as "
    "being the original software this notice may not be removed or altered from any source distribution"
)
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source "
    "code form or as a compiled binary for any purpose commercial or non commercial and by any means"
)
# Texts and opening sentences of public licenses and their labels (fixed values).
TEMPLATES = (
    (_MIT, "mit"),
    (_BSD, "bsd"),
    (_ZLIB, "zlib"),
    (_UNLICENSE, "unlicense"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
)
#: Templates of fewer words need all their grams on one diagonal; others this share of them.
WHOLE_WORDS, SHARE = 10, 0.7
#: Diagonals so near to each other merge; a span may be so much longer than its template.
GAP, STRETCH = 3, 1.5
BITS, SENT_GRAMS = 63, 100_000
DOC = -1  # the template number of the row that stands for the document itself


def words_of(text: Column) -> Column:
    """Lower-cases A-Z; words are runs of a-z, 0-9 and anything beyond ASCII.  Null: none."""
    text = F.coalesce(text, F.lit(""))
    # in pure ASCII texts the fast built-in does the same as the letter table
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def template_grams(spark, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``t, label, base, whole, t_words, tpos, gram`` for every 2-word gram of every template, and a row
    for the gram hash 0 that stands for the document."""
    rows = []
    for t, (text, label) in enumerate((*phrases, *templates)):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"a template needs two words or more: {text!r}")
        base = t < len(phrases)
        rows += [(t, label, base, base or len(words) < WHOLE_WORDS, len(words), k, words[k], words[k + 1]) for k in range(len(words) - 1)]
    df = spark.createDataFrame(rows, "t int, label string, base boolean, whole boolean, t_words int, tpos int, a string, b string")
    grams = df.select("t", "label", "base", "whole", "t_words", "tpos", F.xxhash64("a", "b").alias("gram"))
    doc = spark.range(1).select(
        F.lit(DOC).alias("t"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(True).alias("whole"),
        F.lit(0).alias("t_words"), F.lit(0).alias("tpos"), F.lit(0).cast("long").alias("gram"),
    )
    return grams.union(doc)


def find_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans``.

    ``n_base``: places where a phrase's words stand consecutively; ``first_word``/``last_word``: smallest
    and largest start of such a place, words counted from 0, else null; ``labels``: of phrases and
    of verified template spans, distinct, sorted, comma-joined (empty string if none); ``score``:
    the largest share of a phrase's or template's grams in a verified span, 0 if none; ``spans``:
    the verified spans as (label, start, end) in words.  Null or empty texts have no words.
    Rows are told apart by their id and two hashes of their text; rows alike in these are judged once and
    come as often as they were given.  Extra columns are left out; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    words, none = words_of(text), F.array(F.lit(0).cast("long"))
    gram = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1)))
    # position 0 is the document's own row, so that every document gets a result; words are bound once, as the only
    # element of an array, or they would be split anew for every gram
    marks = F.flatten(F.transform(F.array(words), lambda ws: F.when(F.size(ws) < 2, none).otherwise(F.concat(none, gram(ws)))))
    row = ["doc_id", "h1", "h2", "n_words"]
    grams = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.size(words).cast("long").alias("n_words"), marks.alias("marks")
    )
    grams = grams.select(*row, F.posexplode("marks").alias("at", "gram"))
    n_grams = sum(len(t.split()) for t, _ in (*phrases, *templates))
    table = template_grams(docs.sparkSession, phrases, templates)
    hits = grams.join(F.broadcast(table) if n_grams <= SENT_GRAMS else table, "gram")
    hits = hits.filter((F.col("t") != DOC) | (F.col("at") == 0)).withColumn("pos", F.col("at") - 1)

    template = ["t", "label", "base", "whole", "t_words"]
    chunk, bit = F.floor(F.col("tpos") / BITS).cast("int"), F.expr(f"shiftleft(1L, tpos % {BITS})")
    diagonals = hits.groupBy(*row, *template, (F.col("pos") - F.col("tpos")).alias("diagonal"), chunk.alias("chunk")).agg(
        F.bit_or(bit).alias("mask"), F.min("pos").alias("start"), (F.max("pos") + 2).alias("end"), F.count_if(F.col("t") == DOC).alias("copies")
    )
    order = Window.partitionBy(*row[:3], "t").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order)
    merged = diagonals.withColumn("cut", F.coalesce((far > GAP) | ((far > 0) & F.col("whole")), F.lit(True)).cast("int"))
    merged = merged.withColumn("part", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = merged.groupBy(*row, *template, "part", "chunk").agg(F.bit_or("mask").alias("mask"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("copies").alias("copies"))
    spans = chunks.groupBy(*row, *template, "part").agg(F.sum(F.bit_count("mask")).alias("found"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("copies").alias("copies"))
    share = F.col("found") / (F.col("t_words") - 1)
    sure = (F.col("t") != DOC) & F.when(F.col("whole"), F.col("found") == F.col("t_words") - 1).otherwise(
        (share >= SHARE) & (F.col("end") - F.col("start") <= F.col("t_words") * STRETCH)
    )
    spans = spans.withColumn("sure", sure).filter(F.col("sure") | (F.col("t") == DOC))
    base = F.col("sure") & F.col("base")
    joined = lambda ok: F.array_join(F.sort_array(F.collect_set(F.when(ok, F.col("label")))), ",")
    found = spans.groupBy(*row).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("start").cast("long"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("sure")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("sure"), share)), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_set(F.when(F.col("sure"), F.struct("start", "end", "label")))).alias("spans"),
        F.max("copies").alias("copies"),
    )
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "h1", "h2")
