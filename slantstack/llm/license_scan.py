"""License scans by diagonal voting, in DataFrame functions only.

Texts and templates are lower-cased (A-Z) and cut into words. The hashes of all rolling pairs of words of a text are
joined to the templates' positions (a fixed list of a few hundred rows, broadcast; ``MAX_POSITIONS`` bounds a list of the
caller's), and the words themselves are compared. A hit votes for its diagonal, word number less template position; votes
are counted per (text, template, diagonal). Base phrases stand where a diagonal has all votes. Other templates merge
diagonals that lie within ``GAP`` words of each other (words were inserted or left out), and a span is verified if the
positions it covers make up ``min_cover`` of the template's (all of a short template's).

Only hits are shuffled, by (id, digest of the text), so copies of a text spread over their ids.

Defined results. Null text: no words. Null ids and repeated rows: a result each (equal rows share hits, counted once).
Empty table: empty result. Other columns are ignored. score: the largest covered part of any template, 1 with a base
phrase, else 0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP_CLASS, source_key

#: Templates of fewer pairs of words must be covered whole: variants of one notice differ in a word.
GAP, MAX_POSITIONS, SHORT = 6, 100_000, 12

#: Phrases and labels of the base.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Public license notices in their usual wording, and labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software"),
    ("mit", "Released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
]


def words(text):
    """Words of a text column. U+212A and U+0130 are replaced first: their lower case has an ASCII letter."""
    plain = F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ß")), F.lit("İ"), F.lit("ß"))
    return F.array_remove(F.split(F.lower(plain), GAP_CLASS), "")


def positions(spark, base=BASE, notices=NOTICES) -> DataFrame:
    """template, label, base, size (pairs), tpos, a, b and h of every pair of words of every template."""
    rows = []
    for t, (label, text, is_base) in enumerate([(label, text, True) for text, label in base] + [(label, text, False) for label, text in notices]):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        rows += [(t, label, is_base, len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    if len(rows) > MAX_POSITIONS:
        raise ValueError(f"templates have more than {MAX_POSITIONS} positions, too many to broadcast")
    return spark.createDataFrame(rows, "template int, label string, base boolean, size int, tpos int, ta string, tb string").withColumn("th", F.xxhash64("ta", "tb"))


def scan(docs: DataFrame, *, min_cover: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), source_key(text_col).alias("key"), words(F.col(text_col)).alias("w"))
    n = F.size("w")
    pairs = F.when(n > 1, F.zip_with(F.slice("w", F.lit(1), n - 1), F.slice("w", F.lit(2), n - 1), lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), a.alias("a"), b.alias("b"))))
    places = rows.select("doc_id", "key", F.posexplode(pairs).alias("pos", "pair")).select("doc_id", "key", "pos", "pair.*")
    templates = positions(docs.sparkSession)
    hits = places.join(F.broadcast(templates), (F.col("h") == F.col("th")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")))
    key = ["doc_id", "key", "template", "label", "base", "size"]
    votes = hits.groupBy(*key, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("met"))
    by = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by) > GAP)).cast("int"), F.lit(1))
    spans = votes.withColumn("apart", apart).withColumn("span", F.sum("apart").over(by))
    merged = spans.groupBy(*key, "span").agg(F.min("diagonal").alias("start"), (F.size(F.array_distinct(F.flatten(F.collect_list("met")))) / F.col("size")).alias("cover"))
    good = merged.where(F.col("cover") >= F.when(F.col("base") | (F.col("size") < SHORT), 1.0).otherwise(min_cover))
    of_base = lambda v: F.when(F.col("base"), v)
    found = good.groupBy("doc_id", "key").agg(F.count(of_base(F.lit(1))).alias("n_base"), F.min(of_base(F.col("start"))).alias("first_word"), F.max(of_base(F.col("start"))).alias("last_word"), F.collect_set(of_base(F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("cover").alias("score"))
    joined = rows.select("doc_id", "key", n.cast("long").alias("n_words")).alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key")), "left")
    text = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return joined.select("d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), text("base_labels").alias("base_labels"), text("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
