"""License scans by diagonal voting. Built-in functions only.

Rolling hashes of two words from every text are joined to the positions of the same hash in the license templates
(a fixed list, broadcast). A hit votes for the diagonal (text position minus template position); votes are counted per
row, template and diagonal. Neighbouring diagonals whose places touch are chained, since an inserted or left-out word
shifts the rest, and the span of a chain is verified by the share of the template it covers. The join compares the words
themselves besides the hash, so a collision cannot vote.

Short phrases are templates that must be covered whole on one diagonal. A null or empty text has no words, no labels and
score 0. Repeated rows give repeated results; a row is known by its id and a hash of its text, null ids included.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipgraph.llm.common import ALNUM, lowered, same_key, text_of

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Opening passages of public licenses and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
     "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
     "and or sell copies of the software", "mit-text"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "bsd-text"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-text"),
    ("this work is licensed under a creative commons attribution", "cc-by-text"),
)
KEY = ["doc_id", "_text_key"]


def chains(parts: Column, length: Column, shift: int, gap: int, cover: float) -> Column:
    """Array of (n, lo, hi, diag, seen): chains of touching, neighbouring diagonals that cover enough of the template, none overlapping a better one.

    Every diagonal extends the chain that gives it the widest cover, whatever lies between them in the order, or starts one.
    """
    kind = "struct<n:int,lo:int,hi:int,diag:int,seen:array<int>>"

    def joined(c, x):
        seen = F.array_union(c["seen"], x["seen"])
        return F.struct(F.size(seen).alias("n"), F.least(c["lo"], x["lo"]).alias("lo"), F.greatest(c["hi"], x["hi"]).alias("hi"), x["diag"].alias("diag"), seen.alias("seen"))

    def step(s, x):
        live = F.filter(s["live"], lambda c: c["hi"] + gap >= x["lo"])
        fits = F.filter(live, lambda c: (F.abs(c["diag"] - x["diag"]) <= shift) & (F.greatest(c["hi"], x["hi"]) - F.least(c["lo"], x["lo"]) <= 2 * length))
        best = F.coalesce(F.array_max(F.transform(fits, lambda c: joined(c, x))), joined(x, x))
        # the array of one item holds the chain, which would be computed anew at each mention otherwise
        return F.transform(F.array(best), lambda b: F.struct(F.concat(live, F.array(b)).alias("live"), F.when(b["n"] >= cover * (length - 1), F.concat(s["done"], F.array(b)))
                                                             .otherwise(s["done"]).alias("done")))[0]

    start = F.expr(f"named_struct('live', cast(array() AS array<{kind}>), 'done', cast(array() AS array<{kind}>))")
    done = F.reverse(F.array_sort(F.aggregate(parts, start, step, lambda s: s["done"])))
    apart = lambda kept, c: ~F.exists(kept, lambda k: (k["lo"] < c["hi"]) & (c["lo"] < k["hi"]))
    return F.aggregate(done, F.expr(f"cast(array() AS array<{kind}>)"), lambda kept, c: F.when(apart(kept, c), F.concat(kept, F.array(c))).otherwise(kept))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, shift: int = 3, gap: int = 8, cover: float = 0.6) -> DataFrame:
    """Per row: words, places and labels of phrases, all labels with verified templates, score and spans (word positions)."""
    spark = docs.sparkSession
    words = docs.select("doc_id", text_of().alias("_t")).select(
        "doc_id", F.xxhash64("_t").alias("_text_key"), F.regexp_extract_all(lowered(F.col("_t")), F.lit(ALNUM), F.lit(0)).alias("_w"))
    listed = [(i, label, len(ws), kind, p, ws[p], ws[p + 1])
              for i, (text, label, kind) in enumerate([(*x, "phrase") for x in phrases] + [(*x, "text") for x in templates])
              for ws in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)] for p in range(len(ws) - 1)]
    places = (spark.createDataFrame(listed, "t INT, label STRING, len INT, kind STRING, tpos INT, t1 STRING, t2 STRING")
              .withColumn("gram", F.xxhash64("t1", "t2")))
    grams = (words.select(*KEY, F.explode(F.transform("_w", lambda w, i: F.struct(i.alias("pos"), w.alias("w1"), F.get("_w", i + 1).alias("w2")))).alias("g"))
             .select(*KEY, "g.*").where("w2 IS NOT NULL").withColumn("gram", F.xxhash64("w1", "w2")))
    hits = grams.join(F.broadcast(places), "gram").where("w1 = t1 AND w2 = t2")
    # a diagonal holds at most as many places as its template, so the set is bounded and repeated rows do not vote twice
    diagonals = (hits.groupBy(*KEY, "t", "label", "len", "kind", (F.col("pos") - F.col("tpos")).alias("diag"))
                 .agg(F.sort_array(F.collect_set("tpos")).alias("seen")))
    exact = (diagonals.where("kind = 'phrase' AND size(seen) = len - 1")
             .select(*KEY, "label", "kind", F.col("diag").alias("start"), (F.col("diag") + F.col("len")).alias("end"), F.lit(1.0).alias("share")))
    placed = (diagonals.where("kind = 'text'").groupBy(*KEY, "t", "label", "len", "kind")
              .agg(F.sort_array(F.collect_list(F.struct((F.col("diag") + F.col("seen")[0]).alias("lo"), (F.col("diag") + F.element_at("seen", -1) + 2).alias("hi"), "diag", "seen"))).alias("parts"))
              # a chain covers no more than all diagonals together
              .where(F.size(F.array_distinct(F.flatten("parts.seen"))) >= cover * (F.col("len") - 1)))
    merged = (placed.select(*KEY, "label", "kind", "len", F.explode(chains(F.col("parts"), F.col("len"), shift, gap, cover)).alias("c"))
              .select(*KEY, "label", "kind", F.col("c.lo").alias("start"), F.col("c.hi").alias("end"), (F.col("c.n") / (F.col("len") - 1)).alias("share")))
    of_phrase = F.col("kind") == "phrase"
    labelled = exact.unionByName(merged).groupBy(*KEY).agg(
        F.count_if(of_phrase).alias("n_base"), F.min(F.when(of_phrase, F.col("start"))).alias("first_word"), F.max(F.when(of_phrase, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(of_phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"),
        F.sort_array(F.collect_set(F.when(~of_phrase, F.struct("start", "end", "label", "share")))).alias("spans"))
    return (words.select(*KEY, F.size("_w").cast("long").alias("n_words")).alias("d").join(labelled.alias("l"), same_key("d", "l", KEY), "left")
            .select("d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"),
                    F.col("last_word").cast("long"), F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score"), F.col("spans")))
