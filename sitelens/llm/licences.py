"""Licence scan by a positional index of licence words (DataFrame functions only).

Templates of licence texts and notices are indexed by word and position, without the words of STOP.
All licence words that a file holds are looked up; their postings are intersected by relative position
(place in the file less place in the template), so a template is a candidate where at least two of its
words stand at the same distances as in it, whatever else the file holds; a candidate counts only if a
mandatory key phrase of the template stands in the file. Its score is the share of its licence words that
are aligned. Every step is an expression on the file's own row: nothing is shuffled.

Defined results: a null or empty text has no words and no labels; ids may repeat or be null,
every row is scanned alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, mandatory key phrase, and text of licence notices and of passages of licences.
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "cc by 4", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
)
#: Words of templates that say nothing about licences.
STOP = frozenset("the of and to in is it a an or as by at for with this that you are can may not be any use file work 0 2 3 4 v no on such".split())
#: Aligned words that make a candidate.
MIN_ALIGNED = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def vocabulary() -> list[str]:
    return sorted({w for _, _, text in TEMPLATES for w in text.split()} - STOP)


def normal(text: Column) -> Column:
    """The words of a text, lower case, with one space between them. The two letters outside
    ASCII whose lower case is in it stay as they are."""
    joined = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " "))
    upper = "".join(map(chr, range(65, 91)))
    return F.when(joined.rlike("[Kİ]"), F.translate(joined, upper, upper.lower())).otherwise(F.lower(joined))


def counted(docs: DataFrame) -> DataFrame:
    norm = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    spaces = F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit("")))
    return norm.withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(spaces + 1).cast("long"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): counts and places of base phrases, labels and score."""
    df = counted(docs)
    known = vocabulary()
    # Only files that hold a licence word are split into words.
    some = F.size(F.array_intersect(F.array(*map(F.lit, known)), F.split("norm", " "))) > 0
    df = df.withColumn("words", F.when(some, F.split("norm", " ")))
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: _any(
        _all(F.get("words", i + k) == w for k, w in enumerate(p.split())) for p in BASE))
    based = F.col("norm").rlike(r"\b(" + "|".join(map(re.escape, BASE)) + r")\b")
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda h: h["w"].isin(known))
    df = df.withColumns({"starts": F.when(F.col("words").isNotNull() & based, starts), "hits": hits})
    places = {w: [(t, q) for t, (_, _, text) in enumerate(TEMPLATES) for q, x in enumerate(text.split()) if x == w] for w in known}
    postings = F.create_map(*(c for w, at in places.items() for c in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in at)))))
    aligned = F.flatten(F.transform("hits", lambda h: F.transform(
        F.element_at(postings, h["w"]), lambda x: F.struct(x["t"].alias("t"), (h["p"] - x["q"]).alias("o")))))
    df = df.withColumn("aligned", F.sort_array(aligned))
    padded = F.concat(F.lit(" "), "norm", F.lit(" "))
    found_labels = []
    for t, (label, key, text) in enumerate(TEMPLATES):
        most = sum(w in places for w in text.split())
        best = F.aggregate(
            F.filter("aligned", _of_template(t)),
            F.struct(F.lit(None).cast("int").alias("o"), F.lit(0).alias("run"), F.lit(0).alias("best")),
            _longest, lambda a: a["best"])
        verified = F.col("aligned").isNotNull() & padded.contains(f" {key} ")
        found_labels.append(F.when(verified, F.struct(F.lit(label).alias("label"), best.alias("n"), F.lit(float(most)).alias("most"))))
    df = df.withColumn("templates", F.filter(F.array(*found_labels), lambda x: x["n"] >= MIN_ALIGNED))
    base_labels = F.array_compact(F.array(*(F.when(F.col("starts").isNotNull() & padded.contains(f" {p} "), F.lit(v)) for p, v in BASE.items())))
    matched = F.transform("templates", lambda x: F.least(F.lit(1.0), x["n"] / x["most"]))
    n_base = F.coalesce(F.size("starts"), F.lit(0))
    return df.select(
        "doc_id", "n_words",
        F.when(F.col("starts").isNull(), 0).otherwise(n_base).cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base_labels, F.transform("templates", lambda x: x["label"]))), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(matched), F.lit(0.0)), F.when(F.coalesce(F.size("starts"), F.lit(0)) > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def _all(conditions) -> Column:
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for x in conditions:
        out = out | F.coalesce(x, F.lit(False))
    return out


def _of_template(t: int):
    return lambda x: x["t"] == t


def _longest(a: Column, x: Column) -> Column:
    run = F.when(a["o"].eqNullSafe(x["o"]), a["run"] + 1).otherwise(1)
    return F.struct(x["o"].alias("o"), run.alias("run"), F.greatest(a["best"], run).alias("best"))


def op1_licences(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
