"""License scans by diagonal voting, in DataFrame functions only."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Words of a rolling hash.
GRAM = 2
#: A template is one row of votes with a bit per gram; longer texts are given in parts.
MAX_GRAMS = 63
#: Number of what stands for the end of every text.
END = -1
#: Neighbouring diagonals so far apart at most are one place: words put in or left out.
GAP = 3
#: A place counts if so large a share of the template's grams agrees.
AGREEMENT = 0.7


@dataclass(frozen=True)
class Template:
    """Words of a license text or phrase. A `base` phrase counts only where all its words stand."""

    label: str
    words: str
    base: bool = False


# Phrases, and openings of well-known license texts, each with its label.
BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
NOTICES = (
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file "
                       "except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are "
                    "permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or "
                    "neighboring rights to this work"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of "
                    "the gnu general public license as published by the free software foundation"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or "
                    "without fee is hereby granted"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
                    "and associated documentation files the software to deal in the software without restriction"),
    Template("mit", "released under the mit license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


# ASCII letters to be folded, and what ASCII signs are no words.
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
_SIGNS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, lower-cased in A-Z; null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SIGNS, _LOWER + " " * len(_SIGNS))
    return F.array_remove(F.split(spaced, " "), "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, label, base, grams, place, t1, t2, gram), one row per gram of every template and one of END."""
    rows = []
    for number, template in enumerate(templates):
        words = template.words.split()
        grams = len(words) - GRAM + 1
        if not 1 <= grams <= MAX_GRAMS:
            raise ValueError(f"a template has {GRAM} to {MAX_GRAMS + GRAM - 1} words: {template}")
        rows += [(number, template.label, template.base, grams, k, words[k], words[k + 1]) for k in range(grams)]
    rows.append((END, "", False, 0, 0, "", ""))
    table = spark.createDataFrame(
        rows, "template int, label string, base boolean, grams int, place int, t1 string, t2 string"
    )
    return table.withColumn("gram", F.xxhash64("t1", "t2"))


def license_hits(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(doc_id, text_hash, pos, template, label, base, grams, place): grams of templates in texts.

    Every gram of two words is hashed and joined to the templates' grams, those with words that no
    template has left out before. One row more for each text, of template END, has the number of its
    words as `pos`. The words of a text are cut once.
    """
    words = F.col("words")
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    end = F.lit("")
    pairs = docs.select("doc_id", "text_hash", words_of(F.col("text")).alias("words")).select(
        "doc_id", "text_hash",
        F.posexplode(
            F.arrays_zip(F.concat(words, F.array(end)).alias("a"), F.concat(after, F.array(end, end)).alias("b"))
        ).alias("pos", "pair"),
    ).select("doc_id", "text_hash", "pos", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    known = sorted({"", *(w for t in templates for w in t.words.split())})
    # The templates are a fixed list of a few hundred short rows.
    grams = F.broadcast(template_grams(docs.sparkSession, templates))
    return (
        pairs.where(F.col("a").isin(known) & F.col("b").isin(known))
        .withColumn("hash", F.xxhash64("a", "b"))
        .join(grams, (F.col("hash") == F.col("gram")) & (F.col("a") == F.col("t1")) & (F.col("b") == F.col("t2")))
        .select("doc_id", "text_hash", "pos", "template", "label", "base", "grams", "place")
    )


def license_places(hits: DataFrame) -> DataFrame:
    """(doc_id, text_hash, label, base, first, last, score): verified places of templates in texts.

    Hits vote for the diagonal (place in the text minus place in the template) as bits of one number.
    Diagonals at most GAP apart are one place. It is verified if the grams that agree, word by word,
    are AGREEMENT or more of the larger of template and span; a base phrase needs all its grams on
    one diagonal.
    """
    votes = (
        hits.where(F.col("template") != END).groupBy("doc_id", "text_hash", "template", "label", "base", "grams", (F.col("pos") - F.col("place")).alias("diagonal"))
        .agg(
            F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"),
            F.min("pos").alias("first"), F.max("pos").alias("last"),
        )
    )
    base = votes.where(F.col("base") & (F.bit_count("bits") == F.col("grams"))).select(
        "doc_id", "text_hash", "label", "base", F.col("diagonal").alias("first"),
        (F.col("diagonal") + F.col("grams")).alias("last"), F.lit(1.0).alias("score"),
    )
    near = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    placed = (
        votes.where(~F.col("base"))
        .withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > GAP).cast("int"), F.lit(0)))
        .withColumn("cluster", F.sum("new").over(near))
        .groupBy("doc_id", "text_hash", "template", "cluster")
        .agg(
            F.first("label").alias("label"), F.first("grams").alias("grams"), F.bit_or("bits").alias("bits"),
            F.min("first").alias("first"), F.max("last").alias("last"),
        )
        .withColumn("score", F.bit_count("bits") / F.greatest(F.col("grams"), F.col("last") - F.col("first") + 1))
        .where(F.col("score") >= AGREEMENT)
        .select("doc_id", "text_hash", "label", F.lit(False).alias("base"), "first", (F.col("last") + 1).alias("last"), "score")
    )
    return base.union(placed)


def license_labels(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    `n_base` counts the places where all words of a base phrase stand consecutively; `first_word`
    and `last_word` are the smallest and largest of their starts, in words from 0, or null.
    `base_labels` are the labels of these phrases, `labels` those of all verified places, distinct,
    sorted and joined by commas, empty if there are none. `score` is the best agreement, 0 to 1.

    Null and empty texts have no words and no label. Rows equal in doc_id and text have equal
    results, each row its own; a null doc_id is carried along. The words of a text are never held
    together with those of others, so very long texts cost what they are long. Other columns are not
    read. An empty table gives no rows. Texts are read once; their hits and numbers of words are written
    to the shared folder, and nothing else is shuffled.
    """
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )
    hits = Scratch(docs.sparkSession).keep(license_hits(source, templates), "hits")
    places = license_places(hits)
    found = places.groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    counted = hits.where(F.col("template") == END).select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    joined = counted.join(
        found, counted["doc_id"].eqNullSafe(found["found_id"]) & (counted["text_hash"] == found["found_hash"]), "left"
    )
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
