"""License scans in DataFrame functions only: sparse TF-IDF cosine of lines, runs of lines and licence files, then inheritance from the nearest directory.

Inverse document frequencies of the templates' words come from all files; there are as many as the templates have words, so they are
collected and go back as small broadcast tables. For a cosine of `least` a line needs one of its template's most telling words, namely
those without which the rest of the template's vector is shorter than `least`. Only lines with such a word, and runs of
lines around them, are scored; no other can pass. Licence files are also compared as a whole with whole licence texts.

A directory takes the licence that most of its licence files have. Directories inherit from their nearest ancestor by a join of their paths'
beginnings, and files then join their own directory: the number of directories, not of files, goes through the path join.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .licence_texts import TEXTS

#: Short notices by licence. Fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("all rights reserved", "Copyright. All rights reserved."),
]
#: What the registered query scores: TEMPLATES, which its SQL reads and which so stay as they are, and a notice that lacks a rare word of theirs.
NOTICES = [*TEMPLATES, ("all rights reserved", "All rights reserved.")]
RESERVED = "all rights reserved"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?()[]{}<>\"'`|*#&%$+=~^\\@/_-\t\r\f\x0b"
_TO = "abcdefghijklmnopqrstuvwxyz" + " " * (len(_FROM) - 26)


def plain(text: Column) -> Column:
    """A-Z lower-cased, punctuation and blanks as spaces; newlines stay."""
    return F.translate(text, _FROM, _TO)


def plain_words(text: str) -> list[str]:
    return text.translate(str.maketrans(_FROM, _TO)).split()


def telling(vector: dict[str, float], least: float) -> set[str]:
    """The heaviest words of a unit vector without which the rest is shorter than `least`."""
    out, rest = set(), 1.0
    for word, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if rest < least * least * (1 - 1e-9):
            break
        out.add(word)
        rest -= w * w
    return out


def vectors(templates: list[tuple[str, str]], idf: dict[str, float]) -> list[tuple[int, str, dict[str, float]]]:
    out = []
    for i, (name, text) in enumerate(templates):
        words = plain_words(text)
        raw = {w: words.count(w) * idf[w] for w in set(words)}
        size = math.sqrt(sum(x * x for x in raw.values()))
        if size:
            out.append((i, name, {w: x / size for w, x in raw.items()}))
    return out


def word_lists(text: Column) -> Column:
    """Lines as arrays of words."""
    return F.split(plain(text), r"[ \n]+")


def windows(found: DataFrame, notices: list[tuple[str, str]], key: Column) -> DataFrame:
    """path, line, upto, words: runs of two neighbouring lines or more, lines without words left out, that may be a wrapped notice.

    The best run begins and ends with lines that have a word of a notice and holds a telling one. A run has at most twice the words of the longest notice.
    """
    longest = 2 * max((len(plain_words(t)) for _, t in notices), default=0)
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, t in notices for w in plain_words(t)})])
    lines = F.transform(F.split(plain(F.col("text")), "\n", -1), lambda x, i: F.struct(i.alias("line"), F.filter(F.split(x, " +"), lambda w: w != "").alias("words")))
    ls = found.select("path", F.filter(lines, lambda x: F.size(x.words) > 0).alias("ls")).where(F.size("ls") > 1)
    runs = ls.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("ls") - 1), lambda k: F.slice("ls", k, longest))).alias("run"))
    runs = runs.where(F.arrays_overlap(F.col("run")[0].words, vocabulary))
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    fits = F.aggregate("run", none, lambda x, y: F.struct((x.words + F.size(y.words)).alias("words"), (x.n + (x.words + F.size(y.words) <= longest).cast("int")).alias("n")), lambda x: x.n)
    runs = runs.select("path", F.col("run")[0].line.alias("line"), "run", fits.alias("n")).where("n > 1")
    part = lambda n: F.slice("run", F.lit(1), n)
    ends = F.transform(F.sequence(F.lit(2), F.col("n")), lambda n: F.struct(F.element_at(part(n), -1).alias("last"), F.flatten(F.transform(part(n), lambda y: y.words)).alias("words")))
    units = runs.select("path", "line", F.explode(ends).alias("u")).where(F.arrays_overlap("u.last.words", vocabulary) & F.arrays_overlap("u.words", key))
    return units.select("path", "line", F.col("u.last.line").alias("upto"), F.col("u.words").alias("words"))


def headers(files: DataFrame, templates: list[tuple[str, str]], least: float, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """path, line (from 0), licence, similarity, whole: the best template of each line that comes to `least`. files: path, text, is_file, no nulls.

    With texts, runs of lines are compared with the templates as well, and whole licence files (whole is true, line is 0) with the texts.
    """
    spark = files.sparkSession
    vocabulary = sorted({w for _, t in [*templates, *(texts or [])] for w in plain_words(t)})
    n, df = files.count(), {}
    rows = files.select(F.explode(F.array_intersect(word_lists(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    df = {r.word: r["count"] for r in rows.groupBy("word").count().collect()}  # as many rows as the templates have words at most
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}
    other = math.log(n + 1) + 1  # of a word in no template: the most that a word can have
    weights = vectors(templates, idf)
    key = F.array(*[F.lit(w) for w in sorted({w for _, _, v in weights for w in telling(v, least)})])
    found = files.where(F.arrays_overlap(word_lists(F.col("text")), key))
    lines = found.select("path", F.posexplode(F.split(plain(F.col("text")), "\n", -1)).alias("line", "body")).select("path", "line", F.col("line").alias("upto"), F.split("body", " +").alias("words"))
    units = lines.where(F.arrays_overlap("words", key)).withColumn("whole", F.lit(False))
    table = [(i, name, w, x, False) for i, name, v in weights for w, x in v.items()]
    if texts is not None:
        units = units.union(windows(found, templates, key).withColumn("whole", F.lit(False)))
        units = units.union(files.where("is_file").select("path", F.lit(0), F.lit(0), word_lists(F.col("text")), F.lit(True)))
        table += [(len(templates) + i, name, w, x, True) for i, name, v in vectors(texts, idf) for w, x in v.items()]
    unit = ["path", "line", "upto", "whole"]
    terms = units.select(*unit, F.explode("words").alias("word")).where("word <> ''").groupBy(*unit, "word").agg(F.count(F.lit(1)).alias("tf"))
    known = spark.createDataFrame([(w, idf[w]) for w in vocabulary], "word string, idf double")
    terms = terms.join(F.broadcast(known), "word", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(other)))
    terms = written(terms.select(*unit, "word", "x"), "licence-terms")
    sizes = terms.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    table = spark.createDataFrame(table, "template int, licence string, word string, w double, whole boolean")
    dots = terms.join(F.broadcast(table), ["word", "whole"]).groupBy(*unit, "template", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    near = dots.join(sizes, unit).withColumn("similarity", F.round(F.col("dot") / F.col("size"), 6)).where(F.col("similarity") >= least)
    best = near.groupBy("path", "line", "whole").agg(F.max(F.struct(granting("licence").alias("grants"), "similarity", (F.col("line") - F.col("upto")).alias("span"), (-F.col("template")).alias("t"), "licence")).alias("b"))
    return best.select("path", "line", "b.licence", "b.similarity", "whole")


def granting(licence: str) -> Column:
    """False of the bare notice that all rights are reserved, which stands in licences (BSD) as well and so counts only without another one."""
    return F.col(licence) != RESERVED


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, licence, from_dir, levels) of directories (dir) by their nearest ancestor in licensed (dir, licence), themselves included."""
    parts = F.split("dir", "/")
    up = directories.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))).alias("levels", "from_dir"))
    near = up.distinct().join(licensed.withColumnRenamed("dir", "from_dir"), "from_dir")
    return near.groupBy("dir").agg(F.min(F.struct("levels", "from_dir", "licence")).alias("m")).select("dir", "m.licence", "m.from_dir", "m.levels")


def license_scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8, licence_file: Column | None = None, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of files (path, text): path, licence, similarity, line, origin, from_dir.

    A file's own licence is that of its most similar line or run of neighbouring lines (the first one, there the shortest, and there the first
    template, between equals), its origin is "header", its line the first one. A licence file that is similar to a whole text (texts, or TEXTS) has the
    licence of that text, at line 0; that all rights are reserved counts only where nothing else is found. Else it inherits that of the nearest directory upwards that has licence files with a licence, its origin is "directory";
    licence files are those whose name says so, or which the predicate licence_file picks. Else licence, similarity, line and origin are
    null. A directory with several licences has the most frequent, then the first by name.

    A null text is empty, a null path is the empty path, a file without a name at the root. Rows that repeat a path are one file: each of
    their lines counts, and each row gets the file's result. An empty table gives an empty result; other columns are ignored.
    """
    is_file = F.coalesce(licence_file if licence_file is not None else F.col("path").rlike(LICENCE_FILE), F.lit(False))
    files = files.select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), is_file.alias("is_file"))
    lines = headers(files, templates or TEMPLATES, least, TEXTS if texts is None else texts)
    own = lines.groupBy("path").agg(F.max(F.struct("whole", granting("licence").alias("grants"), "similarity", (-F.col("line")).alias("first"), "licence")).alias("b"))
    own = written(own.select("path", "b.licence", "b.similarity", (-F.col("b.first")).alias("line")), "licence-headers")
    names = files.select("path", "is_file")
    counts = names.where("is_file").join(own, "path").groupBy(directory(F.col("path")).alias("dir"), "licence").agg(F.count(F.lit(1)).alias("n"))
    licensed = counts.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "licence")).alias("m")).select("dir", "m.licence")
    rows = names.select("path", directory(F.col("path")).alias("dir"))
    above = inherited(rows.select("dir").distinct(), licensed).select("dir", F.col("licence").alias("dir_licence"), "from_dir")
    rows = rows.join(own, "path", "left").join(above, "dir", "left")
    own_one = F.col("licence").isNotNull()
    return rows.select(
        "path",
        F.coalesce("licence", "dir_licence").alias("licence"),
        "similarity",
        F.col("line").cast("long").alias("line"),
        F.when(own_one, "header").when(F.col("dir_licence").isNotNull(), "directory").alias("origin"),
        F.when(~own_one, F.col("from_dir")).alias("from_dir"),
    )
