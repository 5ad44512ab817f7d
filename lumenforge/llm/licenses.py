"""Operator 5: license scans.

Header lines and licence files are compared with licence templates by the cosine of sparse TF-IDF vectors; a file without a
licence of its own inherits that of the nearest ancestor directory that has one, by path joins.

Three kinds of units are vectors: lines that hold a licence word, the blocks of two, four and six lines that start with such a
line (notices of several lines), and whole texts that hold one. Equal units are scored once; document frequencies are counted
over all distinct units and the templates. A text at least half of whose words are those of its best template is a licence
text, however long it is. Templates and full texts are constants, so their vectors are broadcast; nothing that grows with the
corpus is.

A file sits at `path` (slash-separated). A file named LICENSE, LICENCE, COPYING or NOTICE (any extension) states the licence
of its directory. For tables without paths, `document_paths` derives one: a document sits at source/language/block/id, a licence
text at its language's folder, or at its source's if it is in English, the language of the licences themselves.

Every row is a file of its own; texts are known by their SHA-256, so no key of the caller has to be unique or known.

Defined results: null or empty texts have no header; ties of the cosine go to the alphabetically first licence; several
licence files of one directory: the best cosine, then the first licence name; null paths inherit nothing (document_paths gives
one to rows without an id); repeated rows and rows of one id are judged each by its own text and path; very long texts are read
whole; further columns pass unchanged, but an output replaces an old column of its name.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm.shared import cleared, free_name, kept, salted_join

MIN_COSINE = 0.45
#: Least share of the words of a licence text that its template holds.
MIN_SHARE = 0.5
#: Lines of the blocks that start with a line that holds a licence word.
BLOCK_LINES = (1, 2, 4, 6)
#: Ids of a folder of derived paths.
BLOCK_IDS = 1000

#: Names and opening or grant phrases of common public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
]
LICENSE_WORD = r"(?i)licen[sc]e|copyright|\bspdx\b|permission (is|to use)|redistribut|all rights reserved|public domain|free software|\bcc0\b|\bcc by"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.\-_].*)?$"


TOKEN = re.compile("[a-z0-9]+")


def counted(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, token, tf of each row's line; the tokens of a row are counted where it is read."""

    def run(batches):
        for batch in batches:
            counts = [Counter(TOKEN.findall((x or "").lower())) for x in batch.column(len(keys)).to_pylist()]
            rows = pa.array([k for k, c in enumerate(counts) for _ in c], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in range(len(keys))], pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())], names=[*keys, "token", "tf"])

    kinds = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in keys)
    return lines.select(*keys, "line").mapInArrow(run, f"{kinds}, token string, tf long")


def templates(spark: SparkSession) -> DataFrame:
    """The templates and the full licence texts."""
    texts = [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    return spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate([*TEMPLATES, *texts])], "template int, license string, line string")


def digest_of(text: Column) -> Column:
    """Key of a text with a licence word; null for the others."""
    text = text.cast("string")
    return F.when(text.rlike(LICENSE_WORD), F.sha2(text, 256))


def licensed_texts(df: DataFrame, text_col: str) -> DataFrame:
    """digest, text, n (rows) of the distinct texts with a licence word."""
    own = df.select(digest_of(F.col(text_col)).alias("digest"), F.col(text_col).cast("string").alias("text")).where("digest IS NOT NULL")
    return own.groupBy("digest").agg(F.any_value("text").alias("text"), F.count("*").alias("n"))


def units(texts: DataFrame) -> DataFrame:
    """digest, unit, line, whole: what of each text is compared; unit is the key of its words."""
    lines = F.split("text", r"\r?\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(LICENSE_WORD), i)), lambda i: i.isNotNull())
    placed = texts.select("digest", lines.alias("lines"), F.explode(at).alias("i"))
    blocks = placed.select("digest", F.explode(F.array(*[F.concat_ws(" ", F.slice("lines", F.col("i") + 1, k)) for k in BLOCK_LINES])).alias("line"), F.lit(False).alias("whole"))
    every = blocks.unionByName(texts.select("digest", F.col("text").alias("line"), F.lit(True).alias("whole")))
    return every.select("digest", F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("unit"), "line", "whole")


def cosines(units: DataFrame, known: DataFrame) -> DataFrame:
    """number, license, cosine, share (words that the template holds) of every pair of a unit (number, line) and a template that
    reaches MIN_COSINE."""
    unit_tokens, template_tokens = kept(counted(units, "number"), "unit-tokens"), counted(known, "template", "license")
    # frequencies over all units and templates; a partial sum per task is all that is shuffled for a frequent word
    counts = unit_tokens.groupBy("token").agg(F.count("*").alias("df")).unionByName(template_tokens.groupBy("token").agg(F.countDistinct("template").alias("df")))
    total = units.count() + known.count()
    idf = kept(counts.groupBy("token").agg((F.log((total + 1) / (F.sum("df") + 1)) + 1).alias("idf"), F.sum("df").alias("n")), "idf")
    weighted = salted_join(unit_tokens, idf.select("token", "idf"), ["token"], idf.select("token", "n"), F.col("number")).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norms = weighted.groupBy("number").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    # the templates' tokens are a constant of the module, so this side is broadcast
    fixed = template_tokens.join(idf, "token").withColumn("v", (1 + F.log("tf")) * F.col("idf"))
    fixed_norm = fixed.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v_norm"))
    fixed = fixed.join(fixed_norm, "template").select("template", "license", "token", (F.col("v") / F.col("v_norm")).alias("v"))
    dots = weighted.join(F.broadcast(fixed), "token").groupBy("number", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.sum("tf").alias("held"))
    return dots.join(norms, "number").select("number", "license", (F.col("dot") / F.col("norm")).alias("cosine"), (F.col("held") / F.col("words")).alias("share")).where(F.col("cosine") >= MIN_COSINE)


def own_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """digest, license, cosine, whole, n of each distinct text that has a licence: that of the whole text if it is a licence
    text, else that of its best header."""
    texts = kept(licensed_texts(df, text_col), "license-texts")  # all texts are read once
    parts = units(texts)
    distinct = kept(parts.groupBy("unit").agg(F.any_value("line").alias("line"), F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()), "units")
    scored = cosines(distinct.select("number", "line"), templates(df.sparkSession))
    order = F.struct((-F.round("cosine", 9)).alias("c"), F.col("license"))
    found = scored.groupBy("number").agg(F.min(order).alias("header"), F.min(F.when(F.col("share") >= MIN_SHARE, order)).alias("file"))
    best = kept(distinct.select("number", "unit", "n").join(found, "number").drop("number"), "best")
    members = parts.select("digest", "unit", "whole").distinct()
    met = salted_join(members, best.drop("n"), ["unit"], best.select("unit", "n"), F.col("digest"))
    found = met.select("digest", F.struct((~F.col("whole")).alias("part"), F.when(F.col("whole"), F.col("file")).otherwise(F.col("header")).alias("b")).alias("b")).where("b.b IS NOT NULL")
    return found.groupBy("digest").agg(F.min("b").alias("b")).select("digest", F.col("b.b.license").alias("license"), (-F.col("b.b.c")).alias("cosine"), (~F.col("b.part")).alias("whole")).join(texts.select("digest", "n"), "digest")


def with_own(df: DataFrame, own: DataFrame, digest: str) -> DataFrame:
    """df with the columns of own, by the digest of a text; rows without a licence word meet nothing and are spread evenly."""
    spread = free_name(df, "_spread")
    key = F.coalesce(F.col(digest), F.concat(F.lit("-"), F.xxhash64(F.monotonically_increasing_id())))
    keyed = df.withColumn(spread, key)
    named = own.select(F.col("digest").alias(spread), "license", "cosine", "whole")
    return salted_join(keyed, named, [spread], own.select(F.col("digest").alias(spread), "n"), F.monotonically_increasing_id(), "left").drop(spread)


def ancestors(path: Column) -> Column:
    """array<struct<directory, depth>> of the directories above a path, the root ('' at depth 0) included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("directory"), n.alias("depth")))


def inherited(judged: DataFrame, path: str) -> DataFrame:
    """judged (a path, license, cosine of a text's own licence) with license, license_source (header: the text's own; directory
    or none), license_cosine and license_directory."""
    directory = F.regexp_replace(path, "/?[^/]*$", "")
    files = judged.where(F.element_at(F.split(path, "/"), -1).rlike(LICENSE_FILE) & F.col("license").isNotNull())
    stated = files.groupBy(directory.alias("directory")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license"))).alias("b")).select("directory", F.col("b.license").alias("d_license"), (-F.col("b.c")).alias("d_cosine"))
    # directories, not files, climb: each distinct directory is joined once with its ancestors
    counts = kept(judged.where(F.col(path).isNotNull()).groupBy(directory.alias("_own")).agg(F.count("*").alias("n")), "directories")
    climbed = counts.select("_own", F.explode(ancestors(F.concat(F.col("_own"), F.lit("/x")))).alias("a")).select("_own", "a.directory", "a.depth")
    # a directory near the root is above very many, but it is met by one row of each
    nearest = climbed.join(stated, "directory").groupBy("_own").agg(F.max(F.struct("depth", "directory", "d_license", "d_cosine")).alias("m")).select("_own", "m.directory", "m.d_license", "m.d_cosine")
    met = salted_join(judged.withColumn("_own", directory), nearest, ["_own"], counts, F.monotonically_increasing_id(), "left")
    return met.select(
        *[F.col(f"`{c}`") for c in judged.columns if c not in ("license", "cosine", "whole")],
        F.coalesce("license", "d_license").alias("license"),
        F.when(F.col("license").isNotNull(), "header").when(F.col("d_license").isNotNull(), "directory").otherwise("none").alias("license_source"),
        F.coalesce("cosine", "d_cosine").alias("license_cosine"),
        F.when(F.col("license").isNull(), F.col("directory")).alias("license_directory"),
    )


def scan(df: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """df with license, license_source, license_cosine and license_directory."""
    taken = ["license", "license_source", "license_cosine", "license_directory", "cosine", "whole", "directory", "d_license", "d_cosine", "_own"]
    plain = cleared(df, taken[:4], [path_col, text_col])
    digest = free_name(plain, "_digest")
    aside = {c: free_name(plain, f"_aside_{k}") for k, c in enumerate(plain.columns) if c.lower() in taken}
    marked = plain.withColumnsRenamed(aside).withColumn(digest, digest_of(F.col(aside.get(text_col, text_col))))
    judged = kept(with_own(marked, own_licenses(df, text_col), digest).drop(digest), "judged")
    out = inherited(judged, aside.get(path_col, path_col)).withColumnsRenamed({v: k for k, v in aside.items()})
    return out.select(*[F.col(f"`{c}`") for c in plain.columns], *taken[:4])


def document_paths(docs: DataFrame, whole: Column) -> DataFrame:
    """docs with path: source/language/block/id.txt; a licence text (whole): source/LICENSE-id if it is in English, else
    source/language/LICENSE-id. Without an id, block and number are `unknown`."""
    source, lang = F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und"))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown"))
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK_IDS).cast("string"), F.lit("unknown"))
    stated = F.concat(F.lit("LICENSE-"), number)
    path = F.when(~F.coalesce(whole, F.lit(False)), F.concat_ws("/", source, lang, block, F.concat(number, F.lit(".txt")))).when(lang == "en", F.concat_ws("/", source, stated)).otherwise(F.concat_ws("/", source, lang, stated))
    return docs.withColumn("path", path)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, path and licence of every document, a row for each row of docs."""
    own = kept(own_licenses(docs), "own-licenses")
    marked = docs.select("doc_id", "source", "lang", digest_of(F.col("text")).alias("_digest"))
    judged = kept(document_paths(with_own(marked, own, "_digest"), F.col("whole")).select("doc_id", "path", "license", "cosine", "whole"), "judged")
    return inherited(judged, "path").select("doc_id", "path", "license", "license_source", F.round("license_cosine", 6).alias("license_cosine"), "license_directory")
