"""Licence scans: every line of a file against licence templates by TF-IDF cosine, then inheritance from licence files
of the nearest directory above.

Weights come from all files: a token's document frequency is counted for the tokens of the templates, any other token
weighs as much as one never seen. A line that lacks the anchors of every template, tokens without which the cosine
cannot reach the threshold, is passed over; that test is exact. Only lines that pass are exploded, and only they and
one row per file cross a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import lower_ascii
from rookery.session import stage

#: (licence, statement), fixed texts that licences ask for in headers and licence files.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("LicenseRef-Proprietary", "All rights reserved."),
)
THRESHOLD = 0.8
TOKEN = r"[^0-9a-z.]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and dots, without dots at their ends."""
    return F.array_remove(F.transform(F.split(lower_ascii(text), TOKEN), lambda t: F.btrim(t, F.lit("."))), "")


def _weights(files: DataFrame, templates: tuple[tuple[str, str], ...]) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequency of the template tokens over all files, that of an unseen token, and the templates' unit vectors."""
    spark = files.sparkSession
    rows = spark.createDataFrame(list(templates), "license string, statement string").select(tokens(F.col("statement")).alias("t")).collect()
    known = sorted({t for r in rows for t in r["t"]})
    counts = files.select(F.array_intersect(tokens(F.coalesce(F.col("text"), F.lit(""))), F.array(*[F.lit(t) for t in known])).alias("t"))
    total = files.count()
    found = {r["t"]: r["n"] for r in counts.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    idf = {t: math.log((1 + total) / (1 + found.get(t, 0))) + 1 for t in known}
    unseen = math.log(1 + total) + 1
    vectors = []
    for r in rows:
        raw = {t: r["t"].count(t) * idf[t] for t in r["t"]}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({t: w / norm for t, w in raw.items()})
    return idf, unseen, vectors


def anchors(vector: dict[str, float], threshold: float) -> set[str]:
    """The heaviest tokens such that a line with none of them has a cosine below ``threshold``."""
    rest, found = 1.0, set()
    for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if rest < threshold * threshold - 1e-9:
            break
        found.add(t)
        rest -= w * w
    return found


def headers(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, score): for each file with a line like a template, the best; ties go to the first name."""
    idf, unseen, vectors = _weights(files, templates)
    wanted = sorted(set().union(*(anchors(v, threshold) for v in vectors)))
    spark = files.sparkSession
    words = "|".join(t.replace(".", r"\.") for t in wanted)
    line = F.explode(F.array_distinct(F.filter(F.split(F.coalesce("text", F.lit("")), r"\n"), lambda x: lower_ascii(x).rlike(rf"(?<![0-9a-z])(?:{words})(?![0-9a-z])"))))
    lines = files.select("doc_id", line.alias("line")).select("doc_id", "line", tokens(F.col("line")).alias("t"))
    side = spark.createDataFrame(
        [(t, idf[t], [v.get(t, 0.0) for v in vectors]) for t in sorted(idf)], "token string, idf double, shares array<double>"
    )
    terms = lines.select("doc_id", "line", F.explode("t").alias("token")).groupBy("doc_id", "line", "token").agg(F.count("*").alias("tf"))
    weighed = terms.join(F.broadcast(side), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))  # bounded by the templates
    dots = [F.sum(F.col("w") * F.coalesce(F.get("shares", F.lit(k)), F.lit(0.0))).alias(f"d{k}") for k in range(len(vectors))]
    summed = weighed.groupBy("doc_id", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    best = F.array_max(F.array(*[
        F.struct(F.round(F.col(f"d{k}") / F.col("norm"), 9).alias("score"), F.lit(-rank).alias("order"), F.lit(name).alias("license"))
        for k, (rank, name) in enumerate(_ranked(templates))
    ]))
    return summed.select("doc_id", best.alias("b")).groupBy("doc_id").agg(F.max("b").alias("b")).where(F.col("b.score") >= threshold).select(
        "doc_id", "b.license", "b.score"
    )


def _ranked(templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str]]:
    names = sorted({name for name, _ in templates})
    return [(names.index(name), name) for name, _ in templates]


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, file_names: str = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$") -> DataFrame:
    """(doc_id, path, license, origin, score, inherited_from): one row per row of ``files`` (doc_id, path, text).

    ``origin`` is ``header`` for a file's own statement, ``inherited`` for that of the licence file in the nearest
    directory at or above its own, else ``none`` with null licence. Several licence files of one directory: the best
    score, then the first name. Null and empty texts have no statement but inherit; a null path inherits nothing.
    Repeated rows each get a row; ids are expected to name one file. An empty table gives an empty table.
    """
    own = stage(headers(files.select("doc_id", "text"), templates, threshold), "license_headers")
    paths = files.select("doc_id", "path").join(own, "doc_id", "left")
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    offers = paths.where(F.col("path").rlike(file_names) & F.col("license").isNotNull()).groupBy(directory.alias("dir")).agg(
        F.min_by(F.struct("license", "path"), F.struct(-F.col("score"), "license", "path")).alias("offer")
    )
    # every directory is looked up once, not every file
    parts = F.split(F.col("dir"), "/")
    homes = paths.where(F.col("license").isNull() & F.col("path").isNotNull()).select(directory.alias("dir")).distinct()
    above = homes.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select(
        "dir", "depth", F.array_join(F.slice(parts, 1, F.col("depth")), "/").alias("up")
    )
    nearest = above.join(offers.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("offer", "depth").alias("offer"))
    found = paths.withColumn("dir", directory).join(nearest, "dir", "left")
    inherits = F.col("license").isNull() & F.col("offer").isNotNull()
    return found.select(
        "doc_id", "path", F.coalesce("license", "offer.license").alias("license"),
        F.when(F.col("license").isNotNull(), "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        "score", F.when(inherits, F.col("offer.path")).alias("inherited_from"),
    )


def paths_of(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text) of documents laid out as a tree: ``thousands/hundreds/tens/file``.

    The table has no paths. Of each run of ten ids the first is the licence file of its ``tens`` directory, of each
    hundred that of ``hundreds``, of each thousand that of ``thousands``; the rest are texts. A null id gives a null path.
    """
    d = F.col("doc_id")
    up = lambda n: F.floor(d / n).cast("string")
    name = F.concat(F.lit("LICENSE-"), d.cast("string"))
    path = (
        F.when(d % 1000 == 0, F.concat_ws("/", up(1000), name))
        .when(d % 100 == 0, F.concat_ws("/", up(1000), up(100), name))
        .when(d % 10 == 0, F.concat_ws("/", up(1000), up(100), up(10), name))
        .otherwise(F.concat_ws("/", up(1000), up(100), up(10), F.concat(d.cast("string"), F.lit(".txt"))))
    )
    return docs.select("doc_id", F.when(d.isNotNull(), path).alias("path"), "text")
