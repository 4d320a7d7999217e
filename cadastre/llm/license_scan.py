"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates (and the pieces of long ones) fall into classes by their number of 5-word shingles. A class has windows
as long as its longest member plus the stride, so every place of a text lies whole in a window. Bands
hold one MinHash each; their number follows from the least similarity that a contained template can have to
such a window, so that the chance of a common band is at least 99 %. What is retrieved is
verified: at least 80 % of the whole template's shingles must stand in the text around the window.
Texts are read once and never shuffled; only the few matches are grouped.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.llm.decontaminate import NOT_WORD, plain_words
from cadastre.llm.text import indexes, table
from cadastre.session import small_table

SHINGLE, PERCENT, CHANCE, PIECE = 5, 80, 0.99, 32
BANDS_SEED = 0x5851F42D4C957F2D

# Sentences by which works state common licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _shingles(words: Column) -> Column:
    return F.transform(indexes(F.size(words) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.get(words, i + o) for o in range(SHINGLE)]))


def _value(shingle: Column, j: Column) -> Column:
    """The j-th MinHash function."""
    return F.xxhash64(shingle, j, F.lit(BANDS_SEED))


def bands_needed(size: int, window: int) -> int:
    """Bands of one MinHash by which a template of `size` shingles, 80 % of them in a window, is met with probability CHANCE."""
    common = math.ceil(size * PERCENT / 100)
    similar = common / (size + window - common)
    return 1 if similar >= 1 else math.ceil(math.log(1 - CHANCE) / math.log(1 - similar))


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license found in it: id, license, n_shingles, n_found, start (word, of the first window that met it).

    Templates are a mapping that the caller holds, so their tables are broadcast; those under five words are never found. NULL
    and empty texts hold none; rows with one id are judged together, a NULL id is an id; an empty table gives no rows.
    """
    spark = docs.sparkSession
    given = small_table(spark, list(templates.items()), "license string, text string")
    known = given.select("license", F.array_distinct(_shingles(plain_words(F.col("text")))).alias("all"), _shingles(plain_words(F.col("text"))).alias("run")).filter("size(run) > 0").collect()
    classes: dict[int, list[tuple[str, list[int]]]] = {}
    for t in known:
        cuts = math.ceil(len(t["run"]) / PIECE)
        for c in range(cuts):
            piece = t["run"][len(t["run"]) * c // cuts : len(t["run"]) * (c + 1) // cuts]
            classes.setdefault(math.ceil(math.log(len(piece), 1.5)), []).append((t["license"], piece))
    settings = {}
    for k, pieces in sorted(classes.items()):
        sizes = [len(p) for _, p in pieces]
        stride = max(1, min(sizes) // 4)
        window = max(sizes) + stride - 1
        settings[k] = (stride, window, max(bands_needed(len(set(p)), window) for _, p in pieces))
    bands = [(k, j, stride, window) for k, (stride, window, n) in settings.items() for j in range(n)]
    of_pieces = small_table(spark, [(k, p) for k, pieces in classes.items() for _, p in pieces], "class int, piece array<bigint>")
    banded = of_pieces.join(small_table(spark, bands, "class int, j int, stride int, window int"), "class")
    least = F.array_min(F.transform("piece", lambda x: F.struct(_value(x, F.col("j")).alias("value"), x.alias("shingle"))))
    index = banded.select("class", "j", "stride", "window", least.alias("l")).select("class", "j", "stride", "window", "l.*").distinct()  # a row for each piece and band
    marks = [r["shingle"] for r in index.select("shingle").distinct().collect()]

    # A window shares a band with a piece where it holds the piece's least shingle and none below it: look where such shingles stand, then test
    words = docs.select(F.col(id_col).alias("key"), plain_words(F.col(text_col)).alias("words"))
    texts = words.select("key", _shingles(F.col("words")).alias("shingles"))
    n = F.size("shingles")
    found = texts.select("key", "shingles", F.explode(F.filter(indexes(n), lambda i: F.get(F.col("shingles"), i).isin(*marks))).alias("p"))
    found = found.withColumn("shingle", F.get("shingles", F.col("p"))).join(F.broadcast(index), "shingle")  # bounded by the templates
    last = F.floor((F.greatest(F.lit(0), n - F.col("window")) + F.col("stride") - 1) / F.col("stride"))  # window number that reaches the end
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - F.col("window") + 1) / F.col("stride")))
    upto = F.least(last, F.floor(F.col("p") / F.col("stride")))
    placed = found.filter(first <= upto).select("*", F.explode(F.sequence(first.cast("int"), upto.cast("int"))).alias("number")).withColumn("at", F.col("number") * F.col("stride"))
    values = F.transform(F.slice("shingles", F.col("at") + 1, F.col("window")), lambda x: _value(x, F.col("j")))
    hits = placed.filter(F.array_min(values) == F.col("value")).select("key", "shingles", "class", "window", "at")
    pairs = sorted({(k, license) for k, pieces in classes.items() for license, _ in pieces})
    whole = {t["license"]: t["all"] for t in known}
    wanted = small_table(spark, [(k, license, whole[license]) for k, license in pairs], "class int, license string, whole array<bigint>")
    near = hits.join(F.broadcast(wanted), "class")  # the templates themselves
    size = F.size("whole")
    begin = F.greatest(F.lit(0), F.col("at") - size)
    around = F.slice("shingles", begin + 1, size * 2 + F.col("window"))
    near = near.select("key", "license", "at", size.alias("n_shingles"), F.size(F.array_intersect("whole", around)).alias("n_found"))
    near = near.filter(F.col("n_found") * 100 >= F.col("n_shingles") * PERCENT)
    out = near.groupBy("key", "license").agg(F.max("n_shingles").cast("long").alias("n_shingles"), F.max("n_found").cast("long").alias("n_found"), F.min("at").cast("long").alias("start"))
    return out.withColumnRenamed("key", id_col)


def op8_window_minhash(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("start")


_WORDS = f"list_filter(string_split_regex(lower(text), '{NOT_WORD}'), lambda x: x <> '')"
_RUNS = f"list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')))"
SQL = f"""
WITH t AS (SELECT license, {_RUNS} AS s FROM (SELECT license, {_WORDS} AS w FROM (VALUES {", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in TEMPLATES.items())}) v(license, text))),
d AS (SELECT doc_id, unnest({_RUNS}) AS x FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= {SHINGLE}),
hit AS (SELECT doc_id, license, count(DISTINCT d.x) AS n FROM d JOIN (SELECT license, unnest(s) AS x FROM t) u ON u.x = d.x GROUP BY ALL)
SELECT doc_id, license, len(s)::BIGINT AS n_shingles, n::BIGINT AS n_found FROM hit JOIN t USING (license) WHERE n * 100 >= len(s) * {PERCENT}
"""
