"""Operator 5: license scan by diagonal voting, native DataFrame operations only.

Every rolling word k-gram of a text is joined with the positions of the license
templates by hash (and compared as text, so a vote is never a collision).  A vote's
offset, text position minus template position, is its diagonal: a copied notice puts many
votes on one diagonal, an edited one on a few neighbouring diagonals.  Neighbours are merged,
and a merged span is accepted if its votes cover enough of the template's words.

The templates are a parameter; their k-grams (a few thousand rows at most, checked) are
broadcast.  Texts are read once; only votes and one row per document leave the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, same

#: Wording of public licenses and customary notices.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "mit-notice": "released under the MIT License",
    "gpl-notice": "licensed under the GNU General Public License, version 3",
    "cc-by-nc-notice": "licensed under CC BY-NC 4.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
K = 4
GAP = 4
COVERAGE = 0.8
MAX_TEMPLATE_GRAMS = 50_000

KELVIN, DOTTED_I, ASIDE = "\u212a", "\u0130", "\u00e9"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> str:
    """SQL for the words of a text column with A-Z lowered; a null text has none.

    lower() also lowers other alphabets, which changes no word boundary and no match with ASCII
    words; the two letters that it would turn into ASCII are set aside first.
    """
    safe = f"replace(replace(coalesce({text}, ''), '{KELVIN}', '{ASIDE}'), '{DOTTED_I}', '{ASIDE}')"
    return f"array_remove(split(lower({safe}), '{SEPARATORS}'), '')".replace("\\", "\\\\")


def template_grams(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """template, t_len (words), t_pos, gram: one row per template position, and one row for the scan's marker."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, body string").select("template", F.expr(words("body")).alias("w"))
    rows = rows.filter(F.size("w") >= k).select("template", F.size("w").alias("t_len"), F.posexplode(F.expr(f"transform(sequence(0, size(w) - {k}), i -> array_join(slice(w, i + 1, {k}), ' '))")).alias("t_pos", "t_gram"))
    marker = spark.createDataFrame([(None, None, None, "")], "template string, t_len int, t_pos int, t_gram string")
    out = rows.unionByName(marker)
    if (n := out.count()) > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{n} template k-grams are too many to broadcast; the bound is {MAX_TEMPLATE_GRAMS}")
    return out.withColumn("t_hash", F.xxhash64("t_gram"))


def base_columns(w: str = "w") -> list:
    """n_words, n_base, first_word, last_word, base_labels from the array of words."""
    places, labels = [], []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        here = " and ".join(f"get({w}, i + {j}) = '{p}'" for j, p in enumerate(parts))
        every = " and ".join(f"array_contains({w}, '{p}')" for p in parts)
        places.append(f"case when {every} then filter(sequence(0, size({w}) - 1), i -> {here}) else cast(array() as array<int>) end")
        labels.append(label)
    named = [F.expr(p).alias(f"p{i}") for i, p in enumerate(places)]
    cols = [F.col(f"p{i}") for i in range(len(places))]
    flat = F.concat(*cols)
    label_list = F.array_sort(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(x)) for c, x in zip(cols, labels, strict=True)])))
    return [named, [F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"), label_list.alias("base")]]


def votes(docs: DataFrame, templates: dict[str, str], k: int = K) -> DataFrame:
    """One marker row per document with its base columns (template null), and one row per vote."""
    own = docs.select("doc_id", F.xxhash64("text").alias("key"), F.expr(words("text")).alias("w"))
    places, base = base_columns()
    own = own.select("*", *places).select("doc_id", "key", "w", F.size("w").cast("long").alias("n_words"), *base)
    grams = F.expr(f"case when size(w) >= {k} then concat(array(''), transform(sequence(0, size(w) - {k}), i -> array_join(slice(w, i + 1, {k}), ' '))) else array('') end")
    rolled = own.select("doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base", F.posexplode(grams).alias("pos", "gram"))
    hashed = rolled.withColumn("hash", F.xxhash64("gram"))
    grams_of_templates = F.broadcast(template_grams(docs.sparkSession, templates, k))
    hit = hashed.join(grams_of_templates, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    return hit.select("doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base", "template", "t_len", "t_pos", (F.col("pos") - 1).alias("pos"))


def spans(voted: DataFrame, k: int = K, gap: int = GAP) -> DataFrame:
    """doc_id, key, template, first, last (words of the text), coverage: merged diagonals, before the threshold."""
    cast = voted.filter("template is not null").select("doc_id", "key", "template", "t_len", "t_pos", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    lines = cast.groupBy("doc_id", "key", "template", "t_len", "diagonal").agg(F.collect_set("t_pos").alias("at"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = W.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    step = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= gap, 0).otherwise(1)
    merged = lines.withColumn("step", step).withColumn("cluster", F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = merged.groupBy("doc_id", "key", "template", "t_len", "cluster").agg(F.flatten(F.collect_list("at")).alias("at"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda t: F.sequence(t, t + (k - 1))))))
    return found.select("doc_id", "key", "template", "first", (F.col("last") + (k - 1)).alias("last"), (covered / F.col("t_len")).alias("coverage"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K, gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    score: the largest share of a template's words found in one span (0: none).  ``labels`` has the
    base labels and the templates whose share reaches ``coverage``.  Null, empty or wordless text: zeros,
    null places, empty labels.  Repeated rows give repeated results; other columns are ignored.
    """
    voted = durable(votes(docs, templates, k), "votes")
    best = spans(voted, k, gap).groupBy("doc_id", "key").agg(
        F.max("coverage").alias("score"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("coverage") >= coverage, F.array("template")).otherwise(F.array().cast("array<string>"))))).alias("found"),
    )
    rows = voted.filter("template is null")
    none = F.array().cast("array<string>")
    out = rows.join(best, same(rows, best, "doc_id", "key"), "left")
    return out.select(
        rows["doc_id"], "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", none))))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
