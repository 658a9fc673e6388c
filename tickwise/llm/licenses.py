"""License scan by diagonal voting, with DataFrame functions only (operator 12).

Every run of ``GRAM`` words of a document is hashed and joined to the positions of the same run in the license
templates. A hit at document word ``p`` and template word ``t`` votes for the diagonal ``p - t``: a copy of the template
puts all its votes on one diagonal, and a copy with words added or removed on a few neighbouring ones. Diagonals
not farther apart than the template's slack are merged into one place. A place is verified on its span: the share of
the template's words that its hits cover, word for word, and the length of the span.

Short phrases are templates of the same kind that allow no slack and ask for every word. The template table is
configuration, so its size is known before the join; the join follows the exploded document rows in one pass over
the texts, and only hits and one row per document are shuffled, by row, once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a hashed run; the shortest phrase has as many.
GRAM = 3
#: Diagonals of a notice with fewer votes take no part.
MIN_VOTES = 2
#: Template words up to which the template table is broadcast; larger ones are joined as the planner sees fit.
BROADCAST_WORDS = 200_000

# Characters between words, and upper and lower case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    """A text that stands for a license. ``share`` of its words must be covered by a place; ``slack`` is the largest
    distance of neighbouring diagonals of one place; ``base`` marks the phrases that are counted."""

    label: str
    text: str
    share: float = 0.8
    slack: int = 8
    base: bool = False


def phrase(label: str, text: str, base: bool = False) -> Template:
    """A phrase that must stand word for word."""
    return Template(label, text, 1.0, 0, base)


# The phrases and their labels.
PHRASES = (
    phrase("mit", "under the mit license", base=True),
    phrase("apache-2", "apache license version 2", base=True),
    phrase("cc-by-nc", "cc by nc", base=True),
)

# Names and notices as the licenses' publishers word them.
NOTICES = (
    phrase("gpl-3", "gnu general public license version 3"),
    phrase("gpl-2", "gnu general public license version 2"),
    phrase("lgpl-3", "gnu lesser general public license version 3"),
    phrase("agpl-3", "gnu affero general public license version 3"),
    phrase("mpl-2", "mozilla public license version 2"),
    phrase("cc-by-sa", "cc by sa"),
    phrase("cc-by-nd", "cc by nd"),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software."""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
        above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""),
    Template("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at"""),
    Template("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version."""),
    Template("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version.""", share=0.95),
    Template("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at"""),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means."""),
    Template("cc-by-nc", """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International
        License""", share=0.9, slack=2),
    Template("cc-by-sa", """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International
        License""", share=0.9, slack=2),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", share=1.0,
             slack=0),
)

TEMPLATES = PHRASES + NOTICES
#: A place's span may be longer than its template by this factor.
LONGEST_SPAN = 1.25


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    pieces = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BETWEEN)
    return F.filter(pieces, lambda w: w != "")


def gram_hashes(words: Column) -> Column:
    """Hashes of the runs of ``GRAM`` words, in order."""
    runs = F.size(words) - (GRAM - 1)
    return F.when(runs > 0, F.transform(F.sequence(F.lit(1), runs), lambda i: F.xxhash64(
        *[F.element_at(words, i + j) for j in range(GRAM)])))


def gram_at(words: Column, pos: Column) -> Column:
    """The words of the run that starts at ``pos``, from 0."""
    return F.array_join(F.slice(words, pos + 1, GRAM), " ")


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """One row per run of a template: ``hash, gram, t_pos`` and the template's number, label and rules."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.text).alias("text"),
                              F.lit(float(t.share)).alias("share"), F.lit(t.slack).alias("slack"), F.lit(t.base).alias("base"))
                     for i, t in enumerate(templates)])
    listed = (spark.range(1, numPartitions=1).select(F.inline(rows)).withColumn("words", words(F.col("text")))
              .withColumn("t_words", F.size("words")))
    return listed.select("template", "label", "share", "slack", "base", "t_words", "words",
                         F.posexplode(gram_hashes(F.col("words"))).alias("t_pos", "hash")).select(
        "hash", gram_at(F.col("words"), F.col("t_pos")).alias("gram"), "t_pos", "template", "label", "share", "slack", "base",
        "t_words")


def license_scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are the smallest and largest
    start of one (null without any). ``labels`` holds the base labels and those of all verified places of other
    templates. ``score`` is the largest share of a template's words that a place covers, 0 without a hit. Null and empty
    texts have no words and no labels. Rows that repeat a ``doc_id`` or lack one are rows of their own. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    shortest = min(len(t.text.split()) for t in templates)
    if shortest < GRAM:
        raise ValueError(f"a template needs at least {GRAM} words")
    grams = template_grams(spark, templates)
    if sum(len(t.text.split()) for t in templates) <= BROADCAST_WORDS:
        grams = F.broadcast(grams)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       words(F.col("text")).alias("words")).withColumn("hashes", gram_hashes(F.col("words")))
    # hashed before the explode, which then is compiled with the join and does not copy the words to every run
    runs = rows.select("row", "doc_id", "words", F.posexplode_outer("hashes").alias("pos", "hash"))
    real = F.col("template").isNotNull() & (gram_at(F.col("words"), F.col("pos")) == F.col("gram"))
    rules = ("template", "label", "share", "slack", "base", "t_words", "t_pos")
    # the first run of a document, or the row without one, stands for documents without a hit
    hits = (runs.join(grams, "hash", "left")
            .where(real | F.col("pos").isNull() | (F.col("pos") == 0))
            .select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.col("pos").cast("long").alias("pos"),
                    *[F.when(real, F.col(c)).alias(c) for c in rules])
            .repartition("row"))

    of_doc = ("row", "doc_id", "n_words")
    of_template = ("template", "label", "share", "slack", "base", "t_words")
    diagonals = hits.withColumn("diagonal", F.col("pos") - F.col("t_pos")).groupBy(*of_doc, *of_template, "diagonal").agg(
        F.count("t_pos").alias("votes"), F.collect_set("t_pos").alias("t_runs"), F.min("pos").alias("low"),
        F.max("pos").alias("high"))
    diagonals = diagonals.where(F.col("template").isNull() | (F.col("slack") == 0) | (F.col("votes") >= MIN_VOTES)
                                | (F.col("low") == 0))
    counted = (F.col("slack") == 0) | (F.col("votes") >= MIN_VOTES)
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack"), F.lit(False)).cast("int")
    places = (diagonals.withColumn("far", far).withColumn("place", F.sum("far").over(order))
              .groupBy(*of_doc, *of_template, "place").agg(
                  F.flatten(F.collect_list(F.when(counted, F.col("t_runs")))).alias("t_runs"),
                  F.min(F.when(counted, F.col("low"))).alias("start"), (F.max(F.when(counted, F.col("high"))) + GRAM).alias("stop")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("t_runs", lambda t: F.sequence(t, t + (GRAM - 1))))))
    places = places.withColumn("cover", F.coalesce(covered / F.col("t_words"), F.lit(0.0)))
    found = (F.col("cover") >= F.col("share")) & (F.col("stop") - F.col("start") <= F.col("t_words") * LONGEST_SPAN)
    base = found & F.col("base")

    def listed(when: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")

    return places.groupBy(*of_doc).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), listed(base).alias("base_labels"),
        listed(found).alias("labels"), F.max("cover").alias("score")).drop("row")


def oracle_sql(templates=TEMPLATES) -> str:
    """The same scan in DuckDB SQL, over the words of every run instead of their hashes."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    values = ",\n".join(f"({i}, {quoted(t.label)}, {quoted(' '.join(t.text.split()))}, {float(t.share)}, {t.slack}, {t.base})"
                        for i, t in enumerate(templates))
    cutter = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN.replace('[', '[^')}')"
    return f"""
with templates(template, label, text, share, slack, base) as (values {values}),
template_words as (select *, {cutter} as w from templates),
grams as (select * exclude (w, text), len(w) as t_words, t_pos, array_to_string(w[t_pos + 1:t_pos + {GRAM}], ' ') as gram
          from (select *, unnest(range(0, len(w) - {GRAM - 1})) as t_pos from template_words)),
doc_words as (select row_number() over () as row, doc_id, {cutter} as w from documents),
runs as (select row, pos, array_to_string(w[pos + 1:pos + {GRAM}], ' ') as gram
         from (select row, w, unnest(range(0, len(w) - {GRAM - 1})) as pos from doc_words)),
hits as (select row, pos, pos - t_pos as diagonal, g.* exclude (gram) from runs join grams g using (gram)),
diagonals as (select row, template, label, share, slack, base, t_words, diagonal, list(t_pos) as t_runs, min(pos) as low,
                     max(pos) as high from hits group by all having slack = 0 or count(*) >= {MIN_VOTES}),
apart as (select *, case when diagonal - lag(diagonal) over (partition by row, template order by diagonal) > slack
                         then 1 else 0 end as far from diagonals),
numbered as (select *, sum(far) over (partition by row, template order by diagonal) as place from apart),
spans as (select row, template, label, share, slack, base, t_words, place, min(low) as start, max(high) + {GRAM} as stop,
                 flatten(list(t_runs)) as t_runs from numbered group by all),
places as (select *, len(list_distinct(flatten([t_runs] || [list_transform(t_runs, lambda t: t + j) for j in range(1, {GRAM})])))
                     / t_words as cover from spans),
found as (select *, cover >= share and stop - start <= t_words * {LONGEST_SPAN} as ok from places),
per_row as (select row, count(*) filter (ok and base) as n_base, min(start) filter (ok and base) as first_word,
                   max(start) filter (ok and base) as last_word,
                   string_agg(distinct label, ',' order by label) filter (ok and base) as base_labels,
                   string_agg(distinct label, ',' order by label) filter (ok) as labels, max(cover) as score
            from found group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0)::double as score
from doc_words left join per_row using (row)"""
