"""License scan by an exact set-similarity join, with DataFrame and SQL functions only.

Templates are sentences of license notices. A block is a run of words that begins at any word of a text and is as long as the template in words (shorter at the text's end), whatever lines, comment marks or
punctuation lie between the words; so a notice is found however it is wrapped. A block matches a template if it holds at least ``THRESHOLD`` of the
template's distinct words (containment); of up to four distinct words that is all of them. The join finds every such pair:

* Order: all words in one global order, those of no template first, then the templates' words from the rarest in the whole corpus
  to the most frequent (one counting pass; the vocabulary of the templates bounds its result).
* Prefix filter: a block that holds ``need`` of a template's n words holds one of the template's first n - need + 1. Only texts, and pieces of texts,
  with such a word are taken apart; each place of such a word, with the words around it, joins the table of prefixes.
* Length filter: the words around it are at least ``need``.
* Positional filter: as the first common word in the order, what follows in the template must be at least ``need`` long, and the words around
  must hold ``need`` of these.
* What is left is verified, block by block around the place, by the size of the intersection.

Phrases are a plain rule beside that: places where a phrase's words stand one after the other.

The templates are a parameter of fixed size, broadcast up to ``BROADCAST_WORDS`` prefix words and joined by a shuffle beyond.

Nulls and empty texts have no words, labels or matches. Long texts are joined in pieces of ``PIECE`` words, which share as many as a block may reach over. Repeated rows come back as often as they occur; an empty table gives an empty result.
Other columns are ignored. Ties of frequency are ordered by the word; the order changes no result.
"""

from __future__ import annotations

import math
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
BROADCAST_WORDS = 20_000
PIECE = 512
#: Words that make a label where they stand one after the other.
PHRASES = {"apache": "apache license", "gpl": "general public license", "mit": "mit license"}
#: (label, sentence of the notice)
TEMPLATES = (
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("cc-by", "CC BY 4.0"),
    ("cc-by", "Attribution 4.0 International"),
    ("cc-by-nc", "CC BY NC"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    ("cc-by-sa", "CC BY SA"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [x for x in re.split(_GAP, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase))) if x]


def words(text: Column) -> Column:
    """The words of a string column, A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), _GAP), lambda x: x != "")


def frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Occurrences of each word of the vocabulary in all texts."""
    seen = docs.select(F.explode(F.split(F.lower(docs[text_col]), _GAP)).alias("word")).where(F.col("word").isin(vocabulary))
    return {x: n for x, n in seen.groupBy("word").count().collect()}


def _places(found: Column, phrase: str) -> Column:
    """Indices at which the phrase's words start."""
    parts = words_of(phrase)

    def here(i: Column) -> Column:
        test = F.get(found, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(found, i + k) == part)
        return test

    return F.filter(F.when(F.size(found) >= len(parts), F.sequence(F.lit(0), F.size(found) - len(parts))).otherwise(F.array().cast("array<int>")), here)


def prepared(templates, threshold: float) -> list[tuple[int, str, int, list[str], int]]:
    """(number, label, words, distinct words, how many of them are needed) of each template."""
    out = []
    for number, (label, text) in enumerate(templates):
        members = sorted(set(words_of(text)))
        out.append((number, label, len(words_of(text)), members, math.ceil(threshold * len(members) - 1e-9)))
    return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of every row.

    matches: array of (template, label, first, containment), the pairs of the join; first is the block's first word, from 0. score: 1 if there is a phrase, else the largest containment, else 0.
    """
    phrases = PHRASES if phrases is None else phrases
    spark = docs.sparkSession
    sets = prepared(templates, threshold)
    vocabulary = sorted({x for *_, members, _ in sets for x in members})
    count = frequencies(docs, vocabulary, text_col)
    rank = {x: k for k, x in enumerate(sorted(vocabulary, key=lambda x: (count.get(x, 0), x)))}
    prefixes = []
    for number, label, length, members, need in sets:
        ordered = sorted(members, key=rank.__getitem__)
        prefixes += [(x, number, label, length, need, members, ordered[p:]) for p, x in enumerate(ordered[: len(members) - need + 1])]
    table = spark.createDataFrame(prefixes, "of string, template int, label string, length int, need int, members array<string>, later array<string>")
    table = F.broadcast(table) if len(prefixes) <= BROADCAST_WORDS else table
    first_words = sorted({x[0] for x in prefixes})
    wanted_words = F.array(*[F.lit(x) for x in first_words])
    # Java's (?i) folds ASCII letters only
    wanted = "(?i)(?<![0-9A-Za-z\\x80-\\x{10FFFF}])(?:" + "|".join(first_words) + ")(?![0-9A-Za-z\\x80-\\x{10FFFF}])"
    last = "(?i)(?:" + "|".join(sorted({words_of(x)[-1] for x in phrases.values()})) + ")"
    around = max((x[2] for x in sets), default=1) - 1  # words that a block may reach to either side of one of its words

    text = F.coalesce(docs[text_col], F.lit(""))
    pieces = F.split(text, _GAP)
    ends = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].alias("doc_id"),
        (F.size(pieces) - ends).cast("long").alias("n_words"),
        text.rlike(wanted).alias("wanted"),
        F.when(text.rlike(last) | text.rlike(wanted), words(text)).alias("found"),
    )
    places = F.when(F.col("found").isNotNull(), F.array(*[F.struct(F.lit(label).alias("label"), _places(F.col("found"), phrase).alias("at")) for label, phrase in sorted(phrases.items())]))

    def cut_out(low: Column) -> Column:
        start = F.greatest(low - around, F.lit(0))
        return F.struct(low.alias("low"), start.alias("start"), F.slice("found", start + 1, low - start + piece + around).alias("words"))

    cuts = F.when(F.col("wanted") & (F.size("found") > 0), F.filter(F.transform(F.sequence(F.lit(0), F.size("found") - 1, F.lit(piece)), cut_out), lambda x: F.arrays_overlap(x["words"], wanted_words)))
    rows = rows.select("row", "doc_id", "n_words", F.filter(places, lambda x: F.size(x["at"]) > 0).alias("places"), cuts.alias("cuts"))
    at = F.flatten(F.transform("places", lambda x: x["at"]))
    rows = rows.select(
        "row", "doc_id", "n_words", "cuts",
        F.when(F.size("places") > 0, F.size(at)).otherwise(0).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.when(F.size("places") > 0, F.transform("places", lambda x: x["label"])).otherwise(F.array().cast("array<string>")).alias("base"),
    )
    kept = [x for x in rows.columns if x != "cuts"]

    def spot(i: Column) -> Column:
        """A place in a piece, with the words that blocks around it may hold."""
        start = F.greatest(i - around, F.lit(0))
        return F.struct(F.get("cut.words", i).alias("word"), (F.col("cut.start") + start).alias("start"), (i - start).alias("lead"), F.slice("cut.words", start + 1, i - start + 1 + around).alias("words"))

    own = F.sequence(F.col("cut.low") - F.col("cut.start"), F.least(F.col("cut.low") - F.col("cut.start") + piece, F.size("cut.words")) - 1)
    spots = F.transform(F.filter(own, lambda i: F.array_contains(wanted_words, F.get("cut.words", i))), spot)
    lined = rows.select(*kept, F.explode_outer("cuts").alias("cut")).select(*kept, F.explode_outer(F.when(F.col("cut.low") < F.col("n_words"), spots)).alias("spot"))
    joined = lined.join(table, F.col("spot.word") == F.col("of"), "left")
    candidate = (F.size("spot.words") >= F.col("need")) & (F.size(F.array_intersect("spot.words", "later")) >= F.col("need"))

    def block(i: Column) -> Column:
        overlap = F.size(F.array_intersect(F.slice("spot.words", i + 1, F.col("length")), F.col("members")))
        return F.when(overlap >= F.col("need"), F.struct("template", "label", (F.col("spot.start") + i).cast("long").alias("first"), (overlap / F.size("members")).alias("containment")))

    starts = F.sequence(F.greatest(F.col("spot.lead") - F.col("length") + 1, F.lit(0)), F.col("spot.lead"))
    hits = F.when(candidate, F.filter(F.transform(starts, block), lambda x: x.isNotNull()))
    per_row = joined.groupBy("row").agg(*[F.first(x).alias(x) for x in kept if x != "row"], F.array_distinct(F.flatten(F.collect_list(hits))).alias("matches"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("matches", lambda x: x["label"]))))
    best = F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0))
    return per_row.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"), "matches")


def sql_list(items) -> str:
    return "[" + ", ".join("'" + x + "'" for x in items) + "]"


def oracle_sql(templates=TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The scan's digest in SQL for another engine: every text that has enough of a template's words, block by block.

    A block that begins with no word of the template is left out, as one that begins at its first such word holds no less.
    """
    phrases = PHRASES if phrases is None else phrases
    lower = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    sets = ", ".join(f"('{label}', {length}, {sql_list(members)}, {need})" for _, label, length, members, need in prepared(templates, threshold))
    places = ", ".join(
        f"{{'label': '{label}', 'spots': list_filter(range(1, len(w) + 1), lambda i: {' and '.join(f'w[i + {k}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(words_of(phrase)))})}}"
        for label, phrase in sorted(phrases.items())
    )
    return f"""
with t(label, length, members, need) as (values {sets}),
d as (select row_number() over () as row, doc_id, text, regexp_extract_all({lower}, {word}) as w from documents),
p as (select row, u.label, unnest(u.spots) - 1 as spot from (select row, unnest([{places}]) as u from d)),
b as (select row, count(*) as n_base, min(spot) as first_word, max(spot) as last_word, string_agg(distinct label, ',' order by label) as base_labels from p group by row),
e as (select row, w, list_distinct(w) as own from d),
l as (select row, label, length, members, need, w, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(members, w[i]))) as i from e, t where len(list_intersect(own, members)) >= need),
c as (select row, label, overlap / len(members) as containment from (select row, label, members, need, len(list_intersect(list_distinct(w[i : i + length - 1]), members)) as overlap from l) where overlap >= need),
g as (select row, max(containment) as best from c group by row),
a as (select row, string_agg(distinct label, ',' order by label) as labels from (select row, label from c union all select row, label from p) group by row)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, case when n_base > 0 then 1.0::double else coalesce(best, 0)::double end as score
from d left join b using (row) left join g using (row) left join a using (row)"""
