"""License scans: Dice coefficient over word bigrams against license templates, in DataFrame functions only.

A text is cut into segments (lines and sentences); each segment and, for long templates, the whole
text is normalised to lower-case words of a-z and 0-9 and compared with every template whose size
leaves the threshold open: with A and B bigrams, 2 min(A, B) / (A + B) must reach it. Bigrams are sets.

Before anything is cut, a text must hold one of the templates' anchor words. They lose nothing: a
segment that reaches the threshold shares at least o = ceil(t B / (2 - t)) of a template's B
bigrams, so it holds one of any B - o + 1 of them. A text is tested as the normaliser reads it: A-Z
lower-cased, and whatever isn't a-z or 0-9 (an underscore, an accented letter) ends a word.

Defined results: null, empty and wordless texts match nothing; a segment under two words has no
bigram and matches nothing; a segment counts for its best template only (ties to the last name); each row
of the table gives a row per template found, with its best segment (ties to the first in binary order),
or, if no segment shows it, its best window (ties to the first place); rows with null ids keep them.
``license_sql`` states the segments' part alone. Whole license texts are found by their grants, which are
among the templates.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, texts

THRESHOLD = 0.8

# Short license notices, and sentences of well-known license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
}

#: A sentence's end, in both Spark's and DuckDB's dialects: its mark, then white space.
SENTENCE_END = r"([.!?])[ \t\r]+"


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    """Distinct bigrams in order."""
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def overlap_needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size / (2 - threshold) - 1e-9)


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which a matching text holds one at least.

    A matching segment holds one of any B - o + 1 bigrams of its template, so words that stand in so
    many of each template's bigrams are enough. They are chosen greedily; long words are rarer and
    count more.
    """
    bigrams = {k: bigrams_of(v) for k, v in templates.items()}
    needed = {k: len(b) - overlap_needed(len(b), threshold) + 1 for k, b in bigrams.items()}
    chosen: list[str] = []

    def missing(words: list[str]) -> int:
        return sum(max(0, needed[k] - sum(any(w in x.split() for w in words) for x in b)) for k, b in bigrams.items())

    every = sorted({w for b in bigrams.values() for x in b for w in x.split()})
    while left := missing(chosen):
        chosen.append(max(every, key=lambda w: ((left - missing([*chosen, w])) * (10 if len(w) > 5 else 4 if len(w) > 3 else 1), len(w), w)))
    return chosen


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """The numbers of bigrams that can reach the threshold against so many."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def _lower(text: Column) -> Column:
    """A-Z only, as the normaliser has it: lower() would make letters of others."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(_lower(text), "[^a-z0-9]+", " "))


def _bigrams(w: Column) -> Column:
    """Distinct bigrams of an array of words."""
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))


def _best(b: Column, templates: dict[str, str], threshold: float) -> Column:
    """The best template's dice and name for an array of bigrams; null if none reaches the threshold.

    Sizes are compared first: array_intersect runs for the templates that their bounds leave open.
    """
    hits = []
    for name, text in templates.items():
        t = bigrams_of(text)
        low, high = size_bounds(len(t), threshold)
        dice = F.when(F.size(b).between(low, high), 2.0 * F.size(F.array_intersect(b, F.array(*map(F.lit, t)))) / (F.size(b) + len(t)))
        hits.append(F.struct(dice.alias("dice"), F.lit(name).alias("license")))
    return F.array_max(F.filter(F.array(*hits), lambda h: h["dice"] >= threshold))


def _holds(text: Column, word: str) -> Column:
    """Whether a lower-cased text may hold a word; short ones are common inside others and need their bounds."""
    there = text.contains(word)
    return there if len(word) > 4 else there & text.rlike(f"(?:^|[^a-z0-9]){word}(?:[^a-z0-9]|$)")


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, anchored: bool = True) -> DataFrame:
    """doc_id, license, dice, segment: the best segment for each row of docs and template that reaches the threshold.

    Without anchors every text is cut and compared; the result is the same.
    """
    templates = templates or TEMPLATES
    docs = texts(docs).where("text is not null")
    words = anchors(templates, threshold) if anchored else []
    # the array binds the lower-cased text, so that it is made once for all words
    holds = F.exists(F.array(_lower(F.col("text"))), lambda t: reduce(lambda x, y: x | y, (_holds(t, w) for w in words))) if words else F.lit(True)
    # written once: rows are numbered, and read by segments and by windows
    found = Scratch(docs.sparkSession, "licenses").table(docs.where(holds).withColumn("row", F.monotonically_increasing_id()), "found")
    by_segment = _by_segment(found, templates, threshold)
    by_window = _by_window(found, templates, threshold)
    more = by_window.join(by_segment.select("row", "license"), ["row", "license"], "left_anti")
    out = by_segment.unionByName(more)
    return out.select("doc_id", "license", F.round(-F.col("m.neg"), 6).alias("dice"), F.col("m.segment").alias("segment"))


def _by_segment(found: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """row, doc_id, license, m (neg, segment): the best of lines, sentences and whole texts."""
    segments = F.split(F.regexp_replace("text", SENTENCE_END, "$1\n"), "\n")
    # the outer form: for the other one Spark infers a filter on the segments and cuts every text to evaluate it
    spans = found.select("doc_id", "row", F.explode_outer(F.array_distinct(F.concat(F.array("text"), segments))).alias("segment"))
    # arrays of one element bind an intermediate result, so that it is made once
    words = F.array(F.split(_normal(F.col("segment")), " "))
    hit = F.transform(F.transform(words, _bigrams), lambda b: _best(b, templates, threshold))
    scored = spans.select("doc_id", "row", "segment", F.explode_outer(hit).alias("h")).where("h is not null")
    return scored.groupBy("row", "doc_id", F.col("h.license").alias("license")).agg(F.min(F.struct((-F.col("h.dice")).alias("neg"), "segment")).alias("m"))


def _by_window(found: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """row, doc_id, license, m (neg, segment): the best windows of words that overlap no better one."""
    known = {k: b for k, v in templates.items() if (b := bigrams_of(v))}
    table = [(k, x, overlap_needed(len(b), threshold), size_bounds(len(b), threshold)[1]) for k, b in known.items() for x in b]
    bigrams = F.broadcast(found.sparkSession.createDataFrame(table, "license string, bigram string, need int, high int"))
    w = F.array(F.split(_normal(F.col("text")), " "))
    pairs = F.transform(w, lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)))[0]
    hits = found.select("row", F.posexplode(pairs).alias("at", "bigram")).join(bigrams, "bigram")
    # for each hit, where the last of the needed hits from it on lies: beyond high the window can't reach the threshold
    hits = hits.groupBy("row", "license", "need", "high").agg(F.array_sort(F.collect_list("at")).alias("at")).where(F.size("at") >= F.col("need"))
    starts = F.filter("at", lambda x, i: F.coalesce(F.try_element_at("at", i + F.col("need")) - x < F.col("high"), F.lit(False)))
    spots = hits.withColumn("starts", starts).where(F.size("starts") > 0)
    own = F.broadcast(found.sparkSession.createDataFrame(list(known.items()), "license string, own array<string>"))
    # arrays of one element bind a text's words, and a window's, so that they are cut once and not for each start or end
    raw = F.array(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+[^A-Za-z0-9]*"), F.lit(0)))

    def window(raw: Column, x: Column) -> Column:
        """A window's words, and the lengths that it can have: up to a hit, with the needed hits at least."""
        ends = F.transform(F.filter("at", lambda e: (e >= x) & (e < x + F.col("high"))), lambda e: e - x + 1)
        return F.struct(x.alias("first"), F.slice(raw, x + 1, F.col("high") + 1).alias("raw"), F.slice(ends, F.col("need"), F.size("at")).alias("ends"))

    windows = F.flatten(F.transform(raw, lambda r: F.transform("starts", lambda x: window(r, x))))
    cut = spots.join(found, "row").select("row", "doc_id", "license", F.explode(windows).alias("s")).select("row", "doc_id", "license", "s.*")
    words = F.array(F.transform("raw", lambda x: _lower(F.regexp_extract(x, "[A-Za-z0-9]+", 0))))

    def dice(w: Column, n: Column) -> Column:
        parts = F.transform(F.array(_bigrams(F.slice(w, 1, n + 1))), lambda b: 2.0 * F.size(F.array_intersect(b, F.col("own"))) / (F.size(b) + F.size("own")))
        return F.struct(parts[0].alias("dice"), (-n).alias("short"))

    best = cut.join(own, "license").withColumn("b", F.array_max(F.flatten(F.transform(words, lambda w: F.transform("ends", lambda n: dice(w, n)))))).where(F.col("b.dice") >= threshold)
    said = F.regexp_replace(F.array_join(F.slice("raw", 1, 1 - F.col("b.short")), ""), "[^A-Za-z0-9]+$", "")
    spans = best.select("row", "doc_id", "license", F.col("b.dice").alias("dice"), "first", (F.col("first") - F.col("b.short")).alias("last"), said.alias("segment"))  # words, ends included
    # chains of windows that overlap, in each of them the best first
    ordered = Window.partitionBy("row").orderBy("first", "last", "license")
    new = F.coalesce((F.col("first") > F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    chains = spans.withColumn("new", new).withColumn("chain", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    all_of = F.collect_list(F.struct("dice", "license", (-F.col("first")).alias("early"), "last", "segment"))
    chains = chains.groupBy("row", "doc_id", "chain").agg(F.sort_array(all_of, asc=False).alias("c"))
    none = F.slice("c", 1, 0)
    kept = F.aggregate("c", none, lambda kept, x: F.when(F.exists(kept, lambda y: (-y["early"] <= x["last"]) & (y["last"] >= -x["early"])), kept).otherwise(F.concat(kept, F.array(x))))
    each = chains.select("row", "doc_id", F.explode(kept).alias("k"))
    top = each.groupBy("row", "doc_id", F.col("k.license").alias("license")).agg(F.min(F.struct((-F.col("k.dice")).alias("neg"), (-F.col("k.early")).alias("first"), F.col("k.segment").alias("segment"))).alias("m"))
    return top.select("row", "doc_id", "license", F.struct("m.neg", "m.segment").alias("m"))


def license_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, without anchors and size bounds."""
    templates = templates or TEMPLATES
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(k)}, {q(b)}, {len(bigrams_of(v))})" for k, v in templates.items() for b in bigrams_of(v))
    return f"""
with t(license, bigram, size) as (values {rows}),
docs as (select row_number() over () as r, doc_id, text from documents where text is not null),
spans as (
  select distinct r, doc_id, segment from (
    select r, doc_id, text as segment from docs
    union all
    select r, doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10))) from docs)),
words as (select r, doc_id, segment, string_split(trim(regexp_replace(translate(segment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') as w from spans),
pairs as (select r, doc_id, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from words where len(w) > 1),
flat as (select r, doc_id, segment, len(b) as n, unnest(b) as bigram from pairs),
scored as (
  select r, doc_id, segment, license, 2.0::double * count(*) / (any_value(n) + any_value(size)) as dice
  from flat join t using (bigram) group by r, doc_id, segment, license),
named as (select *, row_number() over (partition by r, segment order by dice desc, license desc) as j from scored where dice >= {threshold}),
best as (select *, row_number() over (partition by r, license order by dice desc, segment) as k from named where j = 1)
select doc_id, license, round(dice, 6) as dice, segment from best where k = 1
"""
