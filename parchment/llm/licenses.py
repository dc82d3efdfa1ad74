"""Licence scans: normalised sentences against licence templates by the Dice coefficient over word bigrams.

SQL functions only. A text is cut into units at line ends and after full stops, exclamation and question marks that white
space follows. A unit's bigrams are counted as a multiset. Two texts of a and b bigrams have a Dice coefficient of at most
2 min(a, b) / (a + b), so a template needs to be compared only with units whose size lies within its bounds; units that fit
no template's bounds are dropped before their bigrams are built. And a unit that reaches the coefficient shares more than
half of a template's bigrams, so it holds one of any half of them: a unit without any of these is dropped as well.

A statement that is wrapped over lines is found as a join: adjacent units, none of which carries a licence itself, without
a blank line between them and of a size within the bounds. Of joins that overlap the best counts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import read

#: The wording that public licences use to announce themselves.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Proprietary": "All rights reserved",
}
#: Dice coefficient from which a unit is said to carry a licence.
DICE = 0.8


def normalised(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bigrams(normal: Column) -> Column:
    """Word bigrams with their occurrence number, so that a set of them is a multiset; a single word stands for itself."""

    def numbered(items: Column) -> Column:
        return F.transform(items, lambda x, i: F.concat(x, F.lit("\t"), F.size(F.filter(F.slice(items, F.lit(1), i), lambda y: y == x)).cast("string")))

    def paired(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.when(F.size(w) > 1, let(pairs, numbered)).otherwise(w)

    return let(F.split(normal, " "), paired)


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    table = spark.createDataFrame(sorted(templates.items()), "_licence string, _text string")
    return table.select("_licence", bigrams(normalised(F.col("_text"))).alias("_own")).withColumn("_size", F.size("_own"))


def _telling(grams: list[str], dice: float) -> list[str]:
    """Bigrams of a template of which a unit with that coefficient has at least one: it shares dice / (2 - dice) of n at least,
    so any n - that + 1 of them will do; the longest are the rarest."""
    n = len(grams)
    return sorted(grams, key=lambda g: (-len(g), g))[: n - math.ceil(n * dice / (2 - dice) - 1e-9) + 1]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, dice: float = DICE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, licences (sorted, distinct), n_units (units that carry one), best (largest Dice).

    Every unit of every text is compared. A null or empty text, and one without such units, gets an empty list, 0 and 0.0.
    A unit that fits several templates counts for the best, of equal ones for the first by name.
    Repeated rows and rows of null doc_id each get their own result: nothing is grouped by doc_id.
    """
    spark = docs.sparkSession
    rows = template_table(spark, templates).orderBy("_licence").collect()  # the templates given, no data
    high = max(r._size for r in rows) * (2 - dice) / dice
    shortest = min(min(len(g.split("\t")[0]) for g in r._own) for r in rows)
    marks = "|".join(sorted({re.escape(x) for r in rows for x in _telling([g.split("\t")[0] for g in r._own], dice)}))
    units = F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r]|(?<=[.!?])[ \t]+")
    # a bound on length is cheap to take before a unit is normalised: a word has at least one character and a blank
    words = int(high) + 1
    has_mark = f"(^| )({marks})( |$)"
    loose = "(" + marks.replace(r"\ ", " ").replace(" ", r"[^\p{L}\p{N}]+") + ")"

    def short(u: Column) -> Column:
        return (F.length(u) > 0) & (F.size(F.split(u, r"[^\p{L}\p{N}]+", words + 4)) <= words + 3)

    near = F.filter(F.transform(F.filter(units, lambda u: (F.length(u) >= shortest) & short(u)), normalised), lambda u: u.rlike(has_mark))

    def compared(found: Column) -> Column:
        def of(own: list[str]) -> Column:
            bounds = (F.size(found) <= len(own) * (2 - dice) / dice) & (F.size(found) >= len(own) * dice / (2 - dice))
            return F.when(bounds, 2.0 * F.size(F.array_intersect(F.array(*[F.lit(x) for x in own]), found)) / (F.size(found) + len(own))).otherwise(0.0)

        return F.array_max(F.array(*[F.struct(of(r._own).alias("dice"), F.lit(-i).alias("order"), F.lit(r._licence).alias("licence")) for i, r in enumerate(rows)]))

    def best(s: Column) -> Column:
        return let(bigrams(s), compared)

    hits = F.filter(F.transform(near, best), lambda h: h["dice"] >= dice)

    def joins(lines: Column) -> Column:
        """Hits of adjacent units, best first; a null is a unit that no join may hold."""

        def of(i: Column) -> Column:
            def made(k: Column) -> Column:
                part = F.slice(lines, i, k)
                return F.when((i + k - 1 <= F.size(lines)) & ~F.exists(part, lambda x: x.isNull()), F.array_join(part, " "))

            def hit(k: Column) -> Column:
                return let(made(k), lambda t: F.when(t.rlike(has_mark) & (F.size(F.split(t, " ")) <= words), F.struct((-best(t)["dice"]).alias("less"), k.alias("k"), i.alias("i"), best(t)["licence"].alias("licence"))))

            return F.when(F.array_join(F.slice(lines, i, words), " ").rlike(has_mark), F.transform(F.sequence(F.lit(2), F.lit(words)), hit))

        found = F.flatten(F.filter(F.transform(F.sequence(F.lit(1), F.size(lines)), of), lambda x: x.isNotNull()))
        return F.array_sort(F.filter(found, lambda h: h.isNotNull() & (h["less"] <= -dice)))

    def apart(found: Column) -> Column:
        none = F.filter(found, lambda h: F.lit(False))
        over = lambda h, x: (h["i"] < x["i"] + x["k"]) & (x["i"] < h["i"] + h["k"])
        return F.aggregate(found, none, lambda taken, h: F.when(F.exists(taken, lambda x: over(h, x)), taken).otherwise(F.concat(taken, F.array(h))))

    def line(u: Column) -> Column:
        text_ = F.when(short(u), normalised(u))
        return let(text_, lambda t: F.when((t != "") & ~F.coalesce(t.rlike(has_mark) & (best(t)["dice"] >= dice), F.lit(False)), t))

    wrapped = F.when(F.lower(text).rlike(loose), let(F.transform(units, line), lambda x: let(joins(x), apart)))
    out = docs.select(F.col(doc_id).alias("doc_id"), hits.alias("_own"), wrapped.alias("_joined"))
    joined = F.transform("_joined", lambda h: F.struct((-h["less"]).alias("dice"), F.lit(0).alias("order"), h["licence"].alias("licence")))
    out = out.select("doc_id", F.concat("_own", F.coalesce(joined, F.filter("_own", lambda h: F.lit(False)))).alias("_hits"))
    return out.select(
        "doc_id",
        F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["licence"]))).alias("licences"),
        F.size("_hits").alias("n_units"),
        F.coalesce(F.array_max(F.transform("_hits", lambda h: h["dice"])), F.lit(0.0)).alias("best"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_units", F.round("best", 6).alias("best"))


_SQL_TEMPLATES = ", ".join(f"('{k}', '{v}')" for k, v in sorted(TEMPLATES.items()))


def _sql_grams(words: str) -> str:
    pairs = f"list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1])"
    return f"CASE WHEN len({words}) > 1 THEN {pairs} ELSE {words} END"


def _sql_normal(text: str) -> str:
    return rf"trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_SQL_NUMBERED = "list_transform(g, lambda x, i: x || chr(9) || len(list_filter(g[1:i], lambda y: y = x)))"
ORACLE = rf"""
WITH t0(licence, g) AS (SELECT licence, {_sql_grams("w")} FROM (SELECT licence, string_split({_sql_normal("body")}, ' ') AS w FROM (VALUES {_SQL_TEMPLATES}) v(licence, body))),
t AS (SELECT licence, {_SQL_NUMBERED} AS b FROM t0),
u AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?])[ 	]+', '' || chr(10), 'g'), '[

]+', chr(10), 'g'), chr(10))) AS s FROM documents),
n AS (SELECT doc_id, row_number() OVER () AS u, string_split({_sql_normal("s")}, ' ') AS w FROM u),
k AS (SELECT doc_id, u, w FROM n WHERE len(w) <= (SELECT max(len(b)) * 1.5 + 2 FROM t) AND w[1] <> ''),
f0 AS (SELECT doc_id, u, {_sql_grams("w")} AS g FROM k),
f AS (SELECT doc_id, u, {_SQL_NUMBERED} AS b FROM f0),
d AS (SELECT doc_id, u, licence, 2.0 * len(list_intersect(f.b, t.b)) / (len(f.b) + len(t.b)) AS dice FROM f, t WHERE len(f.b) BETWEEN len(t.b) / 1.5 - 1 AND len(t.b) * 1.5 + 1),
h AS (SELECT doc_id, u, max(dice) AS dice, arg_min(licence, (-dice, licence)) AS licence FROM d WHERE dice >= {DICE} GROUP BY doc_id, u),
r AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) AS n_units, max(dice) AS best FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_units, 0) AS n_units, round(coalesce(best, 0.0), 6) AS best FROM documents LEFT JOIN r USING (doc_id)
"""
