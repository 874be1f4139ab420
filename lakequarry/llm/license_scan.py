r"""License scans by MinHash bands over overlapping text windows, verified by exact shingle containment, in DataFrame functions only.

Words are runs of letters and digits (ASCII ones, and every character from U+0080 on), lower-cased; a shingle is the hash of five words. Texts and
license templates are cut into windows of WINDOW shingles, one every STRIDE. A window's band k is its shingle that is smallest after XOR with the k-th
of BANDS constants, whose top bits differ, so that each band picks another shingle of the window. A template is retrieved where a band of one of its windows
equals the same band of a window of the text. Bands have one row, as windows that overlap by half still must meet:

- A template of t >= 3 shingles and a text that has it whole have windows with a Jaccard similarity of 3/8 at least (t <= WINDOW; the text's window is aligned
  within half a stride of one that holds the template), or 6/10 (longer ones: windows that begin within two shingles of each other). All BANDS differ with
  a probability of (1 - 3/8)^16 = 0.0006 or (1 - 6/10)^16 = 5e-7; miss_bound() gives it for a template.
- Templates of one or two shingles are windows of one shingle each, for which one band decides without a miss.

Retrieved templates are then verified: the share of a template's different shingles that the text has must be min_share (0.8) or more. Texts that have
no band value of any template cannot meet one and are left after one look at each shingle. Nothing is shuffled; templates are literals of the plan, and
their number is checked.

Defined results: null and empty texts, and those under five words, match nothing. Repeated rows stay repeated rows. An empty table gives an empty result.
Other columns pass unchanged; a column `licenses` of the input is replaced. Matches are in order of the templates' names.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, whole_text

WORDS, WINDOW, STRIDE, BANDS, MOST_SHINGLES = 5, 8, 4, 16, 200_000
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Short notices and opening passages of public licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
    "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
    "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

MATCH = "array<struct<license:string,found:int,of:int>>"


def constants() -> list[int]:
    """BANDS signed 64-bit numbers whose top four bits differ."""
    rng = np.random.default_rng(11)
    rest = rng.integers(0, 1 << 60, BANDS, dtype=np.uint64)
    return [int(x) for x in (rest | np.arange(BANDS, dtype=np.uint64) << np.uint64(60)).view(np.int64)]


def shingles(text: Column) -> Column:
    """Hashes of the text's runs of five words, in order, repeats included."""
    words = F.array_remove(F.split(F.lower(text), _BETWEEN), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    every = lambda h: F.transform(F.slice(h, 1, F.size(h) - WORDS + 1), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WORDS)]))
    return let(hashed, lambda h: F.when(F.size(h) >= WORDS, every(h)).otherwise(F.array().cast("array<bigint>")))


def band_values(h: Column) -> Column:
    """Bands of all windows of the shingles h, as different numbers; a band's constant is part of its number."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(h) - WINDOW) / STRIDE).cast("int")))
    band = lambda w, c: F.array_min(F.transform(w, lambda x: x.bitwiseXOR(F.lit(c).cast("long"))))
    bands = lambda w: F.array(*[band(w, c) for c in constants()])
    return F.array_distinct(F.flatten(F.transform(starts, lambda j: let(F.slice(h, j * STRIDE + 1, WINDOW), bands))))


def miss_bound(n_shingles: int) -> float:
    """The chance, at most, that a text that holds a template of so many different shingles whole does not retrieve it."""
    if n_shingles < 3:
        return 0.0
    least = n_shingles / WINDOW if n_shingles <= STRIDE + 1 else 6 / 10 if n_shingles >= WINDOW else (n_shingles - 2) / (WINDOW + 2)
    return (1 - least) ** BANDS


def prepare(spark: SparkSession, templates: Mapping[str, str]) -> list[dict]:
    """Each template's name, different shingles and band values; by the same functions as the texts', on a table of the templates only."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").withColumn("h", shingles(F.col("text")))
    keys = F.when(F.size(F.array_distinct("h")) < 3, F.array_distinct("h")).otherwise(band_values(F.col("h")))
    found = [r.asDict() for r in rows.select("license", F.array_distinct("h").alias("shingles"), keys.alias("keys")).orderBy("license").collect()]
    if short := [r["license"] for r in found if not r["shingles"]]:
        raise ValueError(f"templates under {WORDS} words: {', '.join(short)}")
    if (n := sum(len(r["shingles"]) for r in found)) > MOST_SHINGLES:
        raise ValueError(f"templates have {n} shingles; {MOST_SHINGLES} fit into a plan")
    return found


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_share: float = 0.8) -> DataFrame:
    """docs (text, others) with licenses: array of (license, found, of), the templates of which the text has min_share of the shingles or more."""
    known = prepare(docs.sparkSession, templates)
    docs = docs.drop("licenses")
    tiny = [k for r in known if len(r["shingles"]) < 3 for k in r["keys"]]
    wide = {k for r in known if len(r["shingles"]) >= 3 for k in r["keys"]}
    member = sorted({*tiny, *(k ^ c for k in wide for c in constants())} & {*tiny, *(s for r in known for s in r["shingles"])})
    literal = F.from_json(F.lit(json.dumps(known)), "array<struct<license:string,shingles:array<bigint>,keys:array<bigint>>>")
    nothing = F.array().cast(MATCH)

    def retrieved(h: Column) -> Column:
        met = F.concat(F.filter(h, lambda x: x.isin(tiny)) if tiny else F.array().cast("array<bigint>"), F.filter(band_values(h), lambda x: x.isin(*wide)) if wide else F.array().cast("array<bigint>"))
        return let(met, lambda m: F.filter(literal, lambda t: F.arrays_overlap(t["keys"], m)))

    def verified(h: Column) -> Column:
        count = lambda t: F.struct(t["license"].alias("license"), F.size(F.array_intersect(t["shingles"], h)).alias("found"), F.size(t["shingles"]).alias("of"))
        return F.filter(F.transform(retrieved(h), count), lambda m: m["found"] >= F.lit(min_share) * m["of"])

    if not known:
        return docs.withColumn("licenses", nothing)
    found = let(shingles(whole_text()), lambda h: F.when(F.exists(h, lambda x: x.isin(member)), verified(h)).otherwise(nothing))
    return docs.withColumn("licenses", found)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.array_join(F.transform("licenses", lambda m: F.concat(m["license"], F.lit(":"), m["found"].cast("string"), F.lit("/"), m["of"].cast("string"))), ";")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), named.alias("licenses"))


_SQL_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SQL_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))"
_SQL_TEMPLATES = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
SQL = f"""
WITH t AS (
  SELECT license, unnest({_SQL_SHINGLES}) AS s FROM (SELECT license, {_SQL_WORDS} AS w FROM (VALUES {_SQL_TEMPLATES}) v(license, text))
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents
), ds AS (
  SELECT r, unnest({_SQL_SHINGLES}) AS s FROM d
), m AS (
  SELECT r, license, count(*) AS found, any_value(n) AS n FROM ds JOIN t USING (s) JOIN (SELECT license, count(*) AS n FROM t GROUP BY license) USING (license) GROUP BY r, license
), l AS (
  SELECT r, count(*) AS n_licenses, string_agg(license || ':' || found || '/' || n, ';' ORDER BY license) AS licenses FROM m WHERE found >= 0.8 * n GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_licenses, 0) AS BIGINT) AS n_licenses, coalesce(licenses, '') AS licenses FROM d LEFT JOIN l USING (r)
"""

QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES = {"op4_license_scan": SQL}
