"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them. JVM-side only.

A template of n distinct five-word shingles is looked for in windows of 2w shingles, one every w, where w is the
power of two at or above n: some window holds any w + 1 shingles in a row whole. A window that contains 0.8 of the
template has a Jaccard similarity to it of 0.4w / 2.1w or more; of BANDS bands with one hash each at least one then
collides with a probability of 1 - (1 - 0.19) ** BANDS, over 0.9997. Exact containment of shingles decides.

Each template has anchor words that stand in over a fifth of its shingles, so a window without any of them can't
contain 0.8. Windows are only made around anchors; documents without any are passed over by one pattern.

Defined results: null and blank texts match nothing and still give a row; repeated rows agree; a template found twice
counts once; texts of any length are scanned whole; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
BANDS = 40

#: Notices by which texts name their licenses, and the bodies of short licenses.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-2-clause-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause-condition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-body": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "zlib-body": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
}


def _shingles(notice: str) -> list[str]:
    words = re.findall("[a-z0-9]+", notice.lower())
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 0))))


def step(n_shingles: int) -> int:
    """Distance of windows for a template: the power of two at or above its shingles."""
    return 1 << (n_shingles - 1).bit_length()


def anchors(templates: dict[str, str]) -> list[str]:
    """Words such that over 1 - CONTAINED of each template's shingles hold one of them; long and shared words first."""
    sets = {t: _shingles(n) for t, n in templates.items()}
    shared = Counter(w for s in sets.values() for w in {w for x in s for w in x.split()})
    chosen: list[str] = []
    for shingles in sets.values():
        while sum(not set(chosen) & set(x.split()) for x in shingles) >= CONTAINED * len(shingles):
            words = {w for x in shingles for w in x.split()} - set(chosen)
            chosen.append(max(words, key=lambda w: (len(w) >= 7, shared[w], len(w), w)))
    return sorted(chosen)


def template_rows(templates: dict[str, str] = TEMPLATES) -> list[tuple[str, str, int, int]]:
    """(template, shingle, distinct shingles of the template, window step)."""
    return [(t, x, len(s), step(len(s))) for t, s in ((t, _shingles(n)) for t, n in templates.items()) for x in s]


def _sketch(hashes: Column) -> Column:
    """Least hash by band."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band))))


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per template and band: step, least, template, own (its shingles' hashes). Bounded by the template list."""
    rows = spark.createDataFrame(template_rows(templates), "template string, shingle string, n int, step int")
    own = rows.groupBy("template", "step").agg(F.collect_set(F.xxhash64("shingle")).alias("own"))
    return own.select("template", "step", "own", F.posexplode(_sketch(F.col("own"))).alias("band", "least"))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per (document, template) found: key, template, containment (of its best window)."""
    words = anchors(templates)
    steps = sorted({s for _, _, _, s in template_rows(templates)})
    lower = F.lower(F.col(text))
    tokens = docs.where(lower.rlike("|".join(words))).select(F.col(key).alias("_key"), F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)).alias("_tokens"))
    n = F.size("_tokens") - (SHINGLE - 1)
    places = F.array_compact(F.transform("_tokens", lambda t, i: F.when(t.isin(words), i)))
    tokens = tokens.where(n > 0).withColumns({"_n": n, "_at": places, "_step": F.explode(F.array(*[F.lit(s) for s in steps]))})
    # windows [k * step, (k + 2) * step) of shingles, of which one has the anchor's word
    last = lambda p: F.least(p, F.col("_n") - 1)
    near = F.transform("_at", lambda p: F.sequence(F.greatest(F.floor((p - (SHINGLE - 1)) / F.col("_step")).cast("int") - 1, F.lit(0)), F.floor(last(p) / F.col("_step")).cast("int")))
    # a window takes its own tokens along, not the whole text's
    own = F.transform(F.array_distinct(F.flatten(near)), lambda k: F.struct(k.alias("k"), F.slice(F.col("_tokens"), k * F.col("_step") + 1, 2 * F.col("_step") + (SHINGLE - 1)).alias("tokens")))
    windows = tokens.select("_key", "_step", F.explode(own).alias("_w")).select("_key", "_step", F.col("_w.k").alias("_k"), F.col("_w.tokens").alias("_tokens"))
    span = F.sequence(F.lit(1), F.size("_tokens") - (SHINGLE - 1))
    hashes = F.array_distinct(F.transform(span, lambda i: F.xxhash64(F.array_join(F.slice(F.col("_tokens"), i, SHINGLE), " "))))
    hashed = windows.where(F.size("_tokens") >= SHINGLE).select("_key", "_step", "_k", hashes.alias("_hashes"))
    banded = hashed.select("_key", "_step", "_k", "_hashes", F.posexplode(_sketch(F.col("_hashes"))).alias("_band", "_least"))
    table = F.broadcast(template_table(docs.sparkSession, templates))
    met = banded.join(table, (F.col("_step") == F.col("step")) & (F.col("_band") == F.col("band")) & (F.col("_least") == F.col("least")))
    containment = F.size(F.array_intersect("own", "_hashes")) / F.size("own")
    return met.select("_key", "template", containment.alias("containment")).where(F.col("containment") >= CONTAINED).groupBy(F.col("_key").alias(key), "template").agg(F.max("containment").alias("containment"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per document: key, n_licenses, licenses (sorted, comma between), containment of the best match (0 if none)."""
    found = scanned(docs, key, text, templates).groupBy(F.col(key).alias("_id")).agg(F.array_sort(F.collect_set("template")).alias("_names"), F.max("containment").alias("_best"))
    joined = docs.select(key).join(found, F.col(key).eqNullSafe(F.col("_id")), "left")
    names = F.coalesce("_names", F.array().cast("array<string>"))
    return joined.select(key, F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce("_best", F.lit(0.0)).alias("containment"))


def oracle_sql(templates: dict[str, str] = TEMPLATES) -> str:
    """The same scan by brute force: every shingle of every text against all templates."""
    values = ", ".join(f"('{t}', '{x}', {n}, {s})" for t, x, n, s in template_rows(templates))
    return f"""
WITH templates(template, shingle, n, step) AS (VALUES {values}),
tokens AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
shingles AS (
    SELECT doc_id, i - 1 AS spot, array_to_string(t[i:i + {SHINGLE - 1}], ' ') AS shingle
    FROM (SELECT doc_id, t, unnest(range(1, len(t) - {SHINGLE - 2})) AS i FROM tokens WHERE len(t) >= {SHINGLE})
),
hits AS (SELECT s.doc_id, s.spot, m.* FROM shingles s JOIN templates m USING (shingle)),
windows AS (
    SELECT doc_id, template, n, shingle, floor(spot / step)::INT AS k FROM hits
    UNION ALL SELECT doc_id, template, n, shingle, floor(spot / step)::INT - 1 FROM hits WHERE spot >= step
),
found AS (
    SELECT doc_id, template, max(share) AS containment
    FROM (SELECT doc_id, template, k, count(DISTINCT shingle) / n::DOUBLE AS share FROM windows GROUP BY doc_id, template, k, n)
    WHERE share >= {CONTAINED} GROUP BY doc_id, template
),
named AS (SELECT doc_id, count(*) AS n_licenses, string_agg(template, ',' ORDER BY template) AS licenses, max(containment) AS containment FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.n_licenses, 0)::BIGINT AS n_licenses, coalesce(f.licenses, '') AS licenses, coalesce(f.containment, 0.0)::DOUBLE AS containment
FROM documents d LEFT JOIN named f ON d.doc_id = f.doc_id
"""
