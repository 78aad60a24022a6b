"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Notices stand at the head or the foot of a file: each of the first ``HEAD_LINES`` and last
``FOOT_LINES`` lines is a possible header, and every whole text a possible licence file.
So is a block: a paragraph of the first ``BLOCK_LINES`` lines, the last paragraph, or the comment
at the head of a text, without comment marks and copyright lines.  Blocks and whole texts are compared to usual notices and to full licence
texts as well (`licence_texts`), lines and whole texts to the one-sentence notices.
All become sparse TF-IDF vectors (terms are runs of a-z and 0-9 of the lower-cased text, hyphens inside included;
stop words left out; inverse document frequencies are those of the templates, a term of no template counting
as the rarest) and are compared to the templates by cosine.  A file without a header of
its own takes the licence of the licence file in the nearest directory at or above its own.

A line can only reach the threshold with one of the *anchor* terms: without them its dot
product with every template stays below the threshold (Cauchy-Schwarz).  Lines without an
anchor are therefore left out before terms are counted, which changes no result.

Everything is DataFrame operations; the templates are constants of the plan.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import materialize

# Notices by which files name their licence, by SPDX identifier.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the two clause BSD License."),
    ("BSD-3-Clause", "Released under the three clause BSD License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Stop words, which are no terms.
STOP = tuple("a all an and any are as by for from in into is it may not of on or that the this to under use with without you".split())
# Terms so frequent in texts that they make poor anchors.
FREQUENT = frozenset("copy fee file files form forms free general mit person public purpose source subject terms three two version work 0 1 2 3 4".split())
#: Those of the long templates.
FREQUENT_LONG = FREQUENT | frozenset("be code do does have if make must no other s see shall so such those used we which within works your".split())

#: Notices of several lines, whose paragraphs are templates too.
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_WARRANTY = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {0}. If not, see https://www.gnu.org/licenses/."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_GNU_NAMES = (
    ("AGPL-3.0", "program", "Affero General Public License", "3"),
    ("GPL-2.0", "program", "General Public License", "2"),
    ("GPL-3.0", "program", "General Public License", "3"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3"),
)
NOTICES = (
    *((k, _GNU.format(*names)) for k, *names in _GNU_NAMES),
    *((k, f"{_GNU.format(*names)} {_WARRANTY.format(*names)}") for k, *names in _GNU_NAMES),
    ("Apache-2.0", _APACHE),
    (
        "Apache-2.0",
        f"{_APACHE} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: SPDX identifiers as tags name them, by the licence they mean.
TAGS = {k: [k] for k in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "ISC", "MIT", "MPL-2.0", "Unlicense")} | {
    k: [k, f"{k}-only", f"{k}-or-later"] for k, *_ in _GNU_NAMES
}
#: Marks with which a line of a comment begins.
MARKS = r"(?:/\*+!?|\*+/|\*+|//+!?|#+!?|--+|;+|%+|<!--+|-->|dnl\b)"

THRESHOLD = 0.78
#: Where headers are sought: lines at either end, and the lines there that are cut into paragraphs.
HEAD_LINES, FOOT_LINES, BLOCK_LINES = 20, 3, 40
TERMS = "[a-z0-9]+(?:-[a-z0-9]+)*"
#: The same terms, possessively: the JVM then loops where it would recurse once a hyphen.
JVM_TERMS = "[a-z0-9]++(?:-[a-z0-9]++)*+"


def terms_of(text: str) -> list[str]:
    return [t for t in re.findall(TERMS, text.lower()) if t not in STOP]


@lru_cache(1)
def block_templates() -> tuple[tuple[str, str], ...]:
    """Long templates, of blocks and whole texts: the notices and the full texts.

    The AGPL is the GPL 3 under its own name but for a section, so its template is made that way.
    """
    texts = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    texts["AGPL-3.0"] = re.sub(r"(?i)gnu\s+general\s+public", "GNU Affero General Public", texts["GPL-3.0"])
    return (*NOTICES, *sorted(texts.items()))


def template_weights(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """Unit weights ``(template, licence, term, weight)``, the idf of each term, and that of all others."""
    counts = [Counter(terms_of(text)) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for k, ((licence, _), c) in enumerate(zip(templates, counts, strict=True)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(k, licence, t, n * idf[t] / norm) for t, n in sorted(c.items())]
    return rows, idf, math.log(1 + len(counts)) + 1


def anchors(threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES, frequent: frozenset[str] = FREQUENT) -> list[str]:
    """Terms of which a line needs one at least to reach the threshold with any template."""
    by_template: dict[int, list[tuple[float, str]]] = {}
    for k, _, term, w in template_weights(templates)[0]:
        by_template.setdefault(k, []).append((w, term))
    out: set[str] = set()
    for own in by_template.values():
        square = 0.0
        for w, term in sorted(own, key=lambda x: (x[1] not in frequent, x[0])):
            square += w * w
            if math.sqrt(square) >= threshold - 1e-9:
                out.add(term)
                square -= w * w  # an anchor stands outside the rest, which must stay below
    return sorted(out)


def _rows(spark, values: list[tuple], names: str) -> DataFrame:
    """A constant table as SQL VALUES, so that no Python runs on executors."""
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) + ("D" if isinstance(v, float) else "") for v in row) + ")" for row in values)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({names})")


def _best(units: DataFrame, keys: list[str], threshold: float, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """For units ``(keys..., part)`` the best template at the threshold: ``(keys..., licence, score)``."""
    spark = units.sparkSession
    weights, idf, other = template_weights(templates)
    table = F.broadcast(_rows(spark, weights, "template, licence, term, w"))
    known = F.broadcast(_rows(spark, sorted(idf.items()), "term, idf"))
    terms = units.select(*keys, F.explode(F.regexp_extract_all(F.lower("part"), F.lit(f"({JVM_TERMS})"), F.lit(1))).alias("term")).where(~F.col("term").isin(*STOP))
    counted = terms.groupBy(*keys, "term").agg(F.count("*").alias("n")).join(known, "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(other)))
    norms = counted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counted.join(table, "term").groupBy(*keys, "template", "licence").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norms, keys).select(*keys, "template", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    return scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("template")).alias("minus"), "licence")).alias("m")).select(*keys, F.col("m.licence").alias("licence"), F.col("m.score").alias("score"))


def _blocks(texts: DataFrame) -> DataFrame:
    """``(unit, place, part)``: whole texts without marks and copyright lines (place -2), their paragraphs, and head comments (place from 2^30)."""
    bare = F.regexp_replace("text", rf"(?id)(?m)^[ \t]*{MARKS}?[ \t]*", "")
    bare = F.regexp_replace(bare, r"(?id)(?m)^(?:copyright\b[^\n]{0,20}?(?:\(c\)|©|\d{4})|\(c\)|©)[^\n]*?(?=all rights reserved|$)", "")
    lines = F.split("text", "\n")
    code = F.array_position(F.transform(lines, lambda x: x.rlike(rf"^\s*(?:{MARKS}|$)")), False).cast("int")
    run = F.when(code > 1, F.array_join(F.slice(lines, F.lit(1), code - 1), "\n"))
    closed = F.regexp_extract("text", r"^\s*(?:/\*(?s:.*?)\*/|<!--(?s:.*?)-->|\"\"\"(?s:.*?)\"\"\")", 0)
    head = F.regexp_replace(F.when(closed != "", closed).otherwise(run), rf"(?id)(?m)^[ \t]*{MARKS}?[ \t]*", "")
    head = F.regexp_replace(head, r"(?id)(?m)^(?:copyright\b[^\n]{0,20}?(?:\(c\)|©|\d{4})|\(c\)|©)[^\n]*?(?=all rights reserved|$)", "")
    rows = F.split(bare, "\n")
    blank = r"\n[ \t\r]*\n"
    first = F.split(F.array_join(F.slice(rows, 1, BLOCK_LINES), "\n"), blank)
    last = F.when(F.size(rows) > BLOCK_LINES, F.element_at(F.split(F.array_join(F.slice(rows, -BLOCK_LINES, BLOCK_LINES), "\n"), blank), -1))
    parts = F.concat(F.array(bare, head), first, F.array(last))
    found = texts.select("unit", F.posexplode(parts).alias("k", "part")).where("part IS NOT NULL")
    return found.select("unit", F.when(F.col("k") == 0, -2).otherwise(F.col("k") + 2**30).cast("int").alias("place"), "part")


def _tags(texts: DataFrame) -> DataFrame:
    """``(unit, licence)`` of texts with an SPDX tag of a known identifier; the first tag counts."""
    names = F.create_map(*(F.lit(x) for k, own in TAGS.items() for n in own for x in (n.lower(), k)))
    tag = F.lower(F.regexp_extract("text", r"(?i)spdx-license-identifier:[ \t]*\(?([a-z0-9.-]+)", 1))
    return texts.select("unit", names[tag].alias("licence")).where("licence IS NOT NULL")


def scan_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, path, licence, score, origin, licence_dir)`` for every row.

    Reads ``doc_id``, ``path`` (directories and a name, joined by '/') and ``text``; other
    columns are ignored.  ``origin`` is ``header`` (a line, block or SPDX tag of the file), ``file`` (the whole
    file is a licence text), ``inherited`` (from ``licence_dir``, '' being the root) or
    ``none``.  Of several licence files in a directory the one of highest cosine counts,
    then the one of smallest doc_id.  Null or empty texts have no header; a null path inherits
    nothing and bequeaths nothing; rows without an id are told apart by path and text.
    """
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("path", F.lit("\0")), F.coalesce("text", F.lit("")))
    rows = rows.withColumn("unit", key)
    def holds(text, terms):
        return F.lower(text).rlike(r"(?:^|[^a-z0-9])(?:" + "|".join(terms) + r")(?:[^a-z0-9]|$)")

    templates = block_templates()
    short, long = anchors(threshold), anchors(threshold, templates, FREQUENT_LONG)
    hit = rows.where(holds("text", sorted({*short, *long, "spdx-license-identifier"}))).select("unit", "text").dropDuplicates(["unit"])
    hit = materialize(hit, "notices")  # a small part of the texts, read several times below
    split = F.split("text", "\n")
    lines = hit.select("unit", F.size(split).alias("n"), F.posexplode(split).alias("place", "part"))
    lines = lines.where((F.col("place") < HEAD_LINES) | (F.col("place") >= F.col("n") - FOOT_LINES)).drop("n")
    blocks = _blocks(hit)
    keys = ["unit", "place"]
    parts = lines.unionByName(hit.select("unit", F.lit(-1).alias("place"), F.col("text").alias("part"))).unionByName(blocks)
    sentences = _best(parts.where(holds("part", short)), keys, threshold).withColumn("long", F.lit(0))
    notices = _best(blocks.where(holds("part", long)), keys, threshold, templates).withColumn("long", F.lit(1))
    tags = _tags(hit).select("unit", F.lit(0).alias("place"), "licence", F.lit(1.0).alias("score"), F.lit(2).alias("long"))
    # A notice or a full text says more than one of its sentences, whatever the cosines.
    order = F.struct("long", "score", (-F.col("place")).alias("minus"), "licence")
    best = sentences.unionByName(notices).unionByName(tags).groupBy("unit").agg(F.max(F.when(F.col("place") >= 0, order)).alias("h"), F.max(F.when(F.col("place") < 0, order)).alias("w"))
    found = best.select("unit", F.col("h.licence").alias("head_licence"), F.col("h.score").alias("head_score"), F.col("w.licence").alias("file_licence"), F.col("w.score").alias("file_score"))

    named = rows.select("unit", "doc_id", "path", F.when(F.col("path").isNotNull(), F.regexp_replace("path", r"/?[^/]*$", "")).alias("dir"))
    own = named.join(found, "unit", "left")
    givers = own.where("file_licence IS NOT NULL AND dir IS NOT NULL")
    given = givers.groupBy("dir").agg(F.max(F.struct(F.col("file_score"), (-F.coalesce("doc_id", F.lit(2**62))).alias("minus"), F.col("file_licence").alias("licence"))).alias("g"))
    given = given.select(F.col("dir").alias("licence_dir"), F.col("g.licence").alias("dir_licence"), F.col("g.file_score").alias("dir_score"))

    dirs = named.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = dirs.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), prefixes))).alias("licence_dir"))
    nearest = above.join(given, "licence_dir").groupBy("dir").agg(F.max(F.struct(F.length("licence_dir").alias("depth"), "licence_dir", "dir_licence", "dir_score")).alias("n"))
    nearest = nearest.select("dir", F.col("n.licence_dir").alias("licence_dir"), F.col("n.dir_licence").alias("dir_licence"), F.col("n.dir_score").alias("dir_score"))

    out = own.join(nearest, "dir", "left")
    origin = F.when(F.col("file_licence").isNotNull(), "file").when(F.col("head_licence").isNotNull(), "header").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("file_licence", "head_licence", "dir_licence").alias("licence"),
        F.coalesce("file_score", "head_score", "dir_score").alias("score"),
        origin.alias("origin"),
        F.when(origin == "inherited", F.col("licence_dir")).alias("licence_dir"),
    )


#: Paths for the table of documents, which has none: sources and languages are directories, some files lie higher up.
PATH_SQL = """concat(coalesce(source, 'none'), CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 5 = 0 THEN concat('/', coalesce(lang, 'none'))
 ELSE concat('/', coalesce(lang, 'none'), '/', cast(cast(floor(doc_id / 100) AS bigint) AS {text})) END, '/', cast(doc_id AS {text}), '.txt')"""


def oracle(threshold: float = THRESHOLD) -> str:
    """The scan of the documents as DuckDB SQL."""
    weights, idf, other = template_weights()
    values = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in row) + ")" for row in rows)
    anchor = "(?:^|[^a-z0-9])(?:" + "|".join(anchors(threshold)) + ")(?:[^a-z0-9]|$)"
    return f"""
WITH weights(template, licence, term, w) AS (SELECT template, licence, term, w::double FROM (VALUES {values(weights)}) v(template, licence, term, w)),
idf(term, idf) AS (SELECT term, idf::double FROM (VALUES {values(sorted(idf.items()))}) v(term, idf)),
rows AS (SELECT doc_id, text, {PATH_SQL.format(text='varchar')} AS path FROM documents),
named AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM rows),
hit AS (SELECT doc_id, text FROM rows WHERE regexp_matches(lower(text), '{anchor}')),
lines AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS part FROM hit),
units AS (SELECT doc_id, line, part FROM lines WHERE (line < {HEAD_LINES} OR line >= n - {FOOT_LINES}) AND regexp_matches(lower(part), '{anchor}')
          UNION ALL SELECT doc_id, -1, text FROM hit),
terms AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(part), '{TERMS}')) AS term FROM units),
counted AS (SELECT doc_id, line, t.term, count(*) * coalesce(any_value(idf), {other!r}::double) AS x FROM terms t LEFT JOIN idf i ON t.term = i.term WHERE t.term NOT IN ({", ".join(repr(t) for t in STOP)}) GROUP BY ALL),
norms AS (SELECT doc_id, line, sqrt(sum(x * x)) AS norm FROM counted GROUP BY ALL),
dots AS (SELECT doc_id, line, template, licence, sum(x * w) AS dot FROM counted JOIN weights USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, line, template, licence, round(dot / norm, 6) AS score FROM dots JOIN norms USING (doc_id, line) WHERE round(dot / norm, 6) >= {threshold}),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, template) = 1),
headers AS (SELECT doc_id, licence AS head_licence, score AS head_score FROM best WHERE line >= 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line) = 1),
whole AS (SELECT doc_id, licence AS file_licence, score AS file_score FROM best WHERE line < 0),
own AS (SELECT * FROM named LEFT JOIN headers USING (doc_id) LEFT JOIN whole USING (doc_id)),
given AS (SELECT dir AS licence_dir, file_licence AS dir_licence, file_score AS dir_score FROM own WHERE file_licence IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY dir ORDER BY file_score DESC, doc_id) = 1),
nearest AS (SELECT d.dir, g.* FROM (SELECT DISTINCT dir FROM own) d JOIN given g ON g.licence_dir = '' OR d.dir = g.licence_dir OR starts_with(d.dir, concat(g.licence_dir, '/'))
            QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(g.licence_dir) DESC) = 1)
SELECT doc_id, path, coalesce(file_licence, head_licence, dir_licence) AS licence, coalesce(file_score, head_score, dir_score) AS score,
       CASE WHEN file_licence IS NOT NULL THEN 'file' WHEN head_licence IS NOT NULL THEN 'header' WHEN dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN file_licence IS NULL AND head_licence IS NULL AND dir_licence IS NOT NULL THEN licence_dir END AS licence_dir
FROM own LEFT JOIN nearest USING (dir)
"""
