"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory, in DataFrame operations only.

A file named as a licence file is compared whole with full licence texts by the
cosine of TF-IDF terms, whatever words it has.  Otherwise a header is a line (or
sentence) of a file that holds a licence cue; every one of a file's lines is looked
at and compared with each one-line template; the best template at ``LEAST`` or more is
the file's own licence.  Where no line reaches that, each block of lines (apart from
the next by a line without letters or digits) and each line that holds a word of
``BLOCK_CUE`` is compared with standard headers, SPDX tags and full texts, as is the
whole text, since headers and licences run over several blocks.  A file is a licence
file if its name says so or if its licence headers hold ``SHARE`` of its words or more.  A file without an own licence takes
that of the nearest ancestor directory that has a licence file (of several, the
best match, then the smallest name, then the smallest file id).

Defined cases: a null path is in no directory; null and empty texts have no
headers; repeated rows each get a row; the similarity is rounded to 6 places;
texts may be of any length; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import json
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

#: Statements by which files name their licence, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license, the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0, the Creative Commons Attribution NonCommercial license"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
LEAST, SHARE = 0.6, 0.2
CUE = r"(?i)licen[cs]e|permission is hereby|public domain|spdx"
_LINES = r"\r?\n|(?<=[.!?;])\s+"
_TERM = re.compile("[a-z0-9]+")


_NAMED = r"(?i)^(licen[cs]e|copying|unlicense)(\.|-|$)"
#: Any licence header, tag or text has one of these words.
BLOCK_CUE = r"(?i)licen[cs]e|permission|permitted|redistribut|warrant|public domain|spdx"
_BLOCKS = r"\r?\n[^A-Za-z0-9\n]*\r?\n"

#: Full licence texts by SPDX identifier.
FULL_TEXTS = tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def _gnu(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version."
    )


_GNU_REST = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GNU = (
    ("AGPL-3.0-or-later", "Affero General Public License", "3"), ("GPL-2.0-or-later", "General Public License", "2"), ("GPL-3.0-or-later", "General Public License", "3"),
    ("LGPL-2.1-or-later", "Lesser General Public License", "2.1"), ("LGPL-3.0-or-later", "Lesser General Public License", "3"),
)
_SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GFDL-1.3-only", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0",
    "Unlicense", "Zlib",
)
#: Standard headers of several lines, and SPDX tags.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
     "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, _gnu(kind, version)) for name, kind, version in _GNU),
    *((name, _gnu(kind, version) + _GNU_REST.format(kind=kind)) for name, kind, version in _GNU),
    *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX),
)


def _weights(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """Inverse document frequencies over the templates, and each template's unit vector."""
    bags = [(name, _TERM.findall(text.lower())) for name, text in templates]
    df: dict[str, int] = {}
    for _, bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
    vectors = []
    for name, bag in bags:
        v = {t: (1 + math.log(bag.count(t))) * idf[t] for t in sorted(set(bag))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((name, {t: x / norm for t, x in v.items()}))
    return idf, vectors


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for item in sorted(values.items()) for x in item])


def headers(text: Column) -> Column:
    """Structs (similarity, license, words) of all headers that reach LEAST; null where the text has no cue."""
    idf, vectors = _weights()
    unknown = math.log(1 + len(TEMPLATES)) + 1
    idf_map, template_maps = _map(idf), [(name, _map(v)) for name, v in vectors]

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def of_line(line: Column) -> Column:
        terms = F.regexp_extract_all(F.lower(line), F.lit("[a-z0-9]+"), 0)
        known = F.filter(terms, lambda t: F.element_at(idf_map, t).isNotNull())
        weighed = F.transform(
            F.array_distinct(known),
            lambda t: F.struct(t.alias("t"), ((1 + F.log(F.size(F.filter(known, lambda u: u == t)))) * F.element_at(idf_map, t)).alias("w")),
        )
        others = F.size(F.array_distinct(terms)) - F.size(F.array_distinct(known))
        norm = F.sqrt(total(F.transform(weighed, lambda x: x["w"] * x["w"])) + others * F.lit(unknown * unknown))

        def against(name: str, template: Column) -> Column:
            dot = total(F.transform(weighed, lambda x: x["w"] * F.coalesce(F.element_at(template, x["t"]), F.lit(0.0))))
            return F.struct(F.round(F.try_divide(dot, norm), 6).alias("similarity"), F.lit(name).alias("license"))

        best = F.array_max(F.array(*[against(name, m) for name, m in template_maps]))
        return F.struct(best["similarity"].alias("similarity"), best["license"].alias("license"), F.size(terms).alias("words"))

    cued = F.filter(F.split(text, _LINES), lambda x: x.rlike(CUE))
    return F.when(text.rlike(CUE), F.filter(F.transform(cued, of_line), lambda x: x["similarity"] >= LEAST))


def _nearest(pieces: Column, templates: tuple[tuple[str, str], ...]) -> Column:
    """Struct (similarity, license, words) of the piece of text nearest to a template, if that reaches LEAST."""
    idf, vectors = _weights(templates)
    unknown, k = math.log(1 + len(templates)) + 1, len(vectors)
    # one look at each term gives its own weight and, after that, its weight in each template
    table = F.from_json(F.lit(json.dumps({t: [x, *(v.get(t, 0.0) for _, v in vectors)] for t, x in idf.items()})), "map<string,array<double>>")
    names = F.array(*[F.lit(name) for name, _ in vectors])

    def of_piece(piece: Column) -> Column:
        terms = F.regexp_extract_all(F.lower(piece), F.lit("[a-z0-9]+"), 0)
        return F.transform(F.array(terms), of_terms)[0]

    def of_terms(terms: Column) -> Column:
        weighed = F.transform(F.array_distinct(terms), lambda t: F.struct(F.element_at(table, t).alias("row"), (1 + F.log(F.size(terms) - F.size(F.array_remove(terms, t)))).alias("w")))
        start = F.struct(F.lit(0.0).alias("squares"), F.array_repeat(F.lit(0.0), k + 1).alias("dots"))

        def add(acc: Column, x: Column) -> Column:
            w = x["w"] * F.coalesce(x["row"][0], F.lit(unknown))
            dots = F.when(x["row"].isNull(), acc["dots"]).otherwise(F.zip_with(acc["dots"], x["row"], lambda d, y: d + w * y))
            return F.struct((acc["squares"] + w * w).alias("squares"), dots.alias("dots"))

        def best(acc: Column) -> Column:
            cosines = F.transform(F.slice(acc["dots"], 2, k), lambda d: F.round(F.try_divide(d, F.sqrt(acc["squares"])), 6))
            top = F.array_max(F.arrays_zip(cosines.alias("similarity"), names.alias("license")))
            return F.struct(top["similarity"].alias("similarity"), top["license"].alias("license"), F.size(terms).alias("words"))

        return F.aggregate(weighed, start, add, best)

    return F.array_max(F.filter(F.transform(pieces, of_piece), lambda x: x["similarity"] >= LEAST))


def scan(files: DataFrame) -> DataFrame:
    """file_id, path, license, similarity, origin (header, file, inherited or none) and inherited_from of every file."""
    base = pick(files, "file_id", "path", "text")
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    n_words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))
    named = F.coalesce(name.rlike(_NAMED), F.lit(False)).alias("named")
    text = F.col("text")
    own = base.select("file_id", "path", directory.alias("dir"), named, headers(text).alias("found"), "text")
    whole = F.when(F.col("named"), _nearest(F.array(text), FULL_TEXTS))
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(BLOCK_CUE))
    blocks = F.filter(F.split(text, _BLOCKS), lambda x: x.rlike(BLOCK_CUE))
    several = F.array_distinct(F.concat(lines, blocks, F.array(text)))
    block = F.when((F.coalesce(F.size("found"), F.lit(0)) <= 0) & text.rlike(BLOCK_CUE), _nearest(several, HEADERS + FULL_TEXTS))
    of_lines = F.when(F.size("found") > 0, F.struct(F.array_max("found")["similarity"].alias("similarity"), F.array_max("found")["license"].alias("license"), F.aggregate("found", F.lit(0), lambda a, x: a + x["words"]).alias("words")))
    own = own.select("file_id", "path", "dir", "named", F.coalesce(whole, of_lines, block).alias("own"), n_words.alias("n_words"))
    own = materialize(own, "license-own")  # each column below reads it; inlined, every one would compare the texts again
    own = own.select(
        "file_id", "path", "dir", F.col("own.license").alias("license"), F.col("own.similarity").alias("similarity"),
        F.when(F.col("own").isNotNull(), F.col("named") | (F.col("own.words") >= F.lit(SHARE) * F.col("n_words"))).otherwise(False).alias("is_file"),
    )
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("license"), F.col("file_id")))
    granted = own.where("is_file and path is not null").groupBy(F.col("dir").alias("from_dir")).agg(best.alias("b")).select("from_dir", F.col("b.license").alias("dir_license"))
    # only directories, never files, are paired with their ancestors
    dirs = own.where("license is null and path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.concat_ws("/", F.slice(parts, 1, k)).alias("from_dir")))).alias("up")
    nearest = (
        dirs.select("dir", above).select("dir", F.col("up.depth").alias("depth"), F.col("up.from_dir").alias("from_dir"))
        .join(granted, "from_dir").groupBy("dir").agg(F.max_by(F.struct("dir_license", "from_dir"), "depth").alias("g"))
    )
    nearest = materialize(nearest, "license-nearest")  # so that the join reads plain shuffles, of which Spark can split a large directory
    takes = F.col("license").isNull() & F.col("path").isNotNull() & F.col("g").isNotNull()
    return own.join(nearest, "dir", "left").select(
        "file_id", "path",
        F.when(takes, F.col("g.dir_license")).otherwise(F.col("license")).alias("license"),
        "similarity",
        F.when(takes, "inherited").when(F.col("license").isNull(), "none").when(F.col("is_file"), "file").otherwise("header").alias("origin"),
        F.when(takes, F.col("g.from_dir")).alias("inherited_from"),
    )
