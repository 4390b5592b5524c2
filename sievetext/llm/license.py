"""License scans: TF-IDF cosine of lines to licence templates, then inheritance along directories.

Units of one kind are compared with templates of that kind, as sparse TF-IDF vectors: every line
with notices, the header of a file (its leading comment lines, or else its first paragraph) with
standard headers and short licences, the whole text of a licence file with whole licences.  A term's
weight comes from how many of all documents hold it.  A file's licence is that of its best unit; a
file without one takes that of the licence file in its nearest directory above, found by joins on the
paths of directories.  All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

import math
import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

# Notices by which files commonly state the licence they are under.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "MIT": ("Released under the MIT License.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}

# What the licences ask to be put at the head of a file.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
        should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
#: Licences whose whole text stands in ``licences``; those that are short are put at the head of files, too.
WHOLE, SHORT = ("Apache-2.0", "BSD-3-Clause", "GPL-3.0", "MIT", "MPL-2.0"), ("BSD-3-Clause", "MIT")
#: What begins a line of a comment.
COMMENT = r"(?://|/?\*|#|--|;|%|<!--|\(\*|\"\"\")"
#: From the first character on that is no white space: a block comment, the comment lines, or the lines up to a blank one.
HEADER = rf"^(?:/\*(?s:.*?)\*/|(?:[^\S\n]*{COMMENT}[^\n]*(?:\n|\z))++|(?:[^\S\n]*\S[^\n]*(?:\n|\z))++)"

THRESHOLD = 0.8
#: A term: letters, digits and dots between digits; case does not count.
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"


def template_terms() -> list[tuple[str, int, str, int]]:
    """(licence, template, term, how often) of the templates."""
    return _term_rows(TEMPLATES)


def header_terms() -> list[tuple[str, int, str, int]]:
    """The same of standard headers and short licences."""
    return _term_rows({name: (text,) for name, text in HEADERS.items()} | {name: (_whole(name),) for name in SHORT})


def whole_terms() -> list[tuple[str, int, str, int]]:
    """The same of whole licences."""
    return _term_rows({name: (_whole(name),) for name in WHOLE})


def _whole(licence: str) -> str:
    return files("sievetext.llm").joinpath("licences", f"{licence}.txt").read_text("utf-8")


def _term_rows(templates: dict[str, tuple[str, ...]]) -> list[tuple[str, int, str, int]]:
    rows = []
    for licence, texts in templates.items():
        for i, text in enumerate(texts):
            terms = re.findall(TERM, text.lower())
            rows += [(licence, i, term, terms.count(term)) for term in sorted(set(terms))]
    return rows


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({TERM})"), F.lit(1))


def _idf(n, rows: int):
    """Of a term that n of ``rows`` texts hold, as number or column."""
    return F.log((1 + rows) / (1 + n)) + 1 if isinstance(n, Column) else math.log((1 + rows) / (1 + n)) + 1


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): how many of the texts hold each term."""
    return docs.select(F.explode(F.array_distinct(_terms(text_of()))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def header(text: Column) -> Column:
    """A file's leading comment lines, or its first paragraph if it begins otherwise; '' if it is blank.

    One expression from the start of the text on, which does not go back over a line it has taken.
    """
    return F.regexp_extract(F.regexp_replace(text, r"^\s+", ""), HEADER, 0)


def matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, line_no, licence, cosine) of units that reach ``threshold`` with a template of their kind.

    ``docs`` has key, text and named (whether the file's name says that it is a licence).  Headers and whole
    texts count as line 0.  A unit is first held against what its cosine could be at most if it had no
    term but the templates', which loses none; what remains is scored exactly.
    """
    frequencies, rows = stored(document_frequencies(docs), "document-frequencies"), docs.count()
    lines = docs.select("key", F.posexplode(F.split(text_of(), "\n")).alias("line_no", "line"))
    heads = docs.select("key", F.lit(0).alias("line_no"), header(text_of()).alias("line"))
    wholes = docs.where("named").select("key", F.lit(0).alias("line_no"), text_of().alias("line"))
    found = unit_matches(lines, template_terms(), frequencies, rows, threshold)
    found = found.union(unit_matches(heads, header_terms(), frequencies, rows, threshold))
    return found.union(unit_matches(wholes, whole_terms(), frequencies, rows, threshold))


def unit_matches(units: DataFrame, templates: list[tuple[str, int, str, int]], frequencies: DataFrame, rows: int, threshold: float) -> DataFrame:
    """(key, line_no, licence, cosine) of the units (key, line_no, line) that reach ``threshold`` with one of the templates."""
    spark = units.sparkSession
    names = spark.createDataFrame([(t,) for t in sorted({term for _, _, term, _ in templates})], "term string")
    counts = {r["term"]: r["df"] for r in frequencies.join(F.broadcast(names), "term").collect()}  # the templates' terms
    vectors: dict[tuple[str, int], dict[str, float]] = {}
    for licence, i, term, n in templates:
        vectors.setdefault((licence, i), {})[term] = n * _idf(counts.get(term, 0), rows)
    telling = "|".join(re.escape(t) for t in sorted(needed(vectors, threshold)))
    units = units.where(F.lower("line").rlike(f"(?<![a-z])(?:{telling})(?![a-z])"))
    terms = units.select("key", "line_no", F.explode(_terms(F.col("line"))).alias("term"))
    tf = stored(terms.groupBy("key", "line_no", "term").agg(F.count("*").cast("double").alias("tf")), "line-terms")
    weighed = tf.join(frequencies, "term").withColumn("x", F.col("tf") * _idf(F.col("df"), rows))
    weighed = stored(weighed.select("key", "line_no", "term", "x"), "line-weights")
    norms = weighed.groupBy("key", "line_no").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    shares = []
    for (licence, i), vector in vectors.items():
        length = sum(w * w for w in vector.values()) ** 0.5
        shares += [(licence, i, term, w / length) for term, w in vector.items()]
    shares = spark.createDataFrame(shares, "licence string, i int, term string, w double")
    dots = weighed.join(F.broadcast(shares), "term").groupBy("key", "line_no", "licence", "i")  # the templates' terms
    dots = dots.agg(F.sum(F.col("x") * F.col("w")).alias("dot")).join(norms, ["key", "line_no"])
    found = dots.select("key", "line_no", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    return found.where(F.col("cosine") >= threshold)


def needed(vectors: dict[tuple[str, int], dict[str, float]], threshold: float) -> set[str]:
    """Terms of which a line reaching ``threshold`` has at least one.

    With the terms outside alone a line shares so little of each template's length that its
    cosine stays below: the squares of their shares add up to less than threshold squared.
    """
    found: set[str] = set()
    for vector in vectors.values():
        total = sum(w * w for w in vector.values())
        left = total
        for term, weight in sorted(vector.items(), key=lambda x: -x[1]):
            if left < threshold**2 * total * 0.999:
                break
            found.add(term)
            left -= weight * weight
    return found


def directory_of(path: Column) -> Column:
    """The path less its last part; '' at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def upwards(directory: Column) -> Column:
    """A directory and those above it, nearest first; the root is ''."""
    parts = F.array_remove(F.split(directory, "/"), "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, licence, cosine, source (own, inherited, none), licence_path of every row of ``files``.

    ``files``: doc_id, path, text; other columns are ignored.

    A file's own licence is that of its best line, header or (of a licence file) whole text, ties to the first line, then by name; one whose name says so
    (LICENSE, COPYING, NOTICE) is its directory's licence file and passes its licence on.  Of several
    in a directory the first by path counts.  Null paths have no directory and inherit nothing; null and empty
    texts have no licence of their own; repeated rows each get theirs; no rows give no rows.
    """
    keyed = files.select("doc_id", "path", F.xxhash64("path", text_of()).alias("key"), text_of().alias("text"))
    found = matches(keyed.select("key", "text", F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)).alias("named")), threshold)
    first = F.min(F.struct((-F.col("cosine")).alias("c"), "line_no", "licence")).alias("m")
    best = found.groupBy("key").agg(first).select("key", F.col("m.licence").alias("own"), (-F.col("m.c")).alias("own_cosine"))
    own = stored(keyed.select("doc_id", "path", "key").join(best, "key", "left"), "own-licences")
    holders = own.where("own is not null and path is not null").where(F.col("path").rlike(LICENCE_FILE))
    holders = holders.groupBy(directory_of(F.col("path")).alias("dir")).agg(F.min(F.struct("path", "own", "own_cosine")).alias("h"))
    # paths of directories meet those of licence files; of a file's matches the deepest counts
    leaves = own.where("own is null and path is not null").select(directory_of(F.col("path")).alias("leaf")).distinct()
    above = leaves.select("leaf", F.posexplode(upwards(F.col("leaf"))).alias("up", "dir"))
    nearest = above.join(holders, "dir").groupBy("leaf").agg(F.min(F.struct("up", "h")).alias("n"))
    nearest = nearest.select("leaf", F.col("n.h").alias("h"))
    rows = own.withColumn("leaf", F.when(F.col("own").isNull(), directory_of(F.col("path"))))
    rows = rows.join(nearest, "leaf", "left")
    source = F.when(F.col("own").isNotNull(), "own").when(F.col("h").isNotNull(), "inherited").otherwise("none")
    return rows.select(
        "doc_id", "path", F.coalesce("own", "h.own").alias("licence"), F.coalesce("own_cosine", "h.own_cosine").alias("cosine"),
        source.alias("source"), F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("h.path")).alias("licence_path"),
    )
