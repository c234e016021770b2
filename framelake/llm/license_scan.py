r"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (case, punctuation, copyright lines,
equivalent spellings), and the digest of the whole is hash-joined to those of
known licence texts. The same is done with each whole line and each whole
paragraph: a licence of several paragraphs is stated by a document that holds
all of them, in whatever order and between whatever else, such as the header of
a source file.
"""

from __future__ import annotations

from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, settle

#: Spellings that licence texts use for each other; the left one becomes the right one.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"),
    ("copyright holder", "copyright owner"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("authoris", "authoriz"), ("organis", "organiz"),
    ("recognis", "recogniz"), ("utilis", "utiliz"), ("initialis", "initializ"), ("merchantib", "merchantab"), ("favour", "favor"), ("honour", "honor"), ("wilful", "willful"),
    ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"), ("•", "*"), ("\u00a0", " "), ("\ufeff", ""), ("whilst", "while"), ("per cent", "percent"), ("https://", "http://"), ("&", " and "), ("(c)", "copyright"), ("©", "copyright"),
]

#: A line that only states a copyright: the word or sign, then a year or another sign; or the usual reservation.
_COPYRIGHT = r"(^|\n)[ \t/*#;-]*(copyright[ \t]*(copyright|[0-9]{4}|by )|all rights reserved)[^\n]*"
#: Between paragraphs of a canonical text: lines without words.
_BLANK = r"\n(?: ?\n)+"
_SIGNS = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"

#: Public licence texts and notices, word for word.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Names under which notices cite a licence.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0", "GPL-3.0-only"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL-2.0", "GPL-2.0-only"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPL-2.1", "LGPL-2.1-only"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPL-3.0", "LGPL-3.0-only"],
    "GFDL-1.3": ["GNU Free Documentation License, version 1.3", "GNU Free Documentation License v1.3", "GFDL-1.3"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL-1.1"],
    "Artistic-1.0": ["Artistic License 1.0", "Artistic-1.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "zlib/libpng License", "Zlib"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
}
#: Names of licences whose whole texts aren't known here.
CITED = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPL-3.0", "AGPL-3.0-only"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0"],
}
_FORMS = ["See the {} in LICENSE", "See the {} in the LICENSE file", "{} - see the LICENSE file for details", "This project is licensed under the {} - see the LICENSE file for details", "Licensed under the terms of the {}", "Distributed under the terms of the {}", "Available under the {}", "License: {}", "{}", "Released under the {}", "Released under {}", "Licensed under the {}", "Licensed under {}", "Distributed under the {}", "This work is licensed under the {}", "This work is licensed under {}", "This project is licensed under the {}", "This software is released under the {}", "SPDX-License-Identifier: {}"]


#: The third condition of BSD-3-Clause.
#: Fixed value: a clause of public licences, word for word.
_NO_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_END = "END OF TERMS AND CONDITIONS"


@cache
def _bodies() -> list[tuple[str, str]]:
    """Whole licence texts of the folder `licenses`, in the forms they go round in: with and without what follows the terms, with and without title or numbers."""
    text = {f.stem: f.read_text("utf-8") for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    out = list(text.items())
    for i in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1"):
        terms = text[i].split(_END)[0]
        out += [(i, terms), (i, terms + _END)]
    # a filled-in copyright line leaves the canonical text, the template's own doesn't
    out.append(("Apache-2.0", text["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "")))
    two = text["BSD-2-Clause"]
    three = two.replace("THIS SOFTWARE IS", f"3. {_NO_NAMES}\n\nTHIS SOFTWARE IS", 1)
    for i, t, titles in (("BSD-2-Clause", two, ["BSD 2-Clause License", "The 2-Clause BSD License"]), ("BSD-3-Clause", three, ["BSD 3-Clause License", "The 3-Clause BSD License"])):
        plain = reduce(lambda x, n: x.replace(f"\n{n}. ", "\n* "), "123", t)
        out += [(i, h + x) for x in (t, plain) for h in ("", *(f"{h}\n\n" for h in titles))]
    return out


def _known() -> list[tuple[str, str]]:
    texts = [("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("Apache-2.0", _APACHE), *_bodies()]
    return texts + [(i, f.format(n)) for i, names in (NAMES | CITED).items() for n in names for f in _FORMS]


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text): whole licence texts, and the notices that cite a licence by name."""
    return spark.createDataFrame(_known(), "license_id string, text string")


def canonical_lines(text: Column) -> Column:
    """The text in canonical form, line by line: lower case, no copyright lines, one spelling, words parted by single spaces."""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SPELLINGS, x)
    x = F.regexp_replace(x, _COPYRIGHT, "\n")
    return F.regexp_replace(x, _SIGNS, " ")


def with_digests(df: DataFrame) -> DataFrame:
    """`df` (with `text`) with `digest` of the whole canonical text and `parts`, the distinct ones of its lines and paragraphs, in place of `text`; null for what has no words. `paragraphs` are those of the paragraphs alone, sorted."""
    md5 = lambda c: F.md5(F.nullif(F.trim(F.regexp_replace(c, r"[ \n]+", " ")), F.lit("")))
    known = lambda c: F.array_distinct(F.filter(c, lambda d: d.isNotNull()))
    # a step of its own, so that the canonical text is worked out once
    made = df.withColumn("_lines", canonical_lines(F.col("text"))).drop("text")
    made = made.withColumns({"digest": md5(F.col("_lines")), "_by_line": F.transform(F.split("_lines", "\n"), md5), "paragraphs": F.sort_array(known(F.transform(F.split("_lines", _BLANK), md5)))})
    return made.withColumn("parts", known(F.concat("_by_line", "paragraphs"))).drop("_lines", "_by_line")


def _whole(licenses: DataFrame) -> DataFrame:
    """(digest, license_id): the smallest id of each whole text."""
    return licenses.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _pieces(licenses: DataFrame) -> DataFrame:
    """What a document may hold of the known texts: (d, t, n, license_id, over). The text `t` is stated where all its `n` digests `d` are; it is one digest, its whole, or those of its paragraphs. `over`: texts that hold all paragraphs of this one and more."""
    whole = _whole(licenses)
    texts = licenses.filter("digest IS NOT NULL").select("digest", "paragraphs").distinct().join(whole, "digest").withColumn("n", F.size("paragraphs"))
    texts = texts.withColumn("t", F.md5(F.array_join("paragraphs", "")))
    texts = texts.groupBy("t").agg(F.min("license_id").alias("license_id"), F.first("n").alias("n"), F.first("paragraphs").alias("paragraphs"))
    split = texts.filter("n > 1").select("t", "n", "license_id", F.explode("paragraphs").alias("d"))
    a, b = split.select("t", "n", "d"), split.select(F.col("t").alias("u"), F.col("n").alias("m"), "d")
    held = a.join(b, "d").filter("m > n").groupBy("t", "n", "u").count().filter("count = n").groupBy("t").agg(F.collect_set("u").alias("over"))
    none = F.array().cast("array<string>")
    split = split.join(held, "t", "left").select("d", "t", "n", "license_id", F.coalesce("over", none).alias("over"))
    return split.unionByName(whole.select(F.col("digest").alias("d"), F.col("digest").alias("t"), F.lit(1).alias("n"), "license_id", none.alias("over")))


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `digest` of its canonical text, `license_id` of the whole text (null: none known), `notices` (sorted ids of the licences that its whole lines or paragraphs state; one whose paragraphs are all part of another stated text doesn't count).

    Null, empty and wordless texts have a null digest and no licence. Repeated
    rows give equal rows. A digest that stands for several ids in `licenses`
    gives the smallest. Digests of the texts are written once, in the shared
    folder, as is what equal texts state, so that a text of many rows can be
    split where both meet; a list of licences that fits in BROADCAST_BYTES is
    broadcast, a longer one hash-joined.
    """
    licenses = licenses if licenses is not None else known_licenses(docs.sparkSession)
    known = settle(with_digests(licenses.select("license_id", "text")), "licenses")
    whole, pieces = _whole(known), settle(_pieces(known), "license-pieces")
    if (pieces.agg(F.sum(300 + 40 * F.size("over"))).first()[0] or 0) <= BROADCAST_BYTES:
        whole, pieces = F.broadcast(whole), F.broadcast(pieces)
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    base = settle(with_digests(base.withColumn("text_key", F.md5(F.coalesce("text", F.lit(""))))).drop("paragraphs"), "digests")
    # only parts that belong to a licence come back
    held = base.select("text_key", F.explode("parts").alias("d")).join(pieces, "d").groupBy("text_key", "t").agg(F.collect_set("d").alias("ds"), F.first("n").alias("n"), F.first("license_id").alias("license_id"), F.first("over").alias("over"))
    texts = held.filter("size(ds) = n").groupBy("text_key").agg(F.collect_list(F.struct("t", "license_id", "over")).alias("ts"))
    stated = F.filter("ts", lambda x: ~F.arrays_overlap(x["over"], F.col("ts")["t"]))
    stated = settle(texts.select("text_key", F.sort_array(F.array_distinct(F.transform(stated, lambda x: x["license_id"]))).alias("notices")), "stated")
    out = base.drop("parts").join(whole, "digest", "left").join(stated, "text_key", "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def op2_license_digest(spark, sf_dir: str) -> DataFrame:
    """All documents: digest of the canonical text, licence of the whole text, and those that its lines and paragraphs state. A text without words has a null digest."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_lines(column: str) -> str:
    x = f"lower(coalesce({column}, ''))"
    for a, b in SPELLINGS:
        x = f"replace({x}, {_sql_text(a)}, {_sql_text(b)})"
    return f"regexp_replace(regexp_replace({x}, '{_COPYRIGHT}', chr(10), 'g'), '{_SIGNS}', ' ', 'g')"


def oracle() -> str:
    """DuckDB SQL for `op2_license_digest`; the known texts stand in it as values."""
    md5 = lambda x: rf"md5(nullif(trim(regexp_replace({x}, '[ \n]+', ' ', 'g')), ''))"
    parts = lambda split: f"list_distinct(list_filter(list_transform({split}, lambda x: {md5('x')}), lambda x: x IS NOT NULL))"
    paragraphs = parts(f"string_split_regex(l, '{_BLANK}')")
    return rf"""
WITH raw AS (SELECT license_id, {md5("l")} AS d, list_sort({paragraphs}) AS ps FROM (SELECT license_id, {_sql_lines("text")} AS l FROM (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in _known())}) v(license_id, text))),
whole AS (SELECT d, min(license_id) AS license_id FROM raw WHERE d IS NOT NULL GROUP BY d),
texts AS (SELECT ps, min(whole.license_id) AS license_id FROM raw JOIN whole USING (d) GROUP BY ps),
known AS (SELECT [d] AS ps, license_id FROM whole UNION SELECT ps, license_id FROM texts WHERE len(ps) > 1),
pieces AS (SELECT ps, license_id, unnest(ps) AS d FROM known),
docs AS (SELECT doc_id, {_sql_lines("text")} AS l FROM documents),
holds AS (SELECT DISTINCT doc_id, unnest(list_concat({parts("string_split(l, chr(10))")}, {paragraphs})) AS d FROM docs),
complete AS (SELECT doc_id, ps, license_id FROM holds JOIN pieces USING (d) GROUP BY ALL HAVING count(*) = len(ps)),
stated AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM complete c
  WHERE NOT EXISTS (SELECT 1 FROM complete o WHERE o.doc_id = c.doc_id AND len(c.ps) > 1 AND len(o.ps) > len(c.ps) AND list_has_all(o.ps, c.ps)) GROUP BY doc_id)
SELECT doc_id, {md5("l")} AS digest, whole.license_id, coalesce(stated.notices, '') AS notices
FROM docs LEFT JOIN whole ON whole.d = {md5("l")} LEFT JOIN stated USING (doc_id)
"""
