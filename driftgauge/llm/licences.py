"""Operator 9, licence scans by canonical digest look-up; DataFrame functions only.

A text is brought to a canonical form: lines that state a copyright are dropped (a line
of a hard-wrapped sentence that merely begins with the word is none), letters are lower-cased, hyphens vanish (also at the end of a line), other punctuation and white space separate
words, and words spelt in several ways get one spelling. Entire canonical texts are
hash-joined by digest to those of known licences. A line that is by itself a known
notice is looked up alike, as an entire text of its own.

The known texts are a table of names and texts: the one of this module, part of it files
beside it, or another one. While it has at most ``MAX_KNOWN`` texts its digests are
part of the plan and nothing is shuffled; a larger table is joined by its digests,
entire texts and lines alike. Canonical forms keep the number of words, so a digest is only
made where the word count is one of a known text's: that skips no match. No document
is joined by a key of its own, so hot groups don't matter.

Edge cases: a null, empty or wordless text, or one that only states a copyright, has no
words, no digest and no licence; of known texts with equal canonical forms (ties) the
first name by the alphabet counts; repeated rows are independent; a text of any length
is looked up whole; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, text_of

# Known licence texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("GPL-3.0-or-later", _GPL_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
]
#: Entire licence texts, a file each: NAME.txt, or NAME+b.txt for another wording of it.
TEXTS = Path(__file__).parent / "licence_texts"
_APPENDIX = re.compile(r"\n[ \t]*(?:APPENDIX: How to apply|(?:Appendix: )?How to Apply These Terms|ADDENDUM: How to use)", re.I)
_END = re.compile(r"\n[ \t]*END OF TERMS AND CONDITIONS\s*$")
_BSD_NAMES = {
    "BSD-2-Clause": [*(t.format(2) for t in ("BSD {}-Clause License", "{}-Clause BSD License", "BSD-{}-Clause", "BSD-{}-Clause License", "License: BSD-{}-Clause")), 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License"],
    "BSD-3-Clause": [*(t.format(3) for t in ("BSD {}-Clause License", "{}-Clause BSD License", "BSD-{}-Clause", "BSD-{}-Clause License", "License: BSD-{}-Clause")), 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "BSD License"],
}
#: Titles a text may be headed by; each also with "The" before it.
TITLES: dict[str, list[str]] = {
    "MIT": ["MIT License (MIT)", "MIT License", "MIT", "MIT License (Expat)", "License: MIT"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License", "MIT No Attribution (MIT-0)", "MIT-0"],
    "ISC": ["ISC License", "ISC License (ISC)", "ISC", "License: ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD"],
    "Zlib": ["zlib License", "zlib/libpng License", "zlib", "zlib License (Zlib)"],
    **_BSD_NAMES,
}


def _bodies() -> list[tuple[str, str]]:
    """Short licences in their usual wordings, without a title; list marks are numbers, letters or signs."""
    first, condition, rest = _MIT.split("\n\n")
    granted = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
    out = [("MIT", _MIT), ("MIT-0", first.replace(", subject to the following conditions:", ".") + "\n\n" + rest)]
    out += [("ISC", _ISC), ("ISC", _ISC.replace("and/or", "and")), ("0BSD", granted)]
    for marks in (r"\1.", "", r"(\1)"):
        out.append(("Zlib", re.sub(r"(?m)^(\d)\.", marks, _ZLIB)))
    for marks in ("123", "abc", ("", "", "")):
        for name, text in (("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL)):
            out.append((name, re.sub(r"(?m)^(\d)\.", lambda m, marks=marks: marks[int(m[1]) - 1], text)))
    return out


def further() -> list[tuple[str, str]]:
    """What is known besides ``KNOWN``: entire texts, also without their appendix, and short licences with titles."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        text, name = path.read_text("utf-8"), path.stem.partition("+")[0]
        bare = _APPENDIX.split(text)[0]
        out += [(name, t) for t in dict.fromkeys((text, bare, _END.sub("", bare)))]
    for name, text in _bodies():
        out.append((name, text))
        out += [(name, f"{the}{title}\n\n{text}") for title in TITLES[name] for the in ("", "The ")]
    return out


#: Equivalent spellings, as canonical words.
SPELLINGS: dict[str, str] = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "http": "https",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "merchantibility": "merchantability",
    "modelled": "modeled",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "owner": "holder",
    "owners": "holders",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
#: Words after "copyright" in sentences of licences; lines that hard wraps let begin so state no copyright.
_PROSE = r"(?:notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?|protections?|permissions?|disclaimers?|rights?|treaty|treaties|and|or|in|on|to|of|is|are|as|for|that|which|this|these|may|shall|will|the[ \t]+(?:software|library|program|work)s?)\b"
#: A line that states, after marks of a comment, a copyright: with the sign, (c), a year, a place for one, or a name.
_STATED = r"copyright(?:[ \t:]*(?:\(c\)|©|\(?[12][0-9]{3}|[\[<{])|[ \t:]+(?!" + _PROSE + r")\p{L})"
COPYRIGHT = r"[ \t>*#/;-]*(?:" + _STATED + r"|\(c\)[ \t]*(?:[12][0-9]{3}|©|[\[<{]|" + _STATED + r")|©|all rights reserved)[^\n]*"
BREAKS = r"[\s!\"#$%&'()*+,./:;<=>?@\[\\\]^_`{|}~“”‘’«»–—…•·©]+"
#: Known texts whose digests are part of the plan; more are joined.
MAX_KNOWN = 10_000


def _line_words(line: Column) -> Column:
    """Canonical words of a line, before spellings; none if it states a copyright."""
    lower = F.lower(line)
    words = F.filter(F.split(F.replace(lower, F.lit("-"), F.lit("")), BREAKS), lambda w: w != F.lit(""))
    return F.when(F.regexp_like(lower, F.lit("^" + COPYRIGHT)), F.array().cast("array<string>")).otherwise(words)


def _lines(text: Column) -> Column:
    """The words of each line; a line that is broken at a hyphen goes on."""
    return F.transform(F.split(F.regexp_replace(text, r"([\p{L}\p{N}])-\r?\n[ \t]*", "$1"), "\n"), _line_words)


def _digest(words: Column) -> Column:
    respelt = F.transform(words, lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv]), w), w))
    return F.sha2(F.array_join(respelt, " "), 256)


def canonical_digest(text: Column) -> Column:
    return _digest(F.flatten(_lines(text)))


def known_table(known: DataFrame) -> DataFrame:
    """(d, n, name) of a table (name, text): digest and number of words by the same columns as documents; texts without words are none."""
    rows = known.select("name", F.flatten(_lines(F.col("text"))).alias("_w")).where(F.size("_w") > 0)
    return rows.select(_digest(F.col("_w")).alias("d"), F.size("_w").alias("n"), "name").groupBy("d", "n").agg(F.min("name").alias("name"))


def standard_texts() -> list[tuple[str, str]]:
    """All texts that are known by default."""
    return KNOWN + further()


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """id, canonical_words, canonical_sha256, licence of the entire text, line_licences (sorted names).

    ``known`` is a list of (name, text), or a table of them, in place of ``standard_texts()``. The digest is given where
    the word count is that of a known text.
    """
    spark = docs.sparkSession
    texts = standard_texts() if known is None else known
    table_of = known_table(texts if isinstance(texts, DataFrame) else spark.createDataFrame(texts, "name string, text string"))
    if isinstance(texts, DataFrame):
        table_of = materialise(table_of, "licences-known")
    large = isinstance(texts, DataFrame) and table_of.count() > MAX_KNOWN or not isinstance(texts, DataFrame) and len(texts) > MAX_KNOWN
    rows = docs.select(F.col(id_col).alias("_id"), _lines(text_of(text_col)).alias("_lines"))
    if large:
        return _joined(rows, table_of, id_col)
    found = table_of.collect()
    counts = sorted({r["n"] for r in found})
    names = F.create_map(*[F.lit(x) for r in found for x in (r["d"], r["name"])]) if found else F.create_map().cast("map<string,string>")
    rows = rows.select("_id", F.flatten("_lines").alias("_w"), F.filter("_lines", lambda w: F.size(w).isin(counts)).alias("_lines"))
    rows = rows.select("_id", F.size("_w").cast("long").alias("canonical_words"), F.when(F.size("_w").isin(counts), _digest(F.col("_w"))).alias("canonical_sha256"), F.array_sort(F.array_distinct(F.filter(F.transform("_lines", lambda w: F.element_at(names, _digest(w))), lambda x: x.isNotNull()))).alias("_found"))
    licence = spark.createDataFrame([(r["d"], r["name"]) for r in found], "canonical_sha256 string, licence string")
    joined = rows.join(F.broadcast(licence), "canonical_sha256", "left")  # MAX_KNOWN rows at most
    return joined.select(F.col("_id").alias(id_col), "canonical_words", "canonical_sha256", "licence", F.array_join("_found", ",").alias("line_licences"))


def _joined(rows: DataFrame, table_of: DataFrame, id_col: str) -> DataFrame:
    """The look-up by joins, for tables too large for a plan; word counts, of which there are no more than words in the longest text, still prune."""
    counts = [r["n"] for r in table_of.select("n").distinct().collect()]
    words = F.flatten("_lines")
    lines = F.transform(F.filter("_lines", lambda w: F.size(w).isin(counts)), _digest)
    base = rows.select("_id", F.size(words).cast("long").alias("canonical_words"), F.when(F.size(words).isin(counts), _digest(words)).alias("canonical_sha256"), lines.alias("_digests"), F.monotonically_increasing_id().alias("_row"))
    base = materialise(base, "licences-rows")
    hits = base.select("_row", F.explode(F.array_distinct("_digests")).alias("d")).join(table_of.select("d", "name"), "d")
    hits = hits.groupBy("_row").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("line_licences"))
    whole = base.where("canonical_sha256 IS NOT NULL").select("_row", F.col("canonical_sha256").alias("d")).join(table_of.select("d", F.col("name").alias("licence")), "d").drop("d")
    out = base.join(whole, "_row", "left").join(hits, "_row", "left")
    return out.select(F.col("_id").alias(id_col), "canonical_words", "canonical_sha256", "licence", F.coalesce("line_licences", F.lit("")).alias("line_licences"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


# The oracle: canonical forms of its own, in Python for the known texts and in SQL for the documents.


def plain_words(text: str) -> list[str]:
    """Canonical words in plain Python."""
    words = []
    for line in re.sub(r"([^\W_])-\r?\n[ \t]*", r"\1", text.lower()).split("\n"):
        bare = line.lstrip(" \t>*#/;-")
        if bare.startswith(("©", "all rights reserved")) or _states(bare):
            continue
        words += [SPELLINGS.get(w, w) for w in re.split(BREAKS, line.replace("-", "")) if w]
    return words


def _states(bare: str) -> bool:
    """Whether a line that begins so states a copyright: the word or the sign (c), then a sign, a year, a place for one, or a name."""
    if bare.startswith("(c)"):
        rest = bare[3:].lstrip(" \t")
        return bool(re.match(r"[12][0-9]{3}|[©\[<{]", rest)) or _states_word(rest)
    return _states_word(bare)


def _states_word(bare: str) -> bool:
    if not bare.startswith("copyright"):
        return False
    tail = bare[9:]
    rest = tail.lstrip(" \t:")
    if re.match(r"\(c\)|©|\(?[12][0-9]{3}|[\[<{]", rest):
        return True
    return rest != tail and rest[:1].isalpha() and not re.match(_PROSE, rest, re.ASCII)


def _oracle_sql() -> str:
    import hashlib

    best: dict[tuple[str, int], str] = {}
    for name, text in standard_texts():
        w = plain_words(text)
        key = (hashlib.sha256(" ".join(w).encode()).hexdigest(), len(w))
        if w:
            best[key] = min(name, best.get(key, name))
    known = ", ".join(f"('{d}', {n}, '{name}')" for (d, n), name in sorted(best.items()))
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPELLINGS.items())
    breaks = BREAKS.replace("\\s", " \\t\\n\\x0B\\f\\r").replace("'", "''")
    stated = r"""(regexp_matches({0}, '^copyright[ \t:]*(\(c\)|©|\(?[12][0-9]|[\[<{{])') AND regexp_matches({0}, '^copyright[ \t:]*(\(c\)|©|\(?[12][0-9]{{3}}|[\[<{{])') OR regexp_matches({0}, '^copyright[ \t:]+\pL') AND NOT regexp_matches({0}, '^copyright[ \t:]+PROSE'))""".replace("PROSE", _PROSE)
    gone = f"starts_with(b, '©') OR starts_with(b, 'all rights reserved') OR {stated.format('b')} OR starts_with(b, '(c)') AND (regexp_matches(c, '^([12][0-9]{{3}}|©|[\\[<{{])') OR {stated.format('c')})"
    return f"""
WITH k(d, n, name) AS (VALUES {known}),
l0 AS (SELECT doc_id, rn, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(regexp_replace(lower(coalesce(text, '')), '([\\pL\\pN])-\\r?\\n[ \\t]*', '\\1', 'g'), chr(10)) AS ls FROM documents)),
l1 AS (SELECT *, regexp_replace(line, '^[ \\t>*#/;-]+', '') AS b FROM l0),
l2 AS (SELECT *, regexp_replace(substr(b, 4), '^[ \\t]+', '') AS c FROM l1),
l3 AS (SELECT doc_id, rn, i, CASE WHEN {gone} THEN [] ELSE list_filter(regexp_split_to_array(replace(line, '-', ''), '{breaks}'), lambda x: x <> '') END AS w FROM l2),
l4 AS (SELECT doc_id, rn, i, list_transform(w, lambda x: CASE x {cases} ELSE x END) AS w FROM l3),
f AS (SELECT rn, string_agg(DISTINCT k.name, ',' ORDER BY k.name) AS found FROM l4 JOIN k ON len(w) = n AND sha256(array_to_string(w, ' ')) = d GROUP BY 1),
t AS (SELECT doc_id, rn, flatten(list(w ORDER BY i)) AS w FROM l4 GROUP BY 1, 2),
c AS (SELECT doc_id, rn, CAST(len(w) AS BIGINT) AS canonical_words, CASE WHEN len(w) IN (SELECT n FROM k) THEN sha256(array_to_string(w, ' ')) END AS canonical_sha256 FROM t)
SELECT c.doc_id, canonical_words, canonical_sha256, k.name AS licence, coalesce(f.found, '') AS line_licences FROM c LEFT JOIN k ON d = canonical_sha256 LEFT JOIN f USING (rn)
"""


ORACLE_SQL = _oracle_sql()
