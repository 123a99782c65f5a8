"""License scans by canonical digests.

A text is brought to one canonical form: lower case, copyright lines left out,
punctuation and blanks as single blanks, equivalent spellings as one.  Digests
of the whole canonical text and of each of its lines are hash-joined with those
of known licenses and license notices: a table (name, text), by default a fixed one.
A license inside a longer text is found by the digests of its paragraphs, one after
the other.  DataFrame operations only.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One spelling for each group of equivalent words.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "licencing": "licensing",
    "sublicence": "sublicense",
    "favour": "favor",
    "organisation": "organization",
    "programme": "program",
    "whilst": "while",
    "acknowledgement": "acknowledgment",
    "noncommercial": "nc",
    "version": "v",
}
#: A line that only names the holder of the rights, with a mark or a year, but for the words that reserve them; what shows that there may be one.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright[ \t]*(?:\(c\)|©|[^\p{L}\p{N}\n]*(?:[0-9]{4}|year|yyyy))|©|\(c\)[^\p{L}\p{N}\n]*(?:[0-9]{4}|copyright|year|yyyy))[^\n]*?((?:all rights reserved[^\p{L}\p{N}\n]*)?)$"
COPYRIGHT_SIGN = r"copyright|©|\(c\)"
#: Where one paragraph of the canonical form ends and the next begins.
PARAGRAPHS = r"\n *\n[ \n]*"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"

#: Notices of one line, and whole short licenses, by name.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.",),
    "all-rights-reserved": ("All rights reserved.",),
}
#: Names that a tag may give, and the tag.
TAGGED, TAG = "Apache-2.0 MIT MIT-0 ISC Zlib BSD-2-Clause BSD-3-Clause 0BSD GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 BSL-1.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split(), "SPDX-License-Identifier: "
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: Whole licenses in ``license_texts`` with the number of lines of their title, and titles that are put before the texts without one.
WHOLE = {"Apache-2.0": 3, "BSD-2-Clause": 0, "BSD-3-Clause": 0, "CC0-1.0": 2, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-2.0": 2}
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License"),
}
#: What may stand between a short license's title and its text, once the holder's line is left out; where a long license's terms end and its advice on use begins.
RESERVED, TERMS_END = "All rights reserved.", "END OF TERMS AND CONDITIONS"


_ANY_SPELLING = rf"\b(?:{'|'.join(SPELLINGS)})\b"


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks; a line may have blanks at its ends.

    Most texts have none of the words that have other spellings, and no holder's line: one look tells.
    """

    def spelled(low: Column) -> Column:
        one = low
        for other, word in SPELLINGS.items():
            one = F.regexp_replace(one, rf"\b{other}\b", word)
        return F.when(F.rlike(low, F.lit(_ANY_SPELLING)), one).otherwise(low)

    def plain(low: Column) -> Column:
        bare = F.when(F.rlike(low, F.lit(COPYRIGHT_SIGN)), F.regexp_replace(low, COPYRIGHT_LINE, "$1")).otherwise(low)
        return F.regexp_replace(bare, PUNCTUATION, " ")

    # The lambdas make each step once.
    return F.transform(F.transform(F.array(F.lower(text)), plain), spelled)[0]


def canonical(text: str) -> str:
    """The same form of a known text with its line breaks."""
    low = re.sub(r"(?m)^[^\w\n©(]*(?:copyright[ \t]*(?:\(c\)|©|[^\w\n]*(?:[0-9]{4}|year|yyyy))|©|\(c\)[^\w\n]*(?:[0-9]{4}|copyright|year|yyyy))[^\n]*?((?:all rights reserved[^\w\n]*)?)$", r"\1", text.lower())
    low = re.sub(r"[^\w\n]+|_", " ", low)
    for other, one in SPELLINGS.items():
        low = re.sub(rf"\b{other}\b", one, low)
    return low


def _md5(text: str) -> str:
    return hashlib.md5(re.sub(r"[ \n]+", " ", text).strip(" ").encode()).hexdigest()


def known() -> list[tuple[str, str]]:
    """(digest, license) of the notices, tags and texts above, for the SQL, one row for each digest."""
    found: dict[str, str] = {}
    for name, text in [*notices(), *TEXTS.items()]:
        found.setdefault(_md5(canonical(text)), name)
    return sorted(found.items())


def notices() -> list[tuple[str, str]]:
    """(name, text) of the notices of one line, tags among them."""
    return [(name, text) for name, texts in NOTICES.items() for text in texts] + [(name, TAG + name) for name in TAGGED]


def bodies() -> list[tuple[str, str]]:
    """(name, text) of the whole licenses without title and advice on use."""
    folder = Path(__file__).parent / "license_texts"
    found = list(TEXTS.items())
    for name, heading in WHOLE.items():
        body = "\n".join((folder / f"{name}.txt").read_text(encoding="utf-8").strip("\n").split("\n")[heading:])
        found.append((name, body[: body.index(TERMS_END)] if TERMS_END in body else body))
    return found


def shipped() -> list[tuple[str, str]]:
    """(name, text) of all known notices and whole licenses: each of these with and without title, advice on use and numbers of its conditions."""
    folder = Path(__file__).parent / "license_texts"
    rows = notices()
    whole = {name: (text, 0) for name, text in TEXTS.items()} | {name: ((folder / f"{name}.txt").read_text(encoding="utf-8"), n) for name, n in WHOLE.items()}
    for name, (text, heading) in whole.items():
        lines = text.strip("\n").split("\n")
        variants = ["\n".join(lines), "\n".join(lines[heading:])]
        variants += [b[: b.index(TERMS_END) + len(TERMS_END)] for b in variants if TERMS_END in b]
        variants += [re.sub(r"(?m)^\d\. ", "", b) for b in variants if name.startswith("BSD")]
        starts = ("", *(f"{t}\n\n" for t in TITLES.get(name, ())))
        between = ("", f"{RESERVED}\n\n") if name in TITLES else ("",)
        rows += [(name, start + middle + body) for body in dict.fromkeys(variants) for start in starts for middle in between]
    return rows


def _whole(form: Column) -> Column:
    return F.btrim(F.regexp_replace(form, r"[ \n]+", " "))


def _digest(form: Column) -> Column:
    return F.md5(form.cast("binary"))


def digests_of(known: DataFrame) -> DataFrame:
    """(digest, license) of known texts (name, text), by the same expressions as those of documents; the first name where several have one form."""
    form = known.select("name", _whole(canonical_lines(F.col("text"))).alias("whole")).where("whole != ''")
    return form.groupBy(_digest(F.col("whole")).alias("digest")).agg(F.min("name").alias("license"))


def known_texts(spark: SparkSession) -> DataFrame:
    """The shipped licenses as a table (name, text)."""
    return spark.createDataFrame(shipped(), "name string, text string")


def known_bodies(spark: SparkSession) -> DataFrame:
    """The shipped licenses of several paragraphs, to be found inside longer texts, as a table (name, text)."""
    return spark.createDataFrame(bodies(), "name string, text string")


def _paragraphs(form: Column) -> Column:
    """Digests of the paragraphs of a canonical form that are not blank."""
    return F.transform(F.filter(F.transform(F.split(form, PARAGRAPHS), _whole), lambda p: p != ""), _digest)


def scan(docs: DataFrame, known: DataFrame | None = None, inside: DataFrame | None = None) -> DataFrame:
    """(doc_id, scope, line, license): what of each document is a known license, of ``known`` (name, text) or else of those shipped.

    ``scope`` is 'text' where the whole document is one (line 0), 'line' for
    each line that is, counted from 1 among the lines of the canonical form, and
    'span' for each run of two or more paragraphs (the first counted from 1) that is a
    whole license of ``inside`` (name, text; else ``known``, or those shipped without title).  A
    null, empty or blank text has none; very long texts are read whole.  Repeated rows and lines each give rows.
    """
    spark = docs.sparkSession
    table = digests_of(known_texts(spark) if known is None else known)
    inside = inside if inside is not None else known if known is not None else known_bodies(spark)
    lines = docs.select("doc_id", canonical_lines(F.coalesce("text", F.lit(""))).alias("form"))
    lines = lines.select("doc_id", F.split("form", "\n").alias("lines"), _whole(F.col("form")).alias("whole"), _paragraphs(F.col("form")).alias("paragraphs"), F.monotonically_increasing_id().alias("row"))
    own = F.concat(F.array(_digest(F.col("whole"))), F.transform("lines", lambda x: _digest(F.btrim(x))))
    own = F.transform(own, lambda d, i: F.struct(F.lit(False).alias("part"), i.alias("line"), d.alias("digest")))
    parts = F.transform("paragraphs", lambda d, i: F.struct(F.lit(True).alias("part"), (i + 1).alias("line"), d.alias("digest")))
    digests = lines.select("doc_id", "row", F.inline(F.concat(own, parts)))

    # Each known digest with the licenses that it is, and the places of the licenses' paragraphs that it is.
    spans = inside.select("name", _paragraphs(canonical_lines(F.col("text"))).alias("p")).where(F.size("p") > 1).withColumn("text", F.xxhash64("p"))
    spans = spans.select(F.lit(True).alias("part"), "name", "text", F.size("p").alias("n"), F.posexplode("p").alias("at", "digest"))
    whole = table.select(F.lit(False).alias("part"), F.col("license").alias("name"), F.lit(0).cast("long").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("at"), "digest")
    found = digests.join(F.broadcast(whole.unionByName(spans)), ["part", "digest"])
    # Only paragraphs of licenses are left here; a whole license has all of them in order.
    runs = found.groupBy("row", "doc_id", "name", "text", (F.col("line") - F.col("at")).alias("line"), F.when(~F.col("part"), F.col("line")).alias("own"), "part", "n").agg(F.count_distinct("at").alias("found"))
    runs = runs.where(~F.col("part") | (F.col("found") == F.col("n"))).select("row", "doc_id", "part", "line", F.col("name").alias("license")).distinct()
    return runs.select("doc_id", F.when(F.col("part"), "span").when(F.col("line") == 0, "text").otherwise("line").alias("scope"), "line", "license")


def oracle() -> str:
    quoted = COPYRIGHT_LINE.replace("'", "''")
    form = rf"regexp_replace(lower(coalesce(text, '')), '{quoted}', '\1', 'g')"
    form = f"regexp_replace({form}, '{PUNCTUATION}', ' ', 'g')"
    for other, one in SPELLINGS.items():
        form = rf"regexp_replace({form}, '\b{other}\b', '{one}', 'g')"
    values = ", ".join(f"('{d}', '{n}')" for d, n in known())
    spans = []
    for name, text in TEXTS.items():
        parts = [_md5(p) for p in re.split(PARAGRAPHS, canonical(text)) if p.strip(" \n")]
        spans += [f"('{name}', {len(parts)}, {k}, '{d}')" for k, d in enumerate(parts)]
    return f"""
WITH known(digest, license) AS (VALUES {values}),
span(license, n, place, digest) AS (VALUES {", ".join(spans)}),
f AS (SELECT doc_id, {form} AS form FROM documents),
l AS (SELECT doc_id, form, string_split(form, chr(10)) AS lines,
             list_filter(list_transform(string_split_regex(form, '{PARAGRAPHS}'), lambda p: trim(regexp_replace(p, '[ \\n]+', ' ', 'g'), ' ')), lambda p: p <> '') AS parts FROM f),
d AS (
  SELECT doc_id, 0 AS line, md5(trim(regexp_replace(form, '[ \\n]+', ' ', 'g'), ' ')) AS digest FROM l
  UNION ALL
  SELECT doc_id, i AS line, md5(trim(lines[i], ' ')) AS digest FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM l)),
p AS (SELECT doc_id, i, md5(parts[i]) AS digest FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM l))
SELECT doc_id, CASE WHEN line = 0 THEN 'text' ELSE 'line' END AS scope, CAST(line AS int) AS line, license
FROM d JOIN known USING (digest)
UNION ALL
SELECT doc_id, 'span', CAST(i - place AS int), license FROM p JOIN span USING (digest) GROUP BY doc_id, license, n, i - place HAVING count(*) = n
"""
