"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: lower case, without copyright lines, equivalent spellings made one, and every
run of characters that are neither letters nor digits made one space.  The digest of the whole canonical text is joined
by hash with the digests of known licences; so is that of each short notice, a line that speaks of a licence, whose
names are returned sorted.

Null and empty texts, and texts without a letter or digit, have the digest of the empty text and match nothing.  Rows
are handled one by one: repeated rows keep their number, other columns are ignored, an empty table gives an empty
result.  Known are the fixed texts of this module, the longer whole texts of the folder ``license_texts``, and those of a
table that the caller may add; each is small however large the documents are.
"""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_DISCLAIMER = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: Whole texts (the public licence texts, without copyright lines) and short notices, by identifier.
KNOWN = [
    ("MIT", MIT_GRANT),
    ("MIT", "MIT License\n\n" + MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT_GRANT),
    ("BSD-2-Clause", BSD_CONDITIONS + BSD_DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_CONDITIONS + BSD_DISCLAIMER),
    ("BSD-3-Clause", BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + ISC_DISCLAIMER),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + ISC_DISCLAIMER),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + ISC_DISCLAIMER),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
#: Spellings that count as one.
SPELLINGS = [("licence", "license"), ("licencing", "licensing"), ("acknowledgement", "acknowledgment"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("whilst", "while")]
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)[ \t]*[0-9]|©)[^\n]*$|^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
NOTICE = r"(?i)licen[cs]e|spdx"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.when(F.contains(t, F.lit("copyright")) | F.contains(t, F.lit("(c)")) | F.contains(t, F.lit("©")) | F.contains(t, F.lit("all rights reserved")), F.regexp_replace(t, COPYRIGHT_LINE, "")).otherwise(t)
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def whole_texts() -> list[tuple[str, str]]:
    """The longer licences by identifier: whole, and without what follows the end of their terms."""
    found = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        found.append((path.stem, text))
        if end := re.search(r"END OF TERMS AND CONDITIONS", text):
            found.append((path.stem, text[: end.end()]))
    return found


def known_digests(spark: SparkSession, further: DataFrame | None = None) -> dict[str, str]:
    """The identifier of each digest of a known text; further ones have ``license_id``, ``text``.  Of the identifiers of
    one text the least is taken."""
    # an Arrow table becomes a local relation, so no executor handles it
    texts = pa.table(dict(zip(("license_id", "text"), map(list, zip(*KNOWN, *whole_texts(), strict=True)), strict=True)))
    rows = spark.createDataFrame(texts)
    if further is not None:
        rows = rows.unionByName(further.select("license_id", "text").filter("license_id is not null"))
    rows = rows.select(canonical(F.col("text")).alias("form"), "license_id").filter("form <> ''").select(F.sha2("form", 256).alias("digest"), "license_id")
    return dict(sorted(((r["digest"], r["license_id"]) for r in rows.collect()), reverse=True))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", further: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``digest`` of the whole text, ``license_id`` if the whole text is a known one, ``notices``: sorted
    names of the known texts among its lines that speak of a licence (null for none).  further: more known texts."""
    spark = docs.sparkSession
    table = known_digests(spark, further)
    known = spark.createDataFrame(pa.table({"digest": list(table.keys()), "license_id": list(table.values())}))
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(NOTICE))
    # the known texts are few, so the lines are looked up in a literal of them
    lookup = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    names = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(lookup, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())))
    names = F.when(F.col(text).rlike(NOTICE), names)
    out = docs.select(F.col(id_column).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("digest"), F.when(F.size(names) > 0, F.array_join(names, ",")).alias("notices"))
    return out.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license_id", "notices")


def oracle_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = "lower(coalesce(t, ''))"
    body = f"CASE WHEN contains({low}, 'copyright') OR contains({low}, '(c)') OR contains({low}, '©') OR contains({low}, 'all rights reserved') THEN regexp_replace({low}, {quote(COPYRIGHT_LINE)}, '', 'g') ELSE {low} END"
    for old, new in SPELLINGS:
        body = f"replace({body}, '{old}', '{new}')"
    form = f"sha256(trim(regexp_replace({body}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT {form} AS digest, license_id FROM (VALUES {values}) AS k(license_id, t)),
whole AS (SELECT doc_id, {form} AS digest FROM (SELECT doc_id, text AS t FROM documents)),
lines AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
hits AS (SELECT DISTINCT l.doc_id, k.license_id FROM (SELECT doc_id, {form} AS digest FROM lines WHERE regexp_matches(t, '{NOTICE}')) AS l JOIN known AS k USING (digest)),
names AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM hits GROUP BY doc_id)
SELECT w.doc_id AS doc_id, w.digest AS digest, k.license_id AS license_id, n.notices AS notices
FROM whole AS w LEFT JOIN known AS k ON w.digest = k.digest LEFT JOIN names AS n ON w.doc_id = n.doc_id
"""
