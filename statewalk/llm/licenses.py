"""Licence scans by canonical digest lookup.

A text is brought to a canonical form (lower case, copyright lines dropped, equivalent spellings unified, everything but
letters and digits turned to single blanks), its digest is taken, and the digests of entire texts are hash-joined to those of
known licences. The same lookup runs on every line, so that a one-line notice within a longer document is found too; a licence
of several lines within other text is not looked for. All of it is built-in column functions; the known digests are a small
fixed table, whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewalk.llm.common import texts_of

#: Published licence texts and the notices that commonly stand for a licence.
KNOWN: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: The lines that stand above a licence's text; each makes a whole text of its own.
TITLES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"),
    "Unlicense": ("The Unlicense",),
}
#: Digests of the canonical form of whole published licences that are too long to be written here.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "39e02f42ec27f643f8eeab3a467dcaee"),
    ("Artistic-1.0-Perl", "1e04d13d478684795e6712112a5929bc"),
    ("CC0-1.0", "a7c55e3bdff27d204ac5b2d405654b0c"),
    ("GFDL-1.2", "6fae616a2084258d6f1635920433f2e2"),
    ("GFDL-1.3", "9715992e76e496f0c0d0a6fcfb268fed"),
    ("GPL-1.0", "4994268c92e663e4cada1a4faddb1f5f"),
    ("GPL-2.0", "2dd3ed1a35757ae824c2359a36c1ffb7"),
    ("GPL-3.0", "0ccdbec2d2196d0e7d4bb037702357d6"),
    ("LGPL-2.0", "8db8c73ff85892b91557b016cc5a3278"),
    ("LGPL-2.1", "bb3ad06175dcb67a26c7caaf5c6782b2"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "3395c4c72cf079882d4ca6de3f20e97a"),
    ("MPL-2.0", "e00837723f0a465a0a71a328d56758de"),
)
#: Spellings that count as the same, as (pattern on words, replacement).
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("modelled", "modeled"),
    ("favour", "favor"),
    ("ver", "version"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("non infringement", "noninfringement"),
    ("as is", "asis"),
)
#: Fixed value: a line that names a copyright holder or reserves all rights, which goes whole.
COPYRIGHT = r"(?:^|\n)[ \t*#/]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Fixed value: each known text has one of these within a word of its canonical form. A line that hasn't, in lower case, isn't
#: known: the canonical form joins no two letters that weren't neighbours.
HINTS = "licen|permission|redistribution|software|spdx|released"


def canonical(text: Column) -> Column:
    """The canonical form: one blank between words, none at the ends; '' for null and for texts without letters or digits."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^a-z0-9]+", " "), F.lit(" "))
    for spelling, same in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {same} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def bodies() -> list[tuple[str, str]]:
    """license and text of all that is known by its text: bodies with and without a title, and notices."""
    return [*KNOWN, *((name, f"{title}\n\n{body}") for name, body in KNOWN if "\n" in body for title in TITLES.get(name, ()))]


def known(spark: SparkSession) -> DataFrame:
    """digest, license: one row for each distinct known digest; the fixed tables' length bounds it."""
    texts = spark.createDataFrame(bodies(), "license string, body string").select(F.md5(canonical(F.col("body")).cast("binary")).alias("digest"), "license")
    given = spark.createDataFrame([(digest, name) for name, digest in DIGESTS], "digest string, license string")
    return texts.union(given).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (of the canonical whole text), license (of the whole text, else null), n_notices (lines that are a
    known licence or notice) and notices (their sorted distinct licences, comma-separated, '' if none).

    licenses: digest, license, for the whole texts; by default the fixed table, which alone is broadcast, as its length is
    bounded. Any other is joined as Spark sees fit. Null and empty texts have the digest of '' and no licence. Lines of any
    length are looked at. Repeated rows, and rows without an id, are reported as often as they occur; other columns are dropped;
    an empty table gives no rows. Of licences with one digest the first by name counts.
    """
    fixed = known(docs.sparkSession)
    notices = {r["digest"]: r["license"] for r in fixed.collect()}
    table = F.create_map(*[F.lit(x) for kv in sorted(notices.items()) for x in kv])
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.lower(line).rlike(HINTS))
    found = F.filter(F.transform(lines, lambda line: F.try_element_at(table, F.md5(canonical(line).cast("binary")))), lambda x: x.isNotNull())
    rows = texts_of(docs).select("doc_id", F.md5(canonical(F.col("text")).cast("binary")).alias("digest"), found.alias("found"))
    right = F.broadcast(fixed) if licenses is None else licenses.groupBy("digest").agg(F.min("license").alias("license"))
    return rows.join(right, "digest", "left").select(
        "doc_id",
        "digest",
        "license",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"),
    )


def oracle() -> str:
    """The same in DuckDB SQL: lines are unnested and joined there, rather than looked up in a map."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canon(x: str) -> str:
        pattern = quoted(COPYRIGHT.replace("\\n", "\n").replace("\\t", "\t"))
        out = f"' ' || regexp_replace(regexp_replace(lower(coalesce({x}, '')), {pattern}, chr(10), 'g'), '[^a-z0-9]+', ' ', 'g') || ' '"
        for spelling, same in SPELLINGS:
            out = f"replace({out}, {quoted(f' {spelling} ')}, {quoted(f' {same} ')})"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    values = ", ".join(f"({quoted(name)}, {quoted(body)})" for name, body in bodies())
    given = ", ".join(f"({quoted(name)}, {quoted(digest)})" for name, digest in DIGESTS)
    return f"""
    WITH known AS (SELECT digest, min(name) AS license FROM (SELECT md5({canon("body")}) AS digest, name FROM (VALUES {values}) v(name, body) UNION ALL SELECT digest, name FROM (VALUES {given}) g(name, digest)) GROUP BY 1),
    docs AS (SELECT doc_id, md5({canon("text")}) AS digest FROM documents),
    lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
    hits AS (SELECT doc_id, license FROM (SELECT doc_id, md5({canon("line")}) AS digest FROM lines WHERE regexp_matches(lower(line), '{HINTS}')) l JOIN known USING (digest)),
    counted AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM hits GROUP BY doc_id)
    SELECT d.doc_id, d.digest, k.license, coalesce(c.n_notices, 0) AS n_notices, coalesce(c.notices, '') AS notices
    FROM docs d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN counted c ON c.doc_id = d.doc_id"""
