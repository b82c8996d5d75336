"""Licence scans by canonical digest lookup (built-in functions only).

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent
spellings unified, everything but letters and digits squeezed to single spaces. The
SHA-256 of the canonical form of an *entire* text is then joined with the digests of
known texts. Two kinds of text are looked up: the whole document against licence texts,
and each of its lines against licence notices (the sentences by which a work names its
licence). The known table is fixed and small, so it is broadcast; the documents are not
shuffled.

Null and empty texts, and texts with no letter or digit, have no digest and match
nothing. A line that repeats a notice counts each time. Repeated rows get equal results;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import without

#: A line that only states a copyright, in lower case; fixed value.
COPYRIGHT_LINE = r"^[ \t#*/;%-]*(copyright|\(c\)|©|all rights reserved)"
#: (pattern, replacement) on squeezed lower-case lines, in this order; fixed values.
SPELLINGS = [
    (r"licenc", "licens"),
    (r"(organ|author|util|optim|real|recogn|initial|custom)is(e|es|ed|ing|ation|ations)( |$)", "$1iz$2$3"),
    (r"(favo|hono|behavio|colo)ur", "$1r"),
    (r"(^| )copyright (holders|owners|owner)( |$)", "$1copyright holder$3"),
    (r"(^| )per cent( |$)", "$1percent$2"),
    (r"(^| )sub licens", "$1sublicens"),
    (r"(^| )non commercial", "$1noncommercial"),
]
#: Title lines that a licence text may begin with; fixed values.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "Zlib": ["zlib License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "MIT-0": ["MIT No Attribution"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
}

#: Licence texts by SPDX id, without copyright lines; fixed values.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}

#: Notices by SPDX id; fixed values.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
]
NOT_ALNUM = r"[^\p{L}\p{N}]+"


def canonical_line(line: Column) -> Column:
    low = F.lower(line)
    out = F.regexp_replace(low, NOT_ALNUM, " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.when(F.regexp_like(low, F.lit(COPYRIGHT_LINE)), F.lit("")).otherwise(F.trim(out))


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines that have one; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical_line), lambda x: x != "")


def _digest(canonical: Column) -> Column:
    return F.when(canonical != "", F.sha2(canonical, 256))


def known(spark: SparkSession, texts=None, notices=None) -> DataFrame:
    """(kind, digest, license) of the known texts, with and without title, and notices."""
    rows = [("text", k, t + v) for k, v in (TEXTS if texts is None else texts).items() for t in ["", *(f"{x}\n" for x in TITLES.get(k, []))]]
    rows += [("notice", k, v) for k, v in (NOTICES if notices is None else notices)]
    table = spark.createDataFrame(rows, "kind string, license string, body string")
    form = F.array_join(canonical_lines(F.col("body")), " ")
    return table.groupBy("kind", _digest(form).alias("digest")).agg(F.min("license").alias("license")).where("digest IS NOT NULL")


def scan(docs: DataFrame, texts=None, notices=None) -> DataFrame:
    """``docs`` with digest, license (of the whole text), notice_lines and notices (sorted);
    columns of these names give way."""
    docs = without(docs, "digest", "license", "notice_lines", "notices")
    table = known(docs.sparkSession, texts, notices)
    of_line = {r["digest"]: r["license"] for r in table.where("kind = 'notice'").collect()}  # fixed and small
    pairs = F.create_map(*[F.lit(x) for kv in sorted(of_line.items()) for x in kv]) if of_line else None
    rows = docs.select(F.struct("*").alias("_row"), canonical_lines(F.col("text")).alias("_forms"))
    named = (lambda x: pairs[F.sha2(x, 256)]) if of_line else (lambda x: F.lit(None).cast("string"))
    rows = rows.withColumn("_hits", F.filter(F.transform("_forms", named), lambda x: x.isNotNull()))
    rows = rows.withColumn("_digest", _digest(F.array_join("_forms", " ")))
    of_text = table.where("kind = 'text'").select(F.col("digest").alias("_d"), F.col("license").alias("_license"))
    return rows.join(F.broadcast(of_text), F.col("_digest") == F.col("_d"), "left").select(
        "_row.*",
        F.col("_digest").alias("digest"),
        F.col("_license").alias("license"),
        F.size("_hits").cast("long").alias("notice_lines"),
        F.array_join(F.array_sort(F.array_distinct("_hits")), ",").alias("notices"),
    )


def scan_sql(source: str = "documents") -> str:
    """The scan in DuckDB SQL: doc_id, digest, license, notice_lines, notices."""

    def form(line: str) -> str:
        out = f"regexp_replace(lower({line}), '{NOT_ALNUM}', ' ', 'g')"
        for pattern, to in SPELLINGS:
            for i in (1, 2, 3):
                to = to.replace(f"${i}", f"\\{i}")
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
        return f"CASE WHEN regexp_matches(lower({line}), '{COPYRIGHT_LINE}') THEN '' ELSE trim({out}) END"

    quoted = lambda x: x.replace("'", "''")
    rows = [("text", k, t + v) for k, v in TEXTS.items() for t in ["", *(f"{x}\n" for x in TITLES.get(k, []))]]
    rows += [("notice", k, v) for k, v in NOTICES]
    values = ", ".join(f"('{kind}', '{k}', '{quoted(v)}')" for kind, k, v in rows)
    forms = lambda text: f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda x: {form('x')}), lambda x: x <> '')"
    return f"""
WITH known AS (
  SELECT kind, min(license) AS license, sha256(array_to_string(forms, ' ')) AS digest
  FROM (SELECT kind, license, {forms("body")} AS forms FROM (VALUES {values}) v(kind, license, body)) GROUP BY ALL
), d AS (
  SELECT doc_id, {forms("text")} AS forms FROM {source}
), w AS (
  SELECT row_number() OVER () AS n, doc_id, forms,
         CASE WHEN len(forms) > 0 THEN sha256(array_to_string(forms, ' ')) END AS digest FROM d
), h AS (
  SELECT n, count(*) AS notice_lines, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices
  FROM (SELECT n, sha256(unnest(forms)) AS line FROM w) l JOIN known k ON k.kind = 'notice' AND k.digest = l.line GROUP BY n
)
SELECT w.doc_id, w.digest, k.license, coalesce(h.notice_lines, 0) AS notice_lines, coalesce(h.notices, '') AS notices
FROM w LEFT JOIN known k ON k.kind = 'text' AND k.digest = w.digest LEFT JOIN h USING (n)
"""
