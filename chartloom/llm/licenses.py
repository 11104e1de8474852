"""Licence scans: canonical digests of whole texts, hash-joined to those of known licences.

Both sides are normalised alike: lower case, copyright lines and list marks out, runs of
punctuation and white space to one space, equivalent spellings to one form.  Some of the spelling rules
also change words they weren't made for ("your"); as both sides pass them, that
does no harm.  DataFrame functions only.

Defined results: null text counts as empty; a text without any word has a digest but matches
nothing; known texts without any word are left out; where several known licences have one
digest, the first by name is given; repeated rows give repeated results, null ids are passed on; the longest
texts are read whole; an empty table gives an empty table; columns of docs other than those named
aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known digests that may be broadcast, at about 100 bytes each; larger catalogues are left to the planner.
MOST_BROADCAST = 100_000

# Lines that only state a copyright, and marks that begin a list item.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[ \t]*)?(\(c\)|©|copyright[ \t]+([0-9]{4}|<|\[|\{))[^\n]*"
RIGHTS_LINE = "all rights reserved"
LIST_MARK = r"(?m)^[ \t]*([*+-]|\(?[0-9a-z]{1,2}[.)])[ \t]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}\x{A9}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}\x{2026}]+"

# Equivalent spellings, each pair applied in this order to all texts.
SPELLINGS = [
    ("practis", "practic"),
    ("isation", "ization"),
    ("ise", "ize"),
    ("ising", "izing"),
    ("yse", "yze"),
    ("our", "or"),
    ("licenc", "licens"),
    ("offenc", "offens"),
    ("centre", "center"),
    ("calibre", "caliber"),
    ("ogue", "og"),
    ("programme", "program"),
    ("dgement", "dgment"),
    ("artefact", "artifact"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
    ("sub licens", "sublicens"),
    ("non commercial", "noncommercial"),
    ("non infring", "noninfring"),
    ("ll", "l"),
]


def canonical(text: Column) -> Column:
    """The normalised form of a text; the same steps as canonical_sql()."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.regexp_replace(F.regexp_replace(out, LIST_MARK, ""), GAP, " ")
    out = F.replace(F.trim(out), F.lit(RIGHTS_LINE), F.lit(""))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical_sql(text: str) -> str:
    """DuckDB SQL for canonical()."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower(coalesce({text}, '')), {quote(COPYRIGHT_LINE)}, '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, {quote(LIST_MARK)}, '', 'g'), {quote(GAP)}, ' ', 'g')"
    out = f"replace(trim({out}), {quote(RIGHTS_LINE)}, '')"
    for one, other in SPELLINGS:
        out = f"replace({out}, {quote(one)}, {quote(other)})"
    return f"trim(replace({out}, '  ', ' '))"


# Texts of well-known licences, without their copyright lines.
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_TWO_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_PERMISSION_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _PERMISSION_AS_IS,
    "BSD-2-Clause": _TWO_CLAUSES + "\n" + _DISCLAIMER,
    "BSD-3-Clause": _TWO_CLAUSES + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _DISCLAIMER,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _PERMISSION_AS_IS,
    "MIT": _MIT_BODY,
    "MIT (with title)": "The MIT License (MIT)\n\n" + _MIT_BODY,
    "MIT (notice)": "Released under the MIT License.",
    "Apache-2.0 (notice)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
}


# Canonical digests of whole licence texts too long to be kept here, as published by their stewards.
DIGESTS = {
    "Apache-2.0": "dbefe1e8d983a6e05eb701dcd2418087eb4560b5e3b0d48a570a9128fa210a87",
    "CC0-1.0": "c061862ee4e59062b7f25831a7235fd6bce427b54d6126249f7174d761c5e32a",
    "GFDL-1.2": "00b8c4cbc16b12ee37f03802255b8b402dda1b97a54f4dbd33268167ec913483",
    "GFDL-1.3": "4bcfe2d1cd7cb54c79bacbebf67f863d8893e2407a31510e6ba3f5c9b69cab58",
    "GPL-1.0": "39fad0500e38ada3922854b629c4a496e7aed6a34847cce73e86bb2e42eaf134",
    "GPL-2.0": "c0347c99dd6844782f634d634b302577a2d4459b115ffd5c05da6ecc4468ac80",
    "GPL-3.0": "4061ef76d838242ac1a59af673f582cb36e468d30140776ef52776d7c3496255",
    "LGPL-2.0": "d5f1716f8fc5829130d99cef1cd62ce22b0f8562f80e48857074d1a85987e6d7",
    "LGPL-2.1": "785ced338abdcc6c1fb8c9bbccad111a6fc78fc05e08c1cc576a95ce9b3b03f9",
    "LGPL-3.0": "ed297f681f257f15a4fb3a9bcbd4b1b04125dad56f4fdccc0ce673fdbe150870",
    "MPL-1.1": "20c53a909350ecd96270528c343d833aaf133f7e51386a8606e2abb3478a1adf",
    "MPL-2.0": "48ba33ef9214fcdc192fe61ffd821bde002a7b2fc69ee83725f7fd8d17fbd7eb",
}


def known_digests(spark: SparkSession) -> DataFrame:
    """license_id and canonical_sha256 of licences known by their digest alone."""
    return spark.createDataFrame(list(DIGESTS.items()), "license_id string, canonical_sha256 string")


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id and text of the built-in catalogue."""
    return spark.createDataFrame(list(KNOWN.items()), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame, keep: list[str] | None = None, text: str = "text", digests: DataFrame | None = None) -> DataFrame:
    """keep (default doc_id) with canonical_chars, canonical_sha256, license_id (null if unknown) and is_license.

    known: license_id and text; digests: license_id and canonical_sha256 of further licences.
    """
    keep = keep if keep is not None else ["doc_id"]
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    of_texts = known.select("license_id", canonical(F.col("text")).alias("_c")).where("_c <> ''").select("license_id", digest(F.col("_c")).alias("_sha"))
    every = of_texts if digests is None else of_texts.union(digests.select("license_id", "canonical_sha256"))
    digests = every.groupBy("_sha").agg(F.min("license_id").alias("license_id"))
    if digests.count() <= MOST_BROADCAST:
        digests = F.broadcast(digests)
    inner = [f"_keep{i}" for i in range(len(keep))]
    read = docs.select(*(F.col(c).alias(x) for c, x in zip(keep, inner, strict=True)), canonical(F.col(text)).alias("_c"))
    read = read.select(*inner, F.length("_c").cast("long").alias("canonical_chars"), digest(F.col("_c")).alias("canonical_sha256"))
    out = read.join(digests, F.col("canonical_sha256") == F.col("_sha"), "left")
    return out.select(*(F.col(x).alias(c) for c, x in zip(keep, inner, strict=True)), "canonical_chars", "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def scan_sql() -> str:
    """DuckDB SQL for scan() of the table documents with the built-in catalogue."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in KNOWN.items())
    digests = ", ".join(f"('{name}', '{sha}')" for name, sha in DIGESTS.items())
    return f"""
WITH known AS (SELECT sha, min(license_id) AS license_id FROM (SELECT license_id, sha256({canonical_sql('text')}) AS sha FROM (VALUES {rows}) AS k(license_id, text) UNION ALL FROM (VALUES {digests}) AS d(license_id, sha)) GROUP BY 1),
canon AS (SELECT doc_id, {canonical_sql('text')} AS c FROM documents)
SELECT doc_id, CAST(length(c) AS BIGINT) AS canonical_chars, sha256(c) AS canonical_sha256, license_id, license_id IS NOT NULL AS is_license
FROM canon LEFT JOIN known ON sha256(c) = sha
"""
