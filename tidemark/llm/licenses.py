"""License scans by canonical digest.

A text is canonicalised (lower case, copyright and rights-reserved lines dropped, equivalent spellings made one, everything but letters and
digits turned into single spaces) and its SHA-256 digest looked up in a table of known licence digests by a hash join. Two kinds of units
are looked up: the entire text, and each of its lines, so that a one-line notice inside a page is found too. The known table is a
parameter; it is a short list of licence texts and notices, so it is bounded and broadcast.

Defined results: a null or empty text has the digest of the empty text and no licence; equal rows are looked up alike; an empty table gives
no rows; columns of the input other than those returned are carried by ``scan`` and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, table

# Spellings that count as one, as in the public matching guidelines for licence texts.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub-license", "sublicense"), ("noncommercial", "non commercial"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("behaviour", "behavior"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("organisation", "organization"), ("authorised", "authorized"), ("customised", "customized"), ("recognised", "recognized"),
    ("utilisation", "utilization"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("https", "http"), ("per cent", "percent"),
)

# Public licence texts and notices.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted")
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n"
            + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n\n" + _ISC_GRANT + ".\n\n" + _ISC_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_RIGHTS = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
_OTHER = r"[^\p{L}\p{N}]+"


def _apart(words: str) -> str:
    """Words as they stand in a text whose words are two spaces apart, so that neighbours can be replaced one by one."""
    return " " + "  ".join(words.replace("-", " ").split()) + " "


def canonical(text: Column) -> Column:
    """Canonical form of a text; null gives the empty text."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _RIGHTS, " ")
    x = F.concat(F.lit(" "), F.regexp_replace(x, _OTHER, "  "), F.lit(" "))
    for spelled, one in SPELLINGS:
        x = F.replace(x, F.lit(_apart(spelled)), F.lit(_apart(one)))
    return F.trim(F.regexp_replace(x, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license) of licence texts, one row per digest."""
    rows = spark.createDataFrame(list(known), "license string, body string")
    return rows.groupBy(digest(F.col("body")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit, line, digest, license): a row with unit 'text' and line 0 for every document, whose license is null unless its
    entire text is known, and a row with unit 'line' for every line that is a known notice (lines count from 1)."""
    known = F.broadcast(known if known is not None else known_licenses(docs.sparkSession))
    whole = docs.select("doc_id", F.lit("text").alias("unit"), F.lit(0).alias("line"), digest(F.col("text")).alias("digest"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "_x")).filter(F.length("_x") > 0)
    lines = lines.select("doc_id", F.lit("line").alias("unit"), (F.col("line") + 1).alias("line"), digest(F.col("_x")).alias("digest"))
    columns = ["doc_id", "unit", "line", "digest", "license"]
    return whole.join(known, "digest", "left").select(columns).unionByName(lines.join(known, "digest").select(columns))


def _sql() -> str:
    def canon(x: str) -> str:
        x = f"regexp_replace(lower(coalesce({x}, '')), '{_RIGHTS}', ' ', 'g')"
        x = f"' ' || regexp_replace({x}, '{_OTHER}', '  ', 'g') || ' '"
        for spelled, one in SPELLINGS:
            x = f"replace({x}, '{_apart(spelled)}', '{_apart(one)}')"
        return f"sha256(trim(regexp_replace({x}, ' +', ' ', 'g')))"

    rows = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in KNOWN)
    return f"""
with known as (select digest, min(license) as license from (select {canon('body')} as digest, license
               from (values {rows}) as t(license, body)) group by 1),
lines as (select doc_id, unnest(range(1, len(x) + 1)) as line, unnest(x) as x from (select doc_id, string_split(text, chr(10)) as x from documents))
select doc_id, 'text' as unit, 0 as line, digest, license from (select doc_id, {canon('text')} as digest from documents) left join known using (digest)
union all
select doc_id, 'line', cast(line as int), digest, license from (select doc_id, line, {canon('x')} as digest from lines where x <> '') join known using (digest)
"""


@query("op8_licenses", _sql())
def op8_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
