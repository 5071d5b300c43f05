"""Operator 10, licence scans by canonical digests.

Built-in SQL functions only.  Texts are brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings), digested whole, and hash-joined to the digests of known licences.  The same join, on the
canonical form of each line, finds licence notices inside longer texts.
"""

from __future__ import annotations

import re
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, small_side

# Equivalent spellings, applied in this order to lower-case text in single spaces.
SPELLINGS = [
    ("licence", "license"),
    ("licencing", "licensing"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("initialise", "initialize"),
    ("modernise", "modernize"),
    ("acknowledgement", "acknowledgment"),
    ("fulfil ", "fulfill "),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

# Title lines under which a text goes, besides none, and lines after which it may end.
TITLES = {
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License", "New BSD License", "BSD License"],
}
ENDS = re.compile(r"^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$", re.M)
ITEM = re.compile(r"^[ \t]*(?:\d\.|\*)[ \t]*", re.M)


def full_texts() -> list[tuple[str, str]]:
    """license_id and text of the files license_texts/<SPDX id>[.<variant>].txt, in their usual variants.

    BSD texts: with and without title, items with numbers and with bullets.  Texts with an appendix on how to apply
    them: with and without it, and without their closing line too.
    """
    out = []
    for file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name = re.sub(r"(\.[a-z]+)?\.txt$", "", file.name)
        text = file.read_text(encoding="utf-8")
        forms = [text]
        if name in TITLES:
            forms += [ITEM.sub("* ", text)]
            forms += [f"{title}\n\n{t}" for title in TITLES[name] for t in forms]
        elif end := ENDS.search(text):
            forms += [text[: end.end()], text[: end.start()]]
        out += [(name, t) for t in forms]
    return out


# Known licences and notices, (license_id, text).
KNOWN = [
    *full_texts(),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", _ISC),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Zlib", _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright( \(c\)| ©)? [^\n]*[0-9]{4}|\(c\) [^\n]*[0-9]{4}|© ?[^\n]*[0-9]{4}|all rights reserved)[^\n]*"
SEPARATORS = r"[ -/:-@\[-`{-~\t-\r]+"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, words parted by single spaces, one spelling for each word."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    spaced = F.btrim(F.regexp_replace(bare, SEPARATORS, " "))
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), SPELLINGS, spaced)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, in hex."""
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id and text of the licences and notices listed here."""
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def known_digests(licenses: DataFrame) -> DataFrame:
    """k_digest and license_id (the least, if several share a text) of licences with a canonical word."""
    named = licenses.select(digest(F.coalesce("text", F.lit(""))).alias("k_digest"), "license_id", canonical(F.col("text")).alias("c"))
    return named.where("c <> ''").groupBy("k_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """Digest and licences of each document.

    ``docs`` has doc_id and text, ``licenses`` license_id and text.  Returns doc_id, digest (of the whole
    canonical text), license_id (the known licence that the whole text is, or null), notices (the known ones
    that single lines are, distinct, sorted, comma-separated; empty for none) and n_notices (lines that are one).
    A null text counts as empty and matches nothing; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are ignored.
    """
    known = small_side(materialize(known_digests(licenses), "license-digests"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = materialize(rows.select("doc_id", F.xxhash64("text").alias("th"), digest(F.col("text")).alias("digest")), "digests")
    units = rows.select("doc_id", F.xxhash64("text").alias("th"), F.explode(F.split("text", "\n")).alias("line"))
    hits = units.select("doc_id", "th", digest(F.col("line")).alias("d")).join(known, F.col("d") == F.col("k_digest"))
    notices = hits.groupBy("doc_id", "th").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices"), F.count("*").alias("lines"))
    copies = marked.groupBy(F.col("doc_id").alias("c_doc"), F.col("th").alias("c_th")).agg(F.count("*").alias("copies"))
    notices = notices.join(copies, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("th") == F.col("c_th")))
    notices = notices.select(F.col("c_doc").alias("_doc"), F.col("c_th").alias("_th"), "notices", F.expr("lines div copies").alias("n_notices"))
    whole = marked.join(known, F.col("digest") == F.col("k_digest"), "left")
    joined = whole.join(notices, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left")
    return joined.select("doc_id", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
