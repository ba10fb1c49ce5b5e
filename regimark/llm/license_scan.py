"""License scans: canonical digest lookup.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation and spaces) and
its digest is joined to the digests of known licences, canonical in the same way. The unit looked up is a
whole document and, so that notices inside documents are found, each whole line of it. DataFrame operations
only; the known digests are a parameter of checked size.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above so many known texts the lookup shuffles.
BROADCAST_LICENSES = 50_000

# Equivalent spellings of words, and of words in a row, each with the one that stands for it.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "cancelled": "canceled", "centre": "center", "favour": "favor", "favourite": "favorite", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize",
    "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed",
    "merchantibility": "merchantability", "offence": "offense", "organisation": "organization", "organisations": "organizations", "programme": "program",
    "realise": "realize", "recognise": "recognize", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
PHRASES = {
    "copyright holder": "copyright owner", "copyright holders": "copyright owners", "non commercial": "noncommercial", "non infringement": "noninfringement", "per cent": "percent",
    "sub license": "sublicense", "sub licensed": "sublicensed",
}
#: What may follow a copyright line and belongs to it: more of those who hold it, and a rights line, a blank one before it or not.
COPYRIGHT_MORE = (
    r"(?i:(?:\n[ \t*#/;>]*and [^\n]{0,30}(?:contributors|others)[.]?[ \t\r]*$)?"
    r"(?:[ \t\r]*\n(?:[ \t*#/;>\r]*\n)?[ \t*#/;>]*all rights reserved[.]?[ \t\r]*$)?)"
)
#: A line with a copyright sign, or the word, and then a year or a place for one; other lines that begin with the word stay.
COPYRIGHT_LINE = (
    r"(?m)^[ \t*#/;>]*(?:portions[ \t]+)?(?:(?:©|\(c\))[ \t]*(?:copyright[ \t:]*)?[<\[]?(?:year|yyyy|(?:19|20)[0-9]{2})|copyright[ \t:]*(?:\(c\)|©)"
    r"|copyright[ \t:]+[<\[]?(?:year|yyyy|(?:19|20)[0-9]{2})|copyright[ \t:]+[^\n,]{1,60},[ \t]*(?:19|20)[0-9]{2}[.]?[ \t\r]*$)[^\n]*$"
) + COPYRIGHT_MORE
#: A line of the word and names alone, told by their capitals, before case is folded: no sentence of a licence is such a line.
COPYRIGHT_NAMES = r"(?m)^[ \t*#/;>]*(?:[Pp]ortions[ \t]+)?Copyright[ \t:]+[A-Z][a-z'.-]+(?:,?[ \t]+(?:and|[A-Z][A-Za-z'.-]*))+[.]?[ \t\r]*$" + COPYRIGHT_MORE

# Known notices and licence texts; those in files, of which notices follow, are added below.
LICENSES = {
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "All rights reserved": "All rights reserved.",
    "MIT notice": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

LICENSES["0BSD"] = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + LICENSES["ISC"].partition("\n")[2]
LICENSES["Zlib"] = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
LICENSES["BSL-1.0"] = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

# Headings that these texts have or not.
HEADINGS = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License"), "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"), "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "Zlib": ("zlib License", "The zlib License"),
}

# How notices begin, how they name each licence, and the identifiers that they give.
NOTICES = ("Licensed under", "Released under", "Distributed under", "Available under", *(f"This {x} is licensed under" for x in ("work", "project", "software", "file", "document")))
NOTICE_NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License"),
    "BSD": ("the BSD License", "a BSD-style license"),
    "ISC": ("the ISC License",),
    "MIT": ("the MIT License", "the terms of the MIT License", "MIT"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0"),
    "Unlicense": ("the Unlicense",),
    **{f"{k}-{v}": tuple(x for n in (name, k) for x in (f"the {n}, version {v}", f"the {n}, version {v[:1] if v[2:] == '0' else v}", f"the {n} v{v}", f"the {n} v{v[:1]}" if v[2:] == "0" else f"{n} {v}"))
       for k, name, vs in (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",))) for v in vs},
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"a Creative Commons {name} {v} International License", f"the Creative Commons {name} {v} International License", f"Creative Commons {name} {v}")
       for v in ("3.0", "4.0") for k, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    "CC0-1.0": ("CC0", "CC0 1.0", "the Creative Commons CC0 1.0 Universal license"),
}


def _known() -> dict[str, str]:
    """LICENSES with the published texts in licenses/, as they are and with a line a paragraph, and the notices.

    Names of notices end in their number from the second on; of wordings that are alike the first in order counts.
    """
    out = dict(LICENSES)
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        out[path.stem] = text = path.read_text()
        out[f"{path.stem} (a line a paragraph)"] = re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", text)
    for name, headings in HEADINGS.items():
        for k, heading in enumerate(headings, 1):
            out[f"{name} (with heading {k})"] = f"{heading}\n\n{out[name]}"
            out[f"{name} (with heading {k} and rights)"] = f"{heading}\n\nAll rights reserved.\n\n{out[name]}"
    for name, wordings in NOTICE_NAMES.items():
        bodies = [f"{begin} {x}." for x in wordings for begin in NOTICES] + [f"SPDX-License-Identifier: {name}{x}" for x in ("", "-only", "-or-later")]
        for k, body in enumerate(bodies, 1):
            out[f"{name} notice {k:02}"] = body
    return out


LICENSES = _known()


def canonical(text: Column) -> Column:
    """Lower case; no copyright lines; letters and digits in words, one space between, one spelling; lines kept."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_NAMES, "")
    out = F.regexp_replace(F.lower(out), COPYRIGHT_LINE, "")
    # Each word between two spaces of its own, so that words in a row are all replaced.
    out = F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", "  "), r"\n", " \n ")
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for other, usual in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.regexp_replace(_phrased(out), " +", " ")


def _phrased(text: Column) -> Column:
    for other, usual in PHRASES.items():
        text = F.replace(text, F.lit(" " + other.replace(" ", "  ") + " "), F.lit(" " + usual.replace(" ", "  ") + " "))
    return text


def one_line(text: Column) -> Column:
    """A canonical text as one line of words; words in a row are now also spelled over line breaks."""
    out = F.concat(F.lit(" "), F.regexp_replace(text, r"[ \n]+", "  "), F.lit(" "))
    return F.trim(F.regexp_replace(_phrased(out), " +", " "))


def license_scan(docs: DataFrame, licenses: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_digest, license, notices of every row of docs.

    text_digest: SHA-256 of the whole canonical text; license: the known licence that the whole text is, or
    null; notices: sorted names of known texts that some whole line is, joined by `; `, or empty. Of names
    with one digest the first in order counts. Null and empty texts have the digest of the empty text, which
    no licence has. Rows that repeat an id with another text stay apart by digest; equal rows stay repeated.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list((LICENSES if licenses is None else licenses).items()), "name string, body string")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    known = known.select("name", one_line(canonical(F.col("body"))).alias("line")).filter("line <> ''")
    bounded = F.broadcast if known.count() <= BROADCAST_LICENSES else (lambda df: df)
    # Lines that no known text can be aren't hashed: others have the length and the beginning of one.
    begin = lambda c: F.concat(F.length(c).cast("string"), F.lit(" "), F.substring(c, 1, 24))
    begins = [r[0] for r in known.select(begin(F.col("line"))).distinct().collect()]  # of a bounded parameter
    known = known.groupBy(digest(F.col("line")).alias("known")).agg(F.min("name").alias("name"))

    texts = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x: F.trim(x))
    candidates = F.array_distinct(F.filter(lines, lambda x: begin(x).isin(begins)))
    units = texts.select(id_col, digest(one_line(F.col("t"))).alias("text_digest"), F.transform(candidates, lambda x: digest(x)).alias("found"))
    # "" stands for the row itself, so that each row is in its group as often as it is repeated.
    expanded = units.select(id_col, "text_digest", F.explode(F.array_union(F.array(F.lit("")), F.array_union(F.array("text_digest"), "found"))).alias("unit"), "found")
    joined = expanded.join(bounded(known), F.col("unit") == F.col("known"), "left")
    grouped = joined.groupBy(id_col, "text_digest").agg(
        F.min(F.when(F.col("unit") == F.col("text_digest"), F.col("name"))).alias("license"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.array_contains("found", F.col("unit")), F.col("name")))), "; ").alias("notices"),
        F.sum(F.when(F.col("unit") == "", 1).otherwise(0)).alias("copies"),
    )
    return grouped.select(id_col, "text_digest", "license", "notices", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
