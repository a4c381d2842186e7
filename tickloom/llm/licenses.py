"""License scan by canonical digests, in DataFrame functions only.

Known license texts and notices, and what documents hold, are brought to one canonical form: lower case; copyright
lines left out; equivalent spellings made one; punctuation and white space to single spaces. A document is looked up
as a whole, and so is each of its lines, by the SHA-256 digest of the canonical text in a hash join with the known
digests. A unit matches only if all of it is a known text, so quotations inside prose don't count.

Defined cases: null and empty texts have no unit and no license; a null doc_id stays null; rows that share a doc_id,
equal or not, get a row each; a text known under several ids counts for all of them. Other columns are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger tables of known texts are joined by shuffle.
BROADCAST_TEXTS = 100_000

# License ids with texts or usual notices.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        'granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not "
        "be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source "
        "distribution.",
    ),
]

#: Full texts, a file each: license id, then ~ and a number for another wording.
TEXTS = Path(__file__).with_name("license_texts")
# Headings that copies of the short licenses have or leave out.
HEADINGS = {
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["", "ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["", "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["", "zlib License", "The zlib License", "The zlib/libpng License"],
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License"],
    "BSL-1.0": ["", "Boost Software License 1.0"],
    "Unlicense": ["", "The Unlicense"],
}
# Where the terms end and the advice on how to use them begins.
ADVICE = ["APPENDIX: How to apply the Apache License", "How to Apply These Terms to Your New Programs", "How to Apply These Terms to Your New Libraries", "ADDENDUM: How to use this License for your documents"]
# Names in notices.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"], "MIT": ["MIT License"], "ISC": ["ISC License"], "Zlib": ["zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "BSL-1.0": ["Boost Software License, Version 1.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"], "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"], "EPL-2.0": ["Eclipse Public License 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"], "Unlicense": ["Unlicense"],
} | {f"CC-{x}-4.0": [f"CC {x} 4.0"] for x in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")}
IDENTIFIERS = [*NAMES, "0BSD", "CC0-1.0", "NCSA", "Unicode-3.0", "Artistic-1.0-Perl", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "LGPL-2.0", "MPL-1.1"]


def _wordings(license_id: str, text: str) -> list[str]:
    """A full text as copies have it: without the advice at its end, without numbers or owners, under each heading."""
    text = text.replace("<copyright notice>", "")
    out = [text]
    for mark in ADVICE:
        out += [text[: text.index(mark)]] if mark in text else []
    if "Copyright [yyyy] [name of copyright owner]" in text:
        out.append(text.replace("Copyright [yyyy] [name of copyright owner]", ""))  # filled in, it is a copyright line
    if license_id == "BSD-2-Clause":
        out += [text.replace("HOLDER OR", "OWNER OR"), text.replace("HOLDER OR", "HOLDERS OR")]
    if license_id in ("BSD-2-Clause", "BSD-3-Clause"):
        out += [x.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ") for x in out]
    headings = HEADINGS.get(license_id, [""])
    for h in headings:
        out = [x.partition("\n")[2] if h and x.partition("\n")[0].strip() == h else x for x in out]
    return [f"{h}\n\n{x}" if h else x for x in out for h in headings]


def _catalogue() -> list[tuple[str, str]]:
    full = [(f.stem.partition("~")[0], f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    disclaimer = "THIS SOFTWARE IS PROVIDED BY"
    for text in [t for i, t in full if i == "BSD-2-Clause"]:
        third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
        full += [("BSD-3-Clause", x.replace(disclaimer, third + disclaimer)) for x in (text, text.replace("HOLDER OR", "OWNER OR"), text.replace("HOLDER OR", "HOLDERS OR"))]
    full += [(i, t) for i, t in KNOWN if len(t) > 200]
    notices = [(i, f"{verb} the {n}." if "License" in n or "Unlicense" in n else f"{verb} {n}.") for i, names in NAMES.items() for n in names
               for verb in ("Licensed under", "Released under", "This work is licensed under", "This project is licensed under", "Distributed under")]
    suffixes = lambda i: ["", "-only", "-or-later", "+"] if "GPL" in i or "GFDL" in i else [""]
    spdx = [(i, f"SPDX-License-Identifier: {i}{x}") for i in IDENTIFIERS for x in suffixes(i)]
    return list(dict.fromkeys([*KNOWN, *((i, x) for i, t in full for x in _wordings(i, t)), *notices, *spdx]))


# Spellings that count as equal, applied to lower-case text in this order.
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("merchantibility", "merchantability"),
    ("favour", "favor"), ("judgement", "judgment"), ("whilst", "while"), ("wilful", "willful"), ("https:", "http:"),
    ("(c)", "©"), ("&", " and "),
]
KNOWN = _catalogue()
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright[ \t]*(©|[0-9])|©|all rights reserved)[^\n]*$"

SEPARATORS = "[^a-z0-9+]+"


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    return F.trim(F.regexp_replace(out, SEPARATORS, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """digest and ids of a table of license texts (license_id, text)."""
    rows = known.where(canonical(F.col("text")) != "").select(digest(F.col("text")).alias("digest"), "license_id")
    return rows.groupBy("digest").agg(F.array_sort(F.collect_set("license_id")).alias("ids"))


def known_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, whole_license, n_notices (lines that are a known text), license_ids, text_digest.

    License ids are comma-joined in order; without a match they are empty. ``text_digest`` is that of the whole text.
    """
    table = known_digests(known if known is not None else known_texts(docs.sparkSession))
    few = known is None or table.count() <= BROADCAST_TEXTS
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"), digest(F.col("text")).alias("text_digest"))
    # a line can only be a known text if it isn't the whole document
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    units = F.when(F.instr("text", "\n") > 0, F.transform(lines, lambda x: digest(x))).otherwise(F.array().cast("array<string>"))
    probes = rows.select("row", "doc_id", "text_digest", F.posexplode(F.concat(F.array("text_digest"), units)).alias("at", "digest"))
    found = probes.join(F.broadcast(table) if few else table, "digest", "left").where("at = 0 or ids is not null")
    whole = F.when(F.col("at") == 0, F.array_join("ids", ","))
    out = found.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("at") == 0, F.col("text_digest"))).alias("text_digest"),
        F.coalesce(F.max(whole), F.lit("")).alias("whole_license"),
        F.count(F.when((F.col("at") > 0) & F.col("ids").isNotNull(), 1)).alias("n_notices"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("all_ids"),
    )
    return out.select("doc_id", "whole_license", "n_notices", F.array_join("all_ids", ",").alias("license_ids"), "text_digest")
