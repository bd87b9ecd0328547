"""License scans by canonical digest, in DataFrame functions alone.

A text is brought to a canonical form: lower case, lines that state a copyright
left out, everything but letters and digits as one blank, spellings that license
lists hold equal made one. The digest of the entire form is joined to those of
known license texts (of ids with the same digest, the first by name), and the digest of each line's form is looked up among those
of known texts and notices. There is no shuffle: the known digests are a list of
fixed length in this module, so they are broadcast.

Defined cases: a null text is empty; a text without letters or digits has no
digest and matches nothing. Very long texts are read whole. Repeated rows get
the same answer each. An empty table gives an empty result. Other columns are
not returned.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal; the first becomes the second.
SPELLINGS = {
    "licence": "license", "licenced": "licensed", "sub license": "sublicense", "sublicence": "sublicense", "copyright holder": "copyright owner",
    "copyright holders": "copyright owners", "organisation": "organization", "non infringement": "noninfringement",
    "fulfil": "fulfill", "whilst": "while", "modelled": "modeled", "favour": "favor", "behaviour": "behavior", "centre": "center", "programme": "program", "version 2 0": "version 2", "version 3 0": "version 3",
}

# Names by which notices call a license.
NAMES = {
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause", "the 3-Clause BSD License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "ISC": ["the ISC License", "ISC"],
    "GPL-2.0": ["the GNU General Public License, version 2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GPL-3.0", "GPLv3"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Unlicense": ["the Unlicense"],
}
NOTICES = ["Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "Available under {}.", "License: {}", "SPDX-License-Identifier: {}"]

# Whole texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "All-Rights-Reserved": "All rights reserved.",
}

# Whole texts beside those that the SQL lists; the long ones are files.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_NO_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MORE_TEXTS = {
    "BSD-2-Clause": _BSD + _AS_IS,
    "BSD-3-Clause": _BSD + _NO_NAMES + _AS_IS,
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
}
LONG_TEXTS = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

# Title lines of texts that do not hold their title.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"], "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "Unlicense": ["The Unlicense", "Unlicense"],
}


#: Lines that state a holder: with a year anywhere, or without one where they begin with the word and the sign.
_HOLDER = r"(?m)^(?:[^\n]*(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©)?[ \t]*[0-9]{4}|[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©)|©))[^\n]*$"


def whole_texts() -> list[tuple[str, str]]:
    """(license_id, text) of each known entire text: with and without title, appendix, 'All rights reserved.' and lines left open for a holder."""
    out = [("All-Rights-Reserved", TEXTS["All-Rights-Reserved"])]
    for k, t in [*TEXTS.items(), *MORE_TEXTS.items()]:
        for title in ["", *TITLES.get(k, [])]:
            out += [(k, f"{title}\n{said}\n{t}") for said in ("", "All rights reserved.")] if k in TITLES else []
        if k == "Unlicense":  # the older address
            out += [(k, f"{title}\n{t.replace('https://unlicense.org', 'http://unlicense.org/')}") for title in ["", *TITLES[k]]]
    for k, t in LONG_TEXTS.items():
        paragraphs = re.split(r"\n[ \t]*\n", t.strip("\n"))
        for n in range(3 if k == "CC0-1.0" else 2):  # paragraphs that are the title
            rest = "\n\n".join(paragraphs[n:])
            short = re.split(r"(?m)^[ \t]*(?:APPENDIX: )?How to apply (?:these terms|the apache license)", rest, flags=re.I)[0]
            out += [(k, x) for x in dict.fromkeys((rest, re.sub(r"(?m)^[ \t]*Copyright \[yyyy\].*$", "", rest), short, re.sub(r"END OF TERMS AND CONDITIONS\s*$", "", short)))]
    return out



def canonical(rows: DataFrame, text: str, form: str = "form") -> DataFrame:
    """rows with the canonical form, its lines kept, for the text; what states a copyright holder goes with its line."""
    rows = rows.withColumn(form, F.lower(F.coalesce(F.col(text), F.lit("")))).drop(*[text] * (text != form))
    low = F.col(form)
    signed = low.contains("copyright") | low.contains("(c)") | low.contains("©")  # else no line states a holder
    rows = rows.withColumn(form, F.when(signed, F.regexp_replace(low, _HOLDER, "")).otherwise(low))
    rows = rows.withColumn(form, F.regexp_replace(form, r"[^\p{L}\p{N}\n]+", " "))
    out = F.col(form)
    for a, b in SPELLINGS.items():
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return rows.withColumn(form, F.when(F.col(form).rlike(rf"\b(?:{'|'.join(SPELLINGS)})\b"), out).otherwise(F.col(form)))


def digest(form: Column) -> Column:
    """Digest of a form with its line ends as blanks; null if nothing is left of it."""
    flat = F.trim(F.regexp_replace(form, r"[ \n]+", " "))
    return F.when(flat != "", F.md5(flat.cast("binary")))


def whole_digest(form: Column) -> Column:
    """Digest of a form as if it were one line: spellings that a line end parts are made one too."""
    parted = {a: b for a, b in SPELLINGS.items() if " " in a}
    flat = F.trim(F.regexp_replace(form, r"[ \n]+", " "))
    for a, b in parted.items():
        flat = F.regexp_replace(flat, rf"\b{a}\b", b)
    gap = r"(?: |[ \n]*\n[ \n]*)"
    return F.when(form.contains("\n") & form.rlike(rf"\b(?:{'|'.join(a.replace(' ', gap) for a in parted)})\b"), F.md5(flat.cast("binary"))).otherwise(digest(form))


def known(spark: SparkSession) -> DataFrame:
    """digest, license_id and whole (a text, not a notice): one row a digest, of a list of fixed length."""
    rows = [(k, v, True) for k, v in whole_texts()] + [(k, n.format(name), False) for k, names in NAMES.items() for name in names for n in NOTICES]
    table = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text"), F.lit(w).alias("whole")) for k, t, w in rows])))
    out = canonical(table, "text").select("license_id", "whole", whole_digest(F.col("form")).alias("digest"))
    return out.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.max("whole").alias("whole"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, digest of the entire text, license_id that it is, and notices: the licenses that a line of it is a text or notice of, sorted."""
    spark = docs.sparkSession
    pairs = sorted((r.digest, r.license_id) for r in known(spark).where("digest is not null").collect())  # as long as the lists above
    lookup = F.map_from_arrays(F.lit([d for d, _ in pairs]), F.lit([x for _, x in pairs]))
    rows = canonical(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text")
    lines = F.transform(F.filter(F.split("form", "\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.try_element_at(lookup, F.md5(F.trim(x).cast("binary"))))
    rows = rows.select("doc_id", digest(F.col("form")).alias("digest"), whole_digest(F.col("form")).alias("_whole"), F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.isNotNull()))).alias("notices"))
    whole = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(d).alias("k"), F.lit(x).alias("license_id")) for d, x in pairs])))
    return rows.join(F.broadcast(whole), rows["_whole"] == whole["k"], "left").select(F.col("doc_id").alias(key), "digest", "license_id", "notices")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def _oracle() -> str:
    def form(x: str) -> str:
        x = f"lower(coalesce({x}, ''))"
        x = f"regexp_replace({x}, '{_HOLDER}', '', 'g')"
        x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
        for a, b in SPELLINGS.items():
            x = rf"regexp_replace({x}, '\b{a}\b', '{b}', 'g')"
        return x

    rows = [(k, v) for k, v in TEXTS.items()] + [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in rows)
    flat = r"trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"
    return f"""
with known as (select md5(form) as digest, min(id) as license_id from (select id, {flat.format(form("t"))} as form from (values {values}) v(id, t)) group by 1),
forms as (select row_number() over () as row_id, doc_id, {form("text")} as form from documents),
flat as (select row_id, doc_id, {flat.format("form")} as flat from forms),
lines as (select row_id, md5(trim(unnest(string_split(form, chr(10))))) as digest from forms),
found as (select row_id, string_agg(distinct license_id, ',' order by license_id) as notices from lines join known using (digest) group by row_id)
select doc_id, case when flat <> '' then md5(flat) end as digest, license_id, coalesce(notices, '') as notices
from flat left join known on known.digest = md5(flat.flat) and flat <> '' left join found using (row_id)
"""


ORACLE = _oracle()
