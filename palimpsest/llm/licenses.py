"""Licence texts in a corpus, by digests of canonical texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, each written as its second form wherever it stands (fixed values).
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("recognised", "recognized"),
    ("fulfil ", "fulfill "),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
]

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.\n"
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Known licence texts and notices (fixed values), the years and holders left out as any copyright line goes.
KNOWN = {
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software.\n\n" + _AS_IS,
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END,
    "BSD-2-Clause": _BSD_START + "1. " + _BSD_1 + "2. " + _BSD_2 + _BSD_END,
    "BSD-3-Clause": _BSD_START + "1. " + _BSD_1 + "2. " + _BSD_2 + "3. " + _BSD_3 + _BSD_END,
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, "
    "please refer to <https://unlicense.org>",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy "
    'of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the '
    "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
    "following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
    "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative "
    "works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES "
    "OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
    "of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
    "it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any "
    "source distribution.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the "
    'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
    "governing permissions and limitations under the License.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
    "for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}


_OTHER = r"[^\p{L}\p{N}]"
_MARK = rf"(?:{_OTHER}*(?:copyright|©|c\)))+"
#: A line of small letters that may state a copyright: marks and a year, or a place for one, and what follows; marks, a
#: holder and a year at the end; the sign and a holder of five words at most; or the rights reserved.
_STATEMENT = (
    rf"^(?:{_MARK}{_OTHER}*(?:[0-9]{{4}}|year|yyyy)(?:{_OTHER}.{{0,120}})?|{_MARK}{_OTHER}+.{{1,100}}[ ,](?:19|20)[0-9]{{2}}{_OTHER}*"
    rf"|{_OTHER}*(?:©|copyright{_OTHER}*(?:©|c\))){_OTHER}*(?:[\p{{L}}\p{{N}}]+(?:{_OTHER}+|$)){{1,5}}|{_OTHER}*all rights reserved{_OTHER}*)$"
)
#: Words of sentences, which no statement of years and a holder has (fixed values).
_SENTENCE = (
    r"(?:^|[^a-z])(?:must|shall|should|would|cannot|could|is|are|was|were|be|been|has|have|not|no|any|if|pay|paid|use|used|using|permitted|granted|provided|required|subject|"
    r"distribute|distributed|copy|copied|modify|modified|notice|notices|permission|fee|fees|terms|conditions|agree|agrees|grant|revoke|lists|holders|owners|users|you|we|they|anyone|"
    r"licensee|licensees)(?:[^a-z]|$)"
)
#: Texts with none of these have no statement.
_MENTION = r"copyright|©|c\)|all rights reserved"
#: A line that is a licence's title.
_TITLE = (
    rf"^{_OTHER}*(?:the )?(?:mit|expat|isc|zlib|zlib/libpng|0bsd|(?:simplified |new |modified |revised )?bsd(?:[ -][23][ -]clause)?|[23][ -]clause bsd) licen[cs]e"
    rf"(?: \((?:mit|expat|isc|zlib|0bsd|bsd[ -]?[23]?(?:[ -]clause)?)\))?{_OTHER}*$"
)
#: Sentences that name a holder, in words parted by single spaces, and what is written for them (fixed values).
_HOLDERS = [
    (r"neither the names? of (?:[\p{L}\p{N}]+ ){1,12}?nor the names of (?:its|their|the) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"provided by (?:[\p{L}\p{N}]+ ){1,12}?and contributors as is", "provided by the copyright holders and contributors as is"),
    (r"in no event shall (?:[\p{L}\p{N}]+ ){1,12}?or contributors be liable", "in no event shall the copyright holder or contributors be liable"),
]
#: What numbers the items of a list.
_ITEM = r"^[^\n\p{L}\p{N}]*(?:[0-9]{1,2}|[a-z])[.)][ \t]+"
_MARKS = r"[^\p{L}\p{N}]+"
#: Lines that may be a notice.
_WORD = "licen[cs]e"


def canonical(text: Column) -> Column:
    """Lower case without copyright statements, titles, list marks and punctuation, words parted by single spaces, equivalent
    spellings made one, and holders that a sentence names written as one.

    A line is a statement if it has marks, years and a holder alone; one with a word of a sentence is a part of the text."""
    out = F.lower(F.coalesce(text, F.lit("")))
    matches = lambda line, p: F.rlike(line, F.lit(p))
    kept = F.filter(F.split(out, "\n", -1), lambda line: ~matches(line, _TITLE) & (~matches(line, _STATEMENT) | matches(line, _SENTENCE)))
    out = F.when(matches(out, f"{_MENTION}|licen[cs]e"), F.array_join(kept, "\n")).otherwise(out)
    for pattern, to in (("(?md)" + _ITEM, ""), (_MARKS, " ")):
        out = F.regexp_replace(out, pattern, to)
    out = F.trim(out)
    for pattern, to in _HOLDERS:
        out = F.regexp_replace(out, pattern, to)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN.items()), "license_id string, license_text string")


def scan_licenses(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with (canonical_sha256, license_id, notices): the digest of each whole canonical text, the licence that
    has it, and the licences that are a whole line of the text.

    ``known`` has (license_id, license_text).  A text that is no known licence, a null or an empty one has a null
    ``license_id``; of licences with equal canonical texts the least id counts, and one whose canonical text is empty
    never does.  ``notices`` holds the distinct ids, in order, of lines with the word licence whose own digest is known;
    it is empty if there are none.  Repeated rows stay; other columns pass, but for the new ones, which are replaced;
    an empty table gives an empty one.

    Licences are hashed by the same expressions and joined by equality of digests; the join is left to Spark, which
    broadcasts the known ones only below its size threshold.  Lines look their digests up in a map of the known ones,
    whose size is that of the list of licences and does not grow with the corpus.
    """
    empty = F.sha2(F.lit(""), 256)
    digests = known.select(F.sha2(canonical(F.col("license_text")), 256).alias("canonical_sha256"), "license_id").filter(F.col("canonical_sha256") != empty)
    digests = digests.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    lookup = digests.agg(F.map_from_entries(F.collect_list(F.struct("canonical_sha256", "license_id"))).alias("m")).scalar()
    docs = docs.drop("canonical_sha256", "license_id", "notices", "_known").withColumn("_known", lookup)
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: F.rlike(line, F.lit("(?i)" + _WORD)))
    found = F.transform(lines, lambda line: F.element_at("_known", F.sha2(canonical(line), 256)))
    notices = F.when(F.rlike(F.col(text), F.lit("(?i)" + _WORD)), F.array_sort(F.array_distinct(F.array_compact(found)))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn("canonical_sha256", F.sha2(canonical(F.col(text)), 256)).withColumn("notices", notices).drop("_known")
    return docs.join(digests, "canonical_sha256", "left")


def canonical_sql(text: str) -> str:
    """``canonical`` as DuckDB SQL."""
    out = f"lower(coalesce({text}, ''))"
    out = f"array_to_string(list_filter(string_split({out}, chr(10)), lambda line: NOT regexp_matches(line, '{_TITLE}') AND (NOT regexp_matches(line, '{_STATEMENT}') OR regexp_matches(line, '{_SENTENCE}'))), chr(10))"
    for pattern, to in (("(?m)" + _ITEM, ""), (_MARKS, " ")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    out = f"trim({out})"
    for pattern, to in _HOLDERS:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
    return f"""
        WITH k AS (
            SELECT sha256({canonical_sql('t')}) AS canonical_sha256, min(l) AS license_id FROM (VALUES {rows}) AS v(l, t) GROUP BY 1
        ), d AS (
            SELECT doc_id, sha256({canonical_sql('text')}) AS canonical_sha256, row_number() OVER () AS r,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '(?i){_WORD}')) AS lines
            FROM documents
        ), n AS (
            SELECT r, list_sort(list(DISTINCT license_id)) AS notices
            FROM (SELECT r, unnest(lines) AS x FROM d WHERE len(lines) > 0) JOIN k ON k.canonical_sha256 = sha256({canonical_sql('x')}) GROUP BY r
        )
        SELECT doc_id, canonical_sha256, license_id, array_to_string(coalesce(notices, []), ',') AS notices FROM d LEFT JOIN k USING (canonical_sha256) LEFT JOIN n USING (r)"""
