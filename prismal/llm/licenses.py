"""License scans by canonical digest lookup.

A text is normalised: lower case, copyright lines removed, equivalent
spellings made one, quotation marks and all other punctuation dropped, white
space single. Entire known licences and notices are normalised alike, and a
licence is found where some consecutive lines of a text, all of them taken
whole, have the digest of an entire known text. So the file of a licence is
found behind a paragraph of a read-me, however its lines are wrapped, and a
notice within other prose where it has lines of its own.

Not all runs of lines are hashed: a run must begin with the first ANCHOR words
of a known text, which one hash of each line's beginning tells, and has as many
words as that text. Runs that begin like a known text and end with a line are
given their digest, and the digests are joined.

The known texts are a parameter; the default is the notices below and the full
texts in the folder `known`, which are public texts under their SPDX names, fixed values
all of them. Their table is as large as that list. Only hits are aggregated, by
document. The result has one row a document: doc_id, licenses (sorted names),
whole (the name if the entire document is one licence, else null).

Null and empty texts have no licence; rows with a null or repeated id are
treated one by one; of several names for one text the first of the list counts;
a document that is several known texts by turns has all their names; an empty
table gives no rows. A very long text is one array of its words. Only the two
columns that are named are read, so that others can't clash.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismal.llm.common import keyed, shown_id
from prismal.session import stored

#: Spellings that count as one.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("https", "http"), ("favour", "favor"), ("organisation", "organization"), ("per cent", "percent"), ("wilful", "willful"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"), ("&", "and"), ("version 2 0", "version 2"), ("version 3 0", "version 3"), ("v2 0", "version 2"), ("v3", "version 3"))

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MAY = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Fixed values: (name, entire text) of public licences and of the notices that stand for them.
KNOWN = (
    ("MIT", f"MIT License. {_MAY}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT", f"{_MAY}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT-0", f"{_MAY}. {_AS_IS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
)


#: Words by which a known text is first looked up; none has fewer.
ANCHOR = 4
#: Stands for the end of a line while a text is normalised.
EOL = "\u2424"


def known_texts() -> tuple[tuple[str, str], ...]:
    """KNOWN, and the files of the folder `known`: each whole, and up to the end of its terms where an appendix follows."""
    out = list(KNOWN)
    for f in sorted((Path(__file__).parent / "known").glob("*.txt")):
        text = f.read_text(encoding="utf-8", errors="replace")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        out += [(f.stem, text), *([(f.stem, terms), (f.stem, terms + end)] if end else [])]
    return tuple(out)


def normalised(text: Column) -> Column:
    """Words of letters and digits, each followed by one blank, and EOL behind the last of each line."""
    x = F.lower(text)
    x = F.regexp_replace(x, r"(?m)^[^\p{L}\n]*(?:copyright\b|\(c\)|©)(?! holder| notice| owner)[^\n]*$|all rights reserved\.?", " ")
    x = F.regexp_replace(x, "&", " and ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\n]+", " ")
    x = F.concat(F.lit(" "), F.regexp_replace(x, r" *\n[ \n]*", f" {EOL} "), F.lit(f" {EOL} "))
    for other, one in SPELLINGS:
        if other != "&":  # its words may stand on two lines
            first, *rest = other.split(" ")
            x = F.regexp_replace(x, rf"(?<= ){first}" + "".join(f" ((?:{EOL} )?){w}" for w in rest) + r"(?= )", one + "".join(f" ${k}" for k in range(1, len(rest) + 1)) if rest else one)
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _words(normal: Column) -> Column:
    """Array of the words, without the ends of lines."""
    return F.filter(F.split(normal, " "), lambda w: (w != "") & (w != EOL))


def _starts(normal: Column) -> Column:
    """How many words stand before each line, and before the end."""
    pieces = F.transform(F.split(normal, " "), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    ends = F.transform(F.filter(pieces, lambda p: p["w"] == EOL), lambda p, k: p["i"] - k)
    return F.array_distinct(F.concat(F.array(F.lit(0)), ends))


def _anchor(words: Column, at: Column) -> Column:
    return F.xxhash64(*(F.get(words, at + k) for k in range(ANCHOR)))


def _digest(words: Column) -> Column:
    return F.sha2(F.array_join(words, " ").cast("binary"), 256)


def known_digests(spark, known=None) -> DataFrame:
    """(anchor, length, digest, name): as many rows as there are known texts."""
    given = known_texts() if known is None else known
    texts = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(given)], "k int, name string, t string")
    texts = texts.withColumn("_w", _words(normalised(F.col("t"))))
    return texts.groupBy(_anchor(F.col("_w"), F.lit(0)).alias("anchor"), F.size("_w").alias("length"), _digest(F.col("_w")).alias("digest")).agg(F.min(F.struct("k", "name")).alias("_n")).select("anchor", "length", "digest", F.col("_n.name").alias("name"))


#: Every known text has one of these stems, in any spelling; normalising neither makes nor removes one outside copyright lines.
MARK = "(?i)licen[cs]|permission|redistribut"


def scanned(docs: DataFrame, *, known=None, mark: str = MARK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document. `mark` must match every known text; texts without it are not normalised."""
    given = known_texts() if known is None else known
    if any(not re.search(mark, text) for _, text in given):
        raise ValueError("a known text lacks the mark")
    if any(len(re.findall(r"[^\W_]+", text)) < ANCHOR for _, text in given):
        raise ValueError(f"a known text has fewer than {ANCHOR} words")
    table = stored(known_digests(docs.sparkSession, given), "known")
    docs = keyed(docs, id_col, text_col)
    marked = docs.where(F.col("_text").rlike(mark)).select("_id", "_th", normalised(F.col("_text")).alias("_n"))
    # An array of one element: a generator keeps the optimiser from normalising once for every use.
    x = marked.select("_id", "_th", F.explode(F.array(F.struct(_words(F.col("_n")).alias("w"), _starts(F.col("_n")).alias("s")))).alias("_x"))
    begun = x.select("_id", "_th", "_x", F.explode("_x.s").alias("_at")).withColumn("anchor", _anchor(F.col("_x.w"), F.col("_at")))
    runs = begun.join(table, "anchor").where(F.array_contains("_x.s", F.col("_at") + F.col("length")))
    found = (
        runs.where(_digest(F.slice("_x.w", F.col("_at") + 1, F.col("length"))) == F.col("digest"))
        .groupBy("_id", "_th")
        .agg(F.array_sort(F.collect_set("name")).alias("licenses"), F.max(F.when(F.col("length") == F.size("_x.w"), F.col("name"))).alias("whole"))
    )
    every = docs.select("_id", "_th").join(found, ["_id", "_th"], "left")
    return every.select(shown_id(F.col("_id")).alias("doc_id"), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), "whole")


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
