"""Licence scans by canonical digests of entire texts.

A text is normalised (case, punctuation, copyright lines, equivalent spellings, white space) and
its SHA-256 is joined with the digests of known licences. Only a whole text that says what a known
licence says, apart from these differences, matches. The known licences are a small table, a
parameter; up to ``lookup.BROADCAST_IDS`` digests are broadcast, more are joined by shuffle.

Defined cases: null texts and texts without a word after normalising have a null digest and match
nothing; several known licences with one digest give the smallest id; repeated rows match each;
empty tables give no rows; other columns of ``docs`` pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm.lookup import BROADCAST_IDS

#: (pattern, replacement) on lower-cased text, in order. The patterns are plain enough to mean the
#: same in Spark and DuckDB.
RULES = [
    # lines that are notices: "copyright" with a sign, a year or "by", a sign with a year, and reservation
    # lines; not lines of a wrapped text that happen to begin with the word
    (r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9][0-9][0-9][0-9]|by[ \t])|\(c\)[ \t]*(copyright|[0-9][0-9][0-9][0-9])|©)[^\n]*", "\n"),
    (r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*($|\n)", "\n"),
    (r"[‘’ʼ']", ""),
    # equivalent spellings
    (r"licence", "license"), (r"(organi|recogni|authori)s(e|i|ation)", r"\1z\2"),
    (r"favour", "favor"), (r"behaviour", "behavior"), (r"analogue", "analog"),
    (r"(^|[^a-z])(merchantability|merchantibility)([^a-z]|$)", r"\1merchantability\3"),
    (r"non-infringement", "noninfringement"), (r"sub-license", "sublicense"),
    (r"https?://", ""),
    # punctuation and white space
    (r"[^a-z0-9à-öø-ÿ]+", " "),
]


def canonical_text(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(F.nullif(text, F.lit("")).cast("binary"), 256)


#: Known licences (id, text), public texts, and the title lines that their files begin with. Fixed values.
TITLES = {"ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
          "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "Zlib": ["zlib License", "The zlib/libpng License"],
          "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
          "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"]}
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n",
       "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n",
       "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
KNOWN = [
    ("BSD-2-Clause", BSD[0] + BSD[2]),
    ("BSD-3-Clause", "".join(BSD)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("MIT-line", "Released under the MIT License."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
]
KNOWN += [(i, f"{title}\n\n{text}") for i, text in KNOWN for title in TITLES.get(i, ())]


def known_digests(spark: SparkSession, known=None) -> DataFrame:
    """(digest, license_id) of (license_id, text) pairs, by the same normalising."""
    rows = spark.createDataFrame(known or KNOWN, "license_id string, text string")
    return (rows.select(digest(canonical_text(F.col("text"))).alias("digest"), "license_id")
            .filter("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id")))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` (needs ``text``) with ``license_digest`` and ``license_id`` (null: not a known licence).
    Input columns of these names are replaced."""
    docs = docs.drop("license_digest", "license_id").withColumn("license_digest", digest(canonical_text(F.col("text"))))
    known = known.select(F.col("digest").alias("license_digest"), "license_id")
    if known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    return docs.join(known, "license_digest", "left")


def _sql_normal(expr: str) -> str:
    for pattern, to in [(p.replace("'", "''"), t) for p, t in RULES]:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return f"trim({expr})"


def scan_sql() -> str:
    """DuckDB twin of the query over ``documents``."""
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    normal = _sql_normal("lower(text)")
    return f"""with known as (select sha256(n) as digest, min(license_id) as license_id from
  (select license_id, {normal} as n from (values {values}) k(license_id, text)) where n <> '' group by 1),
docs as (select doc_id, nullif({normal}, '') as n from documents)
select doc_id, sha256(n) as license_digest, license_id from docs left join known on known.digest = sha256(n)"""
