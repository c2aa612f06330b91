"""Licence scans by canonical digest.

A text is brought to a canonical form, in which copies of a licence that differ in case, punctuation,
line breaks, copyright lines and spelling are equal, and its digest is looked up among those of known
licences. Short licences are known with their usual titles, "All rights reserved" lines and bullets; long ones are the
files of ``licence_texts``, with and without their appendix. The units are the whole text, for licence files, and each of its lines, for notices.
"""
import pkgutil
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import lower_ascii, whole

# A copyright line, what punctuation is, and spellings that count as equal (canonical form last).
COPYRIGHT = r"(^|\n)[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by )|\(c\)|©)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’«»–—…•·©®™\x{A0}]+"
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"), ("favour", "favor"), ("behaviour", "behavior"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("e mail", "email"), ("per cent", "percent"), ("web site", "website"), ("wilful", "willful"),
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("centre", "center"), ("initialise", "initialize"), ("labour", "labor"),
    ("utilisation", "utilization"), ("while", "whilst"), ("owner", "holder"), ("owners", "holders"), ("https", "http"), ("ver", "version"), ("v2", "version 2"),
]
_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
             "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
             "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
             "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_TERMS = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
              "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
              "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
              "documentation and/or other materials provided with the distribution. ")
_ISC = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
# Known licences and notices.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("BSD-2-Clause", _BSD_TERMS + _BSD),
    ("BSD-3-Clause", _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                     "from this software without specific prior written permission. " + _BSD),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies. " + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
                   "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
                   "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
                   "the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]
_ZLIB = ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
         "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
         "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
         "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
         "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
         "not be removed or altered from any source distribution.")
# What stands over the text of a short licence.
TITLES = {
    "MIT": ["MIT", "MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT/Expat License", "Expat License"],
    "BSD-2-Clause": ["BSD License", "The BSD License", "BSD 2-Clause", "BSD 2-Clause License", "The BSD 2-Clause License", "2-Clause BSD License",
                     "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD License", "The BSD License", "BSD 3-Clause", "BSD 3-Clause License", "The BSD 3-Clause License", "3-Clause BSD License",
                     "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "The New BSD License", "Modified BSD License",
                     "Revised BSD License"],
    "ISC": ["ISC", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["0BSD", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License", "The BSD Zero Clause License", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["zlib", "zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
}
RESERVED = "All rights reserved."
LONG = ("Apache-2.0", "CC0-1.0", "EPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense")  # files of licence_texts
APPENDIX = "END OF TERMS AND CONDITIONS"  # what follows is left out of some copies
FRANKLIN, TEMPLE = re.compile(r"51\s+Franklin\s+Street,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA"), "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"


def long_text(name: str) -> str:
    """The text of a licence as its author publishes it."""
    return pkgutil.get_data(__name__, f"licence_texts/{name}.txt").decode("utf-8")


def _short_forms(name: str, text: str) -> Iterator[str]:
    """A short licence, with numbered clauses and with other bullets, under each title and with RESERVED beside it."""
    for body in {text, re.sub(r"(?<=[:.;] )[1-3]\. ", "* ", text)}:
        for title in ["", *TITLES[name]]:
            yield from (f"{title}\n{body}", f"{title}\n{RESERVED}\n{body}", f"{RESERVED}\n{title}\n{body}")


def _long_forms(text: str) -> Iterator[str]:
    """A long licence with its author's old address, with a filled-in copyright line, and without its appendix."""
    for one in (text, FRANKLIN.sub(TEMPLE, text)):
        terms, end, rest = one.partition(APPENDIX)
        yield from (one, re.sub(r"Copyright \[yyyy\][^\n]*", "", one), terms + end if rest else one, terms)


def known_texts() -> list[tuple[str, str]]:
    """KNOWN and the usual forms of whole licence files, each once."""
    heads: dict[str, str] = {}
    for name, text in KNOWN:
        if name in TITLES:
            heads.setdefault(name, text)  # the whole text comes before the notices
    heads |= {"Zlib": _ZLIB, "Unlicense": long_text("Unlicense")}
    no_link = heads["Unlicense"].partition("For more information")[0]
    forms = [(name, form) for name, text in heads.items() for form in _short_forms(name, text)]
    forms += [("Unlicense", form) for form in _short_forms("Unlicense", no_link)]
    forms += [(name, form) for name in LONG for form in _long_forms(long_text(name))]
    return list(dict.fromkeys(KNOWN + forms))


KNOWN = known_texts()


def canonical(text: Column) -> Column:
    """Lower case without copyright lines and punctuation, one space between words, one spelling of each word."""
    plain = F.regexp_replace(F.regexp_replace(lower_ascii(text), COPYRIGHT, "$1"), PUNCTUATION, " ")
    out = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = tuple(KNOWN)) -> DataFrame:
    """(digest, licence), each digest once."""
    rows = spark.createDataFrame(list(known), "licence string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, licence of the whole text (null if unknown), n_notices and notices of every row.

    ``notices`` are the distinct licences that lines name, sorted and joined by commas. A null text is empty; an
    empty text has the digest of an empty string and no licence. Repeated rows give a row each; an empty table gives none. Known digests
    join by hash, so their table may be large; texts never leave their row for it, only their digests do.
    """
    rows = documents.select("doc_id", whole().alias("text"))
    table = known.groupBy("digest").agg(F.min("licence").alias("licence"))
    mark = F.monotonically_increasing_id()
    units = rows.select(mark.alias("_row"), "doc_id", digest(F.col("text")).alias("canonical_sha256"),
                        F.transform(F.split("text", "\n"), digest).alias("lines"))
    lines = units.select("_row", "doc_id", "canonical_sha256", F.explode(F.concat(F.array(F.struct(
        F.lit(True).alias("whole"), F.col("canonical_sha256").alias("digest"))), F.transform("lines", lambda x: F.struct(
            F.lit(False).alias("whole"), x.alias("digest"))))).alias("u")).select("_row", "doc_id", "canonical_sha256", "u.whole", "u.digest")
    named = lines.join(table, "digest", "left").where("whole or licence is not null")
    return named.groupBy("_row", "doc_id", "canonical_sha256").agg(
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.count(F.when(~F.col("whole"), F.lit(1))).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))), ",").alias("notices")).drop("_row")


def licence_sql() -> str:
    """The same rows in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    form = f"regexp_replace(regexp_replace({lower}, {quote(COPYRIGHT)}, '\\1', 'g'), {quote(PUNCTUATION)}, ' ', 'g')"
    form = f"concat(' ', trim({form}), ' ')"
    for other, one in SPELLINGS:
        form = f"replace({form}, ' {other} ', ' {one} ')"
    of = lambda column: f"sha256(trim({form.format(column)}))"
    form = form.replace("{4}", "{{4}}").replace("{A0}", "{{A0}}")
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN)
    return f"""
WITH k AS (SELECT {of('t')} AS digest, min(n) AS licence FROM (VALUES {values}) AS v(n, t) GROUP BY ALL),
     d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
     l AS (SELECT r, k.licence FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) JOIN k ON {of('line')} = k.digest),
     a AS (SELECT r, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM l GROUP BY r)
SELECT d.doc_id, {of('d.text')} AS canonical_sha256, k.licence, coalesce(a.n, 0) AS n_notices, coalesce(a.names, '') AS notices
FROM d LEFT JOIN k ON k.digest = {of('d.text')} LEFT JOIN a ON a.r = d.r"""
