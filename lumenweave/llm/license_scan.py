"""Licence scans by canonical digest: whole texts, normalised, are hash-joined to known licences.

Normalising lower-cases, drops copyright notices (those that a known text holds itself, wherever
they stand and however they are broken; and any line that begins with the word or sign and goes
on with a year, a sign, a placeholder or a holder, or is but the word and a name of at most six
words; a line of a licence's body that only begins with the word stays), turns comment marks and punctuation into spaces, rewrites
equivalent spellings word by word and leaves the blanks out, so that "sub-license" and
"sublicense", or a word cut at a line's end, are the same. Two texts that differ only in these
have one digest, however they are wrapped. Only DataFrame functions are used.

The catalogue is a table of texts that the caller may pass: known_texts() gives short licences
and notices written out below and the full texts in the folder licenses. A document matches if
its whole text is a known one; a notice at the end of other text is none.

Edge cases: a null or empty text, and one of punctuation only, has an empty normal form and
matches nothing; a null doc_id is returned as it is; repeated rows are each returned; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import documents, table

# Spellings that count as the same, from the public matching guidelines for licence lists.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("owner", "holder"), ("owners", "holders"),
]

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = f"{_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_AS_IS}"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."

# The known texts, by licence identifier; also the one-line notices that name a licence.
KNOWN = [
    ("MIT", _MIT), ("MIT", f"MIT License\n{_MIT}"), ("MIT", f"The MIT License (MIT)\n{_MIT}"), ("MIT", "Released under the MIT License."),
    ("MIT-0", f"{_GRANT}.\n{_AS_IS}"), ("MIT-0", f"MIT No Attribution\n{_GRANT}.\n{_AS_IS}"),
    ("ISC", f"{_ISC}\n{_ISC_END}"), ("ISC", f"ISC License\n{_ISC}\n{_ISC_END}"), ("0BSD", f"{_ISC.split(', provided')[0]}.\n{_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD_1}\n{_BSD_END}"), ("BSD-3-Clause", f"{_BSD_1}\n{_BSD_3}\n{_BSD_END}"), ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

_YEAR = r"(?:19|20)[0-9][0-9]"
_HOLDER = r"by[ \t]|the [^\n\r]*(?:authors|contributors|developers|project|team|foundation)|(?:[a-z.&-]+[ \t,]+){1,5}" + _YEAR
#: What follows a line's end (or the text's start) where the line is a copyright notice, and what is neither letter nor digit. Java's and RE2's patterns read both alike.
NOTICE = (
    r"[ \t#*/;!%>|-]*(?:copyright[ \t]*(?::|,?[ \t]*(?:\(c\)|©|&copy;|[<\[{]|" + _YEAR + "|" + _HOLDER + r"))"
    r"|\(c\)[ \t]*(?:copyright|" + _YEAR + r"|[<\[{])|©|&copy;|all rights reserved)[^\n\r]*"
)
# Words that no holder's name has, which follow "copyright" at the start of lines of licence bodies.
NO_NAMES = (
    "a act also an and any applicable are as at be but by can claim claims conditions contained covered disclaimer disclaimers does doctrines for from has have holder holders if in including infringement interest interests is it its law laws"
    " legend license licensed licenses licence licences licensee licensor list made material materials may must no not notice notices of on or other over owned owner owners ownership permission permissions portion prior protected protection resulting right"
    " rights section shall similar so software statement statements status such terms that the their this those through to treaty treaties under unless use was when which will with within work works you your"
).split()
#: What follows a line's end where the line is the word and a holder's name of at most six words (Java's pattern alone: it looks ahead).
_PLAIN = r"[ \t#*/;!%>|-]*copyright[ \t]+(?:(?!(?:" + "|".join(NO_NAMES) + r")\b)[^\s]+[ \t]*){1,6}(?=[\n\r]|\z)"
#: Single characters as far as one table of bits holds them, which patterns look up at once; ranges beyond.
MARKS = "".join(rf"\x{i:02X}" for i in (*range(0x80), *range(0xA0, 0xC0)) if not (chr(i).isascii() and chr(i).isalnum()) and i not in (10, 13)) + r"\x{2010}-\x{2027}\x{3000}"


@lru_cache(maxsize=1)
def known_texts() -> list[tuple[str, str]]:
    """The catalogue's own rows: licence identifier and text."""
    folder = resources.files("lumenweave.llm") / "licenses"
    full = sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in folder.iterdir() if f.name.endswith(".txt"))
    return [*KNOWN, *full]


@lru_cache(maxsize=1)
def inner_notices() -> str:
    """A pattern of the notices that known texts themselves hold (lines of theirs), word by word, so that they are found however they are broken over lines."""
    lines = {m[0] for _, t in known_texts() for m in re.finditer(rf"(?m)^{NOTICE}", t.lower())}
    phrases = {tuple(w.removesuffix("s") if w == "https" else w for w in re.findall(r"[a-z0-9]+", line)) for line in lines}
    some = sorted((p for p in phrases if len(p) > 3 and p[0] == "copyright"), key=lambda p: (-len(p), p))
    between = r"[^a-z0-9]+"
    return r"\bcopyright(?:" + "|".join(between + between.join("https?" if w == "http" else w for w in p[1:]) for p in some) + r")\b[.>]*"


def normal_form(text: Column) -> Column:
    x = F.concat(F.lit("\n"), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), inner_notices(), " "))
    words = F.split(x, rf"[{MARKS}]+|[\n\r](?:{NOTICE}|{_PLAIN})?")
    same = F.create_map(*(F.lit(w) for pair in EQUIVALENT for w in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(same[w], w)), "")


def catalogue(spark: SparkSession, known=None) -> DataFrame:
    """Digests of the known texts (license_id, text), one row each; its size is the size of that list."""
    texts = spark.createDataFrame(known_texts() if known is None else list(known), "license_id string, text string")
    found = texts.select("license_id", F.sha2(normal_form(F.col("text")), 256).alias("digest"))
    return found.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars of the normal form, digest (null if that is empty), license_id (null if not known)."""
    form = documents(docs).select("doc_id", normal_form(F.col("text")).alias("form"))
    dug = form.select("doc_id", F.length("form").cast("long").alias("n_chars"), F.when(F.col("form") != "", F.sha2("form", 256)).alias("digest"))
    return dug.join(known, "digest", "left").select("doc_id", "n_chars", "digest", "license_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), catalogue(spark))


def _sql() -> str:
    """Notices are found line by line: a line's words beside a list, where the operator's pattern looks ahead."""
    quoted = lambda rows: ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in rows)
    no_names = ", ".join(f"'{w}'" for w in NO_NAMES)
    return f"""
WITH same(other, one) AS (VALUES {quoted(EQUIVALENT)}),
t AS (SELECT row_number() OVER () AS rid, * FROM (
  SELECT false AS is_known, doc_id, NULL AS license_id, text FROM documents
  UNION ALL SELECT true, NULL, * FROM (VALUES {quoted(known_texts())}) k(license_id, text))),
l AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS row FROM (SELECT rid, regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '{inner_notices()}', ' ', 'g'), '[\\n\\r]') AS lines FROM t)),
n AS (SELECT *, regexp_replace(line, '^{NOTICE}', '') AS rest, list_filter(string_split_regex(regexp_extract(line, '^[ \\t#*/;!%>|-]*copyright[ \\t]+(.*)$', 1), '[ \\t]+'), lambda w: w <> '') AS name FROM l),
k AS (SELECT rid, row, CASE WHEN len(name) BETWEEN 1 AND 6 AND len(list_filter(name, lambda w: regexp_extract(w, '^[a-z0-9_]*') IN ({no_names}))) = 0 AND NOT contains(regexp_extract(line, 'copyright[ \\t]+(.*)$', 1), chr(12)) THEN '' ELSE rest END AS line FROM n),
w AS (SELECT rid, string_split(trim(regexp_replace(string_agg(line, chr(10) ORDER BY row), '[\\n\\r{MARKS}]+', ' ', 'g')), ' ') AS words FROM k GROUP BY rid),
one_word AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS nth FROM w),
f AS (SELECT rid, string_agg(coalesce(one, word), '' ORDER BY nth) AS form FROM one_word LEFT JOIN same ON word = other GROUP BY rid),
d AS (SELECT t.*, CAST(length(form) AS BIGINT) AS n_chars, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM t JOIN f USING (rid)),
known AS (SELECT digest, min(license_id) AS license_id FROM d WHERE is_known GROUP BY 1)
SELECT d.doc_id, d.n_chars, d.digest, known.license_id FROM d LEFT JOIN known ON d.digest = known.digest WHERE NOT is_known
"""


QUERIES = {"op10_license_scan": op10_license_scan}
SQL = {"op10_license_scan": _sql()}
