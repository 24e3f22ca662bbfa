"""License scans by canonical digests, with DataFrame functions only.

Texts are brought to a canonical form (lower case, no copyright lines, one spelling of equivalent words, no
punctuation, single spaces), and the SHA-256 of a whole text, and of each of its lines, is looked up among the
digests of known license texts by a hash join.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that license matching treats as the same, variant and canonical form, in lower case.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analog", "analogue"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("http", "https"),
)

# Known texts. Notices are the sentences that name a license; version numbers stand as written.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
)
_NOTICES = (
    ("MIT", f"MIT License\nCopyright (c) <year> <copyright holders>\n{_MIT}{_WARRANTY}"),
    ("MIT", f"{_MIT}{_WARRANTY}"),
    ("ISC", f"ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Whole texts, one file per SPDX name.
TEXTS = Path(__file__).with_name("license_texts")
_APPENDIX = re.compile(r"(?<=END OF TERMS AND CONDITIONS).*", re.S)
_BSD_TITLES = {"BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License")}
_PROGRAM = "under the terms of the GNU {name} as published by the Free Software Foundation{sign} {version}.\n"
_NO_WARRANTY = (
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {name} for more details.\n"
)


def _unwrapped(text: str) -> str:
    """Every paragraph on one line: a wrapped line that begins with "copyright" counts as a copyright line."""
    return "\n".join(" ".join(x.split()) for x in re.split(r"\n\s*\n", text))


def _whole_texts() -> list[tuple[str, str]]:
    """The texts of TEXTS, each as it is wrapped there and unwrapped, with and without appendix, titles or numbers."""
    found = []
    for file in sorted(TEXTS.glob("*.txt")):
        name, text = file.stem, file.read_text(encoding="utf-8")
        forms = [text, _APPENDIX.sub("", text)]
        if name in _BSD_TITLES:
            numbers = iter("123")
            numbered = re.sub(r"(?m)^\* ", lambda _: f"{next(numbers)}. ", text)
            forms = [f"{title}\n\n{x}" for x in (text, numbered) for title in ("", *_BSD_TITLES[name])]
        found += [(name, form) for x in forms for form in (x, _unwrapped(x))]
    return list(dict.fromkeys(found))


def _headers() -> list[tuple[str, str]]:
    """The notices that the texts tell to put into source files."""
    apache = (TEXTS / "Apache-2.0.txt").read_text(encoding="utf-8")
    mpl = (TEXTS / "MPL-2.0.txt").read_text(encoding="utf-8")
    found = [
        ("Apache-2.0", apache[apache.rindex("Licensed under the Apache License") :]),
        ("MPL-2.0", mpl[mpl.rindex("This Source Code Form is subject") : mpl.rindex("If it is not possible or desirable")]),
    ]
    for spdx, what, name, version, sign in (
        ("GPL-2.0", "program", "General Public License", "2", ";"),
        ("GPL-3.0", "program", "General Public License", "3", ","),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1", ";"),
        ("LGPL-3.0", "program", "Lesser General Public License", "3", ","),
        ("AGPL-3.0", "program", "Affero General Public License", "3", ","),
    ):
        for kind, versions in (("only", f"version {version} of the License"), ("or-later", f"either version {version} of the License, or (at your option) any later version")):
            grant = f"This {what} is free software: you can redistribute it and/or modify it " + _PROGRAM.format(name=name, sign=sign, version=versions)
            own = grant + _NO_WARRANTY.format(what=what, name=name)
            received = f"You should have received a copy of the GNU {name} along with this {what}"
            found += [(f"{spdx}-{kind}", x) for x in (own, own + f"{received}. If not, see <https://www.gnu.org/licenses/>.")]
            found.append((f"{spdx}-{kind}", own + f"{received}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."))
    return found


def _spdx_lines() -> list[tuple[str, str]]:
    names = {f.stem for f in TEXTS.glob("*.txt")} | {"ISC", "0BSD", "Zlib", "BSL-1.0", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"}
    names |= {f"{x}-or-later" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")} | {"AGPL-3.0-only"}
    return [(name, f"SPDX-License-Identifier: {name}") for name in sorted(names)]


KNOWN = tuple(dict.fromkeys([*_NOTICES, *_spdx_lines(), *_headers(), *_whole_texts()]))

_COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
_ANY_COPYRIGHT = r"copyright|\(c\)|©|all rights reserved"
_PUNCTUATION = r"[^\p{L}\p{N}\n]+"
_VARIANTS = r"(?:^|[ \n])(?:" + "|".join(a for a, _ in SPELLINGS) + r")(?:$|[ \n])"


def canonical(text: Column) -> Column:
    """The canonical form, line by line: words of letters and digits with single spaces, lines as they were."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    low = F.when(low.rlike(_ANY_COPYRIGHT), F.regexp_replace(low, _COPYRIGHT_LINE, "")).otherwise(low)
    plain = F.regexp_replace(low, _PUNCTUATION, " ")
    padded = plain
    for variant, same in SPELLINGS:  # the sign between two words stands for both of their edges
        padded = F.regexp_replace(padded, rf"(^|[ \n]){variant}(?=$|[ \n])", f"$1{same}")
    return F.when(plain.rlike(_VARIANTS), padded).otherwise(plain)


def _whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest, license of known texts (columns license, text); of texts with one canonical form the first name."""
    known = known if known is not None else spark.createDataFrame(KNOWN, "license string, text string")
    whole = known.select("license", _whole(canonical(F.col("text"))).alias("form")).where("form <> ''")
    return whole.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One line per row of docs: doc_id, canonical_sha256, license, line_licenses.

    license is the known license that the whole text is, else null. line_licenses names the known licenses that
    single lines of it are, in order of name, comma-joined, empty if none; a text of one line has both. A text without
    letters and digits is no license. Rows that repeat an id share line_licenses; rows without id have none.
    Null text counts as empty. Further columns are ignored, and an empty table gives no lines.
    """
    digests = known_digests(docs.sparkSession, known)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text")).alias("form"))
    lines = rows.select("doc_id", F.explode(F.split("form", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    named = lines.where("line <> ''").select("doc_id", F.sha2("line", 256).alias("digest")).join(digests, "digest")
    named = named.groupBy("doc_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("license"))).alias("line_licenses"))
    whole = rows.select("doc_id", _whole(F.col("form")).alias("form")).select("doc_id", F.sha2("form", 256).alias("canonical_sha256"))
    found = whole.join(digests, F.col("canonical_sha256") == F.col("digest"), "left").drop("digest")
    return found.join(named, "doc_id", "left").select("doc_id", "canonical_sha256", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def duckdb_sql(table: str = "documents") -> str:
    """The scan over the built-in texts as DuckDB SQL, for comparison."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(text: str) -> str:
        low = f"lower(coalesce({text}, ''))"
        plain = f"regexp_replace(regexp_replace({low}, {quote(_COPYRIGHT_LINE)}, '', 'g'), {quote(_PUNCTUATION)}, ' ', 'g')"
        out = "p"
        for variant, same in SPELLINGS:  # no look-ahead there: signs are doubled first, so that each word has its own
            out = f"regexp_replace({out}, '(^|[ \\n]){variant.replace(' ', '  ')}($|[ \\n])', '\\1{same.replace(' ', '  ')}\\2', 'g')"
        doubled = f"(SELECT regexp_replace({out}, '([ \\n])[ \\n]', '\\1', 'g') FROM (SELECT regexp_replace({plain}, '([ \\n])', '\\1\\1', 'g') AS p))"
        return f"CASE WHEN regexp_matches({plain}, {quote(_VARIANTS)}) THEN {doubled} ELSE {plain} END"

    known = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in KNOWN)
    whole = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    return f"""
    WITH known AS (SELECT sha256({whole(form("text"))}) AS digest, min(license) AS license FROM (VALUES {known}) AS k(license, text) GROUP BY 1),
    rows AS (SELECT doc_id, {form("text")} AS form FROM {table}),
    lines AS (SELECT doc_id, trim(unnest(string_split(form, chr(10)))) AS line FROM rows),
    named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM lines JOIN known ON sha256(line) = digest WHERE line <> '' GROUP BY 1)
    SELECT r.doc_id, sha256({whole("form")}) AS canonical_sha256, k.license, coalesce(n.line_licenses, '') AS line_licenses
    FROM rows r LEFT JOIN known k ON sha256({whole("form")}) = k.digest LEFT JOIN named n ON r.doc_id = n.doc_id
    """
