r"""Licence scans by canonical digests, in DataFrame operations only.

A text is put in canonical form: lower case; title and copyright notice above a
licence dropped, up to its first words, however long they are and the lines are
wrapped, unless a paragraph between is neither; other lines that are a copyright
notice dropped; everything but letters and digits
one space; equivalent spellings made one (licence/license, -ise/-ize, -our/-or,
and the like). Its SHA-256 is joined to the digests of known licences, whose
texts go through the same expressions. Long licence texts are files in the
folder ``licences``, named by their ids.

The known list is small and is broadcast by Spark if it is below Spark's own
limit; a longer one is a shuffled hash join on the digest.

Edge cases: a null or empty text, or one of copyright lines and punctuation
only, has an empty canonical form, a digest, and no licence; equal texts get
equal rows; one text under two licence ids gets the id that sorts first; an
empty table gives an empty one; columns besides ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of equivalent spellings, applied in this order to words of lower-case letters and digits.
SPELLINGS = (
    (r"\blicenc(e|es|ed|ing|or|ors)\b", "licens$1"),
    (r"\bsub licens(e|es|ed|ing)\b", "sublicens$1"),
    (r"\b(organ|author|util|recogn|initial|custom|real)is(e|es|ed|er|ers|ing|ation|ations)\b", "$1iz$2"),
    (r"\b(fav|hon|behavi|lab|col)our(s|ed|ing|able)?\b", "$1or$2"),
    (r"\b(acknowledg|judg)ement(s)?\b", "$1ment$2"),
    (r"\bnon (infringement|commercial|exclusive|profit)\b", "non$1"),
    (r"\bwhilst\b", "while"),
    (r"\bper cent\b", "percent"),
)
# The holder's own name in BSD texts.
HOLDER = (r"\bneither the names? of .*?nor the names of\b", "neither the name of the copyright holder nor the names of")
OTHER = r"[^\p{L}\p{N}]+"

_GAP, _WORD = r"[^\p{L}\p{N}]++", r"[\p{L}\p{N}]++"
#: Words of licences that follow 'copyright' where no holder does.
_NO_HOLDER = (
    "holders?|notices?|owners?|if|but|when|where|unless|not|than|also|those|licen[cs]\\w*|laws?|statements?|and|or|in|is|are|was|of|to|on|for|with|by|as|that|which|will|shall|may|can|does|under|from|any|"
    "interests?|protections?|treat\\w+|infring\\w+|disclaim\\w*|information|ownership|rights?|permissions?|claims?|attributions?|acts?|doctrines?|status|"
    "this|these|your|our|its|an?(?!\\.)|the(?![^\\n]*(?:authors|contributors|foundation|project|team|regents|university)\\b)"
)
#: What begins a copyright notice, in lower case: (c), a year, or a holder.
_DATED = r"(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|©|\p{N}{4})|copyright[ \t]+by\b|\(c\)[^\p{L}\p{N}\n]*(?:copyright\b|\p{N}{4})|©)"
_HELD = rf"copyright[ \t:]+(?!(?:{_NO_HOLDER})\b)\p{{L}}"
NOTICE = rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:{_DATED}|{_HELD})[^\n]*$"
#: A notice to be filled in, in texts that say how to apply a licence.
BLANK_NOTICE = rf"copyright{_GAP}(?:c{_GAP})?(?:year|yyyy){_GAP}name{_GAP}of{_GAP}(?:copyright{_GAP}owner|author)\b|copyright\s+\(c\)\s+_[_\s]*"
_OPENINGS = (
    "permission is hereby granted",
    "permission to use copy modify",
    "redistribution and use in source",
    "this software is provided as is",
    "licen[cs]ed under the apache",
    "this program is free software",
    "this library is free software",
    "this is free and unencumbered",
    "everyone is permitted to copy",
    "terms and conditions for use",
    "1 definitions",
    "released under the mit",
    "this source code form is",
)
_OPENING = "(?:" + "|".join(x.replace(" ", _GAP) for x in _OPENINGS) + r")\b"
_TITLE = (
    rf"(?:the{_GAP})?(?:\p{{N}}{_GAP}clause{_GAP})?(?:(?:new|modified|simplified|revised){_GAP})?(?:mit|expat|isc|zlib|0?bsd|apache|mozilla|gnu)(?:{_GAP}(?:\p{{N}}|clause|lesser|library|general|affero|public|software|or|new|revised|simplified|modified)){{0,6}}{_GAP}licen[cs]e\b"
    rf"(?:{_GAP}(?:mit|expat|isc|zlib|bsd|version|v?\p{{N}}+|clause|january|february|june|november|https?|www|apache|org|licenses)(?![\p{{L}}\p{{N}}])){{0,10}}"
)
_MARK = rf"(?:{_DATED.replace(chr(92) + 'n', '')}|{_HELD})"
_RESERVED = rf"all{_GAP}rights{_GAP}reserved"
#: What may stand above the first words of a licence: a title, a notice, or both; a notice has any number of words.
TITLED = rf"\A[^\p{{L}}\p{{N}}]*{_TITLE}(?:{_GAP}{_RESERVED})?[^\p{{L}}\p{{N}}]*\z"
NOTED = rf"\A[^\p{{L}}\p{{N}}]*(?:{_TITLE}[^\p{{L}}\p{{N}}]+)?{_MARK}"
#: What texts with either begin with, to look no further in all others.
BEGINS = rf"\A[^\p{{L}}\p{{N}}]*+(?:{_TITLE}|{_MARK})"
#: A paragraph that is neither, so what stands there is more than the head of a licence.
OTHER_PARAGRAPH = rf"\n[ \t\r]*\n[^\p{{L}}\p{{N}}]*+(?!{_MARK}|{_RESERVED}|(?:the{_GAP})?{_TITLE}[^\p{{L}}\p{{N}}]*+(?:\z|\n|{_MARK}))[\p{{L}}\p{{N}}]"

# Public licence texts and notices, without their copyright lines.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "GPL-3.0-or-later-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANK_NOTICE, " ")
    begin = F.regexp_instr(out, F.lit(_OPENING))
    head = F.substring(out, F.lit(1), begin - 1)
    is_head = F.rlike(head, F.lit(TITLED)) | (F.rlike(head, F.lit(NOTED)) & ~F.rlike(head, F.lit(OTHER_PARAGRAPH)))
    out = F.when(F.when(F.rlike(out, F.lit(BEGINS)), (begin > 1) & is_head).otherwise(False), F.substring(out, begin, F.length(out))).otherwise(out)
    out = F.regexp_replace(out, NOTICE, " ")
    out = F.trim(F.regexp_replace(out, OTHER, " "))
    for pattern, to in (*SPELLINGS, HOLDER):
        out = F.regexp_replace(out, pattern, to)
    return out


def long_texts() -> dict[str, str]:
    """Licence texts of the folder ``licences``; those with advice on how to apply them also without, as ``id`` and a blank."""
    own = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in (files(__package__) / "licences").iterdir() if f.name.endswith(".txt")}
    end = "END OF TERMS AND CONDITIONS"
    return own | {f"{k} ": t[: t.index(end) + len(end)] for k, t in own.items() if end in t}


def known_licences(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id) of known texts."""
    pairs = sorted((k.strip(), t) for k, t in (texts or TEXTS | long_texts()).items())
    rows = docs.sparkSession.createDataFrame(pairs, "license_id string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, digest, n_canonical (code points), license_id, null where no licence has that digest."""
    known = known_licences(docs) if known is None else known
    form = docs.select("doc_id", canonical(F.col("text")).alias("form"))
    marked = form.select("doc_id", F.sha2("form", 256).alias("digest"), F.length("form").cast("bigint").alias("n_canonical"))
    return marked.join(known, "digest", "left").select("doc_id", "digest", "n_canonical", "license_id")

