"""Licence scan by sentence rules (German, Manabe & Inoue 2010).

A text is cut into fragments at sentence ends and line ends; runs of fragments
are normalised (case, punctuation, comment marks, wrapping) and looked up among
known licence sentences, the longest run first. A ``*`` inside a known sentence stands for
a few words of any kind (a holder's name, an address). The text becomes a
sequence of sentence identifiers, ``?`` for what is not known; numbers of lists
are passed over. Ordered rules, sequences of identifiers themselves, are matched
against it, an identifier that ends in ``?`` being optional; the first rule that
fits takes its sentences, so a longer licence is named before the shorter one it
contains.

Scale: one pass without a shuffle; a vectorised search for the words that every
known sentence has one of leaves few texts to cut. The length of the longest
known sentence bounds how far a run reaches, not the text.

Edge cases: a null or empty text has no licence; copyright lines are known but
neutral; sentences left over from all rules are reported as ``unmatched``; a
repeated licence is one entry; other columns pass through and a column named
like a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values: licence sentences by identifier, rules in order ---------------

SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-name": ("The MIT License", "MIT License", "The MIT License (MIT)"),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
                   "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
    "mit-asis": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "mit-liability": ("IN NO EVENT SHALL * BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "bsd-conditions": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-endorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
                    "Neither the name of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission",
                    "Neither the names of * nor the names of * may be used to endorse or promote products derived from this software without specific prior written permission",
                    "The name of * may not be used to endorse or promote products derived from this software without specific prior written permission",
                    "The names of * may not be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-advert": ("All advertising materials mentioning features or use of this software must display the following acknowledgement",
                   "All advertising materials mentioning features or use of this software must display the following acknowledgment"),
    "bsd-asis": ('THIS SOFTWARE IS PROVIDED BY * "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',),
    "bsd-liability": ("IN NO EVENT SHALL * BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",),
    "isc-name": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
                  "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "isc-asis": ('THE SOFTWARE IS PROVIDED "AS IS" AND * DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
                 'THE SOFTWARE IS PROVIDED "AS IS" AND * DISCLAIM ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    "isc-liability": ("IN NO EVENT SHALL * BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",),
    "apache-title": ("Apache License Version 2.0, January 2004",),
    "apache-use": ("you may not use this file except in compliance with the License",),
    "apache-copy": ("You may obtain a copy of the License at",
                    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "apache-asis": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',),
    "apache-see": ("See the License for the specific language governing permissions and limitations under the License",),
    "gpl-free": ("This program is free software", "This library is free software"),
    "gpl-warranty": tuple(f"This {x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY{end}" for x in ("program", "library")
                          for end in ("", "; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE")),
    "gpl-see": tuple(f"See the GNU {x}General Public License for more details" for x in ("", "Lesser ", "Affero ")),
    "gpl-copy": tuple(f"You should have received a copy of the GNU {x}General Public License along with this {y}; if not, {end}"
                      for x in ("", "Lesser ", "Affero ") for y in ("program", "library") for end in (
                          "see http://www.gnu.org/licenses/", "see https://www.gnu.org/licenses/",
                          "write to the Free Software Foundation, Inc., * USA")),
    "mpl-form": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "mpl-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
                 "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    "mpl-title": ("Mozilla Public License Version 2.0",),
    "unlicense-domain": ("This is free and unencumbered software released into the public domain",),
    "unlicense-free": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",),
    "unlicense-dedicate": ("In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain",),
    "unlicense-intend": ("We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",),
    "unlicense-see": tuple(f"For more information, please refer to {x}" for x in (
        "http://unlicense.org/", "https://unlicense.org/", "http://unlicense.org", "https://unlicense.org")),
    "zlib-name": ("zlib License", "The zlib License"),
    "zlib-asis": ("This software is provided 'as-is', without any express or implied warranty",
                  "This software is provided 'as is', without any express or implied warranty"),
    "zlib-liability": ("In no event will * be held liable for any damages arising from the use of this software",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "zlib-origin": ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software",),
    "zlib-credit": ("If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required",
                    "If you use this software in a product, an acknowledgement in the product documentation would be appreciated but is not required"),
    "zlib-altered": ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",),
    "zlib-notice": ("This notice may not be removed or altered from any source distribution",),
    "boost-name": ("Distributed under the Boost Software License, Version 1.0",),
    "boost-see": ("See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
                  "See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt"),
    "boost-title": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "boost-grant": ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',),
    "boost-notice": ("The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor",),
    "boost-asis": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT',),
    "boost-liability": ("IN NO EVENT SHALL * BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
}

#: Names of a licence in a reference such as "Licensed under the ...".
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0", "CC0-1.0"),
}
CREATIVE_COMMONS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial",
                    "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
                    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License",
       "AGPL": "GNU Affero General Public License"}
GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
REFERENCES = ("Licensed under {}", "This work is licensed under {}", "Released under {}", "Distributed under {}",
              "This project is licensed under {}", "This software is released under {}", "License: {}",
              "The ASF licenses this file to You under {}")

#: Rules in order: the licence, and its sentence identifiers one after another
#: (``name?``: may be missing; ``??``: unknown words may stand there).
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-4-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-advert", "??", "bsd-endorse?", "bsd-asis?", "bsd-liability?")),
    ("BSD-3-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis?", "bsd-liability?")),
    ("BSD-2-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-asis?", "bsd-liability?")),
    ("MIT", ("mit-name?", "mit-grant", "mit-notice", "mit-asis?", "mit-liability?")),
    ("Zlib", ("zlib-name?", "zlib-asis", "zlib-liability?", "zlib-grant", "zlib-origin?", "zlib-credit?", "zlib-altered?", "zlib-notice?")),
    ("ISC", ("isc-name?", "isc-grant", "isc-asis?", "isc-liability?")),
    ("Apache-2.0", ("ref:Apache-2.0", "apache-use", "apache-copy", "apache-asis?", "apache-see?")),
    ("Apache-2.0", ("apache-title",)),
    ("MPL-2.0", ("mpl-form", "mpl-copy?")),
    ("MPL-2.0", ("mpl-title",)),
    ("Unlicense", ("unlicense-domain", "unlicense-free?", "unlicense-dedicate?", "unlicense-intend?", "mit-asis?", "mit-liability?", "unlicense-see?")),
    ("BSL-1.0", ("boost-title?", "boost-grant", "boost-notice?", "boost-asis?", "boost-liability?")),
    ("BSL-1.0", ("boost-name", "boost-see?")),
    ("BSL-1.0", ("boost-title",)),
    ("MIT", ("mit-name",)),
    ("ISC", ("isc-name",)),
    ("Zlib", ("zlib-name",)),
)
NEUTRAL = "copyright"
UNKNOWN = "?"

_SPLIT = re.compile(r"[.;:!?][^\w\s]*(?:\s+|$)|\n")
_WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*\+?")
_COPYRIGHT = re.compile(r"copyright (?:c )?(?:[0-9]{4}|yyyy|year)\b|c [0-9]{4}\b|all rights reserved$")
#: The number of a list item: a fragment of its own, or in brackets before the words.
_NUMBER = re.compile(r"[0-9]{1,2}|[a-z]|[ivx]{1,4}")
_BRACKET = re.compile(r"[^\w(]*\(?(?:[0-9]{1,2}|[A-Za-z]|[ivxIVX]{1,4})\)\s")
#: The most words that a ``*`` stands for.
MOST_FREE = 16
RESULT = ("n_known", "licenses", "unmatched")


def normalise(sentence: str) -> list[str]:
    """Lower-case words; punctuation, quotes and comment marks are gone."""
    return _WORD.findall(sentence.lower())


class Scanner:
    """Known sentences by their words, and the rules."""

    def __init__(self, sentences=None, rules=RULES):
        table = dict(SENTENCES if sentences is None else sentences)
        rules = list(rules)
        if sentences is None:
            made, extra = _references()
            table.update(made)
            rules += extra
        self.rules = [(name, variant) for name, rule in rules for variant in _variants(tuple(rule))]
        self.known: dict[str, str] = {}
        #: Sentences with a free part: by first word, the words before it and all as a pattern.
        self.free: dict[str, list[tuple[str, re.Pattern, str]]] = {}
        self.longest = 0
        for name, forms in table.items():
            for form in forms:
                # A sentence keeps what stands after inner sentence marks: the
                # words are the same however fragments are cut.
                parts = [" ".join(normalise(x)) for x in form.split("*")]
                words = sum(len(x.split()) for x in parts) + MOST_FREE * (len(parts) - 1)
                self.longest = max(self.longest, words)
                if len(parts) == 1:
                    self.known.setdefault(parts[0], name)
                else:
                    gap = r"(?: \S+){1,%d}?" % MOST_FREE
                    pattern = gap.join(re.escape(f" {x}") if i and x else re.escape(x) for i, x in enumerate(parts))
                    self.free.setdefault(parts[0].split(" ", 1)[0], []).append((parts[0], re.compile(pattern), name))
        self.first = {k.split(" ", 1)[0] for k in self.known} | set(self.free) | {"copyright", "c", "all"}

        #: The first two words of every sentence, one where there is one or a free part follows it.
        heads = [*self.known, *(head for forms in self.free.values() for head, _, _ in forms)]
        self.heads = {" ".join(h.split(" ", 2)[:2]) for h in heads}

    def _sentence(self, fragments: list[list[str]], i: int, skip: int) -> tuple[str, int] | None:
        """The longest known sentence from fragment ``i`` on, less its first ``skip`` words."""
        found, words, j = None, fragments[i][skip:], i + 1
        if not words or words[0] not in self.first:
            return None
        free = self.free.get(words[0], ())
        while len(words) <= self.longest:
            if len(words) > 1 and words[0] not in self.heads and f"{words[0]} {words[1]}" not in self.heads:
                break
            run = " ".join(words)
            name = self.known.get(run) or next((n for head, p, n in free if run.startswith(head) and p.fullmatch(run)), None)
            if name:
                found = (name, j)
            if j == len(fragments):
                break
            words = words + fragments[j]
            j += 1
        return found

    def identifiers(self, text: str) -> list[str]:
        """The text as sentence identifiers; runs of unknown fragments are one ``?``."""
        pieces = [(w, p) for p in _SPLIT.split(text) if (w := normalise(p))]
        fragments = [w for w, _ in pieces]
        out, i = [], 0
        while i < len(fragments):
            found = self._sentence(fragments, i, 0)
            if not found and fragments[i][0] in self.first and _COPYRIGHT.match(" ".join(fragments[i])):
                found = (NEUTRAL, i + 1)
            if not found and _BRACKET.match(pieces[i][1]):
                found = self._sentence(fragments, i, 1)
            if found:
                out.append(found[0])
                i = found[1]
                continue
            number = len(fragments[i]) == 1 and _NUMBER.fullmatch(fragments[i][0])
            if not number and (not out or out[-1] != UNKNOWN):
                out.append(UNKNOWN)
            i += 1
        return out

    def licences(self, identifiers: list[str]) -> tuple[list[str], list[str]]:
        """Licences in the order of their places, and known sentences in no rule."""
        left = [x for x in identifiers if x != NEUTRAL]
        present = set(left)
        at: list[tuple[int, str]] = []
        for name, rule in self.rules:
            if not set(rule) <= present:
                continue
            for i in range(len(left) - len(rule) + 1):
                if tuple(left[i:i + len(rule)]) == rule:
                    at.append((i, name))
                    left[i:i + len(rule)] = [""] * len(rule)
        names = list(dict.fromkeys(name for _, name in sorted(at)))
        return names, list(dict.fromkeys(x for x in left if x not in ("", UNKNOWN)))


def _variants(rule: tuple[str, ...]) -> list[tuple[str, ...]]:
    """A rule with and without its optional identifiers, the longest first."""
    out: list[tuple[str, ...]] = [()]
    for x in rule:
        optional = x.endswith("?") and x != UNKNOWN
        name = x[:-1] if optional else x
        out = [v + (name,) for v in out] + (out if optional else [])
    return sorted(out, key=lambda v: -len(v))


def _references() -> tuple[dict[str, tuple[str, ...]], list[tuple[str, tuple[str, ...]]]]:
    """Reference sentences ("Licensed under ...") of every named licence, by rule."""
    names = dict(NAMES)
    clauses: dict[str, list[str]] = {}
    for code, words in CREATIVE_COMMONS.items():
        for version in CC_VERSIONS:
            short, full = f"CC {code.upper()} {version}", f"Creative Commons {words} {version}"
            names[f"CC-{code.upper()}-{version}"] = (
                short, f"{short} license", f"CC-{code.upper()}-{version}", f"{full} International License",
                f"{full} Unported License", f"{full} License", full)
    for code, words in GNU.items():
        for version in GNU_VERSIONS[code]:
            dotted = version if "." in version else f"{version}.0"
            forms = [f"{words}, version {version}", f"{words} version {version}", f"{words} v{version}",
                     f"{words} {dotted}", f"{code} {dotted}", f"{code}v{version}", f"{code}-{dotted}"]
            names[f"{code}-{dotted}-only"] = (*forms, *(f"{f} only" for f in forms[:2]))
            names[f"{code}-{dotted}-or-later"] = tuple(f"{f}{end}" for f in forms for end in (
                " or later", " or any later version", ", or (at your option) any later version", "+"))
            # The notice of the licence itself names the version after the publisher.
            fsf = f"you can redistribute it and/or modify it under the terms of the {words} as published by the Free Software Foundation"
            for v in dict.fromkeys((version, dotted)):
                of = (f"version {v} of the License", f"version {v}")
                clauses.setdefault(f"{code}-{dotted}-only", []).extend(f"{fsf}, {x}{only}" for x in of for only in ("", " only"))
                clauses.setdefault(f"{code}-{dotted}-or-later", []).extend(
                    f"{fsf}, {either}{x}, or {later}" for either in ("", "either ") for x in of
                    for later in ("(at your option) any later version", "any later version"))
    table, rules = {}, []
    for licence, forms in names.items():
        table[f"ref:{licence}"] = tuple(
            [r.format(x) + end for r in REFERENCES for f in forms for x in (f, f"the {f}", f"a {f}") for end in ("", ' (the "License")')]
            + [f"SPDX-License-Identifier: {licence}"]
            + [f"you can redistribute it and/or modify it under the terms of the {f} as published by the Free Software Foundation"
               for f in forms] + clauses.get(licence, []))
        rules.append((licence, ("gpl-free", f"ref:{licence}", "gpl-warranty", "gpl-see?", "gpl-copy?")))
        rules.append((licence, (f"ref:{licence}",)))
    return table, sorted(rules, key=lambda r: -len(r[1]))


#: A word that every known sentence or licence notice holds one of.
HINT = "licen[cs]|permission|software|distribut|released|obtain"


def scan(docs: DataFrame, text: str = "text", sentences=None, rules=RULES, hint: str = HINT) -> DataFrame:
    """``docs`` with n_known, licenses and unmatched. Own ``sentences`` and
    ``rules`` come with a ``hint`` that every sentence matches."""
    docs = docs.drop(*RESULT)
    strings = T.ArrayType(T.StringType())
    schema = T.StructType(docs.schema.fields + [T.StructField("n_known", T.LongType()),
                                                T.StructField("licenses", strings), T.StructField("unmatched", strings)])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules)
        for batch in batches:
            n = batch.num_rows
            known, names, rest = [0] * n, [[] for _ in range(n)], [[] for _ in range(n)]
            column = batch.column(at)
            for i in pc.indices_nonzero(pc.match_substring_regex(column, hint, ignore_case=True).fill_null(False)).to_pylist():
                ids = scanner.identifiers(column[i].as_py())
                known[i] = sum(x not in (UNKNOWN, NEUTRAL) for x in ids)
                names[i], rest[i] = scanner.licences(ids)
            columns = [pa.array(known, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(rest, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *RESULT])

    return docs.mapInArrow(run, schema)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", *RESULT)
