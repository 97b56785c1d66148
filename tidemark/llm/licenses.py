"""Licence scan by sentence rules.

A text is cut into segments at line breaks and after sentence marks.  A segment's
words are its runs of letters and digits in lower case (``licence`` read as
``license``), without a list mark before them; segments without words, or with a
list mark alone, count nowhere.  Known licence sentences form a trie of words.  From
each segment's first word on the trie is followed over as many segments as it takes,
so a sentence may be wrapped at any width; the longest sentence that ends where a
segment ends is a hit and gives its identifier.  SPDX lines are parsed as
expressions.

Rules are ordered sequences of identifiers, some of them optional; a rule matches
where its identifiers follow each other with at most ``GAP`` other segments between
two of them.  Longer matches win, and no sentence serves twice.

A null or empty text has no matches; a very long text is scanned whole, with time
in proportion to its length.  Each row is scanned by itself, so repeated rows give
equal matches; an empty table gives an empty result; columns other than doc_id and
text play no part.  The tables are fixed and small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.runtime import ship

GAP = 2

# Names by which notices refer to a licence, normalised.
NAMES = {
    "MIT": ["mit", "the mit", "mit license", "the mit license", "the expat license", "expat license"],
    "Apache-2.0": ["apache 2 0", "apache 2", "apache license 2 0", "the apache license 2 0", "the apache license version 2 0", "apache license version 2 0", "the apache 2 0 license"],
    "GPL-2.0-only": ["gpl v2", "gplv2", "gpl 2", "gnu gpl version 2", "gnu gpl v2", "the gnu gpl version 2", "the gnu general public license version 2", "gnu general public license version 2", "gnu general public license v2 0"],
    "GPL-3.0-only": ["gpl v3", "gplv3", "gpl 3", "gnu gpl version 3", "gnu gpl v3", "the gnu gpl version 3", "the gnu general public license version 3", "gnu general public license version 3", "gnu general public license v3 0"],
    "LGPL-2.1-only": ["lgpl v2 1", "lgplv2 1", "lgpl 2 1", "the gnu lesser general public license version 2 1", "gnu lesser general public license v2 1"],
    "LGPL-3.0-only": ["lgpl v3", "lgplv3", "lgpl 3", "the gnu lesser general public license version 3", "gnu lesser general public license v3 0"],
    "AGPL-3.0-only": ["agpl v3", "agplv3", "agpl 3", "the gnu affero general public license version 3", "gnu affero general public license v3 0"],
    "MPL-2.0": ["mpl 2 0", "the mpl 2 0", "the mozilla public license version 2 0", "mozilla public license 2 0", "the mozilla public license 2 0"],
    "EPL-1.0": ["epl 1 0", "the eclipse public license version 1 0", "the eclipse public license v1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["epl 2 0", "the eclipse public license version 2 0", "the eclipse public license v2 0", "eclipse public license 2 0"],
    "EUPL-1.2": ["eupl 1 2", "the eupl 1 2", "the eupl version 1 2", "the european union public license version 1 2", "european union public license 1 2"],
    "BSD-2-Clause": ["bsd 2 clause", "the bsd 2 clause license", "the 2 clause bsd license", "the simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause", "the bsd 3 clause license", "the 3 clause bsd license", "the new bsd license", "the modified bsd license", "a bsd style license"],
    "BSL-1.0": ["bsl 1 0", "the boost software license", "the boost software license version 1 0", "boost software license 1 0", "boost software license version 1 0"],
    "ISC": ["the isc license", "isc license", "isc"],
    "Zlib": ["the zlib license", "zlib license", "the zlib libpng license"],
    "Unlicense": ["the unlicense", "unlicense"],
    "WTFPL": ["the wtfpl", "wtfpl"],
    "CC0-1.0": ["cc0 1 0", "cc0", "the creative commons zero v1 0 universal license", "creative commons zero"],
} | {
    f"CC-{kind.upper().replace(' ', '-')}-{v}": [f"cc {kind} {v.replace('.', ' ')}", f"a creative commons {words} {v.replace('.', ' ')} international license", f"the creative commons {words} {v.replace('.', ' ')} international license", f"the creative commons {words} {v.replace('.', ' ')} license"]
    for v in ("3.0", "4.0")
    for kind, words in (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc", "attribution noncommercial"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))
}

# How notices begin, normalised.
NOTICES = [
    f"{what}{verb} under {terms}"
    for what in ("", "this work is ", "this file is ", "this software is ", "this program is ", "this project is ", "this library is ", "this package is ", "this text is ", "this article is ", "this code is ", "this content is ", "the content is ", "the code is ", "the source code is ", "all code is ", "it is ")
    for verb in ("licensed", "released", "distributed", "available", "published", "made available")
    for terms in ("", "the terms of ")
] + ["license ", "license type ", "code license "]

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_GNU = "you can redistribute it and/or modify it under the terms of the GNU"
_FSF = "as published by the Free Software Foundation"
_LATER = "of the License, or (at your option) any later version."

# Sentences of licence texts, by identifier.
SENTENCES = {
    "mit.title": ["MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"],
    "mit.grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit0.grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ],
    "mit.notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "mit.warranty": [f"{_AS_IS} AND NONINFRINGEMENT."],
    "mit.liability": [
        f"IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE." for who in ("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS", "X CONSORTIUM")
    ],
    "isc.title": ["ISC License", "The ISC License"],
    "isc.grant": [f"Permission to use, copy, modify, {a} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." for a in ("and/or", "and")],
    "0bsd.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc.warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "isc.liability": [
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "bsd2.title": ["BSD 2-Clause License", "The BSD 2-Clause License"],
    "bsd3.title": ["BSD 3-Clause License", "The BSD 3-Clause License"],
    "bsd.grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd.advertise": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd.endorse": [f"Neither the name of the {a} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." for a in ("copyright holder", "University", "author")],
    "bsd.disclaim": [
        f"THIS SOFTWARE IS PROVIDED BY THE {who} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED." for who in ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS", "AUTHOR AND CONTRIBUTORS", "AUTHOR")
    ],
    "bsd.liability": [
        f"IN NO EVENT SHALL THE {who} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
        for who in ("COPYRIGHT HOLDER OR CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS", "AUTHOR")
    ],
    "zlib.warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib.liability": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib.grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib.origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "zlib.altered": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "zlib.notice": ["This notice may not be removed or altered from any source distribution."],
    "bsl.title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl.grant": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ],
    "bsl.notice": [
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ],
    "bsl.warranty": [f"{_AS_IS}, TITLE AND NON-INFRINGEMENT."],
    "bsl.header": ["Distributed under the Boost Software License, Version 1.0."],
    "apache.title": ["Apache License", "The Apache License"],
    "apache.version": ["Version 2.0, January 2004"],
    "apache.terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache.define": ["\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."],
    "apache.licensor": ["\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."],
    "apache.comply": ["you may not use this file except in compliance with the License.", "you may not use this work except in compliance with the License."],
    "apache.licensed": ["Licensed under the Apache License, Version 2.0 (the \"License\");", "This file is licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache.copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache.software": [
        f"Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT {what} OF ANY KIND, either express or implied." for what in ("WARRANTIES OR CONDITIONS", "WARRANTY")
    ],
    "apache.limits": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl.title": ["GNU GENERAL PUBLIC LICENSE"],
    "lgpl.title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "agpl.title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "gnu.v2": ["Version 2, June 1991"],
    "gnu.v21": ["Version 2.1, February 1999"],
    "gnu.v3": ["Version 3, 29 June 2007"],
    "gnu.v3a": ["Version 3, 19 November 2007"],
    "gnu.verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "gpl.copyleft": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "gpl.freedom": ["The licenses for most software are designed to take away your freedom to share and change it."],
    "gpl.free": [f"This {what} is free software: {_GNU} General Public License {_FSF}, either version 3 {_LATER}" for what in ("program", "file", "software", "library")] + [f"is free software: {_GNU} General Public License {_FSF}, either version 3 {_LATER}"],
    "gpl.free2": [f"This {what} is free software; {_GNU} General Public License {_FSF}; either version 2 {_LATER}" for what in ("program", "file", "software", "library")],
    "gpl.only2": [f"This program is free software; {_GNU} General Public License version 2 {_FSF}."],
    "lgpl.free21": [f"This library is free software; {_GNU} Lesser General Public License {_FSF}; either version 2.1 {_LATER}"],
    "lgpl.free3": [f"This {what} is free software: {_GNU} Lesser General Public License {_FSF}, either version 3 {_LATER}" for what in ("program", "library")],
    "agpl.free": [f"This program is free software: {_GNU} Affero General Public License {_FSF}, either version 3 {_LATER}"],
    "gnu.warranty": [f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE." for what in ("program", "library", "file", "software")],
    "gnu.details": [f"See the GNU {kind}General Public License for more details." for kind in ("", "Lesser ", "Affero ")],
    "mpl.title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "mpl.notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl.copy": [f"If a copy of the MPL was not distributed with this file, You can obtain one at {a}://mozilla.org/MPL/2.0/." for a in ("http", "https")],
    "epl.notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "epl1.notice": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "eupl.notice": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");"],
    "unlicense.domain": ["This is free and unencumbered software released into the public domain."],
    "unlicense.anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "unlicense.law": ["In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."],
    "wtfpl.title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "wtfpl.just": ["You just DO WHAT THE FUCK YOU WANT TO."],
    "cc0.dedicate": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "reserved": ["All rights reserved.", "All rights reserved worldwide."],
}

# Rules, as licence and sequence of identifiers; a question mark makes one optional.
RULES = [
    ("MIT", "mit.title? mit.grant mit.notice mit.warranty? mit.liability?"),
    ("MIT-0", "mit0.grant mit.warranty? mit.liability?"),
    ("ISC", "isc.title? isc.grant isc.warranty? isc.liability?"),
    ("0BSD", "0bsd.grant isc.warranty? isc.liability?"),
    ("BSD-2-Clause", "bsd2.title? bsd.grant bsd.source bsd.binary bsd.disclaim? bsd.liability?"),
    ("BSD-3-Clause", "bsd3.title? bsd.grant bsd.source bsd.binary bsd.endorse bsd.disclaim? bsd.liability?"),
    ("BSD-4-Clause", "bsd.grant bsd.source bsd.binary bsd.advertise bsd.endorse bsd.disclaim? bsd.liability?"),
    ("Zlib", "zlib.warranty zlib.liability zlib.grant zlib.origin? zlib.altered? zlib.notice?"),
    ("BSL-1.0", "bsl.title? bsl.grant bsl.notice? bsl.warranty?"),
    ("BSL-1.0", "bsl.header"),
    ("BSL-1.0", "bsl.title"),
    ("Apache-2.0", "apache.title? apache.version apache.terms? apache.define? apache.licensor?"),
    ("Apache-2.0", "apache.licensed apache.comply apache.copy? apache.software? apache.limits?"),
    ("GPL-2.0-only", "gpl.title gnu.v2 gnu.verbatim? gpl.freedom?"),
    ("GPL-2.0-only", "gpl.only2 gnu.warranty? gnu.details?"),
    ("GPL-2.0-or-later", "gpl.free2 gnu.warranty? gnu.details?"),
    ("GPL-3.0-only", "gpl.title gnu.v3 gnu.verbatim? gpl.copyleft? gpl.freedom?"),
    ("GPL-3.0-or-later", "gpl.free gnu.warranty? gnu.details?"),
    ("LGPL-2.1-only", "lgpl.title gnu.v21 gnu.verbatim?"),
    ("LGPL-2.1-or-later", "lgpl.free21 gnu.warranty? gnu.details?"),
    ("LGPL-3.0-only", "lgpl.title gnu.v3 gnu.verbatim?"),
    ("LGPL-3.0-or-later", "lgpl.free3 gnu.warranty? gnu.details?"),
    ("AGPL-3.0-only", "agpl.title gnu.v3a gnu.verbatim?"),
    ("AGPL-3.0-or-later", "agpl.free gnu.warranty? gnu.details?"),
    ("MPL-2.0", "mpl.notice mpl.copy?"),
    ("MPL-2.0", "mpl.title"),
    ("EPL-2.0", "epl.notice"),
    ("EPL-1.0", "epl1.notice"),
    ("EUPL-1.2", "eupl.notice apache.comply?"),
    ("Unlicense", "unlicense.domain unlicense.anyone? unlicense.law?"),
    ("WTFPL", "wtfpl.title wtfpl.just?"),
    ("CC0-1.0", "cc0.dedicate"),
    ("LicenseRef-all-rights-reserved", "reserved"),
] + [(name, f"notice.{name}") for name in NAMES]

# Identifiers in SPDX expressions.
SPDX = {
    s.lower(): s
    for s in "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Ruby Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1".split()
}
EXCEPTIONS = {s.lower(): s for s in "Bison-exception-2.2 Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Linux-syscall-note OpenJDK-assembly-exception-1.0".split()}

_SPLIT = re.compile(r"\n|(?<=[.!?;:])[\x20\x09\x0B-\x0D]+").split
_WORDS = re.compile(r"[^\W_]+").findall
_ITEM = re.compile(r"^[\s>*#/;|-]*(?:\(?(?:\d{1,2}|[a-z])[.)]\s+)?")
_MARK = re.compile(r"[\W_]*(?:\d{1,2}|[a-z])[.)][\W_]*")
_SPDX = re.compile(r"spdx-license-identifier\s*:?\s*(.*)", re.S)
_PART = re.compile(r"[A-Za-z0-9.+:-]*[A-Za-z0-9+]|[()]")


def normalise(segment: str) -> str:
    return " ".join("license" if w == "licence" else "licenses" if w == "licences" else w for w in _WORDS(segment.lower()))


def words_of(segment: str) -> list[str]:
    """A segment's words; none if it is a list mark alone."""
    segment = segment.lower()
    if len(segment) < 12 and _MARK.fullmatch(segment):
        return []
    return ["license" if w == "licence" else "licenses" if w == "licences" else w for w in _WORDS(_ITEM.sub("", segment, count=1))]


def expression(text: str) -> str | None:
    """The longest SPDX expression that a text begins with, in the list's spelling."""
    out, depth, best, want = [], 0, None, True  # want: a licence or an opening bracket is due
    for part in _PART.findall(text):
        low = part.lower()
        if part == "(" and want:
            depth += 1
        elif part == ")" and not want and depth:
            depth -= 1
        elif not want and low in ("and", "or", "with"):
            want, part = True, part.upper()
        elif want and out[-1:] == ["WITH"]:
            if low not in EXCEPTIONS:
                break
            part, want = EXCEPTIONS[low], False
        elif want and (low.removesuffix("+") in SPDX or low.startswith("licenseref-")):
            part = part if low.startswith("licenseref-") else SPDX[low.removesuffix("+")] + "+" * low.endswith("+")
            want = False
        else:
            break
        out.append(part)
        if not want and not depth:
            best = " ".join(out)
    return best.replace("( ", "(").replace(" )", ")") if best else None


def sequences(rules=RULES) -> list[tuple[str, tuple[str, ...]]]:
    """Each rule once for every choice of its optional identifiers, longest first."""
    out = []
    for license, rule in rules:
        parts = [((name.removesuffix("?"),), ()) if name.endswith("?") else ((name,),) for name in rule.split()]
        out += [(license, sum(chosen, ())) for chosen in product(*parts)]
    return sorted(out, key=lambda r: -len(r[1]))


@dataclass(frozen=True)
class Match:
    license: str
    rule: str
    first: int
    last: int
    n_sentences: int


class Scanner:
    def __init__(self, rules=RULES, sentences=SENTENCES, names=NAMES, notices=NOTICES, gap: int = GAP):
        self.known = {normalise(s): i for i, many in sentences.items() for s in many}
        for license, many in names.items():
            for name in many:
                for notice in notices:
                    self.known[f"{notice}{name}"] = f"notice.{license}"
        self.trie: dict[str, dict] = {}
        for sentence, name in self.known.items():
            node = self.trie
            for word in sentence.split():
                node = node.setdefault(word, {})
            node[""] = name
        self.by_first: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for rule in sequences(rules):
            self.by_first.setdefault(rule[1][0], []).append(rule)
        self.gap = gap

    def identifiers(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(first and last segment, identifier, the same two counting segments with words only) of the known sentences, in order."""
        raw = _SPLIT(text)
        own = [(i, w) for i, w in ((i, words_of(s)) for i, s in enumerate(raw)) if w]
        out, at = [], 0
        while at < len(own):
            hit = self._longest(own, at) or self._spdx(raw, own, at)
            if hit:
                out.append((own[at][0], own[hit[0]][0], hit[1], at, hit[0]))
                at = hit[0]
            at += 1
        return out

    def _longest(self, own, at: int) -> tuple[int, str] | None:
        node, found = self.trie, None
        if own[at][1][0] not in node:
            return None
        for last in range(at, len(own)):
            for word in own[last][1]:
                node = node.get(word)
                if node is None:
                    return found
            if "" in node:
                found = last, node[""]
        return found

    def _spdx(self, raw, own, at: int) -> tuple[int, str] | None:
        if own[at][1][0] != "spdx":
            return None
        inside = _SPDX.search(raw[own[at][0]].lower())
        if inside is None:
            return None
        begin, last = inside.start(1), at
        rest = raw[own[at][0]][begin:]
        if not rest and at + 1 < len(own):  # the colon ended the segment
            last, rest = at + 1, raw[own[at + 1][0]]
        found = expression(rest)
        return (last, f"spdx.{found}") if found else None

    def scan(self, text: str | None) -> list[Match]:
        found = self.identifiers(text) if text else []
        used = [False] * len(found)
        out = []
        for at, (first, last, name, _, _) in enumerate(found):
            if name.startswith("spdx."):
                out.append(Match(name[5:], "spdx", first, last, 1))
                continue
            for license, sequence in () if used[at] else self.by_first.get(name, ()):
                places = self._follow(found, used, at, sequence)
                if places:
                    for p in places:
                        used[p] = True
                    out.append(Match(license, "+".join(sequence), found[places[0]][0], found[places[-1]][1], len(sequence)))
                    break
        return out

    def _follow(self, found, used, at: int, sequence: tuple[str, ...]) -> list[int] | None:
        places, end = [at], found[at][4]
        for name in sequence[1:]:
            p = places[-1] + 1
            while p < len(found) and found[p][3] - end - 1 <= self.gap and (used[p] or found[p][2] != name):
                p += 1
            if p >= len(found) or found[p][3] - end - 1 > self.gap:
                return None
            places.append(p)
            end = found[p][4]
        return places


def scan_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, license, rule, first and last segment and number of sentences of each match."""
    ship(documents.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for part in parts:
            rows, own = [], []
            for i, text in enumerate(part.column("text")):
                for m in scanner.scan(text.as_py()):
                    own.append(i)
                    rows.append((m.license, m.rule, m.first, m.last, m.n_sentences))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(own, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "license", "rule", "first_segment", "last_segment", "n_sentences"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, license string, rule string, first_segment int, last_segment int, n_sentences int")
