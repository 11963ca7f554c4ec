"""Licence recognition by sentence rules.

A text is cut into sentences; each is normalised (lower-case words of letters,
digits and dots inside words, copyright years and holders removed) and looked up
among known licence sentences, which gives the text's sequence of sentence
identifiers. ``{}`` in a known sentence stands for up to twelve words (the holder
of a copyright). Short notices ("this project is licensed under the MIT License",
``SPDX-License-Identifier: ...``) are sentences too, by a table of licence names.

Ordered rules, each a sequence of identifiers with a licence, are matched against
that sequence from the left: at every place the first rule of the list whose
identifiers stand there, with no more than ``gap`` unknown sentences between
neighbours, wins and uses up its sentences. A sentence that begins like a known one
and has most of its words is nearly known: it takes its place in a rule (marked
``~`` in the identifiers) as long as no more than half of a rule's sentences are
such, so that a reworded clause does not turn one licence into a shorter one.
Sentences that are known but that no rule takes up are reported as ``UNMATCHED``
with their identifier; nearly known ones alone are not reported.

One row per match, in text order. Null and empty texts, and texts without a known
sentence, give no rows; ids may be null or repeated, each row is scanned by
itself; very long texts are scanned whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_slices

#: Known licence sentences by identifier, fixed values: public licence texts and their usual notices.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title-short": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mit0-title": "MIT No Attribution",
    "mit0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "json-good": "The Software shall be used for Good, not Evil.",
    "x11-liability": "IN NO EVENT SHALL {} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "x11-except": "Except as contained in this notice, the name of {} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {}.",
    "apache2-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache2-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2-compliance": "you may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl3-work": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl3-work": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-one": "Neither the name of {} may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-names": "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-liability": "IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "mpl2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0.",
    "cc0-1": "Licensed under CC0 1.0.",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved.",
}

#: Licences and their classes, fixed values: SPDX identifiers.
CLASSES = {
    "permissive": "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 ISC MIT MIT-0 NCSA PostgreSQL Python-2.0 UPL-1.0 X11 Zlib",
    "weak-copyleft": "CDDL-1.0 EPL-1.0 EPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MPL-1.1 MPL-2.0",
    "copyleft": "AGPL-3.0-only AGPL-3.0-or-later CC-BY-SA-3.0 CC-BY-SA-4.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later OSL-3.0",
    "non-commercial": "CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0",
    "no-derivatives": "CC-BY-ND-4.0",
    "public-domain": "CC0-1.0 Unlicense WTFPL",
}
CLASS_OF = {licence: kind for kind, some in CLASSES.items() for licence in some.split()} | {"JSON": "permissive", "GPL-1.0-or-later": "copyleft"}
#: The Creative Commons family: kind, spoken name, class; fixed values.
CC = [("BY", "attribution", "permissive"), ("BY-SA", "attribution-sharealike", "copyleft"), ("BY-NC", "attribution-noncommercial", "non-commercial"), ("BY-ND", "attribution-noderivatives", "no-derivatives"), ("BY-NC-SA", "attribution-noncommercial-sharealike", "non-commercial"), ("BY-NC-ND", "attribution-noncommercial-noderivatives", "non-commercial")]
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
for _kind, _, _class in CC:
    CLASS_OF |= {f"CC-{_kind}-{v}": _class for v in CC_VERSIONS}
#: Of several licences of which one may be chosen the first class of this order counts, of those that hold together the last.
ORDER = ["public-domain", "permissive", "weak-copyleft", "copyleft", "no-derivatives", "non-commercial"]

#: Names of licences in notices, as normalised words, fixed values.
NAMES = {
    "mit": "MIT", "mit license": "MIT", "isc license": "ISC", "apache license 2.0": "Apache-2.0", "apache license version 2.0": "Apache-2.0", "apache license v2.0": "Apache-2.0", "apache 2.0": "Apache-2.0", "apache 2.0 license": "Apache-2.0", "apache-2.0": "Apache-2.0", "apache-2.0 license": "Apache-2.0",
    "bsd 2-clause license": "BSD-2-Clause", "2-clause bsd license": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause", "bsd 3-clause license": "BSD-3-Clause", "3-clause bsd license": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "modified bsd license": "BSD-3-Clause",
    "boost software license 1.0": "BSL-1.0", "boost software license version 1.0": "BSL-1.0", "zlib license": "Zlib", "mozilla public license 2.0": "MPL-2.0", "mozilla public license version 2.0": "MPL-2.0", "mpl 2.0": "MPL-2.0", "eclipse public license 2.0": "EPL-2.0", "eclipse public license version 2.0": "EPL-2.0", "eclipse public license v2.0": "EPL-2.0", "unlicense": "Unlicense",
    "cc by 4.0": "CC-BY-4.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "cc by-nc 4.0": "CC-BY-NC-4.0", "cc by-nd 4.0": "CC-BY-ND-4.0", "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0", "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0", "cc0 1.0": "CC0-1.0", "cc0": "CC0-1.0",
    "creative commons attribution 4.0 international license": "CC-BY-4.0", "creative commons attribution-sharealike 4.0 international license": "CC-BY-SA-4.0", "creative commons attribution-noncommercial 4.0 international license": "CC-BY-NC-4.0", "creative commons attribution-noderivatives 4.0 international license": "CC-BY-ND-4.0",
}
#: The GNU family: spoken name, short name, versions; fixed values.
GNU = [("general public license", "GPL", ("2", "3")), ("lesser general public license", "LGPL", ("2.1", "3")), ("library general public license", "LGPL", ("2",)), ("affero general public license", "AGPL", ("3",))]


def _gnu() -> tuple[dict[str, str], dict[str, str], list]:
    """Sentences, names and rules of the GNU family, by rule from its names and versions."""
    sentences, names, rules = {}, {}, []
    for subject in ("program", "library", "file", "software"):
        sentences[f"gnu-hope-{subject}"] = f"This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    for spoken, short, versions in GNU:
        sentences[f"gnu-details-{spoken.split()[0]}"] = f"See the GNU {spoken} for more details."
        for v in versions:
            full = f"{short}-{v if '.' in v else v + '.0'}"
            for said in {v, v if "." in v else v + ".0"}:
                for name in (f"gnu {spoken} version {said}", f"gnu {spoken} v{said}", f"gnu {short.lower()} v{said}", f"gnu {short.lower()} version {said}", f"{short.lower()} v{said}", f"{short.lower()}v{said}", f"{short.lower()}-{said}"):
                    names[name] = names[f"{name} license"] = f"{full}-only"
                    names[f"{name} or later"] = names[f"{name} or any later version"] = f"{full}-or-later"
            for subject in ("program", "library", "file", "software"):
                start = f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the GNU {spoken} as published by the Free Software Foundation;"
                later, only = f"{full}-later-{subject}", f"{full}-only-{subject}"
                sentences[later] = f"{start} either version {v} of the License, or (at your option) any later version."
                sentences[only] = f"{start} version {v} of the License."
                for first, licence in ((later, f"{full}-or-later"), (only, f"{full}-only")):
                    hope, details = f"gnu-hope-{subject}", f"gnu-details-{spoken.split()[0]}"
                    rules += [(f"{first}-full", licence, CLASS_OF[licence], (first, hope, details)), (f"{first}-hope", licence, CLASS_OF[licence], (first, hope)), (first, licence, CLASS_OF[licence], (first,))]
    return sentences, names, rules


_GNU_SENTENCES, _GNU_NAMES, _GNU_RULES = _gnu()
SENTENCES |= _GNU_SENTENCES
NAMES |= _GNU_NAMES


def _cc_names() -> dict[str, str]:
    out = {}
    for kind, spoken, _ in CC:
        for v in CC_VERSIONS:
            for name in (f"cc {kind.lower()} {v}", f"cc-{kind.lower()}-{v}", f"cc-{kind.lower()} {v}", *(f"creative commons {said} {v}{where}" for said in {spoken, spoken.replace("-", " ")} for where in ("", " international", " unported", " generic"))):
                out[name] = out[f"{name} license"] = out[f"{name} licence"] = f"CC-{kind}-{v}"
    return out


NAMES |= _cc_names() | {"apache license version 2.0": "Apache-2.0", "apache 2": "Apache-2.0", "0bsd": "0BSD", "mit-0": "MIT-0", "isc": "ISC", "gpl": "GPL-1.0-or-later", "gnu gpl": "GPL-1.0-or-later", "gnu general public license": "GPL-1.0-or-later"}
NAMES |= {f"{name} licenses": licence for name, licence in list(NAMES.items()) if not name.endswith(("license", "licence"))}


def _rule(name: str, licence: str, *identifiers: str) -> tuple:
    return name, licence, CLASS_OF[licence], identifiers


#: (rule, licence, class, identifiers), first fit first; longer rules stand before their own parts. Fixed values.
RULES = [
    _rule("mit-full-title", "MIT", "mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"),
    _rule("mit-full-short", "MIT", "mit-title-short", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"),
    *(_rule(f"x11-{end}", "X11", "mit-grant", "mit-notice", "mit-as-is", end, "x11-except") for end in ("x11-liability", "mit-liability")),
    _rule("json", "JSON", "mit-grant", "mit-notice", "json-good", "mit-as-is", "mit-liability"),
    _rule("json-good", "JSON", "mit-grant", "mit-notice", "json-good"),
    _rule("mit0-title-full", "MIT-0", "mit0-title", "mit0-grant", "mit-as-is", "mit-liability"),
    _rule("mit0-full", "MIT-0", "mit0-grant", "mit-as-is", "mit-liability"),
    _rule("mit0", "MIT-0", "mit0-grant"),
    _rule("mit-full", "MIT", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"),
    _rule("mit-full-holder", "MIT", "mit-grant", "mit-notice", "mit-as-is", "x11-liability"),
    _rule("mit-no-notice", "MIT", "mit-grant", "mit-as-is", "mit-liability"),
    _rule("mit-grant-notice", "MIT", "mit-grant", "mit-notice"),
    _rule("isc", "ISC", "isc-grant"),
    _rule("isc-and", "ISC", "isc-grant-and"),
    _rule("0bsd", "0BSD", "0bsd-grant"),
    _rule("apache2-full", "Apache-2.0", "apache2-header", "apache2-compliance", "apache2-copy", "apache2-unless", "apache2-see"),
    _rule("apache2-notice", "Apache-2.0", "apache2-header", "apache2-compliance"),
    _rule("apache2-short", "Apache-2.0", "apache2-licensed"),
    _rule("apache2-title", "Apache-2.0", "apache2-title"),
    *_GNU_RULES,
    _rule("gpl3-work", "GPL-3.0-only", "gpl3-work"),
    _rule("lgpl3-work", "LGPL-3.0-only", "lgpl3-work"),
    _rule("agpl3-work", "AGPL-3.0-only", "agpl3-work"),
    _rule("gpl3-title", "GPL-3.0-only", "gpl3-title"),
    _rule("gpl2-title", "GPL-2.0-only", "gpl2-title"),
    _rule("lgpl3-title", "LGPL-3.0-only", "lgpl3-title"),
    _rule("lgpl2.1-title", "LGPL-2.1-only", "lgpl2.1-title"),
    _rule("agpl3-title", "AGPL-3.0-only", "agpl3-title"),
    *(_rule(f"bsd4-{end}", "BSD-4-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", end) for end in ("bsd-endorse", "bsd-endorse-one", "bsd-endorse-names")),
    *(_rule(f"bsd3-{end}-as-is", "BSD-3-Clause", "bsd-grant", "bsd-source", "bsd-binary", end, "bsd-as-is", "bsd-liability") for end in ("bsd-endorse", "bsd-endorse-one", "bsd-endorse-names")),
    _rule("bsd3", "BSD-3-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"),
    _rule("bsd3-one", "BSD-3-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-one"),
    _rule("bsd3-names", "BSD-3-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-names"),
    _rule("bsd2-as-is", "BSD-2-Clause", "bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-liability"),
    _rule("bsd2", "BSD-2-Clause", "bsd-grant", "bsd-source", "bsd-binary"),
    _rule("zlib", "Zlib", "zlib-as-is", "zlib-grant"),
    _rule("boost", "BSL-1.0", "boost-grant"),
    _rule("mpl2", "MPL-2.0", "mpl2-header"),
    _rule("mpl2-title", "MPL-2.0", "mpl2-title"),
    _rule("wtfpl", "WTFPL", "wtfpl"),
    _rule("cc-by-nc-4", "CC-BY-NC-4.0", "cc-by-nc-4"),
    _rule("cc-by-nc-4-work", "CC-BY-NC-4.0", "cc-by-nc-4-work"),
    _rule("cc-by-4", "CC-BY-4.0", "cc-by-4"),
    _rule("cc-by-4-work", "CC-BY-4.0", "cc-by-4-work"),
    _rule("cc-by-sa-4", "CC-BY-SA-4.0", "cc-by-sa-4"),
    _rule("cc-by-nd-4", "CC-BY-ND-4.0", "cc-by-nd-4"),
    _rule("cc0", "CC0-1.0", "cc0-1"),
    _rule("unlicense", "Unlicense", "unlicense"),
    _rule("mit-released", "MIT", "mit-released"),
    _rule("mit-licensed", "MIT", "mit-licensed"),
    *(_rule(f"notice:{licence}", licence, f"notice:{licence}") for licence in CLASS_OF),
    *(_rule(f"spdx:{licence}", licence, f"spdx:{licence}") for licence in CLASS_OF),
]

GAP = 2
ALIKE = 0.7
NEAR_WORDS = 8
_CUT = re.compile(r"(?<=[.!?;:])\s+|\s*\n\s*")
_BLANK_LINE = re.compile(r"\n\s*\n")
_COPYRIGHT = re.compile(r"^(copyright|\(c\)|©).*\b(19|20)\d\d\b.*$", re.IGNORECASE)
_MARKS = re.compile(r"^[\s/#*;%>-]+")
_WORD = re.compile(r"[\w]+(?:[.+-][\w]+)*")
#: A notice: perhaps a subject, a verb, "under", and the name of a licence with what may follow it.
_NOTICE = re.compile(r"(?:(?:\S+ ){1,8}(?:is|are) )?(?:dual[- ])?(?:licensed|released|distributed|available|published|provided)(?: and (?:licensed|distributed|released))? under (?:the )?(?:terms of )?(?:(?:the|a|an) )?(.+)")
_AFTER = frozenset("see for and or by please a which that you unless".split())
_SPDX = re.compile(r"spdx-license-identifier (\S+)$")
_SPDX_LINE = re.compile(r"spdx-license-identifier:\s*([A-Za-z0-9.+()\- \t]+)", re.IGNORECASE)
_SPDX_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_SPDX_NAMES = {licence.lower(): licence for licence in CLASS_OF} | {f"{s.lower()}-{v}": f"{s}-{v}-only" for s, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))} | {f"{s.lower()}-{v}+": f"{s}-{v}-or-later" for s, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))}
FIELDS = "licence string, class string, rule string, first_sentence long, n_sentences long, start_char long, end_char long, identifiers array<string>"


def expression(text: str) -> tuple[str, str, int] | None:
    """(expression, class, end) of the longest SPDX expression that text begins with: OR binds weaker than AND, AND than WITH."""
    tokens = [(m[0], m.end()) for m in _SPDX_TOKEN.finditer(text)]

    def chain(at: int, word: str, deeper, pick) -> tuple[str, str, int] | None:
        first = deeper(at)
        while first and first[2] < len(tokens) and tokens[first[2]][0].upper() == word:
            more = deeper(first[2] + 1)
            if not more:
                break
            first = (f"{first[0]} {word} {more[0]}", pick((first[1], more[1]), key=ORDER.index), more[2])
        return first

    def single(at: int) -> tuple[str, str, int] | None:
        if at >= len(tokens):
            return None
        if tokens[at][0] == "(":
            inner = either(at + 1)
            return (f"({inner[0]})", inner[1], inner[2] + 1) if inner and inner[2] < len(tokens) and tokens[inner[2]][0] == ")" else None
        name = _SPDX_NAMES.get(tokens[at][0].lower())
        if not name:
            return None
        if at + 2 < len(tokens) and tokens[at + 1][0].upper() == "WITH" and tokens[at + 2][0] not in "()":
            return f"{name} WITH {tokens[at + 2][0]}", CLASS_OF[name], at + 3
        return name, CLASS_OF[name], at + 1

    def both(at: int) -> tuple[str, str, int] | None:
        return chain(at, "AND", single, max)

    def either(at: int) -> tuple[str, str, int] | None:
        return chain(at, "OR", both, min)

    found = either(0)
    if not found:
        return None
    said = found[0]
    if said.startswith("(") and said.endswith(")") and expression(said[1:-1]) and expression(said[1:-1])[0] == said[1:-1]:
        said = said[1:-1]  # brackets round the whole say nothing
    return said, found[1], tokens[found[2] - 1][1]


def normalise(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


def _pattern(known: str) -> re.Pattern:
    """A known sentence with holes as a pattern over normalised words."""
    parts = [normalise(p) for p in known.split("{}")]
    return re.compile(r"(?:\S+ ){1,12}".join(re.escape(p + " ") if i + 1 < len(parts) else re.escape(p) for i, p in enumerate(parts)))


class Scanner:
    """Sentences may span several lines: the words of the longest known sentence that begins at a place count."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list = RULES, gap: int = GAP, names: dict[str, str] = NAMES, alike: float = ALIKE):
        self.gap, self.names, self.alike = gap, names, alike
        #: Rules by their first identifier, in the order of the list.
        self.rules: dict[str, list[tuple[int, tuple]]] = {}
        for place, rule in enumerate(rules):
            self.rules.setdefault(rule[3][0], []).append((place, rule))
        self.known: dict[str, str] = {}
        self.open: dict[str, list[tuple[re.Pattern, str]]] = {}
        self.like: dict[str, list[tuple[Counter, int, str]]] = {}
        first = []
        for name, text in sentences.items():
            plain = normalise(text.split("{}")[0]) if "{}" in text else normalise(text)
            first.append(plain)
            start = " ".join(plain.split()[:2])
            if "{}" in text:
                self.open.setdefault(start, []).append((_pattern(text), name))
            else:
                self.known.setdefault(plain, name)
            words = normalise(text.replace("{}", "")).split()
            if len(words) >= NEAR_WORDS:
                self.like.setdefault(start, []).append((Counter(words), len(words), name))
        self.starts = {" ".join(k.split()[:2]) for k in first}
        self.longest = max((len(normalise(t)) for t in sentences.values()), default=0) + 120
        #: Every known sentence has one of these words: its longest.
        self.anchors = sorted({max(k.split(), key=lambda w: (len(w), w)) for k in first} | {"under", "spdx"})

    def notice(self, sentence: str) -> str | None:
        """The identifier of a short notice, by the licence that it names."""
        m = _NOTICE.match(sentence)
        if m:
            said = self.named(m[1].split())
            if said:
                return f"notice:{said}"
        m = _SPDX.match(sentence)
        if m:
            name = _SPDX_NAMES.get(m[1])
            return f"spdx:{name}" if name else None
        return None

    def named(self, words: list[str]) -> str | None:
        """The licence that words begin with, or two or more joined by or, and."""
        for n in range(min(len(words), 9), 0, -1):
            licence = self.names.get(" ".join(words[:n]))
            if not licence:
                continue
            rest = words[n:]
            if rest and rest[0] in ("or", "and"):
                more = rest[1:]
                while more and more[0] in ("the", "a", "under", "terms", "of"):
                    more = more[1:]
                other = self.named(more)
                if other:
                    return f"{licence} {rest[0].upper()} {other}"
            if not rest or rest[0] in _AFTER:
                return licence
        return None

    def whole(self, joined: str, start: str) -> str | None:
        """The identifier of a sentence that is known, as it is or with its holes filled."""
        return self.known.get(joined) or next((name for pattern, name in self.open.get(start, ()) if pattern.fullmatch(joined)), None)

    def sentences(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, normalised) of every sentence."""
        out, at = [], 0
        for m in _CUT.finditer(text):
            if m.start() > at:
                out.append((at, m.start(), text[at : m.start()]))
            at = m.end()
        if at < len(text):
            out.append((at, len(text), text[at:]))
        return [(a, b, normalise(_MARKS.sub("", s))) for a, b, s in out if not _COPYRIGHT.match(s)]

    def identify(self, text: str) -> list[tuple[int, int, int, str | None]]:
        """(index, start, end, identifier or None); pieces of one sentence over several lines are joined. Nearly known: ``~`` before."""
        pieces = [p for p in self.sentences(text) if p[2]]
        out, i, number = [], 0, 0
        while i < len(pieces):
            own = pieces[i][2].split()
            start = " ".join(own[:2])
            if len(own) < 2 and i + 1 < len(pieces):
                start = f"{start} {pieces[i + 1][2].split()[0]}"
            found, near, near_share = None, None, self.alike
            if start in self.starts:
                joined = ""
                for k in range(i, len(pieces)):
                    joined = f"{joined} {pieces[k][2]}".strip()
                    if len(joined) > self.longest:
                        break
                    name = self.whole(joined, start)
                    if name:
                        found = (k, name)
                    elif start in self.like:
                        words = joined.split()
                        counts = Counter(words)
                        for wanted, n, name in self.like[start]:
                            share = (counts & wanted).total() / max(len(words), n)
                            if share > near_share:
                                near, near_share = (k, "~" + name), share
            if found is None and "under" in own:
                for k in range(i, min(i + 3, len(pieces))):  # a notice may go on in the next line
                    name = self.notice(" ".join(p[2] for p in pieces[i : k + 1]))
                    if name:
                        found = (k, name)
                        break
            if found is None and own[0].startswith("spdx"):
                m = _SPDX_LINE.search(text, pieces[i][0], pieces[min(i + 1, len(pieces) - 1)][1])
                said = expression(m[1]) if m else None
                if said:
                    found = (i + 1 if i + 1 < len(pieces) and pieces[i + 1][0] < m.start(1) + said[2] else i, f"spdx:{said[0]}")
            found = found or near
            last = found[0] if found else i
            out.append((number, pieces[i][0], pieces[last][1], found[1] if found else None))
            number += 1
            i = last + 1
        return out

    def scan(self, text: str) -> list[tuple]:
        """All matches of a text as rows of FIELDS."""
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return []
        known = [x for x in self.identify(text) if x[3] is not None]
        out, i = [], 0
        while i < len(known):
            way, _, said = known[i][3].partition(":")
            if way in ("notice", "spdx") and known[i][3] not in self.rules:  # several licences
                x = known[i]
                out.append((said, expression(said)[1], way, x[0], 1, x[1], x[2], [x[3]]))
                i += 1
                continue
            for _, (rule, licence, kind, wanted) in self.rules.get(known[i][3].lstrip("~"), ()):
                own = known[i : i + len(wanted)]
                exact = sum(x[3][0] != "~" for x in own)
                if tuple(x[3].lstrip("~") for x in own) == wanted and (2 * exact >= len(own) or len(own) == 1) and all(b[0] - a[0] - 1 <= self.gap for a, b in zip(own, own[1:], strict=False)):
                    out.append((licence, kind, rule, own[0][0], len(own), own[0][1], own[-1][2], [x[3] for x in own]))
                    i += len(own)
                    break
            else:
                x = known[i]
                if x[3][0] != "~":
                    out.append(("UNMATCHED", "unknown", None, x[0], 1, x[1], x[2], [x[3]]))
                i += 1
        return out


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list = RULES, gap: int = GAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the fields of every licence match."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules, gap)
        for batch in bounded_slices(batches, "text"):
            rows, found = [], []
            for i, data in enumerate(as_bytes(batch.column("text"))):
                for x in scanner.scan(data.decode("utf-8", "replace")):
                    rows.append(i)
                    found.append(x)
            columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {FIELDS}")
