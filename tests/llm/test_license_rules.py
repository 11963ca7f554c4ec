import random
import re

import pytest

from brindle.llm import license_scan as L

S = L.SENTENCES


def licences(text):
    return [x[0] for x in L.Scanner().scan(text)]


BSD = "\n".join(S[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))


@pytest.mark.parametrize("holder", ["the copyright holder", "Google Inc.", "the University of California, Berkeley", "Example Ltd"])
def test_bsd_with_any_holder(holder):
    text = f"{BSD}\n{S['bsd-endorse'].format(holder)}\n{S['bsd-as-is'].format('THE COPYRIGHT HOLDERS AND CONTRIBUTORS')} {S['bsd-liability'].format('THE COPYRIGHT OWNER')}"
    assert licences(text) == ["BSD-3-Clause"]
    wrapped = re.sub(r"(.{50}\S*) ", r"\1\n * ", text)
    assert licences(wrapped) == ["BSD-3-Clause"]
    assert licences(BSD) == ["BSD-2-Clause"]


def test_a_reworded_clause_is_not_left_out():
    odd = "Neither the name of the firm nor the names of its helpers may be used to endorse or promote goods derived from this software without specific prior written permission."
    rows = L.Scanner().scan(f"{BSD}\n{odd}")
    assert [r[0] for r in rows] == ["BSD-3-Clause"] and rows[0][7][-1] == "~bsd-endorse"
    assert licences(odd) == []


NOTICES = {
    "This project is licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
    "Licensed under the Apache License 2.0": "Apache-2.0",
    "The code is released under the Apache License, Version 2.0, unless stated.": "Apache-2.0",
    "This software is distributed under the terms of the GNU General Public License version 2.": "GPL-2.0-only",
    "Released under the GNU General Public License v3.0 or later.": "GPL-3.0-or-later",
    "Data is available under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only",
    "/* SPDX-License-Identifier: MIT */": "MIT",
    "// SPDX-License-Identifier: LGPL-2.1+\nint x;": "LGPL-2.1-or-later",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL-2.1-or-later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL-3.0-or-later",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.": "GPL-2.0-only",
    "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007": "GPL-3.0-only",
}


@pytest.mark.parametrize("text", NOTICES)
def test_notices(text):
    assert licences(f"Some words before.\n\n{text}\n\nSome words after.") == [NOTICES[text]]


def test_what_is_no_notice():
    for text in ("He is licensed under the state's law.", "It was published under the sun.", "Under the MIT building.", "This is licensed under the MIT lizard licence.", "spdx", "SPDX-License-Identifier: NONE-SUCH"):
        assert licences(text) == []


def test_rules_against_a_plain_search():
    """Random sequences of known and unknown sentences, wrapped at random: matches as by trying every rule at every place."""
    rng = random.Random(9)
    names = [n for n in S if not n.startswith(("mit-title", "gnu-hope", "mpl2-title", "apache2-lic", "apache2-hea"))]
    chains = [r[3] for r in L.RULES if r[3][0] in S]
    for _ in range(150):
        sequence = []
        while len(sequence) < rng.randint(1, 14):
            sequence += rng.choice([[None], [None], [None] * 3, [rng.choice(names)], list(rng.choice(chains))])
        text, known = [], []
        for at, name in enumerate(sequence):
            text.append(S[name].replace("{}", "Some Holder of It") if name else f"Unknown words number {at} stand here and mean nothing.")
            if name:
                known.append((at, name))
        want, i = [], 0
        while i < len(known):
            for rule, licence, _, wanted in L.RULES:
                own = known[i : i + len(wanted)]
                if tuple(n for _, n in own) == wanted and all(b - a <= L.GAP + 1 for (a, _), (b, _) in zip(own, own[1:], strict=False)):
                    want.append((licence, own[0][0], len(own)))
                    i += len(own)
                    break
            else:
                want.append(("UNMATCHED", known[i][0], 1))
                i += 1
        body = "\n\n".join(re.sub(r"(.{40}\S*) ", lambda m: m[1] + rng.choice([" ", "\n", "\n# "]), t) for t in text)
        got = [(x[0], x[3], x[4]) for x in L.Scanner(alike=2).scan(body)]
        assert [g[0] for g in got] == [w[0] for w in want] and [g[2] for g in got] == [w[2] for w in want]


def _texts(*names):
    return "\n".join(L.SENTENCES[n] for n in names)


X11 = "IN NO EVENT SHALL THE X CONSORTIUM BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nExcept as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."


@pytest.mark.parametrize(
    "text, want",
    [
        (_texts("mit-grant", "mit-notice", "mit-as-is", "mit-liability"), "MIT"), (_texts("mit0-title", "mit0-grant", "mit-as-is", "mit-liability"), "MIT-0"), (_texts("mit0-grant"), "MIT-0"),
        (_texts("mit-grant", "mit-notice", "json-good", "mit-as-is", "mit-liability"), "JSON"), (_texts("mit-grant", "mit-notice", "mit-as-is") + "\n" + X11, "X11"),
        ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "0BSD"),
        (L.SENTENCES["unlicense"].replace("unencumbered", "unburdened"), "Unlicense"),
    ],
)
def test_close_variants_are_told_apart(text, want):
    assert [r[0] for r in L.Scanner().scan("intro text here\n\n" + text + "\n\nrest of it")] == [want]


@pytest.mark.parametrize(
    "text, want, kind",
    [
        ("MIT OR Apache-2.0", "MIT OR Apache-2.0", "permissive"), ("(MIT AND BSD-3-Clause)", "MIT AND BSD-3-Clause", "permissive"), ("(MIT OR GPL-2.0-only) AND LGPL-2.1+", "(MIT OR GPL-2.0-only) AND LGPL-2.1-or-later", "weak-copyleft"),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0-or-later WITH Classpath-exception-2.0", "copyleft"), ("MIT and GPL-3.0-only or ISC", "MIT AND GPL-3.0-only OR ISC", "permissive"), ("ISC */", "ISC", "permissive"),
    ],
)
def test_spdx_expressions(text, want, kind):
    for line in (f"// SPDX-License-Identifier: {text}\nint main() {{}}", f"/* spdx-license-identifier: {text}"):
        assert [(r[0], r[1]) for r in L.Scanner().scan(line)] == [(want, kind)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Dual licensed under the MIT and GPL licenses.", "MIT AND GPL-1.0-or-later"), ("Licensed under the Apache License, Version 2.0 or MIT.", "Apache-2.0 OR MIT"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"), ("Published under the Creative Commons Attribution-NonCommercial-ShareAlike 2.5 Generic licence.", "CC-BY-NC-SA-2.5"), ("It is released under the terms of the GNU GPL v3 or later.", "GPL-3.0-or-later"),
    ],
)
def test_notices_of_several_licences_and_families(text, want):
    assert [r[0] for r in L.Scanner().scan(text)] == [want]


def test_words_that_only_look_like_notices():
    for text in ("The film was released under the title Mit.", "SPDX-License-Identifier: ", "SPDX-License-Identifier: NONE-SUCH", "He was licensed under and or by nothing.", "spdx (((( or and"):
        assert [r for r in L.Scanner().scan(text) if r[0] != "UNMATCHED"] == []
