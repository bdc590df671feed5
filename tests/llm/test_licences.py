import textwrap

import pytest

from kilowatch.llm import licences as L

MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use.

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file.
"""
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def test_rules(documents):
    cases = {
        "MIT": [MIT, "Prose here.\nReleased under the MIT license.\nMore prose."], "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "x\n" + APACHE],
        "GPL-3": ["This work is licensed under the GNU General Public License, version 3."], "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."], "GPL-3-or-later": [GPL],
        "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n* Redistributions of source code must retain the above copyright notice.\n* Redistributions in binary form must reproduce the above copyright notice."],
        "Apache-2.0 OR MIT": [], "MIT-0": ["// SPDX-License-Identifier: MIT-0"], "unknown": ["Licensed under the terms of nobody."],
    }
    scanner = L.Scanner()
    for licence, given in cases.items():
        for text in given:
            found = [m[0] for m in scanner(text)]
            assert (found[0] if found else None).lower() == licence.lower(), (licence, found, list(scanner.sentences(text)))
    assert scanner("A licensee walked in. Nothing else.") == [] and scanner("") == []
    text = "ünï. " + "word " * 1000 + "\nReleased under the MIT license. Then prose.\nLicensed under CC BY-NC 4.0.\n"
    (first, a, b, _), (second, c, d, _) = scanner(text)
    assert (text[a:b], text[c:d]) == ("Released under the MIT license.", "Licensed under CC BY-NC 4.0.") and (first, second) == ("MIT", "CC-BY-NC-4.0")
    rows = [(1, text), (None, text), (2, None), (3, ""), (1, text)]
    assert len(L.scan(documents(rows)).collect()) == 6 and L.scan(documents([])).collect() == []


AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = (
    ["Copyright (c) 2020, Somebody\nAll rights are theirs", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    ["1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    ["3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    ["""THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""],
)
CANONICAL = {
    "MIT": ("mit_grant,mit_notice,as_is,no_liability", ["Copyright (c) 2020 Somebody", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", AS_IS]),
    "ISC": ("isc_grant,as_is,no_liability", ["Copyright (c) 2020, Somebody", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER."""]),
    "BSD-3-Clause": ("bsd_grant,bsd_source,bsd_binary,bsd_names,as_is,no_liability", sum(BSD, [])),
    "BSD-2-Clause": ("bsd_grant,bsd_source,bsd_binary,as_is,no_liability", BSD[0] + BSD[1] + BSD[3]),
    "GPL-3-or-later": ("gpl_free,gpl_hope,gpl_see,gpl_received", ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program."]),
    "GPL-2-or-later": ("gpl_free", ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."]),
    "Apache-2.0": ("apache2_short,apache2_use,apache2_copy,apache2_as_is,apache2_see", ["Copyright 2020 Somebody", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at""", "    http://www.apache.org/licenses/LICENSE-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""]),
    "MPL-2.0": ("mpl2", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."]),
}
MARKS = [("", "", ""), ("", "# ", ""), ("", "// ", ""), ("/*\n", " * ", "\n */"), ("<!--\n", "  ", "\n-->"), ("", "! ", ""), ("", ";; ", ""), ("", "-- ", "")]


@pytest.mark.parametrize("licence", CANONICAL)
def test_wrapped_texts_give_all_their_sentences(licence):
    sentences, paragraphs = CANONICAL[licence]
    scanner = L.Scanner()
    for width in (10_000, 100, 78, 72, 60, 45, 30):
        lines = "\n\n".join(p if p.startswith("    ") else textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in paragraphs).split("\n")
        for before, mark, after in MARKS:
            for end in ("\n", "\r\n"):
                text = (before + "\n".join((mark + x).rstrip() for x in lines) + after).replace("\n", end)
                found = [(m[0], m[3]) for m in scanner(f"Some prose.{end}{end}{text}{end}{end}int main;{end}")]
                assert found == [(licence, sentences)], (width, mark, text)


def test_single_lines_stay_sentences_of_their_own():
    names = lambda text: [(m[0], text[m[1] : m[2]]) for m in L.Scanner()(text)]
    assert names("Title\nReleased under the MIT license\nLicensed under CC BY 4.0\nfoo") == [("MIT", "Released under the MIT license"), ("CC-BY-4.0", "Licensed under CC BY 4.0")]
    assert names("// SPDX-License-Identifier: MIT\n// Copyright 2020 X\n// A licence of nobody\n// with more") == [("MIT", "// SPDX-License-Identifier: MIT"), ("unknown", "// A licence of nobody")]
    assert names("2. Released under the MIT\n   license.") == [("MIT", "Released under the MIT\n   license.")]
    assert names("Licensed under the GNU General Public License, version\n2. Else.") == [("GPL-2", "Licensed under the GNU General Public License, version\n2.")]
    assert names("Licensed under a Creative Commons thing\nReleased under the MIT license.") == [("unknown", "Licensed under a Creative Commons thing"), ("MIT", "Released under the MIT license.")]
    assert names("Keep this\ncopyright notice and its licence.") == [("unknown", "copyright notice and its licence.")]


# Sentences of public licences as they are written, and what each is known as.
SENTENCES = {
    "mit_short": "Released under the MIT license.", "apache2_short": "Licensed under the Apache License, Version 2.0.", "cc": "Licensed under CC BY-NC 4.0.", "gpl_work": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl_work": "Licensed under the GNU Lesser General Public License, version 2.1.", "mpl2": "Licensed under the Mozilla Public License, version 2.0.", "unlicense": "This is free and unencumbered software released into the public domain.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd_source": "Redistributions of source code must retain the above copyright notice.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice.", "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as_is": 'The software is provided "as is", without warranty of any kind, express or implied.', "apache2_use": "You may not use this file except in compliance with the License.", "gpl_see": "See the GNU General Public License for more details.",
    "unknown": "Licensed under the terms of nobody.",
}
VERSIONS = {"cc": "BY-NC-4.0", "gpl_work": "3", "lgpl_work": "2.1"}
PROSE = ["The quick fox walks by the river.", "Nothing was said, and nobody asked.", "Words of no concern stand here."]


def plain_scan(names):
    """Licences of a sequence of sentences (None is prose), sentence by sentence and rule by rule."""
    runs, run = [], []
    for name in [*names, None]:
        if name is None:
            runs, run = (runs + [run] if run else runs), []
        else:
            run.append(name)
    found = []
    for run in runs:
        while run:
            used, licence = 1, "unknown"
            for title, sequence in L.RULES:
                at, version = 0, ""
                for step in sequence:
                    name = step.rstrip("?")
                    if at < len(run) and run[at] == name:
                        version = version or VERSIONS.get(name, "")
                        at += 1
                    elif not step.endswith("?"):
                        at = 0
                        break
                if at:
                    used, licence = at, title.replace("{}", version)
                    break
            found.append((licence, ",".join(run[:used])))
            run = run[used:]
    return found


def test_random_mixtures_equal_a_plain_scan(documents):
    import random

    r = random.Random(17)
    rows, want = [], []
    for k in range(400):
        names = [r.choice([None, *SENTENCES, "bsd_grant", "as_is"]) for _ in range(r.randrange(0, 9))]
        if r.random() < 0.3:
            names += ["bsd_grant", "bsd_source", "bsd_binary", *r.choice([[], ["as_is"], [None]])]
        text = "\n\n".join(SENTENCES[n] if n else r.choice(PROSE) for n in names)
        rows.append((k, text))
        want += [(k, *found) for found in plain_scan(names)]
    got = [(x["doc_id"], x["licence"], x["sentences"]) for x in L.scan(documents(rows)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 600
