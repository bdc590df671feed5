"""Licence scans by sentence rules.

A text is cut into sentences, which end at a full stop, an exclamation or question mark before white space, or at a line
without letters and digits; a single line end is white space. Known sentences are compared by their words (lower case;
comment marks, quotes, punctuation and white space between words don't count); they may begin at the start of a sentence, of
a line or after a semicolon, and end at such a place too. Each has an identifier, and the parts of some that vary (names,
years, versions) are wildcards, which end at a list item, a line that ends with a colon or the next known sentence. An
address on a line of its own after an empty line still belongs to the sentence before. List numbers are left out. The
identifiers of neighbouring sentences form a sequence, with copyright lines left out, and the sequence is matched against
ordered rules: the first rule that fits at a place wins, its sentences are used up, and matching goes on after them. A line
of a sentence that speaks of a licence and belongs to no known one, and known sentences that no rule takes, are reported as
`unknown`.

Result: one row per match with its code points in the text (end exclusive). Null and empty texts give no row, repeated rows
theirs once each, null ids stay null. Texts are read whole, sentence by sentence.
"""

import re

import pyarrow as pa

from kilowatch.llm.common import emit, texts

# Known sentences after normalisation; {} stands for a varying part, which the patterns below limit.
SENTENCES = {
    "mit_short": ["released under the mit license", "licensed under the mit license", "this project is licensed under the terms of the mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction{any}"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as_is": ["the software is provided as is without warranty of any kind express or implied{any}", "this software is provided by the copyright holders and contributors as is{any}", "the software is provided as is and the author disclaims all warranties{any}"],
    "no_liability": ["in no event shall the authors or copyright holders be liable for any claim{any}", "in no event shall the copyright holder{any}", "in no event shall the author be liable for any{any}"],
    "apache2_short": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "released under the apache license version 2.0"],
    "apache2_use": ["you may not use this file except in compliance with the license"],
    "apache2_copy": ["you may obtain a copy of the license at{any}"],
    "apache2_as_is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis{any}"],
    "apache2_see": ["see the license for the specific language governing permissions and limitations under the license"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met{any}"],
    "bsd_source": ["{any}redistributions of source code must retain the above copyright notice{any}"],
    "bsd_binary": ["{any}redistributions in binary form must reproduce the above copyright notice{any}"],
    "bsd_names": ["{any}neither the name of {any} may be used to endorse or promote products derived from this software{any}"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted{any}"],
    "gpl_work": ["this work is licensed under the gnu general public license version {version}", "licensed under the gnu general public license version {version}"],
    "gpl_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {version} of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty{any}"],
    "gpl_see": ["see the gnu general public license for more details"],
    "gpl_received": ["you should have received a copy of the gnu general public license along with this program{any}"],
    "lgpl_work": ["licensed under the gnu lesser general public license version {version}", "this work is licensed under the gnu lesser general public license version {version}"],
    "mpl2": ["this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0"],
    "cc": ["licensed under cc {cc}", "this work is licensed under cc {cc}", "this work is licensed under a creative commons {any} license", "licensed under the creative commons {any} license"],
    "cc0": ["released under cc0 1.0", "to the extent possible under law the author has waived all copyright{any}"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "spdx": ["spdx license identifier {spdx}"],
    "all_rights": ["all rights reserved"],
}

# What a varying part can be.
PARTS = {"any": r".*", "version": r"(?P<version>[0-9]+(?:\.[0-9]+)*)", "cc": r"(?P<version>by(?: (?:nc|sa|nd))* [0-9]\.[0-9])", "spdx": r"(?P<version>.+)"}

# Ordered rules, a licence and the sentences it consists of; `?` marks one that may be missing.
# {} is the varying part of a sentence of the sequence.
RULES = (
    ("MIT", ("mit_short?", "mit_grant", "mit_notice", "as_is", "no_liability?")),
    ("ISC", ("isc_grant", "as_is", "no_liability?")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "as_is?", "no_liability?")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "as_is?", "no_liability?")),
    ("Apache-2.0", ("apache2_short", "apache2_use?", "apache2_copy?", "apache2_as_is?", "apache2_see?")),
    ("GPL-{}-or-later", ("gpl_free", "gpl_hope?", "gpl_see?", "gpl_received?")),
    ("GPL-{}", ("gpl_work",)),
    ("LGPL-{}", ("lgpl_work",)),
    ("MIT", ("mit_short",)),
    ("MPL-2.0", ("mpl2",)),
    ("CC-{}", ("cc",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("{}", ("spdx",)),
    ("proprietary", ("all_rights",)),
)

#: Sentences without any of these are of no concern.
WORTH = re.compile(r"licen[sc]e|copyright|warrant|permission|redistribut|software|all rights reserved|public domain|liable|cc0|law", re.I)
SPEAKS = re.compile(r"\blicen[sc](?:e|ed|es|ing)\b")
COPYRIGHT = re.compile(r"(?:copyright\b|c (?:19|20)[0-9]{2}\b).*")
_BROKEN = r"(?![^\w\n]*(?:\n(?!(?:[^\w\n]*\n){0,3}[^\w\n]*https?://\S+[^\w\n]*(?:\n|\Z))|\Z))"  # after a line end: no line without words, or one before an address
_SENTENCE = re.compile(rf"[^\n.!?]*(?:(?:[.!?](?!\s|$)|(?<=\b[vV])\.(?=\s\W{{0,20}}[0-9])|\n{_BROKEN})[^\n.!?]*)*[.!?]*")
_PIECE = re.compile(r"[^\n;]*(?:;(?!\s)[^\n;]*)*;?")
_STOPS = re.compile(r"(?m)^[^\w\n.!?]*[.!?][^\w\n]*(?=[^\S\n]|$)")  # marks that look like the end of a sentence
_ITEM = re.compile(r"(?m)^([^\w\n]*)([0-9]{1,2}[.)]|[abd-h]\))(?=[^\S\n])")
_BULLET = "•"
_VERSION = re.compile(r"(?:version|\bv)\W*$", re.I)
_WORD = re.compile(r"\w+")
_REST = re.compile(r"[^\w\n;]*;?")
_DATED = re.compile(r"copyright (?:c|[0-9]{4})\b|c (?:19|20)[0-9]{2}\b")
_DROP = re.compile(r"[^\w.]+")
_DOTS = re.compile(r"\.(?![0-9])(?!\s[0-9])")
_END = r"(?=[^\w\n;]*(?:[\n;]|\Z))"


def normal(sentence):
    return _DOTS.sub("", _DROP.sub(" ", sentence.lower())).strip().replace("licence", "license")


def _plain(text):
    """The text, place for place, with bullets for list numbers and blanks for marks that look like a sentence's end."""

    def item(found):
        before = text[max(0, found.start() - 40) : found.start()]
        return found[0] if _VERSION.search(before) else found[1] + _BULLET * len(found[2])

    return _ITEM.sub(item, _STOPS.sub(lambda found: re.sub(r"[.!?]", " ", found[0]), text))


def _words(template):
    """A pattern of the template's words in a text as it is written."""
    words = (re.escape(w).replace("license", "licen[sc]e") for w in re.split(r"\s+", template))
    return r"\W+".join(words)


def _pattern(template):
    parts = re.split(r"(\{\w+\})", template)
    return "".join(PARTS[p[1:-1]].replace(" ", r"\W+") if p.startswith("{") else _words(p) for p in parts)


class Known:
    """A template: its pattern, what it begins with, and whether its last part is open."""

    def __init__(self, name, template):
        self.name, self.led, self.open = name, template.startswith("{any}"), template.endswith("{any}")
        core = template.removeprefix("{any}").removesuffix("{any}")
        self.first, self.free = core.split()[0], "{any}" in core
        self.head = re.compile(_words(core.split("{")[0].strip()), re.I)
        self.pattern = re.compile(_pattern(core).replace(".*", r"[\s\S]*?") + ("" if self.open else _END), re.I)


class Scanner:
    """Known sentences, ready to be looked up by their first words."""

    def __init__(self, sentences=SENTENCES, rules=RULES):
        known = [Known(name, t) for name, templates in sentences.items() for t in templates]
        self.by_first = {}
        for k in sorted(known, key=lambda k: k.free or k.open):  # those that have an end of their own come first
            self.by_first.setdefault(k.first, []).append(k)
        self.led = re.compile(r"\b(?:" + "|".join(sorted({k.first for k in known if k.led})) + r")\b", re.I)
        self.rules = [(licence, [(s.rstrip("?"), s.endswith("?")) for s in sequence]) for licence, sequence in rules]

    def _heads(self, text, start, end):
        """(place, known sentence) of those that begin in a piece."""
        first = _WORD.search(text, start, end)
        if first:
            for known in self.by_first.get(first[0].lower().replace("licence", "license"), ()):
                yield first.start(), known
            for word in self.led.finditer(text, first.end(), end):
                for known in self.by_first[word[0].lower()]:
                    if known.led:
                        yield word.start(), known

    def _found(self, text, pieces, end):
        """For each piece of a sentence the known one that begins there: (its end, identifier, varying part), or None.

        From the last piece to the first; wildcards reach as far as `limit`, where something else begins.
        """
        out, limit = [None] * len(pieces), end
        for k in range(len(pieces) - 1, -1, -1):
            start, stop = pieces[k]
            if k + 1 < len(pieces) and text[start : pieces[k + 1][0]].rstrip("\n\r\t */#-").endswith(":") and "\n" in text[stop : pieces[k + 1][0]]:
                limit = pieces[k + 1][0]
            best, begun = None, False
            for place, known in self._heads(text, start, stop):
                loose = known.free or known.open
                if loose and best:
                    break
                if not loose:
                    match = known.pattern.match(text, place, end)
                elif known.head.match(text, place, limit):
                    begun, match = True, known.pattern.match(text, place, limit)
                else:
                    continue
                if match:
                    close = limit if known.open else _REST.match(text, match.end(), end).end()
                    if best is None or close > best[0]:
                        said = match.groupdict().get("version")
                        best = close, known.name, said and normal(said)
            out[k] = best
            if best or begun or text[start:stop].lstrip("\t */#-;").startswith(_BULLET) or _DATED.match(normal(text[start:stop])):
                limit = start
        return out

    def _line(self, line, fresh):
        """Identifier of what belongs to no known sentence: `copyright`, `unknown`, None for no concern, "" for no word."""
        said = normal(line)
        if not said.strip("0123456789. "):
            return ""
        if _DATED.match(said) or (fresh and COPYRIGHT.match(said)):
            return "copyright"
        return "unknown" if SPEAKS.search(said) else None

    def _parts(self, text, start, end):
        """(start, end, identifier, varying part) of what a sentence of concern consists of."""
        pieces = [m.span() for m in _PIECE.finditer(text, start, end) if _WORD.search(m[0])]
        found, k, fresh = self._found(text, pieces, end), 0, True
        while k < len(pieces):
            first = k
            if found[k]:
                stop, *said = found[k]
                while k < len(pieces) and pieces[k][0] < stop:
                    k += 1
                fresh = True
            else:
                k += 1
                while k < len(pieces) and not found[k] and "\n" not in text[pieces[k - 1][1] : pieces[k][0] + 1]:
                    k += 1
                stop = pieces[k - 1][1]
                said = [self._line(text[pieces[first][0] : stop], fresh), None]
                fresh = said[0] == "copyright"
            held = text[pieces[first][0] : stop]
            lead = len(held) - len(held.lstrip())
            bullet = re.match(rf"[^\w{_BULLET}]*{_BULLET}+\s*", held)
            yield pieces[first][0] + (bullet.end() if bullet else lead), pieces[first][0] + len(held.rstrip()), *said

    def sentences(self, text):
        """Runs of neighbouring sentences of concern: lists of (start, end, identifier, varying part)."""
        run, text = [], _plain(text)
        for match in _SENTENCE.finditer(text):
            if not match[0].strip():
                continue
            worth = WORTH.search(match[0])
            parts = self._parts(text, *match.span()) if worth else [(*match.span(), self._line(match[0], False) and None, None)]
            for part in parts:
                if part[2] is None:
                    if run:
                        yield run
                        run = []
                elif part[2] not in ("copyright", ""):
                    run.append(part)
        if run:
            yield run

    def _fits(self, run, at):
        """The first rule that fits at a place of a run: (licence, sentences used), or None."""
        for licence, sequence in self.rules:
            k, version = at, None
            for name, optional in sequence:
                if k < len(run) and run[k][2] == name:
                    version = version or run[k][3]
                    k += 1
                elif not optional:
                    break
            else:
                return licence.replace("{}", (version or "").upper().replace(" ", "-")), k - at
        return None

    def __call__(self, text):
        """(licence, start, end, identifiers) of the matches in a text."""
        if not WORTH.search(text):
            return []
        out = []
        for run in self.sentences(text):
            at = 0
            while at < len(run):
                licence, used = self._fits(run, at) or ("unknown", 1)
                own = run[at : at + used]
                out.append((licence, own[0][0], own[-1][1], ",".join(s[2] for s in own)))
                at += used
        return out


MATCH = pa.schema([("doc_id", pa.int64()), ("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.string())])


def scan(docs, id_col="doc_id", text_col="text"):
    """One row per licence found: doc_id, licence, start, end, sentences (their identifiers, comma-joined)."""

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            out = [(i, *m) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for m in scanner(t)]
            if out:
                yield emit(out, MATCH)

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, licence string, start bigint, `end` bigint, sentences string")
