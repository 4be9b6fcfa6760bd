"""License scans by template matching.

A template is plain wording with markup: ``<<beginOptional>> ... <<endOptional>>`` holds words that may be left out,
``<<var;name="...";min="a";max="b">>`` stands for a to b words of any kind, ``<<beginAny>> ... <<or>> ... <<endAny>>``
for one of several wordings. Each template compiles to a token automaton; a place in a text is accepted when the
mandatory words follow each other exactly, with any of the optional regions left out and any words (within the bounds)
in the replaceable ones. Words are those of ``WORD`` after A-Z is
lower-cased, so punctuation, case and line breaks do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from setsift.llm._common import slim

#: On UTF-8 bytes after A-Z is lower-cased: digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MARKUP = re.compile(r"<<(beginOptional|endOptional|beginAny|or|endAny|var)([^>]*)>>")

#: Label and wording of the plain phrases.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Label and template of the notices, own markup.
TEMPLATES = {
    "mit-notice": "<<beginOptional>>this <<var;name=\"what\";min=\"1\";max=\"3\">> is <<endOptional>>released under the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0<<beginOptional>> the license<<endOptional>>",
    "gpl-3.0-notice": "<<beginOptional>>this <<var;name=\"what\";min=\"1\";max=\"3\">> is <<endOptional>>licensed under the gnu general public license version 3<<beginOptional>> or any later version<<endOptional>>",
    "cc-by-4.0-notice": "licensed under <<beginOptional>>a <<endOptional>>cc by 4 0<<beginOptional>> international<<endOptional>>",
    "cc-by-nc-4.0-notice": "licensed under <<beginOptional>>a <<endOptional>>cc by nc 4 0<<beginOptional>> international<<endOptional>>",
    "copyright-notice": "copyright <<beginOptional>>c <<endOptional>><<var;name=\"holder\";min=\"1\";max=\"8\">> all rights reserved",
}


def _maybe(words: str) -> str:
    return f" <<beginOptional>>{words}<<endOptional>> "


def _any(*words: str) -> str:
    return f" <<beginAny>>{'<<or>>'.join(words)}<<endAny>> "


def _var(name: str, least: int, most: int) -> str:
    return f' <<var;name="{name}";min="{least}";max="{most}">> '


def _gnu(short: str, name: str, version: str) -> dict[str, str]:
    """Notice, Free Software Foundation header and opening of the text of one GNU license."""
    v, own, fsf = version.replace(".", " ").removesuffix(" 0"), f"gnu {name} public license", "as published by the free software foundation" + _maybe("inc")
    # a version that begins another one (2 and 2.1) needs a word after it, and no room for the "1" in the date
    begins = (short, version) == ("lgpl", "2.0")
    late = "of the license" if begins else _maybe("of the license")
    header = _any(f"version {v} of the {own} {fsf}", f"{own} {_any(f'version {v}', f'v {v}', f'v{v}')} {_maybe('only')} {fsf}", f"{own} {fsf} {_maybe('either')} version {v} {late}")
    return {
        f"{short}-{version}-notice": f"licensed under {_maybe('the terms of')} {_maybe('the')} {own} {_any(f'version {v}', f'v {v}', f'v{v}')}",
        f"{short}-{version}-header": f"{header} {_maybe('or' + _maybe('at your option') + 'any later version')}",
        f"{short}-{version}-text": f"{own} version {v} {_var('date', 2, 3 - begins)} copyright c {_var('holder', 1, 40)} everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    }


_CC = {
    "by": "attribution",
    "sa": _any("sharealike", "share alike"),
    "nc": _any("noncommercial", "non commercial"),
    "nd": _any("noderivatives", "noderivs", "no derivatives", "no derivs"),
}


def _cc(kind: str, version: str) -> dict[str, str]:
    """Notice and opening of the text of one Creative Commons license."""
    short, v, name = "cc " + kind.replace("-", " "), version.replace(".", " "), "creative commons " + " ".join(_CC[k] for k in kind.split("-"))
    place = _any("international", "unported", "generic")
    notice = f"licensed under {_maybe('the terms of')} {_maybe(_any('a', 'the'))} {_any(short, name)} {_maybe(short)} {_maybe(_any('license', 'licence'))} {_maybe('version')} {v} {_maybe(place)}"
    text = f"{name} {v} {place} public license by exercising the licensed rights" if version == "4.0" else f"creative commons legal code {name.removeprefix('creative commons ')} {v}"
    return {f"cc-{kind}-{version}-notice": notice, f"cc-{kind}-{version}-text": text}


_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    + _var("number", 0, 1)
    + "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    + _var("number", 0, 2)
    + "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_NAME = _var("who", 1, 30) + "be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by" + _var("who", 1, 20) + "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_ISC = "permission to use copy modify and" + _maybe("or") + "distribute this software for any purpose with or without fee is hereby granted"

#: Of the long texts (GNU, Apache, MPL, CC) the opening is the template, of the short ones the whole grant and conditions.
TEXTS = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice" + _maybe("including the next paragraph") + "shall be included in all copies or substantial portions of the software"
    + _maybe(
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
        + _any("noninfringement", "non infringement") + "in no event shall" + _var("who", 1, 20) + "be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "bsd-2-clause-text": f"{_BSD} {_BSD_AS_IS}",
    "bsd-3-clause-text": _BSD + _BSD_NAME + _maybe(_BSD_AS_IS),
    "bsd-4-clause-text": _BSD + _var("number", 0, 1) + "all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by" + _var("who", 1, 30) + _BSD_NAME + _maybe(_BSD_AS_IS),
    "isc-text": _ISC + " provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-text": _ISC + " the software is provided as is",
    "apache-2.0-text": "apache license version 2 0 january 2004" + _any("http", "https") + "www apache org licenses terms and conditions for use reproduction and distribution",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license" + _any("version 2 0", "v 2 0", "v2 0") + _maybe("if a copy of the mpl was not distributed with this file you can obtain one at" + _any("http", "https") + _maybe("www") + "mozilla org mpl 2 0"),
    "mpl-2.0-notice": "licensed under" + _maybe("the terms of") + _maybe("the") + "mozilla public license" + _any("version 2 0", "v 2 0", "v2 0", "2 0"),
    "mpl-2.0-text": "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    "cc0-1.0-notice": "extent possible under law" + _var("who", 1, 20) + _any("has", "have") + "waived all copyright and related or neighboring rights",
    "cc0-1.0-text": "creative commons legal code cc0 1 0 universal",
}
for _short, _name, _version in [("gpl", "general", "2.0"), ("gpl", "general", "3.0"), ("lgpl", _any("lesser general", "library general"), "2.0"), ("lgpl", "lesser general", "2.1"), ("lgpl", "lesser general", "3.0"), ("agpl", "affero general", "3.0")]:
    TEXTS |= _gnu(_short, _name, _version)
del TEXTS["lgpl-2.0-notice"]  # its words begin the notice of version 2.1
for _kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
    for _version in ("2.0", "2.5", "3.0", "4.0"):
        TEXTS |= _cc(_kind, _version)
#: The wording of both stands under one label.
TEMPLATES |= {k: _any(TEMPLATES[k], v) if k in TEMPLATES else v for k, v in TEXTS.items()}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, n_matches long, spans string"
)


class Template:
    """States are numbered places between words; ``steps[s]`` has (word, next), ``skips[s]`` the free moves,
    ``open[s]`` the next state after any one word."""

    def __init__(self, markup: str) -> None:
        self.steps: list[list[tuple[bytes, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.open: list[list[int]] = [[]]
        self.mandatory, depth, begun, ends, at, state = 0, 0, [], [], 0, 0
        for m in [*MARKUP.finditer(markup), None]:
            for word in WORD.findall(markup[at : m.start() if m else None].encode().lower()):
                state = self._add(self.steps[state], word)
                self.mandatory += not depth
            if m is None:
                break
            at = m.end()
            if m[1] == "beginOptional":
                begun.append(state)
                depth += 1
            elif m[1] == "endOptional":
                self.skips[begun.pop()].append(state)
                depth -= 1
            elif m[1] == "beginAny":
                begun.append(state)
                ends.append([])
                depth += 1
            elif m[1] == "or":
                ends[-1].append(state)
                state = begun[-1]
            elif m[1] == "endAny":
                begun.pop()
                last, state = [*ends.pop(), state], self._add([])
                for s in last:
                    self.skips[s].append(state)
                depth -= 1
            else:
                least, most = (int(re.search(rf'{k}="(\d+)"', m[2])[1]) for k in ("min", "max"))
                places = [state]
                for _ in range(most):
                    places.append(self._add(self.open[places[-1]]))
                state = places[-1]
                for k in range(least, most):
                    self.skips[places[k]].append(state)
        if begun:
            raise ValueError("a region is not closed")
        self.end = state
        self.first = {w for s in self._free({0}) for w, _ in self.steps[s]}
        if self.end in self._free({0}) or any(self.open[s] for s in self._free({0})):
            raise ValueError("a template must begin with a word of its own")

    def _add(self, moves: list, word: bytes | None = None) -> int:
        self.steps.append([])
        self.skips.append([])
        self.open.append([])
        n = len(self.steps) - 1
        moves.append(n if word is None else (word, n))
        return n

    def _free(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the longest accepted run of words that begins at ``at``; None if there is none."""
        states, found, i = self._free({0}), None, at
        while states and i < len(words):
            nxt = {n for s in states for w, n in self.steps[s] if w == words[i]} | {n for s in states for n in self.open[s]}
            states, i = self._free(nxt), i + 1
            if self.end in states:
                found = i
        return found


@cache
def automata(items: tuple[tuple[str, str], ...]) -> tuple[dict[str, Template], dict[bytes, list[str]]]:
    made = {label: Template(markup) for label, markup in items}
    by_first: dict[bytes, list[str]] = {}
    for label, t in made.items():
        for w in t.first:
            by_first.setdefault(w, []).append(label)
    return made, by_first


def scan(text: str | None, phrases: dict[str, str], templates: dict[str, str]) -> dict:
    """The matches of one text: base phrases, templates, spans (label, first word, end word)."""
    words = WORD.findall((text or "").encode().lower())
    made, by_first = automata((*phrases.items(), *templates.items()))
    base, own, until = [], [], dict.fromkeys(templates, 0)
    for i, w in enumerate(words):
        if w in by_first:
            for label in by_first[w]:
                end = made[label].match(words, i)
                if end is not None and label in phrases:
                    base.append((label, i, end))
                elif end is not None and i >= until[label]:  # not again inside the last match
                    own.append((label, i, end))
                    until[label] = end
    starts = [i for _, i, _ in base]
    # a whole notice is sure; a phrase alone is a hint, a little surer with each further phrase
    score = 1.0 if own else 1 - 0.5 ** len({label for label, _, _ in base})
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted({x[0] for x in base})), "labels": ",".join(sorted({x[0] for x in base + own})), "score": score,
        "n_matches": len(own), "spans": " ".join(f"{label}:{i}-{end}" for label, i, end in own),
    }


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` (repeated and null ids as well), no shuffle.

    n_words, n_base (places of base phrases, ties and overlaps counted), first_word and last_word (their smallest and
    largest start, null without one), base_labels, labels (base and template labels), score (1 with a whole template,
    1 - 2**-k with k base labels alone), n_matches and spans (``label:first-end`` of the template matches, leftmost first and not
    overlapping those of one label). A null
    or empty text has no words and score 0. Long texts are read whole; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t.as_py(), phrases, templates) | {"doc_id": i} for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    big, text, real = pa.int64(), pa.string(), pa.float64()
    kinds = {"long": big, "string": text, "double": real}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])
    return slim(docs, id_col, text_col).mapInArrow(run, SCHEMA)
